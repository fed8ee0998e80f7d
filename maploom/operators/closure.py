"""Ancestor and descendant closures over parent links, semi-naive and set-based."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import cut


def ancestors(nodes: DataFrame, start: DataFrame, limit: int | None = None) -> DataFrame:
    """``id, ancestor`` for every id of ``start(id)`` that is a node; each is its own ancestor.

    ``nodes(id, parent)`` has at most one parent for each id.  Only new pairs are
    extended; cycles end, as pairs are a set.  Each round is cut from its lineage.
    A chain of any length ends; ``limit`` bounds the rounds if it is given.
    """
    links = nodes.where("parent is not null and parent <> ''").select(F.col("id").alias("ancestor"), F.col("parent").alias("next"))
    links = cut(links.join(nodes.select(F.col("id").alias("next")), "next", "left_semi"), "links")  # parents that are nodes
    new = cut(start.select("id").distinct().join(nodes.select("id"), "id", "left_semi").select("id", F.col("id").alias("ancestor")), "anc")
    all_, rounds = new, 0
    while limit is None or rounds < limit:
        step = new.join(links, "ancestor").select("id", F.col("next").alias("ancestor")).distinct()
        new, rounds = cut(step.join(all_, ["id", "ancestor"], "left_anti"), "anc"), rounds + 1
        if new.isEmpty():
            return all_
        all_ = all_.unionByName(new)
    raise RuntimeError("the parent chains are too long")


def descendants(nodes: DataFrame, seed: DataFrame, limit: int | None = None) -> DataFrame:
    """``id`` of the seed and of everything below it in ``nodes(id, parent)``."""
    new = cut(seed.select("id").distinct(), "desc")
    links = cut(nodes.where("parent is not null and parent <> ''").select("id", "parent"), "links")
    all_, rounds = new, 0
    while limit is None or rounds < limit:
        step = links.join(new.select(F.col("id").alias("parent")), "parent", "left_semi").select("id").distinct()
        new, rounds = cut(step.join(all_, "id", "left_anti"), "desc"), rounds + 1
        if new.isEmpty():
            return all_
        all_ = all_.unionByName(new)
    raise RuntimeError("the parent chains are too long")


def issuer_ancestors(nodes: DataFrame) -> DataFrame:
    """``id, ancestor`` of every node that is some node's parent.

    All ancestors are parents themselves, so the rounds run over the parents alone,
    which are few beside the leaves.
    """
    parents = nodes.where("parent is not null and parent <> ''").select(F.col("parent").alias("id")).distinct()
    inner = cut(nodes.select("id", "parent").join(parents, "id", "left_semi"), "issuers")
    return ancestors(inner, inner)


def domain_members(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``domain_id, id``: linked nodes and their ancestors, perhaps repeated.

    Ancestors are found once for each distinct issuer, not for each domain.
    """
    own = links.join(nodes.select("id", "parent"), "id").select("domain_id", "id", "parent")
    memo = issuer_ancestors(nodes).groupBy("id").agg(F.collect_set("ancestor").alias("above"))
    rows = own.join(memo.withColumnRenamed("id", "parent"), "parent", "left")
    return rows.select("domain_id", F.explode(F.concat(F.array("id"), F.coalesce("above", F.array().cast("array<string>")))).alias("id"))
