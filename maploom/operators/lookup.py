"""Batch lookups: presence, entries, payloads in order, dirty bundles, orphans, unfolding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import shard
from .closure import ancestors


def presence(ids: DataFrame, table: DataFrame) -> DataFrame:
    """``pos, id, present`` for ``ids(pos, id)``."""
    known = table.select("id").distinct().withColumn("there", F.lit(True))
    return ids.join(known, "id", "left").select("pos", "id", F.coalesce("there", F.lit(False)).alias("present"))


def presence_bits(found: DataFrame) -> DataFrame:
    """One row of bits, in order of ``pos``."""
    return found.agg(F.expr("listagg(cast(cast(present as int) as string), '') WITHIN GROUP (ORDER BY pos)").alias("bits"))


def payloads_in_order(ids: DataFrame, *tables: DataFrame) -> DataFrame:
    """``pos, id, payload`` for ``ids(pos, id)``; null where no table has it; tables are united as sets."""
    both = tables[0].select("id", "payload")
    for t in tables[1:]:
        both = both.union(t.select("id", "payload"))
    return ids.join(both.distinct(), "id", "left").select("pos", "id", "payload")


def entries(ids: DataFrame, payloads: DataFrame) -> DataFrame:
    """The payload rows of the asked domains; missing ones are left out."""
    return payloads.join(ids.select("domain_id").distinct(), "domain_id", "left_semi")


def open_chunk(dirty: DataFrame, size: int) -> DataFrame:
    """The first ``size`` domains of each shard that are not coalesced yet, by id."""
    w = Window.partitionBy("shard").orderBy("domain_id")
    rows = dirty.where("not coalesced").select("domain_id", shard(F.col("domain_id")).alias("shard"))
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= size)


def dirty_bundle(dirty: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every dirty domain with its payload, null where it has none (that deletes its leaf)."""
    return dirty.select("domain_id").join(payloads, "domain_id", "left")


def orphans(domains: DataFrame, payloads: DataFrame, dirty: DataFrame) -> DataFrame:
    """Dirty domains without a payload."""
    return domains.join(dirty.select("domain_id"), "domain_id", "left_semi").join(payloads.select("domain_id"), "domain_id", "left_anti")


def unfold(chains: DataFrame) -> DataFrame:
    """``cert_id, parent_id, level, name`` of ``chains(leaf, names, chain)``, ids without repeats.

    The leaf has its names and the first chain certificate as parent; the others
    follow without names.
    """
    ids = F.concat(F.array("leaf"), F.col("chain"))
    rows = chains.select("names", ids.alias("ids"), F.posexplode(ids).alias("level", "cert_id"))
    rows = rows.select("cert_id", F.try_element_at("ids", F.col("level") + 2).alias("parent_id"), "level", F.when(F.col("level") == 0, F.col("names")).alias("names"))
    return rows.groupBy("cert_id").agg(F.max("parent_id").alias("parent_id"), F.min("level").alias("level"), F.max("names").alias("names"))


def subject_name(common_name: Column, names: Column) -> Column:
    """The common name, else the first other name that is not empty, else an empty text."""
    return F.coalesce(F.when(common_name != "", common_name), F.try_element_at(F.filter(names, lambda x: x != ""), F.lit(1)), F.lit(""))


def chains(certs: DataFrame, leaves: DataFrame) -> DataFrame:
    """``cert_id, ancestor``: each leaf and the certificates above it, by issuer and subject, up to one that issued itself.

    ``certs(cert_id, subject, issuer)``; of several certificates of a subject the
    least id is taken.
    """
    by_name = certs.groupBy("subject").agg(F.min("cert_id").alias("parent"))
    links = certs.join(by_name.withColumnRenamed("subject", "issuer"), "issuer", "left")
    nodes = links.select(F.col("cert_id").alias("id"), F.when(F.col("issuer") != F.col("subject"), F.col("parent")).alias("parent"))
    return ancestors(nodes, leaves.select(F.col("cert_id").alias("id"))).select(F.col("id").alias("cert_id"), "ancestor")


def count_windows(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Batches of ``size`` rows per key in order; the last may be short."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size))
