"""Inclusive intervals: merging, what is pending, chains of bundles; apportionment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(rows: DataFrame, key: str) -> DataFrame:
    """``key, start, end`` with overlapping and touching intervals of a key merged."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach + 1), 1).otherwise(0)
    g = rows.select(key, "start", "end").distinct().withColumn("new", new).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(key, "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def pending(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The files whose interval is in no completed one."""
    d = done.select(F.col(key).alias("k"), F.col("start").alias("s"), F.col("end").alias("e"))
    return files.join(d, (F.col(key) == F.col("k")) & (F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end")), "left_anti")


def reachable(files: DataFrame, key: str, first: int, max_rows: int | None = None) -> DataFrame:
    """``key, size``: how far contiguous files reach from ``first``; at least one file beyond ``max_rows``.

    Two files with the same start are an error.
    """
    w = Window.partitionBy(key).orderBy("start")
    rows = files.where(F.col("start") >= first).withColumn("same", F.lag("start").over(w))
    rows = rows.withColumn("same", F.when(F.col("same") == F.col("start"), F.raise_error("two bundles have the same start")).otherwise(F.lit(0)))
    good = F.when(F.col("start") == F.coalesce(F.lag("end").over(w) + 1, F.lit(first)), 0).otherwise(1)
    rows = rows.withColumn("gaps", F.sum(good).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("same")).where("gaps = 0")
    if max_rows is not None:
        rows = rows.where((F.col("end") + 1 - first <= max_rows) | (F.col("start") == first))
    return rows.groupBy(key).agg((F.max("end") + 1).alias("size"))


def fair_split(total: int, active: list[int]) -> dict[int, int]:
    """Shares of a total over the active partitions, the first ones with one more."""
    base, rest = divmod(total, len(active)) if active else (0, 0)
    return {p: base + (k < rest) for k, p in enumerate(active)}


def apportion(weights: DataFrame, total: int) -> DataFrame:
    """``idx, share`` by largest remainders; ties to the smaller index."""
    whole = weights.agg(F.sum("weight").alias("all"))
    x = weights.join(F.broadcast(whole))  # one row
    x = x.withColumn("base", F.floor(F.col("weight") * total / F.col("all"))).withColumn("rest", (F.col("weight") * total) % F.col("all"))
    missing = x.agg((F.lit(total) - F.sum("base")).alias("missing"))
    x = x.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("rest"), "idx"))).join(F.broadcast(missing))
    return x.select("idx", (F.col("base") + (F.col("nth") <= F.col("missing")).cast("int")).cast("long").alias("share"))
