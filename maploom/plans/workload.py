"""A deterministic map of any size, for timing coalescing: domains that share issuers in chains."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coalesce import coalesce
from ..store import cut


def _id(kind: str, n) -> F.Column:
    return F.sha2(F.concat(F.lit(f"{kind}:"), n.cast("string")), 256)


def workload(spark: SparkSession, domains: int, certs_each: int = 2, issuers: int = 100, depth: int = 3, policies_every: int = 10) -> dict[str, DataFrame]:
    """``dirty, domain_certs, certs, domain_policies, policies``, saved.

    Each domain has ``certs_each`` leaves; a leaf's issuer is one of ``issuers`` at
    the bottom of ``depth`` levels, each with a tenth of the level below.
    """
    d = spark.range(domains)
    leaves = d.select("id", F.explode(F.sequence(F.lit(0), F.lit(certs_each - 1))).alias("k")).withColumn("n", F.col("id") * certs_each + F.col("k"))
    size = [max(1, issuers // 10**level) for level in range(depth)]
    nodes = leaves.select(_id("leaf", F.col("n")).alias("id"), _id("ca0", F.col("n") % size[0]).alias("parent"))
    for level, n in enumerate(size):
        up = _id(f"ca{level + 1}", F.col("id") % size[level + 1]) if level + 1 < depth else F.lit(None).cast("string")
        nodes = nodes.unionByName(spark.range(n).select(_id(f"ca{level}", F.col("id")).alias("c"), up.alias("parent")).withColumnRenamed("c", "id"))
    some = d.where(F.col("id") % policies_every == 0)
    out = {
        "dirty": d.select(_id("domain", F.col("id")).alias("domain_id")),
        "domain_certs": leaves.select(_id("domain", F.col("id")).alias("domain_id"), _id("leaf", F.col("n")).alias("id")),
        "certs": nodes,
        "domain_policies": some.select(_id("domain", F.col("id")).alias("domain_id"), _id("policy", F.col("id")).alias("id")),
        "policies": some.select(_id("policy", F.col("id")).alias("id"), F.lit(None).cast("string").alias("parent")),
    }
    return {name: cut(df, name) for name, df in out.items()}


def timed(spark: SparkSession, domains: int, runs: int = 3, **shape) -> list[dict]:
    """Seconds and domains a second of each run; the first warms up."""
    w, out = workload(spark, domains, **shape), []
    for _ in range(runs):
        began = time.time()
        coalesce(w["dirty"], w["domain_certs"], w["certs"], w["domain_policies"], w["policies"]).write.format("noop").mode("overwrite").save()
        seconds = time.time() - began
        out.append({"seconds": seconds, "domains_per_second": domains / seconds})
    return out


def speedup(old: list[float], new: list[float]) -> dict[str, float]:
    """Medians, quartile ranges and how much faster the new times are, in percent."""

    def quantile(xs: list[float], q: float) -> float:
        xs = sorted(xs)
        at = q * (len(xs) - 1)
        lo = int(at)
        return xs[lo] + (at - lo) * (xs[min(lo + 1, len(xs) - 1)] - xs[lo])

    a, b = quantile(old, 0.5), quantile(new, 0.5)
    return {"old_median": a, "new_median": b, "old_range": quantile(old, 0.75) - quantile(old, 0.25), "new_range": quantile(new, 0.75) - quantile(new, 0.25), "speedup_percent": 100 * (a - b) / a}
