"""Incremental updates from an append-only log, with Structured Streaming."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import merge
from ..store import Store


def bundles_stream(spark: SparkSession, folder: str, schema: str, max_files: int = 1) -> DataFrame:
    """New Parquet bundles of a folder, a few files in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def run(stream: DataFrame, store: Store, checkpoint: str):
    """Feed ``cert_id, parent_id, expiration, payload, domain_id, domain_name`` rows into the store until none is left.

    Writes are upserts, so a batch that is run again after a failure changes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        store.ignore("certs", batch.select("cert_id", "parent_id", "expiration", "payload"))
        named = batch.where("domain_id is not null")
        store.ignore("domains", named.select("domain_id", "domain_name"))
        store.ignore("domain_certs", named.select("domain_id", "cert_id"))
        store.replace("dirty", named.select("domain_id", F.lit(False).alias("coalesced")))
        batch.unpersist()

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def follow_logs(spark: SparkSession, store: Store, urls: list[str], checkpoint: str, now: int, mode: str = "FAILFAST", **options) -> dict[str, int]:
    """Read each log up to its tree size into the store; the sizes.

    A stream for each log, with a checkpoint of its own; a log's state is saved once
    all entries up to its size are in the store.
    """
    from ..sources.ctlog import Log, LogSource
    from .ingest import add_certificates, decoded_ders

    spark.dataSource.register(LogSource)
    sizes = {}
    for url in urls:
        head = Log(url).head()
        name = hashlib.sha256(url.encode()).hexdigest()[:16]

        def apply(batch: DataFrame, _: int) -> None:
            add_certificates(store, decoded_ders(batch.select(F.concat(F.array("cert"), F.col("chain")).alias("ders")), now, mode)[0])

        query = spark.readStream.format("ctlog").options(url=url, **options).load().writeStream.foreachBatch(apply).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
        query.awaitTermination()
        store.save_log_state(url, head["tree_size"], head["tree_head_signature"])
        sizes[url] = head["tree_size"]
    return sizes


def log_states(events: DataFrame) -> DataFrame:
    """``log, size``: what is covered from index 0 without a gap, of ``events(log, start, end)``."""
    return merge(events, "log").where("start = 0").select("log", (F.col("end") + 1).alias("size"))
