"""Shared folders, saved tables, bounded key sets and connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows in one Arrow batch; bounds the memory of a Python worker.
ARROW_BYTES = "6m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Read from ``spark.checkpoint.dir``; only where that is unset (tests on one
    machine) a folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="maploom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Workspace:
    """A folder of its own in the shared folder, for one call of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/maploom/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:02d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back: cuts lineage, survives lost executors."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._saved_at = path
        return out

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """Save ``df`` bucketed and sorted by ``key``: a join with an equal number of partitions reads it without a shuffle."""
        path, table = self.path(name), f"maploom_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
        out = self.spark.table(table)
        out._saved_at, out._table = path, table
        return out

    def clear(self) -> None:
        """Delete the whole folder: for results that read nothing of it any more."""
        delete(self.spark, self.base)

    def drop(self, *saved: DataFrame) -> None:
        """Delete saved tables that are no longer read, and let Spark clean old shuffles."""
        for df in saved:
            if hasattr(df, "_table"):
                self.spark.sql(f"DROP TABLE IF EXISTS {df._table}")
            delete(self.spark, df._saved_at)
        release(self.spark)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Shuffle files of finished plans go once their Java objects are collected."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings while a plan is run; names have ``__`` for ``.``."""
    conf = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_batches(spark: SparkSession, size: str = ARROW_BYTES) -> None:
    """Bound Arrow batches by bytes, so that very long texts fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")


def docs_of(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: others, with whatever names, never matter."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<short>": pa.list_(pa.int16()), "array<int>": pa.list_(pa.int32()), "short": pa.int16(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[t]) for n, t in (x.strip().split(" ", 1) for x in ddl.split(","))])


_MADE: dict = {}


def kept(key, make: Callable):
    """``make()``, kept in the Python worker for later tasks with the same key; one at a time."""
    if key not in _MADE:
        _MADE.clear()
        trim()  # what earlier tasks of other operators have left, too
        _MADE[key] = make()
    return _MADE[key]


def forget() -> None:
    """Drop what :func:`kept` holds in this Python worker and give the memory back to the system."""
    if _MADE:
        _MADE.clear()
        trim()


def trim() -> None:
    """Give free memory of this Python worker back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn, ddl: str, keeps: bool = False) -> DataFrame:
    """mapInArrow for a generator of dicts of columns or record batches.

    Workers are used again by other operators' tasks; only a function that ``keeps``
    something leaves it there.
    """

    def run(batches):
        schema = arrow_schema(ddl)
        if not keeps:
            forget()
        with np.errstate(over="ignore"):
            for out in fn(batches):
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out, schema=schema)

    return df.mapInArrow(run, ddl)


def lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


class Bloom:
    """A bitmap of hashed keys with a fixed size: never misses a key, may pass others.

    It only saves work before an exact join; its size is set by ``log2_bits``
    and does not depend on the number of keys.
    """

    def __init__(self, words: np.ndarray, log2_bits: int):
        self.words, self.log2 = words, log2_bits

    @staticmethod
    def slot(key: Column, log2_bits: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(key), 64 - log2_bits)

    @classmethod
    def of(cls, df: DataFrame, key: str, log2_bits: int = 23) -> Bloom:
        """Bits are set by the top bits of the key itself, which must be a 64-bit hash."""
        slot = F.shiftrightunsigned(F.col(key), 64 - log2_bits)
        rows = df.select((F.shiftright(slot, 5)).alias("w"), (slot % 32).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).toPandas()
        words = np.zeros(1 << (log2_bits - 5), np.uint32)
        words[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
        return cls(words, log2_bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.view(np.uint64) >> np.uint64(64 - self.log2)
        return (self.words[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0


def components(work: Workspace, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``id, component`` for every end of ``edges(a, b)``; the smallest reachable id names it.

    Alternating large-star and small-star steps.  Every step is a saved table; only
    the number of edges out of place comes to the driver, and the steps end when
    the edges are stars around the smallest ids.
    """
    now = work.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # stars: no end has both a larger and a smaller neighbour, or two smaller ones
        open_ = Observation()
        seen = F.count_if(((F.col("b") > F.col("a")) & (F.col("m") < F.col("a"))) | ((F.col("b") < F.col("a")) & (F.col("b") > F.col("m")))).alias("n")
        large = both.join(least, "a").observe(open_, seen).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = work.save(large, "large")
        if not open_.get["n"]:
            work.drop(large)
            break
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        before, now = now, work.save(small, "small")
        work.drop(before, large)
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def relabel(work: Workspace, comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp(id, component)`` after one step over new ``links(a, b)``: components that meet in a common one get one name.

    Ids with the same name are always connected; those with different names may be,
    too, until :func:`components` is run.
    """
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    base = work.save(comp.unionByName(ends.join(comp, "id", "left_anti").select("id", F.col("id").alias("component"))), "labels")
    x, y = (base.select(F.col("id").alias(e), F.col("component").alias(n)) for e, n in (("a", "x"), ("b", "y")))
    meet = links.join(x, "a").join(y, "b").select("x", "y").where("x <> y")
    both = work.save(meet.unionByName(meet.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "meet")
    least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("y"), F.least("x", "m").alias("m"))
    named = both.join(least, "y").groupBy("x").agg(F.min("m").alias("m")).select(F.col("x").alias("component"), F.least("x", "m").alias("m"))
    return work.save(base.join(named, "component", "left").select("id", F.coalesce("m", "component").alias("component")), "comp")
