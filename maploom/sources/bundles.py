"""Log bundles: ``A-B.gz`` and ``A-B.csv`` files of certificates with chains."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = r"(\d+)-(\d+)\.(?:gz|csv)$"


def file_interval(path: Column) -> tuple[Column, Column]:
    """First and last index in a bundle's file name; an error if they are out of order."""
    first, last = (F.regexp_extract(path, r"(?:^|/)" + _NAME, k).cast("long") for k in (1, 2))
    return first, F.when(first > last, F.raise_error(F.concat(F.lit("indices out of order: "), path))).otherwise(last)


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """``path, start, end, rows`` of the bundles under a folder, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*-*.{gz,csv}").load(folder).select("path")
    files = files.where(F.col("path").rlike(r"/" + _NAME))
    first, last = file_interval(F.col("path"))
    return files.select("path", first.alias("start"), last.alias("end")).withColumn("rows", F.col("end") - F.col("start") + 1).orderBy("start")


def split_lines(lines: DataFrame) -> DataFrame:
    """``value, disposition, cert, chain, expiration`` of ``lines(value)``.

    ``ok``: fields 4 and 5 and the last, which is unix seconds with a fraction;
    ``fallback``: quotes or another expiration; ``error``: an empty line, too few
    fields, no certificate.
    """
    f = F.split("value", ",", -1)
    cert, chain, exp = F.try_element_at(f, F.lit(4)), F.try_element_at(f, F.lit(5)), F.try_element_at(f, F.lit(-1))
    kind = F.when(F.col("value") == "", "error").when(F.contains("value", F.lit('"')), "fallback").when((F.size(f) < 5) | (cert == ""), "error").when(~exp.rlike(r"^\d+\.\d+$"), "fallback").otherwise("ok")
    rows = lines.select("value", kind.alias("disposition"), cert.alias("cert"), chain.alias("chain"), exp.alias("expiration"))
    ok = F.col("disposition") == "ok"
    return rows.select("value", "disposition", *[F.when(ok, F.col(c)).alias(c) for c in ("cert", "chain", "expiration")])


def parse_quoted(rows: DataFrame) -> DataFrame:
    """The fallback lines by a full CSV parser; null fields where that fails too."""
    import pyarrow as pa

    def run(batches):
        import csv

        for b in batches:
            out = {"value": [], "cert": [], "chain": [], "expiration": []}
            for v in b.column("value").to_pylist():
                try:
                    f = next(csv.reader([v], strict=True))
                except (csv.Error, StopIteration):
                    f = []
                good = len(f) > 4 and f[-1] != ""
                for name, x in zip(out, (v, *((f[3], f[4], f[-1]) if good else (None,) * 3)), strict=True):
                    out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.string()) for k in out]))

    return rows.where("disposition = 'fallback'").select("value").mapInArrow(run, "value string, cert string, chain string, expiration string")


FAILFAST, PERMISSIVE = "FAILFAST", "PERMISSIVE"


def bundle_rows(spark: SparkSession, paths: list[str] | str, skip_missing: bool = False) -> DataFrame:
    """``value, cert, chain, expiration, error`` of every line; ``error`` says what is wrong with a bad one.

    ``chain`` has the parts of the chain field, an empty field one empty part, which
    no certificate can be decoded from.  ``expiration`` is the whole seconds before
    its one full stop.  Truncated archives fail the job, and so do missing files
    unless ``skip_missing``, before or while they are read.
    """
    paths = [paths] if isinstance(paths, str) else paths
    if skip_missing:
        paths = existing(spark, paths)
        if not paths:
            return spark.createDataFrame([], "value string, cert string, chain array<string>, expiration long, error string")
    lines = spark.read.option("ignoreMissingFiles", str(skip_missing).lower()).option("ignoreCorruptFiles", "false").text(paths)
    rows = split_lines(lines)
    good = rows.where("disposition <> 'fallback'").select("value", "cert", "chain", "expiration", F.when(F.col("disposition") == "error", "not a bundle line").alias("error"))
    slow = parse_quoted(rows).select("value", "cert", "chain", "expiration", F.when(F.col("cert").isNull(), "not a bundle line").alias("error"))
    both = good.unionByName(slow)
    parts = F.split("expiration", r"\.", -1)
    seconds = F.when(F.size(parts) == 2, F.element_at(parts, 1).try_cast("long"))
    error = F.coalesce("error", F.when(seconds.isNull(), "no expiration"))
    return both.select("value", "cert", F.split("chain", ";", -1).alias("chain"), seconds.alias("expiration"), error.alias("error"))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that are there (globs are left as they are)."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if "*" in p or path(p).getFileSystem(conf).exists(path(p))]


def checked(rows: DataFrame, mode: str) -> DataFrame:
    """Rows without ``error``; with FAILFAST a bad one fails the job."""
    if mode not in (FAILFAST, PERMISSIVE):
        raise ValueError(f"mode {mode}")
    if mode == FAILFAST:
        rows = rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("error"), F.lit(": "), F.substring("value", 1, 200)))))
    return rows.where("error is null").drop("error")


def read_bundles(spark: SparkSession, paths: list[str] | str, now: int, skip_missing: bool = False, mode: str = FAILFAST) -> DataFrame:
    """``cert, chain, expiration`` (seconds) of rows that have not expired at ``now``.

    FAILFAST: a bad line fails the job; PERMISSIVE: it is left out (:func:`bundle_rows` shows it).
    """
    return checked(bundle_rows(spark, paths, skip_missing), mode).select("cert", "chain", "expiration").where(F.col("expiration") >= now)


def sorted_bundles(paths: list[str]) -> list[str]:
    """By first index, then last."""
    return sorted(paths, key=lambda p: tuple(map(int, re.search(_NAME, p).groups())))


def plan_files(files: list[tuple[int, int, str]], last: int, max_rows: int | None = None) -> tuple[int, list[str]]:
    """(size, paths) that can be read on from index ``last``, of ``(start, end, path)``.

    The files chain without a gap; an error if two begin alike.  At most ``max_rows``
    rows, but always one file if there is any.
    """
    by_start: dict[int, tuple[int, str]] = {}
    for start, end, path in files:
        if start in by_start:
            raise ValueError(f"two files begin at {start}")
        by_start[start] = end, path
    at, paths = last, []
    while at in by_start and (not paths or max_rows is None or by_start[at][0] + 1 - last <= max_rows):
        end, path = by_start[at]
        paths.append(path)
        at = end + 1
    return at, paths


def policies_json(spark: SparkSession, path: str) -> DataFrame:
    """``policy_id, tag, domain, raw`` of tagged JSON documents, one per file; ids hash the raw bytes."""
    raw = spark.read.text(path, wholetext=True)
    return tagged(raw.select(F.col("value").alias("raw")))


def tagged(raw: DataFrame) -> DataFrame:
    """``policy_id, tag, is_pointer, domain, raw`` of ``raw(raw)``."""
    tag = F.get_json_object("raw", "$.T")
    return raw.select(F.sha2("raw", 256).alias("policy_id"), F.regexp_replace(tag, r"^\*", "").alias("tag"), F.startswith(tag, F.lit("*")).alias("is_pointer"), F.get_json_object("raw", "$.O.Domain").alias("domain"), "raw")
