"""Tables as CSV with base64 fields, for exchange with other stores; configuration and documents as JSON."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains

# The columns of each file in their order; ids and payloads are base64 of the bytes.
COLUMNS = {
    "certs": ["cert_id", "parent_id", "expiration", "payload"],
    "domains": ["domain_id", "domain_name"],
    "domain_certs": ["domain_id", "cert_id"],
    "dirty": ["domain_id"],
}
_TIME = "yyyy-MM-dd HH:mm:ss"


def to_csv(rows: DataFrame, table: str, path: str) -> None:
    """Write the columns of a table; a missing parent is an empty field."""
    out = [F.coalesce(F.base64(F.unhex(c)), F.lit("")).alias(c) if c.endswith("_id") else F.date_format(c, _TIME).alias(c) if c == "expiration" else F.col(c) for c in COLUMNS[table]]
    rows.select(*out).write.csv(path, emptyValue="")


def from_csv(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The rows of such files, ids in hex; an empty parent is null."""
    rows = spark.read.schema(", ".join(f"{c} string" for c in COLUMNS[table])).csv(path)
    ids = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.lower(F.hex(F.unbase64(c)))).alias(c)
    return rows.select(*[ids(c) if c.endswith("_id") else F.to_timestamp(c, _TIME).alias(c) if c == "expiration" else F.col(c) for c in COLUMNS[table]])


def write_json(path: str, value) -> None:
    """One JSON document, written beside its place and renamed."""
    at, beside = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(at, "w") as f:
        json.dump(value, f, indent=2)
    os.replace(beside, path)


def policies_of(names: DataFrame) -> DataFrame:
    """``policy_id, domain, raw, expiration``: a policy document without attributes for each valid name of ``names(name)``."""
    rows = names.where(domains.is_valid(F.col("name"))).select("name").distinct()
    raw = F.concat(F.lit('{"T":"*pc","O":{"Domain":"'), F.col("name"), F.lit('"}}'))
    return rows.select(F.sha2(raw, 256).alias("policy_id"), F.col("name").alias("domain"), raw.alias("raw"), F.lit("3000-01-01").cast("timestamp").alias("expiration"))
