"""Tables as Parquet folders with upserts, in a folder that all executors share.

A table is a list of folders.  First-writer-wins tables only ever get new keys, so a
write appends a folder.  Last-writer-wins tables append rows with the number of the
write, and a read takes the newest row of each key.  After ``MOST_PARTS`` folders a
table is compacted into one.  A commit writes a manifest with the next number, which
only one writer can create; readers take the newest.  Folders that no kept manifest
names are deleted by :meth:`Store.expire`.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables, their columns and keys.
SCHEMAS = {
    "domains": ("domain_id string, domain_name string", ["domain_id"]),
    "certs": ("cert_id string, parent_id string, expiration timestamp, payload string", ["cert_id"]),
    "domain_certs": ("domain_id string, cert_id string", ["domain_id", "cert_id"]),
    "policies": ("policy_id string, parent_id string, expiration timestamp, payload string", ["policy_id"]),
    "domain_policies": ("domain_id string, policy_id string", ["domain_id", "policy_id"]),
    "domain_payloads": ("domain_id string, cert_ids string, cert_ids_id string, policy_ids string, policy_ids_id string", ["domain_id"]),
    "dirty": ("domain_id string, coalesced boolean", ["domain_id"]),
    "ctlog_state": ("url_hash string, size long, sth string", ["url_hash"]),
    "leaves": ("key string, value string", ["key"]),
    "nodes": ("prefix string, n long, hash string, key string, value string", ["prefix"]),
}
MOST_PARTS, PAST_ROOTS = 8, 300
_TURN = "_turn"  # number of the write that a row is from


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset (one machine), a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="maploom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/maploom/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_per_key(new: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with an equal key the least by the other columns, so that every run picks the same."""
    others = [c for c in new.columns if c not in keys]
    if not others:
        return new.distinct()
    return new.groupBy(*keys).agg(F.min(F.struct(*others)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def upsert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """First writer wins: rows of ``new`` whose key is not in ``old``, one for each key, are added."""
    fresh = one_per_key(new, keys).join(old, keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with an equal key the one with the greatest ``order``, ties by the other columns; without ``order``."""
    others = [c for c in rows.columns if c not in keys and c != order]
    got = rows.groupBy(*keys).agg(F.max(F.struct(F.col(order), *[F.col(c) for c in others])).alias("r"))
    return got.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def upsert_replace(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Last writer wins: rows of ``old`` whose key is in ``new`` go; of equal keys in ``new`` the greatest ``order`` stays, or the least row."""
    new = newest(new, keys, order) if order else one_per_key(new, keys)
    return old.join(new, keys, "left_anti").unionByName(new.select(*old.columns))


class Store:
    """Versioned tables under a path; see the module's text."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._at("")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(""))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d{10})\.json", n)))

    def _load(self, number: int) -> dict:
        stream = self._fs.open(self._at(f"manifest-{number:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The newest state; an unfinished manifest (its writer died) is passed over."""
        for number in reversed(self._numbers()):
            try:
                return self._load(number) | {"number": number}
            except ValueError:
                continue
        return {"tables": {}, "turn": 0, "root": None, "past_roots": [], "number": 0}

    def commit(self, **change) -> None:
        """Write the next manifest; fails if another writer was first."""
        state = self.manifest()
        number = max([0, *self._numbers()]) + 1
        state |= change | {"tables": state["tables"] | change.get("tables", {})}
        state.pop("number")
        out = self._fs.create(self._at(f"manifest-{number:010d}.json"), False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    def expire(self, keep: int = 2) -> int:
        """Delete all but the newest manifests and the folders that none of these names; how many folders went."""
        numbers = self._numbers()
        used = set()
        for n in numbers[-keep:]:
            try:
                used |= {p for parts in self._load(n)["tables"].values() for p in parts}
            except ValueError:
                continue
        gone = 0
        for table in SCHEMAS:
            if self._fs.exists(self._at(table)):
                for x in self._fs.listStatus(self._at(table)):
                    if f"{self.path}/{table}/{x.getPath().getName()}" not in used:
                        self._fs.delete(x.getPath(), True)
                        gone += 1
        for n in numbers[:-keep]:
            self._fs.delete(self._at(f"manifest-{n:010d}.json"), False)
        return gone

    def _rows(self, table: str) -> DataFrame:
        parts, schema = self.manifest()["tables"].get(table), f"{SCHEMAS[table][0]}, {_TURN} long"
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def read(self, table: str) -> DataFrame:
        """The table's rows; of last-writer-wins tables the newest of each key."""
        rows, parts = self._rows(table), self.manifest()["tables"].get(table, [])
        if len(parts) > 1 and f"{self.path}/{table}/r-" in parts[-1]:
            return newest(rows, SCHEMAS[table][1], _TURN)
        return rows.drop(_TURN)

    def _save(self, table: str, df: DataFrame, kind: str, before: list[str]) -> None:
        turn = self.manifest()["turn"] + 1
        at = f"{self.path}/{table}/{kind}-{uuid.uuid4().hex}"
        names = [c.split()[0] for c in SCHEMAS[table][0].split(", ")]
        df.select(*names, F.lit(turn).cast("long").alias(_TURN)).write.parquet(at)
        self.commit(tables={table: [*before, at]}, turn=turn)

    def write(self, table: str, df: DataFrame) -> None:
        """The whole new content of a table."""
        self._save(table, df, "w", [])

    def _append(self, table: str, df: DataFrame, kind: str) -> None:
        before = self.manifest()["tables"].get(table, [])
        self._save(table, df, kind, before)
        if len(before) >= MOST_PARTS:
            self.write(table, self.read(table))

    def ignore(self, table: str, new: DataFrame) -> None:
        """First writer wins; only the new keys are written."""
        keys = SCHEMAS[table][1]
        names = [c.split()[0] for c in SCHEMAS[table][0].split(", ")]
        fresh = one_per_key(new.select(*names), keys).join(self._rows(table).select(*keys), keys, "left_anti")
        self._append(table, fresh, "i")

    def replace(self, table: str, new: DataFrame, order: str | None = None) -> None:
        """Last writer wins; of equal keys in ``new`` the greatest ``order`` stays, or the least row."""
        keys = SCHEMAS[table][1]
        self._append(table, newest(new, keys, order) if order else one_per_key(new, keys), "r")

    def delete(self, table: str, keys: DataFrame) -> None:
        """Remove the rows with these keys: a rewrite of the table."""
        names = SCHEMAS[table][1]
        self.write(table, self.read(table).join(keys.select(*[c for c in names if c in keys.columns]), [c for c in names if c in keys.columns], "left_anti"))

    def truncate(self, *tables: str) -> None:
        """Empty the named tables, or all of them and the root."""
        self.commit(tables=dict.fromkeys(tables or SCHEMAS, []), **({} if tables else {"root": None, "past_roots": []}))

    def save_root(self, root: str | None) -> None:
        """Keeps up to PAST_ROOTS past roots, newest first."""
        state = self.manifest()
        self.commit(root=root, past_roots=([state["root"], *state["past_roots"]] if state["root"] else state["past_roots"])[:PAST_ROOTS])

    def load_root(self) -> str | None:
        return self.manifest()["root"]

    def log_state(self, url: str) -> tuple[int, str | None]:
        """Last size and tree head of a log; (0, null) if it is unknown."""
        r = self.read("ctlog_state").where(F.col("url_hash") == F.sha2(F.lit(url), 256)).first()
        return (r["size"], r["sth"]) if r else (0, None)

    def save_log_state(self, url: str, size: int, sth: str | None = None) -> None:
        row = self.spark.createDataFrame([(url, size, sth)], "url string, size long, sth string")
        self.replace("ctlog_state", row.select(F.sha2("url", 256).alias("url_hash"), "size", "sth"))

    def tree_node(self, prefix: str) -> dict | None:
        """A saved trie node, null if there is none."""
        r = self.read("nodes").where(F.col("prefix") == prefix).first()
        return r.asDict() if r else None
