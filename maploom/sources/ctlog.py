"""A certificate log as a data source: batch reads of index ranges, and a stream whose offset is the tree size.

``spark.dataSource.register(LogSource)``, then ``spark.read.format("ctlog")`` or
``spark.readStream.format("ctlog")`` with the options ``url`` (of the log; a folder's
``file://`` URL holds answers as files), ``start``, ``end`` (inclusive), ``batch``
(entries of one request) and ``part`` (entries of one task).  Rows are ``index,
timestamp, cert, chain`` with the DER of the certificate and of its chain.
"""

from __future__ import annotations

import base64
import json
import re
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "index long, timestamp long, cert binary, chain array<binary>"
BATCH, PART = 128, 128 * 128
_BASE64 = re.compile(r"([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{4}|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{2}==)")


class Log:
    """Requests to a log (RFC 6962)."""

    def __init__(self, url: str, timeout: float = 10.0):
        self.url, self.timeout = url.rstrip("/"), timeout

    def _get(self, call: str, **args) -> dict:
        query = "&".join(f"{k}={v}" for k, v in args.items())
        if self.url.startswith("file:"):
            name = "-".join([call, *map(str, args.values())])
            at = f"{self.url}/{name}.json"
        else:
            at = f"{self.url}/ct/v1/{call}" + (f"?{query}" if query else "")
        request = urllib.request.Request(at, headers={"User-Agent": "maploom"}) if not at.startswith("file:") else at
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def head(self) -> dict:
        """The signed tree head; an error if it is none."""
        out = self._get("get-sth")
        if not is_tree_head(out):
            raise ValueError(f"not a tree head: {out}")
        return out

    def entries(self, start: int, end: int, batch: int = BATCH):
        """(index, entry) from ``start`` to ``end``, both included; short answers are asked on."""
        at = start
        while at <= end:
            got = self._get("get-entries", start=at, end=min(end, at + batch - 1))["entries"]
            if not got:
                raise ValueError(f"no entry at {at}")
            for x in got[: end - at + 1]:
                yield at, x
                at += 1


def is_tree_head(x) -> bool:
    """The shape of a tree head: numbers and base64 texts."""
    text = lambda k: isinstance(x.get(k), str) and bool(_BASE64.fullmatch(x[k]))
    return isinstance(x, dict) and all(isinstance(x.get(k), int) for k in ("tree_size", "timestamp")) and text("sha256_root_hash") and text("tree_head_signature") and ("log_id" not in x or text("log_id"))


def _sized(data: bytes, at: int) -> tuple[bytes, int]:
    """A byte string with its length in three bytes before it, and where it ends."""
    n = int.from_bytes(data[at : at + 3], "big")
    if at + 3 + n > len(data):
        raise ValueError("truncated entry")
    return data[at + 3 : at + 3 + n], at + 3 + n


def parse_entry(entry: dict) -> tuple[int, bytes, list[bytes]]:
    """Timestamp, certificate and chain of an entry; of a precertificate, the certificate as it was submitted."""
    leaf, extra = base64.b64decode(entry["leaf_input"]), base64.b64decode(entry["extra_data"])
    if leaf[:2] != b"\0\0":
        raise ValueError("unknown leaf")
    stamp, kind = int.from_bytes(leaf[2:10], "big"), int.from_bytes(leaf[10:12], "big")
    at = 0
    if kind == 0:
        cert, _ = _sized(leaf, 12)
    elif kind == 1:
        cert, at = _sized(extra, 0)
    else:
        raise ValueError(f"unknown entry type {kind}")
    whole, _ = _sized(extra, at)
    chain, at = [], 0
    while at < len(whole):
        der, at = _sized(whole, at)
        chain.append(der)
    return stamp, cert, chain


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Reads:
    def __init__(self, options):
        self.url, self.batch, self.part = options["url"], int(options.get("batch", BATCH)), int(options.get("part", PART))
        self.first, self.last = int(options.get("start", 0)), options.get("end")

    def ranges(self, start: int, end: int) -> list[Range]:
        """From ``start`` up to, not including, ``end``."""
        return [Range(k, min(end, k + self.part) - 1) for k in range(start, end, self.part)]

    def read(self, partition: Range):
        for index, entry in Log(self.url).entries(partition.start, partition.end, self.batch):
            yield (index, *parse_entry(entry))


class LogReader(_Reads, DataSourceReader):
    def partitions(self):
        end = int(self.last) + 1 if self.last is not None else Log(self.url).head()["tree_size"]
        return self.ranges(self.first, end) or [Range(0, -1)]


class LogStream(_Reads, DataSourceStreamReader):
    def initialOffset(self):
        return {"size": self.first}

    def latestOffset(self):
        return {"size": max(self.first, Log(self.url).head()["tree_size"])}

    def partitions(self, start, end):
        return self.ranges(start["size"], end["size"]) or [Range(0, -1)]

    def commit(self, end):
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls):
        return "ctlog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LogReader(self.options)

    def streamReader(self, schema):
        return LogStream(self.options)
