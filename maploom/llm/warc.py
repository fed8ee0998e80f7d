"""WARC archives with an index: write first, then read by coalesced byte ranges.

Archives are ``.warc.gz`` files with one gzip member per record.  Writing gives an
index of file, offset, length, URL and payload digest per record, which is saved
as a table.  Reading starts from the index: the selected records are sorted by
file and offset, and neighbouring byte ranges are fetched by one read.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with
the largest page_id is a response and the others are revisits that refer to it;
smaller payloads are all responses.  A file gets its name from the task's
attempt; only files of attempts that Spark commits are in the index.

URIs are percent-encoded; record ids are name-based UUIDs of the page_id, which is
also a header of its own.

Defined results: a null html is an empty payload; a null url is an empty URI.
Rows that share the largest page_id of a group are all responses, and so are rows
without a page_id if their payload has no other.  Repeated rows keep a record each.
A very long payload is one record.  Other columns, whatever their names, are never
read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, map_arrow, small_batches
from .token_files import file_system

MIN_REVISIT, FILE_BYTES = 1000, 256 << 20
#: Bytes of an archive that one task reads back, and of payloads that it gives out at once.
READ_BYTES, OUT_BYTES = 8 << 20, 4 << 20
#: Namespace of the record ids; characters of a URI that are not percent-encoded ("%" is, so that reading undoes it).
PAGES, URI_SAFE = uuid.uuid5(uuid.NAMESPACE_URL, "pages"), ":/?#[]@!$&'()*+,;=-._~"
INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string, refers_to long"


def plan_records(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, record_type, refers_to``: which record is the response of each payload."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    large = rows.where(F.col("size") >= MIN_REVISIT)
    chosen = large.groupBy("digest").agg(F.max("page_id").alias("chosen"), F.count("*").alias("n")).where("n > 1").drop("n")
    others = large.select("page_id", "digest").join(chosen, "digest").where("page_id < chosen or page_id is null").distinct()
    others = others.select(F.struct("page_id", "digest").alias("k"), "chosen")
    out = rows.withColumn("k", F.struct("page_id", "digest")).join(others, "k", "left")
    return out.select("page_id", "url", "payload", "digest", F.when(F.col("chosen").isNotNull(), "revisit").otherwise("response").alias("record_type"), F.col("chosen").alias("refers_to"))


def record_urn(page_id: int | None) -> str:
    """The record id of a page: a name-based UUID, or a random one for a page without an id."""
    return (uuid.uuid4() if page_id is None else uuid.uuid5(PAGES, str(page_id))).urn


def _record(r: dict) -> bytes:
    """A record as a gzip member."""
    kind, body = r["record_type"], b"" if r["record_type"] == "revisit" else r["payload"]
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_urn(r['page_id'])}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {quote(r['url'], safe=URI_SAFE)}", f"WARC-Payload-Digest: sha1:{r['digest']}"]
    if r["page_id"] is not None:
        lines.append(f"Page-ID: {r['page_id']}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_urn(r['refers_to'])}>", f"Refers-To-Page-ID: {r['refers_to']}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record's gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def write(pages: DataFrame, work: Workspace) -> DataFrame:
    """Write the archives; the saved index, with the folder in ``_archives_at``."""
    base = work.path("archives")
    fs, root = file_system(base)
    fs.create_dir(root)

    def run(batches):
        fs, root = file_system(base)
        context, out, at, n = TaskContext.get(), None, 0, 0
        for batch in batches:
            rows = batch.to_pylist()
            index = []
            for r in rows:
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{n:03d}.warc.gz"
                    # compression=None: the bytes are gzip members already
                    out, at, n = fs.open_output_stream(f"{root}/{name}", compression=None), 0, n + 1
                member = _record(r)
                out.write(member)
                index.append((name, at, len(member)))
                at += len(member)
            yield {"page_id": [r["page_id"] for r in rows], "file": [x[0] for x in index], "offset": [x[1] for x in index], "length": [x[2] for x in index], "url": [r["url"] for r in rows], "payload_digest": [r["digest"] for r in rows], "record_type": [r["record_type"] for r in rows], "refers_to": [r["refers_to"] for r in rows]}
        if out is not None:
            out.close()

    index = work.save(map_arrow(plan_records(pages), run, INDEX), "index")
    index._archives_at = base
    return index


def read(spark: SparkSession, base: str, index: DataFrame, max_gap: int = 1 << 16, max_range: int = 4 << 20) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_digest, payload`` of the index rows, from the archives.

    The digest of a response's payload is checked against its header.
    """

    columns = ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload")

    def run(batches):
        fs, root = file_system(base)
        name = f = None
        for batch in batches:
            rows, k = batch.to_pylist(), 0
            while k < len(rows):
                if rows[k]["file"] != name:
                    name = rows[k]["file"]
                    f = fs.open_input_file(f"{root}/{name}")
                lo, hi, j = rows[k]["offset"], rows[k]["offset"] + rows[k]["length"], k + 1
                while j < len(rows) and rows[j]["file"] == name and 0 <= rows[j]["offset"] - hi <= max_gap and rows[j]["offset"] + rows[j]["length"] - lo <= max_range:
                    hi = rows[j]["offset"] + rows[j]["length"]
                    j += 1
                block = f.read_at(hi - lo, lo)
                out, held = {c: [] for c in columns}, 0
                for r in rows[k:j]:
                    head, payload = parse(block[r["offset"] - lo : r["offset"] - lo + r["length"]])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    refers = head.get("Refers-To-Page-ID")
                    if refers is None and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"damaged record at {r['offset']} of {name}")
                    out["page_id"].append(int(head["Page-ID"]) if "Page-ID" in head else None)
                    out["url"].append(unquote(head["WARC-Target-URI"]))
                    out["record_type"].append(head["WARC-Type"])
                    out["refers_to"].append(int(refers) if refers else None)
                    out["payload_digest"].append(digest)
                    out["payload"].append(None if refers else payload)
                    held += len(payload)
                    if held > OUT_BYTES:  # compressed bytes say little about those of the payloads
                        yield out
                        out, held = {c: [] for c in columns}, 0
                yield out
                k = j

    total = index.agg(F.sum("length")).first()[0] or 0
    rows = index.withColumn("stretch", F.floor(F.col("offset") / (READ_BYTES // 4))).repartition(1 + total // READ_BYTES, "file", "stretch").sortWithinPartitions("file", "offset")
    return map_arrow(rows.select("file", "offset", "length"), run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write, read back and describe: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    small_batches(spark)
    work = Workspace(spark, "warc")
    index = write(pages, work)
    back = read(spark, index._archives_at, index).withColumn("size", F.octet_length("payload").cast("long")).drop("payload")
    back = work.save(back, "back")
    # a revisit has the size of the response that it refers to
    sizes = back.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("size").alias("referred")).dropDuplicates(["refers_to", "payload_digest"])
    wanted = back.where("record_type = 'revisit'").join(sizes, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "payload_digest", "record_type", "refers_to"]
    out = back.where("record_type = 'response'").select(*columns, F.col("size").alias("payload_bytes"))
    return out.unionByName(wanted.select(*columns, F.col("referred").alias("payload_bytes"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
