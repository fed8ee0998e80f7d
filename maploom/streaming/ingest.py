"""From log bundles to the store, and from the store's dirty domains to the trie."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import smt
from ..operators.coalesce import coalesce, prune
from ..sources import bundles, x509
from ..store import Store, cut
from .journal import Journal


def decoded(rows: DataFrame, now: int, mode: str = bundles.FAILFAST) -> tuple[DataFrame, DataFrame]:
    """(certificates, bad rows) of ``rows(cert, chain)`` in base64.

    Certificates are ``cert_id, parent_id, level, names, not_after, der``, without
    repeats: the first of a row is its leaf, each other one issued the one before it.
    Each distinct certificate is parsed once.  Rows whose leaf has expired at ``now``
    are left out.  Bad rows, ``ids, error``, hold something that is no certificate;
    with FAILFAST they fail the job.
    """
    ders = F.transform(F.concat(F.array("cert"), F.col("chain")), lambda x: F.try_to_binary(x, F.lit("base64")))
    return decoded_ders(rows.select(ders.alias("ders")), now, mode)


def decoded_ders(rows: DataFrame, now: int, mode: str = bundles.FAILFAST) -> tuple[DataFrame, DataFrame]:
    """:func:`decoded` of ``rows(ders)``: the DER of each certificate of a chain, null for what could not be read."""
    rows = rows.withColumn("ids", F.transform("ders", lambda x: F.when(x.isNotNull(), F.sha2(x, 256))))
    rows = cut(rows.dropDuplicates(["ids"]), "rows")
    blobs = rows.select(F.explode(F.arrays_zip("ids", "ders")).alias("x")).select(F.col("x.ids").alias("id"), F.coalesce("x.ders", F.lit(b"")).alias("der")).dropDuplicates(["id"])
    parsed = x509.decode(blobs.select("der"), strict=mode == bundles.FAILFAST)
    parsed = cut(parsed.withColumn("id", F.sha2("der", 256)), "parsed")
    places = rows.select("ids", F.posexplode("ids").alias("level", "id"))
    known = parsed.where("error is null").select("id")
    bad = cut(places.join(known, "id", "left_anti").groupBy("ids").agg(F.concat(F.lit("no certificate at place "), F.min("level").cast("string")).alias("error")), "bad")
    leaves = places.where("level = 0").join(parsed.where(F.col("not_after") < now).select("id"), "id", "left_semi").select("ids")
    fine = places.join(bad.select("ids").unionByName(leaves).distinct(), "ids", "left_anti")
    fine = fine.select("id", "level", F.try_element_at("ids", F.col("level") + 2).alias("parent_id"))
    one = fine.groupBy("id").agg(F.min("level").alias("level"), F.min("parent_id").alias("parent_id"))
    out = one.join(parsed.drop("error"), "id")
    return out.select(F.col("id").alias("cert_id"), "parent_id", "level", F.when(F.col("level") == 0, F.col("names")).alias("names"), "not_after", "der"), bad


def add_certificates(store: Store, certs: DataFrame) -> dict[str, int]:
    """Write certificates, the domains that they name, the links, and mark these domains dirty; repeating it changes nothing."""
    certs = cut(certs, "certs")
    store.ignore("certs", certs.select("cert_id", "parent_id", F.timestamp_seconds("not_after").alias("expiration"), F.base64("der").alias("payload")))
    named = cut(certs.where("names is not null").select("cert_id", F.explode("names").alias("domain_name")).withColumn("domain_id", F.sha2("domain_name", 256)), "named")
    store.ignore("domains", named.select("domain_id", "domain_name"))
    store.ignore("domain_certs", named.select("domain_id", "cert_id"))
    store.replace("dirty", named.select("domain_id", F.lit(False).alias("coalesced")).distinct())
    return {"certs": certs.count(), "links": named.count(), "dirty": named.select("domain_id").distinct().count()}


def ingest_files(store: Store, paths: list[str], now: int, mode: str = bundles.FAILFAST, skip_missing: bool = False) -> dict[str, float]:
    """Put bundles into the store; what was read, left out and written, and rates."""
    began, spark = time.time(), store.spark
    rows = bundles.bundle_rows(spark, paths, skip_missing)
    rows = cut(rows if mode == bundles.PERMISSIVE else bundles.checked(rows, mode).withColumn("error", F.lit(None).cast("string")), "lines")
    count = rows.agg(F.count("*").alias("rows"), F.count("error").alias("bad_lines"), F.count_if(F.col("error").isNull() & (F.col("expiration") < now)).alias("expired"), F.sum(F.octet_length("value") if mode == bundles.PERMISSIVE else F.octet_length("cert")).alias("bytes")).first().asDict()
    certs, bad = decoded(rows.where(F.col("error").isNull() & (F.col("expiration") >= now)), now, mode)
    written = add_certificates(store, certs)
    seconds = time.time() - began
    return {k: v or 0 for k, v in count.items()} | {"bad_chains": bad.count(), "files": len(paths)} | written | {"seconds": seconds, "rows_per_second": count["rows"] / seconds, "certs_per_second": written["certs"] / seconds}


def add_policies(store: Store, documents: DataFrame) -> None:
    """Write ``documents(policy_id, domain, raw, expiration)``, last writer wins, and mark their domains dirty."""
    rows = cut(documents.withColumn("domain_id", F.sha2("domain", 256)), "policies")
    store.replace("policies", rows.select("policy_id", F.lit(None).cast("string").alias("parent_id"), "expiration", F.base64(F.col("raw").cast("binary")).alias("payload")))
    store.ignore("domain_policies", rows.select("domain_id", "policy_id"))
    store.ignore("domains", rows.select("domain_id", F.col("domain").alias("domain_name")))
    store.replace("dirty", rows.select("domain_id", F.lit(False).alias("coalesced")).distinct())


def coalesce_dirty(store: Store) -> int:
    """Coalesce the open dirty domains into ``domain_payloads``; drop empty payloads and orphan domains; flag them done."""
    dirty = cut(store.read("dirty").where("not coalesced").select("domain_id"), "open")
    n = dirty.count()
    if not n:
        return 0
    nodes = lambda t: store.read(t).select(F.col(("cert_id" if t == "certs" else "policy_id")).alias("id"), F.col("parent_id").alias("parent"))
    links = lambda t, c: store.read(t).select("domain_id", F.col(c).alias("id"))
    out = cut(coalesce(dirty, links("domain_certs", "cert_id"), nodes("certs"), links("domain_policies", "policy_id"), nodes("policies")), "coalesced")
    full, empty = out.where("leaf_value is not null"), out.where("leaf_value is null").select("domain_id")
    store.replace("domain_payloads", full.select("domain_id", "cert_ids", "cert_ids_id", "policy_ids", "policy_ids_id"))
    if not empty.isEmpty():
        store.delete("domain_payloads", empty)
        store.delete("domains", empty)
    store.replace("dirty", dirty.select("domain_id", F.lit(True).alias("coalesced")))
    return n


def update_trie(store: Store) -> str | None:
    """Bring the saved leaves and nodes up to the dirty domains and save the root; without dirty domains nothing changes."""
    dirty = cut(store.read("dirty").select("domain_id"), "dirty")
    if dirty.isEmpty():
        return store.load_root()
    payloads = store.read("domain_payloads").select("domain_id", F.array_sort(F.split(F.trim(F.regexp_replace(F.concat_ws("", "cert_ids", "policy_ids"), "([0-9a-f]{64})", "$1 ")), " ")).alias("ids"))
    value = F.sha2(F.unhex(F.array_join(F.array_distinct("ids"), "")), 256)
    changes = dirty.join(payloads, "domain_id", "left").select(F.col("domain_id").alias("key"), F.when(F.col("ids").isNotNull(), value).alias("value"))
    nodes, leaves = smt.update(store.read("nodes"), store.read("leaves"), changes)
    leaves, nodes = cut(leaves, "leaves"), cut(nodes, "nodes")
    store.write("leaves", leaves)
    store.write("nodes", nodes)
    root = smt.root_of(nodes)
    if root != store.load_root():
        store.save_root(root)
    return root


def prune_expired(store: Store, now: int) -> int:
    """Remove the certificates that have expired and all below them; their domains become dirty."""
    certs = store.read("certs")
    nodes = cut(certs.select(F.col("cert_id").alias("id"), F.col("parent_id").alias("parent"), "expiration"), "nodes")
    links = store.read("domain_certs").select("domain_id", F.col("cert_id").alias("id"))
    _, removed, dirty = prune(nodes, links, F.timestamp_seconds(F.lit(now)))
    removed, dirty = cut(removed, "removed"), cut(dirty, "dirty")
    n = removed.count()
    if n:
        store.replace("dirty", dirty.select("domain_id", F.lit(False).alias("coalesced")))
        gone = removed.select(F.col("id").alias("cert_id"))
        store.delete("domain_certs", gone)
        store.delete("certs", gone)
    return n


def update_map(store: Store) -> str | None:
    """Coalesce, fold, clean up."""
    coalesce_dirty(store)
    root = update_trie(store)
    store.truncate("dirty")
    return root


def prune_and_update(store: Store, now: int, fetch=None) -> str | None:
    """One service cycle: prune, ``fetch()`` new certificates into the store, update the map."""
    prune_expired(store, now)
    if fetch is not None:
        fetch()
    return update_map(store)


def run(spark: SparkSession, store: Store, folder: str, journal_path: str, strategy: str = "", files_at_once: int = 0, now: int | None = None, mode: str = bundles.FAILFAST, with_csv: bool = False, skip_missing: bool = False) -> dict:
    """Ingest a log's folder as the strategy says; the statistics of the run.

    Files that the journal has are left out.  A batch counts as done once all steps
    of the strategy are, so a run that was cut off begins with that batch again.
    """
    now = int(datetime.now(timezone.utc).timestamp()) if now is None else now
    journal = Journal(journal_path, folder, strategy, with_csv)
    total: dict = {}
    if journal.does("record"):
        size = journal.size()
        url = spark.range(1).select(times.log_url(F.lit(folder))).first()[0]
        store.save_log_state(url, size)
        journal.commit_log_size(size)
        return {"url": url, "log_size": size}

    def finish(files):
        if journal.does("coalesce"):
            coalesce_dirty(store)
        if journal.does("smt"):
            total["root"] = update_trie(store)
        journal.commit(files, journal.does("coalesce"), journal.does("smt"))

    if not journal.does("ingest"):
        finish([])
        return total
    files = journal.pending([r.path for r in bundles.discover(spark, folder).collect()])
    step = files_at_once or max(1, len(files))
    for k in range(0, len(files), step):
        part = files[k : k + step]
        for name, x in ingest_files(store, part, now, mode, skip_missing).items():
            total[name] = total.get(name, 0) + x
        finish(part)
    return total


def progress(query) -> list[dict]:
    """Of each source of a running stream: where the last batch began and ended, and the newest offset."""
    last = query.lastProgress or {}
    return [{"source": s["description"], "start": s.get("startOffset"), "end": s.get("endOffset"), "latest": s.get("latestOffset")} for s in last.get("sources", [])]
