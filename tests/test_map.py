"""The certificate map: trie, closures, intervals, names, sources, store."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maploom.functions import crypto, domains, policies, times
from maploom.operators import coalesce, intervals, lookup, smt
from maploom.operators.closure import ancestors, descendants
from maploom.sources import bundles, x509
from maploom.store import Store, upsert_replace


def sha(x: str) -> bytes:
    return hashlib.sha256(x.encode()).digest()


def test_trie_golden():
    assert smt.fold([(sha("example.com"), sha("x"))]).at(0).hex() == "28dca35fe6fa30f492ddcdbd8de3ca3feaab235a882f6df920486b3d51273619"
    leaves = sorted((sha(f"d{i}"), sha(f"v{i}")) for i in range(8))
    assert smt.fold(leaves).at(0).hex() == "0ab462b45ad6536180e79f75009ef590f032fcdbdf114cf0a2c18d834a52b4a9"


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 500), min_size=1, max_size=40))
def test_trie_proofs(members):
    leaves = sorted((sha(f"k{i}"), sha(f"v{i}")) for i in members)
    root = smt.fold(leaves).at(0).hex()
    for i in range(0, 500, 37):
        key = sha(f"k{i}")
        path, end = smt.audit(leaves, key)
        path = [p.hex() for p in path]
        assert smt.expand(*smt.compress(path)) == path
        if i in members:
            assert smt.verify_inclusion(root, path, key.hex(), sha(f"v{i}").hex())
            assert not smt.verify_inclusion(root, path, key.hex(), sha("other").hex())
        else:
            other = (end.key.hex(), end.value.hex()) if end.n else (None, None)
            assert smt.verify_absence(root, path, key.hex(), *other)


def test_deep_siblings():
    zero, one = bytes(32), bytes(31) + b"\1"
    path, _ = smt.audit([(zero, sha("a")), (one, sha("b"))], zero)
    assert len(path) == 256


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40])
def test_trie_on_spark(spark, n):
    leaves = sorted((sha(f"k{i}"), sha(f"v{i}")) for i in range(n))
    df = spark.createDataFrame([(k.hex(), v.hex()) for k, v in leaves], "key string, value string")
    root = smt.root(df)
    assert root == (smt.fold(leaves).at(0).hex() if n else None)
    asked = spark.createDataFrame([(sha(f"k{i}").hex(),) for i in range(60)], "key string")
    for r in smt.proofs(asked, df).collect():
        assert r.included == any(k.hex() == r.key for k, _ in leaves)
        if r.included:
            assert smt.verify_inclusion(root, r.path, r.proof_key, r.proof_value)
        else:
            assert smt.verify_absence(root, r.path, r.key, r.proof_key, r.proof_value)


def test_closures_end_on_cycles(spark):
    nodes = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", None), ("f", "missing")], "id string, parent string")
    got = {(r.id, r.ancestor) for r in ancestors(nodes, nodes).collect()}
    assert {x for i, x in got if i == "d"} == {"a", "b", "c", "d"} and ("f", "missing") not in got
    assert {r.id for r in descendants(nodes, nodes.where("id = 'e'")).collect()} == {"e"}


def test_coalesce_keeps_empty_domains(spark):
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    certs = spark.createDataFrame([(h("root"), None), (h("leaf"), h("root"))], "id string, parent string")
    links = spark.createDataFrame([("d1", h("leaf"))], "domain_id string, id string")
    dirty = spark.createDataFrame([("d1",), ("d2",)], "domain_id string")
    rows = {r.domain_id: r for r in coalesce.coalesce(dirty, links, certs, links.limit(0), certs.limit(0)).collect()}
    glued = "".join(sorted([h("root"), h("leaf")]))
    assert rows["d1"].cert_ids == glued and rows["d1"].leaf_value == hashlib.sha256(bytes.fromhex(glued)).hexdigest()
    assert rows["d2"].leaf_value is None and rows["d2"].n_certs == 0


def test_intervals(spark):
    df = spark.createDataFrame([("a", 0, 4), ("a", 5, 9), ("a", 2, 3), ("a", 11, 12), ("b", 1, 1)], "log string, start long, end long")
    assert sorted(map(tuple, intervals.merge(df, "log").collect())) == [("a", 0, 9), ("a", 11, 12), ("b", 1, 1)]
    chain = spark.createDataFrame([("a", 0, 4), ("a", 5, 9), ("a", 11, 12)], "log string, start long, end long")
    assert intervals.reachable(chain, "log", 0).first().size == 10
    assert intervals.reachable(chain, "log", 0, max_rows=1).first().size == 5
    w = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "idx int, weight int")
    assert sorted(map(tuple, intervals.apportion(w, 10).collect())) == [(0, 4), (1, 3), (2, 3)]


def test_names(spark):
    def valid(x):
        return spark.createDataFrame([(x,)], "n string").select(domains.is_valid(F.col("n"))).first()[0]

    for x in (".com", "com", "net", ".baidu.com", "_www.baidu.com", "*.*.baidu.com", None):
        assert not valid(x), x
    for x in ("device-a6789012.baidu.com", "www.baidu.com", "www.2017.cuni.cz", "150.tum.de", "601602.com", "*.9292.nl"):
        assert valid(x), x
    df = spark.createDataFrame([("www.baidu.com",), ("video.mail.baidu.com",)], "n string").select(domains.ancestors(F.col("n")))
    assert [r[0] for r in df.collect()] == [["baidu.com"], ["baidu.com", "mail.baidu.com", "video.mail.baidu.com"]]
    few = spark.createDataFrame([(f"{x}.baidu.com",) for x in "abcde"], "name string")
    assert [r.name for r in domains.affected(few).collect()] == ["baidu.com"]
    assert domains.affected(few.limit(4)).count() == 4


def test_policies_and_durations(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    ask = lambda name, a=(), d=(), e=(): spark.range(1).select(policies.check_domain(F.lit("a.com"), F.lit(name), arr(*a), arr(*d), arr(*e))).first()[0]
    assert ask("x.a.com", d=["x"]) == 1 and ask("y.x.a.com", e=["x"]) == 2 and ask("b.com") == 3 and ask("a.com") == 3
    assert ask("x.a.com", a=["x"], d=["x"]) == 0 and ask("z.a.com", a=["x"], d=["*"]) == 1 and ask("z.a.com") == 0
    row = spark.range(1).select(times.parse_duration(F.lit("3w")).alias("a"), times.format_duration(F.lit(0)).alias("z"), times.format_duration(F.lit(7200 * 10**9)).alias("h"), times.log_url(F.lit("/x/https:__ct.example.com_2025")).alias("u")).first()
    assert (row.a, row.z, row.h, row.u) == (3 * 7 * 86400 * 10**9, "0s", "2h", "https://ct.example.com/2025")


def test_crypto():
    p, q = (1 << 607) - 1, (1 << 521) - 1
    n, e = p * q, 65537
    d = pow(e, -1, (p - 1) * (q - 1))
    s = crypto.rsa_sign(b"hi", n, d)
    assert crypto.rsa_verify(b"hi", s, n, e) and not crypto.rsa_verify(b"ho", s, n, e)
    leaves = [crypto.log_leaf(bytes([i])) for i in range(11)]
    for size in range(1, 12):
        root = crypto.log_root(leaves[:size])
        for i in range(size):
            proof = crypto.log_proof(leaves[:size], i)
            assert crypto.verify_log_inclusion(leaves[i], i, size, proof, root)
            assert size == 1 or not crypto.verify_log_inclusion(leaves[i], i, size, proof[:-1], root)


def test_csv_lines(spark, tmp_path):
    lines = ["0,1,2,CERT,a;b,san,2000.5", '0,1,2,"CE",c,2000.5', "", "a,b", "0,1,2,,x,9.0", "0,1,2,C,x,notime"]
    df = bundles.split_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.disposition for r in df.collect()] == ["ok", "fallback", "error", "error", "error", "fallback"]
    (tmp_path / "bundled").mkdir()
    (tmp_path / "bundled" / "0-5.csv").write_text("\n".join(lines) + "\n")
    assert [(r.start, r.end, r.rows) for r in bundles.discover(spark, str(tmp_path)).collect()] == [(0, 5, 6)]
    rows = bundles.read_bundles(spark, str(tmp_path / "bundled" / "0-5.csv"), now=1000, mode="PERMISSIVE")
    assert sorted((r.cert, tuple(r.chain)) for r in rows.collect()) == [("CE", ("c",)), ("CERT", ("a", "b"))]


def _der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + head + body


def test_x509(spark):
    name = lambda cn: _der(0x30, _der(0x31, _der(0x30, _der(6, bytes.fromhex("550403")), _der(0x0C, cn))))
    san = _der(0xA3, _der(0x30, _der(0x30, _der(6, bytes.fromhex("551d11")), _der(4, _der(0x30, _der(0x82, b"a.com"), _der(0x82, b"b.com"))))))
    tbs = _der(0x30, _der(0xA0, _der(2, b"\2")), _der(2, b"\1"), _der(0x30), name(b"CA"), _der(0x30, _der(0x17, b"200101000000Z"), _der(0x18, b"20500101000000Z")), name(b"a.com"), _der(0x30), san)
    cert = _der(0x30, tbs, _der(0x30), _der(3, b"\0"))
    r = x509.decode(spark.createDataFrame([(bytearray(cert),), (bytearray(b"bad"),)], "der binary"), strict=False).where("error is null").first()
    assert r.names == ["a.com", "b.com"] and r.common_name == "a.com" and r.not_after == 2524608000 and r.cert_id == hashlib.sha256(cert).hexdigest()


def test_unfold_and_lookup(spark):
    df = lookup.unfold(spark.createDataFrame([("l", "n", ["m", "r"]), ("k", "o", ["m", "r"])], "leaf string, names string, chain array<string>"))
    assert {(r.cert_id, r.parent_id, r.names) for r in df.collect()} == {("l", "m", "n"), ("k", "m", "o"), ("m", "r", None), ("r", None, None)}


def test_store_and_stream(spark, tmp_path):
    from maploom.streaming.incremental import bundles_stream, run

    store = Store(spark, str(tmp_path / "store"))
    schema = "cert_id string, parent_id string, expiration timestamp, payload string, domain_id string, domain_name string"
    for k in range(3):
        rows = [("c0", None, None, f"p{k}", None, None), (f"c{k + 1}", "c0", None, "p", f"d{k % 2}", f"n{k % 2}")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(bundles_stream(spark, str(tmp_path / "in"), schema), store, str(tmp_path / "check"))
    run(bundles_stream(spark, str(tmp_path / "in"), schema), store, str(tmp_path / "check"))
    assert store.read("certs").count() == 4 and store.read("domains").count() == 2 and store.read("domain_certs").count() == 3 and store.read("dirty").count() == 2
    assert store.load_root() is None
    store.save_root("aa")
    store.save_root("bb")
    assert store.load_root() == "bb" and store.manifest()["past_roots"] == ["aa"]
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 5, 1), ("b", 3, 2)], "k string, v int, t int")
    assert sorted(map(tuple, upsert_replace(old, new, ["k"], "t").collect())) == [("a", 1), ("b", 3)]


def test_trie_update(spark):
    """An incremental root equals a fresh one; proofs against kept nodes verify; the last key's removal gives a null root."""
    h = lambda x: sha(x).hex()
    frame = lambda rows: spark.createDataFrame(rows, "key string, value string")
    leaves = frame([(h(f"k{i}"), h(f"v{i}")) for i in range(300)])
    kept = smt.nodes(leaves)
    old_root = smt.root_of(kept)
    changes = {h(f"k{i}"): None if i % 2 else h(f"new{i}") for i in range(280, 320)}
    new, fresh = smt.update(kept, leaves, frame(list(changes.items())))
    want = {h(f"k{i}"): h(f"v{i}") for i in range(300)} | changes
    want = sorted((bytes.fromhex(k), bytes.fromhex(v)) for k, v in want.items() if v)
    assert {(r.key, r.value) for r in fresh.collect()} == {(k.hex(), v.hex()) for k, v in want}
    assert smt.root_of(new) == smt.fold(want).at(0).hex() != old_root
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, smt.nodes(fresh).collect()))
    asked = frame([(h(f"k{i}"), "") for i in range(270, 330)]).select("key")
    for root, l, n in ((smt.root_of(new), fresh, new), (old_root, leaves, kept)):  # the second: against a past root
        for r in smt.proofs(asked, l, n).collect():
            bits = smt.compress(r.path)
            if r.included:
                assert smt.verify_inclusion(root, r.path, r.proof_key, r.proof_value) and smt.verify_inclusion_compressed(root, *bits, r.proof_key, r.proof_value)
            else:
                assert smt.verify_absence(root, r.path, r.key, r.proof_key, r.proof_value) and smt.verify_absence_compressed(root, *bits, r.key, r.proof_key, r.proof_value)
    none, empty = smt.update(new, fresh, fresh.select("key", F.lit(None).cast("string").alias("value")))
    assert smt.root_of(none) is None and empty.count() == 0 and none.count() == 0
    assert {(r.key, r.value) for r in smt.get(fresh, asked.limit(60)).collect()} >= {(h("k282"), h("new282")), (h("k281"), None)}


def test_public_suffixes(spark, tmp_path):
    """Wildcards, exceptions and second levels, by expressions and by the join with a list from a file."""
    rows = [("a.example.gr", "example.gr"), ("foo.bar.com.mx", "bar.com.mx"), ("shop.example.co.za", "example.co.za"), ("x.y.z.ck", "y.z.ck"), ("a.www.ck", "www.ck"), ("a.b.example.com", "example.com"), ("host.local", "host.local")]
    df = spark.createDataFrame(rows, "name string, want string")
    assert {r.name: r.got for r in df.select("name", domains.e2ld(F.col("name")).alias("got")).collect()} == dict(rows)
    assert not spark.range(1).select(domains.is_valid(F.lit("gr"))).first()[0] and not spark.range(1).select(domains.is_valid(F.lit("foo.ck"))).first()[0]
    (tmp_path / "list.dat").write_text("// x\n// ===BEGIN ICANN DOMAINS===\ncom\nmx\ncom.mx\n*.ck\n!www.ck\n*.kawasaki.jp\n!city.kawasaki.jp\njp\n// ===END ICANN DOMAINS===\nprivate.com\n")
    rules = domains.read_rules(str(tmp_path / "list.dat"))
    names = spark.createDataFrame([(x,) for x in ("a.com", "b.a.com.mx", "x.y.ck", "a.www.ck", "q.w.e.kawasaki.jp", "a.city.kawasaki.jp", "p.private.com", "none.zz")], "name string")
    want = {"a.com": "com", "b.a.com.mx": "com.mx", "x.y.ck": "y.ck", "a.www.ck": "ck", "q.w.e.kawasaki.jp": "e.kawasaki.jp", "a.city.kawasaki.jp": "kawasaki.jp", "p.private.com": "com", "none.zz": None}
    assert {r.name: r.suffix for r in domains.with_suffix(names, domains.rules_table(spark, rules)).collect()} == want
    got = names.select("name", domains.suffix_labels(F.col("name"), rules).alias("k")).collect()
    assert {r.name: ".".join(r.name.split(".")[-r.k :]) if r.k else None for r in got} == want


def _certificate(subject: str, issuer: str, not_after: str = "20500101000000Z", *names: str) -> bytes:
    name = lambda cn: _der(0x30, _der(0x31, _der(0x30, _der(6, bytes.fromhex("550403")), _der(0x0C, cn.encode()))))
    san = _der(0xA3, _der(0x30, _der(0x30, _der(6, bytes.fromhex("551d11")), _der(4, _der(0x30, *[_der(0x82, x.encode()) for x in names]))))) if names else b""
    return _der(0x30, _der(0x30, _der(0xA0, _der(2, b"\2")), _der(2, b"\1"), _der(0x30), name(issuer), _der(0x30, _der(0x17, b"200101000000Z"), _der(0x18, not_after.encode())), name(subject), _der(0x30), san), _der(0x30), _der(3, b"\0"))


def _line(leaf: bytes, *chain: bytes, expiration: str = "2524608000.0") -> str:
    import base64

    b64 = lambda x: base64.b64encode(x).decode()
    return f"0,1,2,{b64(leaf)},{';'.join(map(b64, chain))},san,{expiration}"


def test_ingest_to_proofs(spark, tmp_path):
    """From gz bundles to verified proofs: batches, journal, incremental roots, payloads, pruning."""
    import gzip

    from maploom.operators import serving
    from maploom.streaming import ingest
    from maploom.streaming.journal import Journal

    root = _certificate("root", "root")
    mid = _certificate("mid", "root", "20400101000000Z")
    leaf = [_certificate(f"h{k}.example.com", "mid", "20300101000000Z" if k % 2 else "20350101000000Z", f"h{k}.example.com", "example.com") for k in range(6)]
    old = _certificate("old.example.com", "mid", "20210101000000Z", "old.example.com")
    folder = tmp_path / "https:__ct.example.com_2025"
    (folder / "bundled").mkdir(parents=True)
    for name, rows in (("0-2.gz", leaf[:3]), ("3-6.gz", leaf[3:])):
        text = "\n".join([*[_line(x, mid, root) for x in rows], _line(leaf[0], mid, root, expiration="5.0"), _line(old, mid, root)])
        (folder / "bundled" / name).write_bytes(gzip.compress((text + "\n").encode()))
    store, journal = Store(spark, str(tmp_path / "store")), str(tmp_path / "journal.json")
    stats = ingest.run(spark, store, str(folder), journal, files_at_once=1, now=1_700_000_000)
    assert (stats["rows"], stats["expired"], stats["files"]) == (10, 2, 2) and stats["certs_per_second"] > 0
    assert store.read("certs").count() == 8 and store.read("domains").count() == 7 and store.read("domain_certs").count() == 12
    assert store.read("dirty").where("not coalesced").count() == 0 and store.load_root() == stats["root"] == smt.root(store.read("leaves"))
    assert ingest.run(spark, store, str(folder), journal, now=1_700_000_000) == {}  # all files are in the journal
    assert ingest.run(spark, store, str(folder), journal, "recordctsize") == {"url": "https://ct.example.com/2025", "log_size": 7}
    assert store.log_state("https://ct.example.com/2025") == (7, None) and store.log_state("other") == (0, None)

    names = spark.createDataFrame([("h1.example.com",), ("none.example.com",), ("com",)], "name string")
    p, q, e = (1 << 607) - 1, (1 << 521) - 1, 65537
    head = serving.signed_head(store, p * q, pow(e, -1, (p - 1) * (q - 1)))
    assert crypto.rsa_verify(bytes.fromhex(head["root"]), bytes.fromhex(head["signature"]), p * q)
    rows = serving.get_proofs(store, names, head).collect()
    assert {(r.domain_name, r.included) for r in rows if r.error is None} == {("example.com", True), ("h1.example.com", True), ("none.example.com", False)}
    assert [r.name for r in rows if r.error] == ["com"] and all(serving.verify(head["root"], r) for r in rows if r.error is None)
    one = next(r for r in rows if r.domain_name == "h1.example.com")
    assert one.cert_ids == "".join(sorted(hashlib.sha256(x).hexdigest() for x in (leaf[1], mid, root))) and one.policy_ids_id == serving.ZERO_ID
    asked = spark.createDataFrame([("r", one.cert_ids + "0" * 64)], "request string, ids string")
    got = serving.get_payloads(store, asked, "certs").orderBy("pos").collect()
    assert [bool(r.payload) for r in got] == [True, True, True, False]
    with pytest.raises(Exception, match="not a list of ids"):
        serving.get_payloads(store, spark.createDataFrame([("r", "ab")], "request string, ids string")).collect()

    before = store.load_root()
    raw = '{"T":"*pc","O":{"Domain":"example.com"}}'
    ingest.add_policies(store, spark.createDataFrame([(hashlib.sha256(raw.encode()).hexdigest(), "example.com", raw, None)], "policy_id string, domain string, raw string, expiration timestamp"))
    after = ingest.prune_and_update(store, 1_900_000_000)  # in 2030: the odd leaves have expired
    assert after != before == store.manifest()["past_roots"][0] and after == smt.root(store.read("leaves")) and store.read("dirty").count() == 0
    assert store.read("certs").count() == 5 and {r.included for r in serving.get_proofs(store, names.limit(1)).where("domain_name = 'h1.example.com'").collect()} == {False}
    assert ingest.prune_and_update(store, 4_000_000_000) is not None and store.read("certs").count() == 0  # the policy stays
    assert store.expire() > 0 and store.read("domain_payloads").count() == 1
    assert Journal(journal, str(folder)).job["smt"]


def test_bad_bundles(spark, tmp_path):
    import gzip

    from maploom.sources import bundles as b
    from maploom.streaming import ingest

    good, mid = _certificate("a.com", "mid", "20500101000000Z", "a.com"), _certificate("mid", "mid")
    lines = [_line(good, mid), "", "a,b", _line(good), _line(good, b"no certificate"), "0,1,2,%%%,x,san,2524608000.0", _line(good, mid, expiration="soon"), _line(good, mid, expiration="1.2.3")]
    path = tmp_path / "0-9.csv"
    path.write_text("\n".join(lines) + "\n")
    rows = b.bundle_rows(spark, str(path))
    assert rows.where("error is not null").count() == 4
    with pytest.raises(Exception, match="not a bundle line|no expiration"):
        b.read_bundles(spark, str(path), 0).collect()
    certs, bad = ingest.decoded(b.read_bundles(spark, str(path), 0, mode="PERMISSIVE"), 0, "PERMISSIVE")
    assert {r.cert_id for r in certs.collect()} == {hashlib.sha256(x).hexdigest() for x in (good, mid)} and bad.count() == 3
    with pytest.raises(Exception):  # noqa: B017
        ingest.decoded(b.read_bundles(spark, str(path), 0, mode="PERMISSIVE"), 0)[0].collect()
    cut = tmp_path / "10-19.gz"
    cut.write_bytes(gzip.compress(("\n".join(_line(good, mid, expiration=f"{2524608000 + k}.5") for k in range(2000)) + "\n").encode())[:-400])
    with pytest.raises(Exception):  # noqa: B017
        b.read_bundles(spark, str(cut), 0).count()
    both = [str(path), str(tmp_path / "20-29.gz")]
    assert b.bundle_rows(spark, both, skip_missing=True).count() == rows.count() and b.bundle_rows(spark, both[1:], skip_missing=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        b.bundle_rows(spark, both).count()
    assert b.sorted_bundles(["x/10-19.gz", "x/9-9.gz", "x/0-8.csv"]) == ["x/0-8.csv", "x/9-9.gz", "x/10-19.gz"]


def test_journal(tmp_path):
    from maploom.streaming import journal as j

    path = str(tmp_path / "journal.json")
    first = j.Journal(path, "logs/x", "onlyingest")
    assert first.does("ingest") and not first.does("smt")
    assert first.pending(["x/10-19.gz", "x/0-9.gz", "x/20-29.csv"]) == ["x/0-9.gz", "x/10-19.gz"]
    first.commit(["x/0-9.gz", "x/20-29.gz"])
    again = j.Journal(path, "logs/x", with_csv=True)
    assert again.pending(["x/0-9.gz", "x/5-12.gz", "x/10-19.csv", "x/20-25.gz"]) == ["x/5-12.gz", "x/10-19.csv"] and again.size() == 10
    again.commit(["x/10-19.csv"], coalesced=True)
    assert again.job["completed"] == {"x": [[0, 29]]} and again.job["coalesced"] and not again.job["smt"] and len(j.Journal(path, "logs/x").jobs) == 3
    with pytest.raises(ValueError):
        j.completed_size([[5, 9]])
    with pytest.raises(ValueError):
        j.parse_interval("9-5.gz")
    with pytest.raises(ValueError):
        j.Journal(path, "logs/x", "everything")


def test_log_source(spark, tmp_path):
    """A log that answers from files: batch ranges, short answers, a stream by tree size."""
    import base64
    import json

    from maploom.sources import ctlog

    b64 = lambda x: base64.b64encode(x).decode()
    sized = lambda x: len(x).to_bytes(3, "big") + x

    def entry(k):
        chain = sized(sized(b"mid") + sized(b"root"))
        head = b"\0\0" + (1000 + k).to_bytes(8, "big")
        if k % 2:
            return {"leaf_input": b64(head + b"\0\1" + bytes(32) + sized(b"tbs")), "extra_data": b64(sized(b"cert%d" % k) + chain)}
        return {"leaf_input": b64(head + b"\0\0" + sized(b"cert%d" % k) + b"\0\0"), "extra_data": b64(chain)}

    head = {"tree_size": 10, "timestamp": 1, "sha256_root_hash": b64(b"r" * 32), "tree_head_signature": b64(b"s")}
    (tmp_path / "get-sth.json").write_text(json.dumps(head))
    for a in range(10):
        for b in range(a, 10):
            (tmp_path / f"get-entries-{a}-{b}.json").write_text(json.dumps({"entries": [entry(k) for k in range(a, min(b + 1, a + 3))]}))  # never more than three
    spark.dataSource.register(ctlog.LogSource)
    read = lambda **o: spark.read.format("ctlog").options(url=f"file://{tmp_path}", batch=4, part=5, **o).load()
    rows = read().orderBy("index").collect()
    assert [(r["index"], r.timestamp, bytes(r.cert), [bytes(c) for c in r.chain]) for r in rows] == [(k, 1000 + k, b"cert%d" % k, [b"mid", b"root"]) for k in range(10)]
    assert [r["index"] for r in read(start=3, end=6).orderBy("index").collect()] == [3, 4, 5, 6]
    stream = spark.readStream.format("ctlog").options(url=f"file://{tmp_path}", batch=4, part=5).load().select("index")
    out = str(tmp_path / "out")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["index"] for r in spark.read.schema("index long").parquet(out).collect()) == list(range(10))
    assert not ctlog.is_tree_head(head | {"sha256_root_hash": "?"}) and not ctlog.is_tree_head({})


def test_follow_logs(spark, tmp_path):
    """Entries of a log get into the store by a stream; a second run reads only what is new."""
    import base64
    import json

    from maploom.streaming.incremental import follow_logs

    b64 = lambda x: base64.b64encode(x).decode()
    sized = lambda x: len(x).to_bytes(3, "big") + x
    root = _certificate("root", "root")
    leaves = [_certificate(f"n{k}.com", "root", "20400101000000Z", f"n{k}.com") for k in range(6)]
    store, url = Store(spark, str(tmp_path / "store")), f"file://{tmp_path}/log"
    (tmp_path / "log").mkdir()
    for size in (4, 6):
        head = {"tree_size": size, "timestamp": 1, "sha256_root_hash": b64(b"r" * 32), "tree_head_signature": b64(b"s%d" % size)}
        (tmp_path / "log" / "get-sth.json").write_text(json.dumps(head))
        for a in range(size):
            for b in range(a, size):
                entries = [{"leaf_input": b64(b"\0\0" + bytes(8) + b"\0\0" + sized(x) + b"\0\0"), "extra_data": b64(sized(sized(root)))} for x in leaves[a : b + 1]]
                (tmp_path / "log" / f"get-entries-{a}-{b}.json").write_text(json.dumps({"entries": entries}))
        assert follow_logs(spark, store, [url], str(tmp_path / "checkpoints"), 0, batch=2, part=3) == {url: size}
        assert store.log_state(url) == (size, b64(b"s%d" % size)) and store.read("certs").count() == size + 1 and store.read("dirty").count() == size


def test_small_helpers(spark):
    from maploom.sources.bundles import plan_files

    files = [(0, 9, "a"), (10, 19, "b"), (30, 39, "d"), (20, 24, "c")]
    assert plan_files(files, 0) == (25, ["a", "b", "c"]) and plan_files(files, 0, 5) == (10, ["a"]) and plan_files(files, 10, 15) == (25, ["b", "c"]) and plan_files(files, 5) == (5, [])
    with pytest.raises(ValueError):
        plan_files([*files, (0, 4, "e")], 0)
    assert intervals.fair_split(11, [2, 5, 7]) == {2: 4, 5: 4, 7: 3} and intervals.fair_split(3, []) == {}
    names = spark.createDataFrame([(1, "cn", ["x"]), (2, "", ["", "san"]), (3, None, [])], "k int, cn string, names array<string>")
    assert [r.s for r in names.orderBy("k").select(lookup.subject_name(F.col("cn"), F.col("names")).alias("s")).collect()] == ["cn", "san", ""]
    certs = spark.createDataFrame([("l", "leaf", "mid"), ("m", "mid", "root"), ("m2", "mid", "root"), ("r", "root", "root"), ("x", "lost", "nobody")], "cert_id string, subject string, issuer string")
    got = {(r.cert_id, r.ancestor) for r in lookup.chains(certs, certs.where("cert_id in ('l', 'x')")).collect()}
    assert got == {("l", "l"), ("l", "m"), ("l", "r"), ("x", "x")}


def test_signatures():
    from maploom.functions import signatures as s

    p, q, e = (1 << 607) - 1, (1 << 521) - 1, 65537
    n, d = p * q, pow(e, -1, (p - 1) * (q - 1))
    number = lambda x: _der(2, x.to_bytes(x.bit_length() // 8 + 1, "big"))
    key = _der(0x30, _der(0x30), _der(3, b"\0" + _der(0x30, number(n), number(e))))
    import base64

    signer = {"SerialNumber": 1, "Domain": "a.com", "CanIssue": True, "CanOwn": True, "PublicKey": base64.b64encode(key).decode(), "SPCTs": [{"Version": 1}]}
    request = {"SerialNumber": 2, "Domain": "b.a.com", "PolicyAttributes": {"AllowedCAs": ["CA"]}}
    owned = s.sign_as_owner(signer, request, n, d)
    assert s.verify_owner(signer, owned) and not s.verify_owner(signer, owned | {"Domain": "c.a.com"}) and not s.verify_owner(signer | {"Domain": "x.com"}, owned)
    issued = s.sign_as_issuer(signer, owned, n, d)
    assert s.verify_issuer(signer, issued) and s.verify_owner(signer, issued) and not s.verify_issuer(signer, issued | {"SerialNumber": 3})
    stamp = s.sign_timestamp(issued, 1, b"log", "2025-01-01T00:00:00Z", n, d)
    logged = issued | {"SPCTs": [stamp]}
    assert s.verify_issuer(signer, logged) and s.signer_hash(signer) == s.signer_hash({k: v for k, v in signer.items() if k != "SPCTs"})
    assert s.verify_timestamp(issued, stamp, n) and not s.verify_timestamp(owned, stamp, n)
    for bad in ((signer, owned), (signer | {"CanOwn": False}, request)):
        with pytest.raises(ValueError):
            s.sign_as_owner(*bad, n, d)
    with pytest.raises(ValueError):
        s.sign_as_issuer(signer, issued, n, d)
    assert s.parse(s.serialize(issued))[:2] == ("pc", True) and s.parse(s.serialize([owned, issued]))[0] == "[]" and s.equal(issued, dict(reversed(issued.items())))
    with pytest.raises(ValueError):
        s.parse(b'{"T":"other","O":{}}')


def test_log_consistency():
    leaves = [crypto.log_leaf(bytes([i])) for i in range(9)]

    def proof(m, rows, whole=True):
        """Consistency proof of RFC 6962, by its definition."""
        n = len(rows)
        if m == n:
            return [] if whole else [crypto.log_root(rows)]
        k = 1 << (n - 1).bit_length() - 1
        if m <= k:
            return [*proof(m, rows[:k], whole), crypto.log_root(rows[k:])]
        return [*proof(m - k, rows[k:], False), crypto.log_root(rows[:k])]

    for n in range(1, 10):
        for m in range(1, n + 1):
            roots = crypto.log_root(leaves[:m]), crypto.log_root(leaves[:n])
            assert crypto.verify_log_consistency(m, n, *roots, proof(m, leaves[:n]))
            assert m == n or not crypto.verify_log_consistency(m, n, roots[1], roots[0], proof(m, leaves[:n]))


def test_pem_and_times(spark, tmp_path):
    from maploom.sources import pem

    a, b = _certificate("a", "a"), _certificate("b", "b")
    (tmp_path / "x.pem").write_text(pem.write("CERTIFICATE", a) + "text\n" + pem.write("PUBLIC KEY", b"k") + pem.write("CERTIFICATE", b))
    assert [(r.place, bytes(r.der)) for r in pem.read_certificates(spark, str(tmp_path / "x.pem")).orderBy("place").collect()] == [(0, a), (1, b)]
    number = lambda x: _der(2, x.to_bytes(2, "big"))
    key = _der(0x30, _der(2, b"\0"), number(3233), number(17), number(2753))
    assert pem.rsa_private_key(pem.write("RSA PRIVATE KEY", key)) == (3233, 17, 2753) == pem.rsa_private_key(pem.write("PRIVATE KEY", _der(0x30, _der(2, b"\0"), _der(0x30), _der(4, key))))
    r = spark.range(1).select(times.time_of_day(F.lit("07:30")).alias("d"), times.to_seconds(times.next_time_of_day(times.from_seconds(F.lit(86400 + 30000)), F.lit(27000))).alias("n"), times.to_seconds(times.next_time_of_day(times.from_seconds(F.lit(86400)), F.lit(27000))).alias("m")).first()
    assert (r.d, r.n, r.m) == (27000, 2 * 86400 + 27000, 86400 + 27000)
    with pytest.raises(Exception, match="not a time of day"):
        spark.range(1).select(times.time_of_day(F.lit("25:00"))).collect()


def test_workload(spark):
    """The generated map coalesces to what a walk along the chains gives."""
    from maploom.plans import workload as w

    t = w.workload(spark, 40, certs_each=2, issuers=20, depth=3, policies_every=5)
    rows = lambda n: [tuple(r) for r in t[n].collect()]
    parent, links, policies = dict(rows("certs")), {}, dict(rows("domain_policies"))
    for domain, cert in rows("domain_certs"):
        while cert:
            links.setdefault(domain, set()).add(cert)
            cert = parent[cert]
    got = {r.domain_id: r for r in coalesce.coalesce(t["dirty"], t["domain_certs"], t["certs"], t["domain_policies"], t["policies"]).collect()}
    assert len(got) == 40 and len(policies) == 8
    for domain, ids in links.items():
        assert got[domain].cert_ids == "".join(sorted(ids)) and got[domain].n_certs == len(ids) and got[domain].policy_ids == policies.get(domain)
        both = sorted(ids | ({policies[domain]} if domain in policies else set()))
        assert got[domain].leaf_value == hashlib.sha256(bytes.fromhex("".join(both))).hexdigest()
    assert w.speedup([4, 2, 6], [1, 2, 3]) == {"old_median": 4, "new_median": 2, "old_range": 2.0, "new_range": 1.0, "speedup_percent": 50}


def test_export(spark, tmp_path):
    import json
    from datetime import datetime

    from maploom.sources import export

    h = lambda x: sha(x).hex()
    rows = [(h("a"), None, datetime(2030, 1, 2, 3, 4, 5), "cGF5"), (h("b"), h("a"), datetime(2031, 1, 1), "bG9hZA==")]
    certs = spark.createDataFrame(rows, "cert_id string, parent_id string, expiration timestamp, payload string")
    export.to_csv(certs, "certs", str(tmp_path / "certs"))
    assert sorted(map(tuple, export.from_csv(spark, "certs", str(tmp_path / "certs")).collect())) == sorted(rows)
    export.write_json(str(tmp_path / "x.json"), {"a": [1]})
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": [1]}
    got = export.policies_of(spark.createDataFrame([("a.com",), ("com",), ("a.com",)], "name string")).collect()
    assert [(r.domain, r.policy_id) for r in got] == [("a.com", hashlib.sha256(b'{"T":"*pc","O":{"Domain":"a.com"}}').hexdigest())]


def _way_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_coalesce_shuffles_numbers_once(spark):
    """on larger tables glued ancestors and hashed ids, shuffled several times, filled the disk."""
    from maploom.plans import queries

    plan = _way_of(queries.coalesce(spark, "/root/testdata/sf0.001"))
    dealt = [x for x in plan.split("\n") if "Exchange" in x]
    assert len(dealt) == 1 and "hashpartitioning(n#" in dealt[0], plan
    assert "Join" not in plan


@pytest.mark.parametrize("limit", [0, coalesce.ISSUERS])
def test_coalesce_ways_agree(spark, limit):
    """Broadcast and joined issuers: cycles, missing parents, repeated, null and empty ids, one id of both kinds, many domains."""
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    parents = {h("a"): h("b"), h("b"): h("c"), h("c"): h("a"), h("root"): None, h("mid"): h("root"), h("lost"): h("missing"), h("blank"): ""}
    parents |= {h(f"leaf{i}"): (h("mid"), h("a"), h("lost"))[i % 3] for i in range(40)}
    others = {h("root"): None, h("mid"): h("root"), h("pol"): h("mid")}
    links = [(f"d{i % 50}", h(f"leaf{i % 40}")) for i in range(200)] + [("d1", h("blank")), ("d1", ""), ("d1", None), (None, h("root")), ("d2", h("nowhere")), ("clean", h("a"))]
    pols = [(f"d{i}", h("pol")) for i in range(0, 60, 7)] + [("d3", h("root"))]
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    dirty = [*{d for d, _ in [*links, *pols]} - {"clean"}, "empty", "d1"]

    def members(pairs, nodes, domain):
        out, todo = set(), [i for d, i in pairs if d == domain and d is not None]
        while todo:
            x = todo.pop()
            if x and x in nodes and x not in out:
                out.add(x)
                todo.append(nodes[x])
        return sorted(out)

    digest = lambda ids: hashlib.sha256(bytes.fromhex("".join(ids))).hexdigest() if ids else None
    want = set()
    for d in {*dirty}:
        c, p = members(links, parents, d), members(pols, others, d)
        want.add((d, "".join(c) or None, len(c), digest(c), "".join(p) or None, len(p), digest(p), digest(sorted({*c, *p}))))
    got = coalesce.coalesce(frame([(d,) for d in dirty], ["domain_id"]), frame(links, ["domain_id", "id"]), frame([*parents.items(), ("", None)], ["id", "parent"]), frame(pols, ["domain_id", "id"]), frame([*others.items()], ["id", "parent"]), limit=limit)
    assert got.columns[0] == "domain_id"
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and {*rows} == want


def _shuffled(spark, run) -> int:
    """Bytes that ``run`` writes to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total() -> int:
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = total()
    run()
    return total() - before


@pytest.mark.parametrize("name", ["smt_root", "smt_leaves", "smt_proofs"])
def test_trie_queries_shuffle_little(spark, name):
    """ancestors and hashed ids went through shuffles before."""
    from maploom.plans import queries

    sf_dir = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert 0 < _shuffled(spark, lambda: queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()) < 100 * rows
