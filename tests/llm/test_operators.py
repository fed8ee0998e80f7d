"""The ten operators against brute force on small hard cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from .fixtures import hard_cases, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(sets):
    """Smallest reachable id by links of Jaccard similarity of at least 0.75."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_jaccard_join(spark):
    from maploom.llm.jaccard_join import jaccard_join

    rows = hard_cases() + [(200 + k, " ".join(prose(900 + k // 6, 30 + k // 6).split()[k % 6 :])) for k in range(60)]
    want = groups({i: shingles(t) for i, t in rows})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(table(spark, rows)).collect()}
    assert got == {i: (len(shingles(t)), want[i]) for i, t in rows}
    assert jaccard_join(table(spark, [])).count() == 0


def test_jaccard_join_with_split_tiles(spark, monkeypatch):
    """Tiles beyond the small size carry bitmaps and are compared in blocks, with the same result."""
    from maploom.llm import jaccard_join as j

    monkeypatch.setattr(j, "SMALL", 1)
    monkeypatch.setattr(j, "BLOCK", 2)
    base = prose(7, 80).split()
    rows = []
    for k in range(14):
        w = list(base)
        for m in range(3):
            w[(11 * k + 25 * m) % 80] = f"x{k}{m}"
        rows.append((k, " ".join(w)))
    want = groups({i: shingles(t) for i, t in rows})
    got = {r.doc_id: r.component_id for r in j.jaccard_join(table(spark, rows)).collect()}
    assert got == want


def quality_by_hand(text):
    from maploom.llm.quality import COVERAGE, LINE_COVERAGE

    text = text or ""
    w = WORD.findall(text)

    def inside(n):
        c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return {k for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}

    lines, seen, dup, dup_chars = text.split("\n"), set(), 0, 0
    for line in lines:
        if WORD.search(line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
    chars = sum(map(len, w))
    repeat = len(inside(8))
    failed = len(w) < 20 or 100 * repeat > 30 * len(w)
    kept = not failed and all(100 * sum(len(w[k]) for k in inside(n)) <= p * chars for n, p in COVERAGE.items()) and 100 * dup_chars <= LINE_COVERAGE * chars
    return len(w), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, failed, kept


def test_quality(spark):
    from maploom.llm.quality import keep_good, quality

    rows = [*hard_cases(), (300, "a b c d e f g h i j\n" * 9), (301, prose(8, 30) + "\n" + prose(9, 12) + "\n" + prose(9, 12)), (302, "# * $ <b>|&% " * 3 + prose(10, 40))]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality(table(spark, rows)).collect()}
    want = {i: quality_by_hand(t) for i, t in rows}
    assert got == want
    kept = keep_good(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "n_lines", "token"] and {r.doc_id for r in kept.collect()} == {i for i in want if want[i][-1]}


def lines_by_hand(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    count = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not key(x) or count[key(x)] < least]
        out[i] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


@pytest.mark.parametrize("bound", [1000, 0])
def test_line_dedup(spark, bound):
    from maploom.llm.line_dedup import line_dedup

    rows = hard_cases() + [(400, "x\n\nshared line\r\n"), (401, "\n")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup(table(spark, rows), broadcast_keys=bound).collect()}
    assert got == lines_by_hand(rows, 10)


def test_line_runs(spark):
    from maploom.llm.common import Workspace
    from maploom.llm.line_dedup import LineRuns

    runs = LineRuns(Workspace(spark, "test"), fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(x, 1) for x in range(k, k + 3)], "key long, docs long"))
    assert sum(map(len, runs.levels.values())) == 2  # 4 batches in one run, and 1
    assert {r.key for r in runs.frequent(3).collect()} == {2, 3, 4}
    assert {r.key for r in runs.unseen(spark.createDataFrame([(1, 1), (99, 1)], "key long, docs long")).collect()} == {99}


@pytest.mark.parametrize("words", [10**6, 40])
def test_contamination(spark, words):
    from maploom.llm.decontaminate import clean, contamination

    item = prose(20, 40)
    rows = [*hard_cases(), (500, prose(21, 3000) + " " + item + " " + prose(22, 500)), (501, " ".join(item.split()[:36]) + " zzz"), (502, " ".join(item.split()[:20])), (503, item), (503, item)]
    bench = [(1, item), (2, None), (3, ""), (4, prose(23, 9)), (5, prose(2, 20_000)[4000:4400].split(" ", 1)[1].rsplit(" ", 1)[0]), (6, item)]
    items = spark.createDataFrame(bench, "item_id int, text string")
    got = Counter(map(tuple, contamination(table(spark, rows), items, broadcast_words=words).collect()))
    want = Counter()
    for d, t in rows:
        for i, x in bench:
            s = shingles(x)
            k = len(s & shingles(t))
            if s and 100 * k >= 75 * len(s):
                want[d, i, len(s), k] += 1
    assert got == want and (8, 5) in {x[:2] for x in want}
    gone = {d for d, *_ in want}
    assert {r.doc_id for r in clean(table(spark, rows), items).collect()} == {d for d, _ in rows} - gone


def test_sentencepiece(spark):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    from maploom.llm.sentencepiece_codec import decode, encode

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    rows = [*hard_cases(), (600, " lead"), (601, "  two"), (602, "tail "), (603, "\nx \n y"), (604, "<s> <0x0A> </s>"), (605, "\0 a" + " " * 40 + "b")]
    got = encode(table(spark, rows), path).collect()
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        assert list(r.ids or []) == sp.encode(text), text[:50]
        assert r.n_tokens == len(r.ids) and r.round_trip and r.n_differ == 0
    back = {r.doc_id: r.text for r in decode(encode(table(spark, rows), path), path).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in rows}


def test_sentencepiece_memory_of_a_worker():
    """The pipeline's last stage held some 270 MB in each worker: a process of its own, as its peak is looked at."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import random, re
import numpy as np, pyarrow as pa, public_tokenizers
from maploom.llm import sentencepiece_codec as c
from maploom.llm import textnum as tn

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def rows(batches, codec):
    if hasattr(c, "encode_rows"):
        yield from c.encode_rows(batches, codec)
    else:
        for _, texts in tn.chunks(batches):
            ids, count = codec.encode(texts)
            codec.differ(texts, ids, np.r_[0, np.cumsum(count)])
            yield

r = random.Random(1)
letters = "etaoinshrdlu"
texts = [" ".join("".join(r.choices(letters, k=r.randint(3, 9))) for _ in range(1000)) for _ in range(300)]
codec = c.Codec(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts})
before = most = held()
with np.errstate(over="ignore"):
    for _ in rows([batch], codec):
        most = max(most, held())
print("MB", most - before)
"""
    here = Path(__file__).resolve().parents[2]
    out = subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert float(out.stdout.split("MB")[-1]) < 110, out.stdout


def test_sentencepiece_rows_are_those_of_the_rebuilt_model(spark, tmp_path, monkeypatch):
    """A wrong rebuild or a wrong cut shows in the ids and in ``n_differ`` of the document, by the query too."""
    import numpy as np
    import public_tokenizers

    from maploom.llm import sentencepiece_codec as c
    from maploom.llm import textnum as tn
    from maploom.llm.queries import op4_sentencepiece

    table(spark, hard_cases()).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    rows = op4_sentencepiece(spark, str(tmp_path)).collect()
    assert len(rows) == len(hard_cases()) and {r.n_differ for r in rows} == {0}
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        raw = f.read()
    data = b"one two three" + b"four"
    texts = tn.Texts(np.frombuffer(data, np.uint8), np.array([0, 13, 17]))

    def encoded(codec):
        ids, count = codec.encode(texts)
        return ids.tolist(), codec.differ(texts, ids, np.r_[0, np.cumsum(count)])

    right, differ = encoded(c.Codec(raw))
    assert differ == [0, 0]
    build = c.Model.tokenizer

    def no_merges(self):
        from tokenizers import models

        out = build(self)
        out.model = models.BPE({p: k for k, (p, _, _) in enumerate(self.pieces)}, [], unk_token=self.pieces[self.unk_id][0], fuse_unk=True, byte_fallback=True)
        return out

    monkeypatch.setattr(c.Model, "tokenizer", no_merges)
    wrong, differ = encoded(c.Codec(raw))
    assert wrong != right and min(differ) > 0
    monkeypatch.undo()
    monkeypatch.setattr(c, "spans", lambda t, cut: (np.array([0, 2, 13]), np.array([2, 13, 17]), np.array([0, 0, 1])))
    differ = encoded(c.Codec(raw))[1]
    assert differ[0] > 0 and differ[1] == 0


def test_unigram_model_is_rebuilt():
    """A unigram model with scores, built here as a protobuf by hand."""
    import struct

    from maploom.llm.sentencepiece_codec import Model

    def field(n, value):
        return bytes([n << 3 | 2, len(value)]) + value

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))

    raw = piece("<unk>", 0, 2) + piece("▁ab", -1, 1) + piece("▁a", -3, 1) + piece("b", -2, 1) + piece("▁", -4, 1) + field(2, bytes([3 << 3, 1]))
    t = Model(raw).tokenizer()
    assert t.encode("ab b", add_special_tokens=False).tokens == ["▁ab", "▁", "b"]


def test_token_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from maploom.llm.token_files import token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = [*hard_cases(), (700, "a b 　c, d.e\n\n x!?×."), (701, "it's l'été. 12.5% <|endoftext|>")]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files(table(spark, rows), path, 2).collect()}
    at, want = 0, {}
    for i, x in sorted(rows):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids)))
        at += len(ids)
    assert got == want
    assert token_files(table(spark, []), path, 2).count() == 0


def test_token_files_with_special_literals(spark, tmp_path):
    """The query's ids are those of the tokenizer file as it is."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from maploom.llm.queries import op6_token_files

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    rows = [*hard_cases(), (710, f"one {end} two"), (711, f"a{end}b, c{end}.{end}{end} |{end}|"), (712, f"x y{end}z w\n{end}\n<|endof text|> <|endoftext"), (713, "|> d"), (714, f"{end} it's {end}'s")]
    table(spark, rows).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op6_token_files(spark, str(tmp_path)).collect()}
    at, want = 0, {}
    for i, x in sorted(rows):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids)))
        at += len(ids)
    assert got == want


@pytest.mark.parametrize("bound", [1000, 0])
def test_paragraphs(spark, bound):
    from maploom.llm.paragraph_dedup import MIN_WORDS, paragraph_dedup

    para = prose(30, 60)
    near = para.split()
    near[30] = "changed"
    rows = [*hard_cases(), (800, para + "\nshort"), (801, prose(31, 30) + "\n" + " ".join(near)), (802, para.upper() + "\n" + para)]
    got = {r.doc_id: (r.text, r.n_shared, r.n_removed, sorted(r.removed_of or [])) for r in paragraph_dedup(table(spark, rows), broadcast_keys=bound).collect()}
    places = [(i, k, line) for i, t in rows for k, line in enumerate((t or "").split("\n")) if len(WORD.findall(line)) >= MIN_WORDS]
    group = groups({n: shingles(line) for n, (_, _, line) in enumerate(places)})
    members = defaultdict(list)
    for n, (i, k, _) in enumerate(places):
        members[group[n]].append((i, k))
    gone = {p: min(m) for m in members.values() for p in m if p != min(m)}
    shared = {p for m in members.values() if len(m) > 1 for p in m}
    for i, t in rows:
        lines = (t or "").split("\n")
        want = "\n".join(x for k, x in enumerate(lines) if (i, k) not in gone)
        assert got[i] == (want, sum(p[0] == i for p in shared), sum(p[0] == i for p in gone), sorted({gone[p][0] for p in gone if p[0] == i}))


def test_toxicity(spark):
    from maploom.llm.toxicity import toxicity

    rows = [(i, prose(1000 + i, 30) + (" you idiot moron" if i % 3 == 0 else " fine day")) for i in range(240)] + [(900, None), (901, ""), (902, "1d10t m0r0n " + prose(3, 20)), (903, "i d i o t " + prose(4, 20)), (904, "idiiiot mooooron " + prose(5, 20))]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(table(spark, rows), labels).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in got if got[i].held_out} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(got[i].predicted == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score and got[900].predicted == 0
    assert all(got[i].predicted == 1 for i in (902, 904))
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in toxicity(table(spark, rows[:3]), labels.limit(0)).collect()} != {None}


def test_toxicity_of_mixed_noise(spark):
    """Spacing by blanks is decoded too, alone and with other noise, at any length and next to any character."""
    from maploom.llm.toxicity import toxicity

    noise = ["i d i o t", "y o u i d i o t", "a i d i o t", "I i d i o t", "i d 1 o t", "i d i i i o t", "ii d i ooo t", "! d ! 0 t", "i . d . i . o . t", "y o u i d i o t m o r o n y o u i d i o t", "\u201c1d10t\u201d", ("-" * 12).join("idiot"), "m 0 r 0 n,"]
    rows = [(i, prose(1000 + i, 30) + (" you idiot moron" if i % 3 == 0 else " fine day")) for i in range(240)] + [(900 + k, f"{x} {prose(3, 20)}") for k, x in enumerate(noise)] + [(990, "f i n e d a y"), (991, "d a y " * 300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity(table(spark, rows), labels).collect()}
    assert [x for k, x in enumerate(noise) if not got[900 + k]] == [] and got[990] == got[991] == 0


def test_spaced_words_are_cut_by_document():
    import numpy as np

    from maploom.llm import textnum as tn
    from maploom.llm.toxicity import Decoder, word_features

    texts = tn.Texts(np.frombuffer(b"a i d" + b"i o t m", np.uint8), np.array([0, 5, 12]))
    owner, feats = word_features(texts, Decoder(np.zeros(27**3, np.int64)))
    want = tn.Texts(np.frombuffer(b"aidiotm", np.uint8), np.array([0, 7]))
    for k, (lo, hi) in enumerate([(0, 3), (3, 7)]):
        assert want.span_hash(np.array([lo]), np.array([hi]))[0] in feats[owner == k]


def test_warc(spark):
    from maploom.llm.common import Workspace
    from maploom.llm.warc import read, round_trip, write

    big = "é" * 600
    rows = [(1, "http://a/\n", big), (2, "u", None), (3, None, ""), (4, "u", big), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", "y" * 1000), (8, "ü", "\r\n\r\n" + "z" * 3000), (9, "u", big)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, length string").repartition(3)
    got = {r.page_id: tuple(r)[1:] for r in round_trip(pages).collect()}
    want = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max(j for j, _, x in rows if x == h) if len(raw) >= 1000 else i
        want[i] = (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if top != i else "response", top if top != i else None)
    assert got == want
    work = Workspace(spark, "test")
    index = write(pages, work)
    some = {r.page_id: r for r in read(spark, index._archives_at, index.where("page_id in (1, 8, 9)"), max_gap=0).collect()}
    assert some[8].payload.decode() == rows[7][2] and some[9].payload.decode() == big and some[1].payload is None and some[1].refers_to == 9 and some[1].url == rows[0][1] and some[8].url == "ü"


def test_sharding(spark):
    from maploom.llm.sharding import min_cost_flow, reshard

    flow = min_cost_flow([10, 0, 5], [5, 5, 5], lambda i, j: int(i != j))
    assert flow.tolist() == [[5, 5, 0], [0, 0, 0], [0, 0, 5]]
    rows = [*hard_cases(), *[(2000 + k, prose(3000 + k, 5 + k % 90)) for k in range(800)], *[(5000 + k, "hot text " * 40) for k in range(400)]]
    got = reshard(table(spark, rows), 6, 8).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    by = defaultdict(list)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode()) and r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r)
    # equal texts share a shard
    where = defaultdict(set)
    for r in got:
        where[dict(rows)[r.doc_id] or ""].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    # two groups are larger than an eighth of all: their shards cannot be smaller, the others are near equal
    sizes = sorted(sum(r.size for r in by[s]) for s in range(8))
    large = sorted([400 * 361, max(len((t or "").encode()) + 1 for _, t in rows)])
    assert max(sizes[:-2]) <= 1.03 * min(sizes[:-2]) and sizes[-2] <= large[0] * 1.01 and sizes[-1] <= large[1] * 1.01
    assert all(sorted(r.slot for r in by[s]) == list(range(len(by[s]))) for s in range(8))
    assert reshard(table(spark, []), 6, 8).count() == 0


def test_sharding_moves_little():
    """Against the least number of bytes that any plan must move, and the files that hold them."""
    import random

    from maploom.llm.sharding import plan

    r = random.Random(3)
    for old, new in ((6, 8), (8, 6), (5, 5)):
        units = [(u, u % old, u // old * 16 // (4096 // old + 1), r.randint(1, 2000) * (3 if u % old == 0 else 1)) for u in range(4096)]
        total, home = sum(u[3] for u in units), {u[0]: u[1] for u in units}
        place = plan(units, old, new)
        sizes = [sum(u[3] for u in units if place[u[0]] == j) for j in range(new)]
        assert max(sizes) - min(sizes) <= 0.01 * total / new
        supply = [sum(u[3] for u in units if u[1] == i) for i in range(old)]
        least = sum(max(0, supply[i] - (total / new if i < new else 0)) for i in range(old))
        moved = [u for u in units if place[u[0]] != home[u[0]]]
        assert least - 0.01 * total <= sum(u[3] for u in moved) <= least + 0.01 * total
        touched = {(u[1], u[2]) for u in moved}
        assert len(touched) <= 16 * old * least / total + 2 * old + 2
    assert plan([], 6, 8) == {}


def test_sharding_leaves_files(spark, monkeypatch):
    """Rows of ranges without a moved block are read from the old files."""
    from maploom.llm import sharding

    at = {}
    lay_out = sharding.lay_out

    def kept(docs, shards, work):
        at["old"] = lay_out(docs, shards, work)
        return at["old"]

    monkeypatch.setattr(sharding, "lay_out", kept)
    rows = [(k, prose(4000 + k, 20)) for k in range(3000)]
    out = sharding.reshard(table(spark, rows), 6, 8)
    new = spark.read.parquet(at["old"][0].replace("/01-old", "/02-new"))
    rewritten, ranges = new.where("shard < 6").select("shard", "span").distinct().count(), spark.read.parquet(at["old"][0]).select("shard", "span").distinct().count()
    assert 0 < rewritten <= 0.4 * ranges and 750 - 40 <= new.count() <= 0.45 * 3000
    assert sorted(r.doc_id for r in out.collect()) == list(range(3000))


EDGES = [(None, None), (None, ""), (None, prose(800, 40)), (1, prose(801, 60)), (1, prose(801, 60)), (1, prose(802, 30)), (2, None), (2, None), (3, "\n\n"), (4, prose(803, 30_000))]


def over_edges(spark):
    """Each operator over a table of (doc_id, text) with clashing extra columns."""
    import public_tokenizers

    from maploom.llm import decontaminate, jaccard_join, line_dedup, paragraph_dedup, quality, sentencepiece_codec, sharding, token_files, toxicity

    labels = spark.createDataFrame([(1, 1, 0.5, "t"), (1, 0, 0.5, "t"), (5, 1, 0.1, "u"), (None, 1, 0.1, "u"), (6, None, 0.2, "v")], "doc_id long, toxic int, score double, text string")
    items = spark.createDataFrame([(1, prose(803, 30_000)[5000:5600].split(" ", 1)[1].rsplit(" ", 1)[0], 9), (1, None, 9), (None, prose(801, 60), 9), (2, prose(801, 60), 9), (2, prose(801, 60), 9)], "item_id int, text string, doc_id int")
    piece, byte = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
    return {
        "1": lambda d: jaccard_join.jaccard_join(d),
        "3": lambda d: toxicity.toxicity(d, labels),
        "4": lambda d: sentencepiece_codec.encode(d, piece),
        "5": lambda d: quality.quality(d),
        "6": lambda d: token_files.token_files(d, byte, 2),
        "7": lambda d: paragraph_dedup.paragraph_dedup(d, passages=True),
        "8": lambda d: line_dedup.line_dedup(d, min_docs=3),
        "9": lambda d: sharding.reshard(d, 6, 8),
        "10": lambda d: decontaminate.contamination(d, items),
    }


@pytest.mark.parametrize("n", ["1", "3", "4", "5", "6", "7", "8", "9", "10"])
def test_edges(spark, n):
    """Empty tables, nulls in any column, repeated rows, very long texts, and extra columns with clashing names."""
    f = over_edges(spark)[n]
    assert f(table(spark, [])).count() == 0
    schema = "doc_id long, text string, n_words long, shard int, score double, key string, component_id long, hashes binary, mark long"
    rows = spark.createDataFrame([(i, t, 7, 7, 0.7, "k", 7, None, None) for i, t in EDGES], schema).repartition(3)
    got = f(rows).collect()
    if n == "10":
        assert Counter((r.doc_id, r.item_id) for r in got) == Counter({(4, 1): 1, (1, None): 2, (1, 2): 4})
        return
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in EDGES)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    if n == "1":
        assert {r.component_id for r in by[1]} == {1} and {r.component_id for r in by[None]} == {None} and {r.n_shingles for r in by[2]} == {0}
    elif n == "3":
        assert {r.held_out for r in by[None]} == {False} and all(0 <= r.score <= 1 for r in got)
    elif n == "6":
        assert sorted(r.start for r in got)[0] == 0 and sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    elif n == "8":
        assert sorted(r.n_dropped for r in by[1]) == [0, 0, 0] and by[3][0].n_lines == 3
    elif n == "9":
        assert len({r.shard for r in got if r.size == 1}) == 1


def test_warc_edges(spark):
    from maploom.llm.warc import round_trip

    schema = "page_id long, url string, html string, file string, offset long, payload_bytes long, digest string"
    assert round_trip(spark.createDataFrame([], schema)).count() == 0
    big = "z" * 2000
    rows = [(None, None, None), (None, "u", big), (1, "u", big), (1, "u", big), (2, "http://x/a b?q=%41\r\n", big), (3, "é", "y" * 3_000_000), (4, "u", "y" * 1500), (None, "u", "w" * 1500)]
    got = round_trip(spark.createDataFrame([(*r, "f", 1, 1, "d") for r in rows], schema).repartition(3)).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == Counter({(None, "response", None, 0): 1, (None, "revisit", 2, 2000): 1, (1, "revisit", 2, 2000): 2, (2, "response", None, 2000): 1, (3, "response", None, 3_000_000): 1, (4, "response", None, 1500): 1, (None, "response", None, 1500): 1})


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_contamination_of_long_items(spark):
    """Items of thousands of shingles, a quarter of them lacking, inside longer documents: all are found, by either way."""
    from maploom.llm.decontaminate import contamination, item_set, sketch

    item = prose(850, 3000).split()
    assert len(sketch(item_set(" ".join(item))[1])) == 2996 - 2247 + 1
    near = list(item)
    for k in range(0, 3000, 24):
        near[k] = f"x{k}"
    rows = [(1, prose(851, 4000) + " " + " ".join(near) + " " + prose(852, 500)), (2, " ".join(item[:2200])), (3, " ".join(item[:2251])), (4, prose(853, 3000))]
    items = spark.createDataFrame([(1, " ".join(item)), (2, prose(854, 2500))], "item_id int, text string")
    want = set()
    for d, t in rows:
        s = shingles(" ".join(item))
        k = len(s & shingles(t))
        if 100 * k >= 75 * len(s):
            want.add((d, 1, len(s), k))
    assert {x[0] for x in want} == {1, 3}
    for words in (10**6, 100):
        assert set(map(tuple, contamination(table(spark, rows), items, broadcast_words=words).collect())) == want


def test_line_runs_are_merge_joined(spark):
    """A batch's run has no key of an earlier one; the anti-join merges bucketed runs without a shuffle of them."""
    from maploom.llm.common import Workspace
    from maploom.llm.line_dedup import LineRuns

    runs = LineRuns(Workspace(spark, "test"), fanout=3)
    batch = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("key"), F.lit(1).cast("long").alias("docs"))
    runs.add(batch(0, 50))
    runs.add(batch(30, 80))
    assert [r.count() for r in runs.levels[0]] == [50, 30] and runs.tallies[0].count() == 20
    own = runs._write(batch(70, 90), "batch")
    plan = runs.unseen(own)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "LeftAnti" in plan and "Exchange" not in plan
    runs.add(batch(70, 90))
    assert sum(map(len, runs.levels.values())) == 1 and {r.key for r in runs.frequent(2).collect()} == {*range(30, 50), *range(70, 80)}


def test_toxicity_with_labels_of_one_class(spark):
    from maploom.llm.toxicity import toxicity

    docs = table(spark, [(k, prose(k, 30)) for k in range(8)])
    for label in (0, 1):
        labels = spark.createDataFrame([(k, label) for k in range(8)], "doc_id long, toxic int")
        assert {(round(r.score, 9), r.predicted) for r in toxicity(docs, labels).collect()} == {(float(label), label)}


def test_decoder_against_all_paths():
    """The Viterbi decoder finds the least cost among all paths of short noisy words."""
    import itertools

    import numpy as np

    from maploom.llm import toxicity as t

    rng = np.random.default_rng(5)
    decoder = t.Decoder(rng.integers(0, 50, 27**3))

    def best(token):
        choices, before = [], ""
        for ch in token:
            options = [(ch, ord(ch) - 96, 0.0)] if "a" <= ch <= "z" else [(ch, 0, 0.0)] if ch.isalnum() and ch not in t.LOOKALIKE else [(x, ord(x) - 96, t.SUBSTITUTE + (1.0 if len(t.LOOKALIKE[ch]) > 2 else 0.0)) for x in t.LOOKALIKE.get(ch, "")]
            skip = t.REPEAT if ch == before else t.SEPARATOR if not ch.isalnum() else None
            choices.append(options + ([(None, None, skip)] if skip is not None else []))
            before = ch
        found = (np.inf, "")
        for path in itertools.product(*choices):
            a, b, cost, text = 0, 0, 0.0, ""
            for x, k, extra in path:
                cost += extra
                if x is not None:
                    cost += decoder.cost[a, b, k]
                    a, b, text = b, k, text + x
            found = min(found, (cost + decoder.cost[a, b, 0], text))
        return found[1]

    for token in ("1d10t", "m0r.0n", "i-d-i-0-t", "aab", "$h!7", "b4d|y", "ss1i", "é1x", "*a"):
        assert decoder(token) == best(token), token


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [*hard_cases(), (6000, prose(40, 200)), (6001, prose(40, 200)), (6002, prose(41, 60) + " " + prose(42, 30))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(42, 30))], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [k for k, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    good = [(i, t) for i, t in rows if quality_by_hand(t)[-1]]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    count = Counter(k for _, t in good for k in {key(x) for x in t.split("\n")})
    good = [(i, "\n".join(x for x in t.split("\n") if not key(x) or count[key(x)] < 10)) for i, t in good]
    group = groups({i: shingles(t) for i, t in good})
    item = shingles(prose(42, 30))
    want = {i for i, t in good if group[i] == i and 100 * len(item & shingles(t)) < 75 * len(item)}
    assert got == want and 6002 not in want and 6001 not in want
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = {i: sp.encode(t) for i, t in good if i in want}
    rows = {r.doc_id: (r.n_tokens, r.ids_crc32, r.round_trip, r.n_differ) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert rows == {i: (len(x), zlib.crc32(b"".join(k.to_bytes(4, "little") for k in x)), True, 0) for i, x in ids.items()}


def test_pipeline_with_null_ids_and_repeated_rows(spark, tmp_path):
    """Exactly one row of each component stays, by (doc_id, null last; text); rows are judged by their own texts."""
    import corpus_pipeline
    from maploom.llm.decontaminate import clean

    base = prose(60, 120)
    near = " ".join(["changed", *base.split()[1:]])
    rows = [(None, prose(61, 80)), (None, prose(62, 80)), (None, prose(62, 80)), (1, prose(63, 80)), (1, prose(63, 80)), (1, prose(64, 80)), (None, base), (7, near), (7, base), (9, base), (2, ""), (2, ""), (3, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.ngram_jaccard_join(spark, docs, str(tmp_path)).collect())
    assert got == Counter([(None, prose(61, 80)), (None, prose(62, 80)), (1, prose(63, 80)), (1, prose(64, 80)), (7, min(near, base)), (2, ""), (3, ""), (None, None)])
    items = spark.createDataFrame([(1, prose(62, 80)), (2, prose(64, 80))], "item_id int, text string")
    for words in (10**6, 100):
        left = clean(docs, items, words)
        assert left.columns == docs.columns and Counter((r.doc_id, r.text) for r in left.collect()) == Counter(x for x in rows if x[1] not in (prose(62, 80), prose(64, 80)))


def shared_windows(rows, size, own=False):
    """The documents that share ``size`` words in a row with another one, or with ``own`` repeat them."""
    owners = defaultdict(list)
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        for k in range(len(w) - size + 1):
            owners[hash(tuple(w[k : k + size]))].append(i)
    return {i for o in owners.values() if len(o if own else set(o)) > 1 for i in o}


@pytest.mark.parametrize("bound", [1000, 0])
def test_passages(spark, bound):
    """Passages inside longer lines, and wrapped otherwise, go from all documents but the first."""
    from maploom.llm.paragraph_dedup import paragraph_dedup

    passage = prose(500, 55)
    wrapped = "\n".join(" ".join(passage.split()[k : k + 9]) for k in range(0, 55, 9))
    rows = [*hard_cases(), (900, f"{prose(501, 90)} {passage} {prose(502, 70)}"), (901, f"{prose(503, 12)} {passage.upper()} {prose(504, 300)}\n{prose(505, 5)}"), (902, f"{prose(506, 30)}\n{wrapped}\n{prose(507, 40)}"), (903, prose(508, 200)), (904, prose(509, 3)), (None, f"{prose(510, 40)} {passage}"), (906, "same " * 400), (907, "same " * 300)]
    got = {r.doc_id: r for r in paragraph_dedup(table(spark, rows), broadcast_keys=bound, passages=True).collect()}
    assert len(got) == len(rows)
    assert all(got[i].n_shared > 0 for i in (900, 901, 902, None)) and [got[i].n_removed > 0 for i in (900, 901, 902, None)] == [False, True, True, True]
    assert got[900].text == dict(rows)[900] and got[901].removed_of == [900] and 900 in got[902].removed_of
    for i in (903, 904):
        assert got[i].text == dict(rows)[i] and got[i].n_shared == got[i].n_removed == 0
    words = WORD.findall(passage)
    for i in (901, 902, None):
        before, after = WORD.findall(dict(rows)[i].translate(LOWER)), WORD.findall(got[i].text.translate(LOWER))
        gone = Counter(before) - Counter(after)
        assert sum(gone.values()) >= 20 and not gone - Counter(words) and not Counter(after) - Counter(before)
    assert len(got[907].text.split()) < 300 and got[904].text == prose(509, 3)
    assert paragraph_dedup(table(spark, []), passages=True).count() == 0


def test_passages_of_a_whole_table(spark):
    """At least 0.97 of the documents that share 50 words in a row are found; what is found has repeated words of a passage's length, or paragraphs."""
    from maploom.llm.paragraph_dedup import PASSAGE, paragraph_dedup

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in paragraph_dedup(docs, passages=True).drop("text").collect()}
    lines = {r.doc_id for r in paragraph_dedup(docs).drop("text").where("n_shared > 0").collect()}
    long = shared_windows(rows, 50)
    assert sum(got[i].n_shared > 0 for i in long) >= 0.97 * len(long)
    assert not {i for i in got if got[i].n_shared} - lines - shared_windows(rows, PASSAGE, own=True)
