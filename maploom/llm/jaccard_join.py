"""N-gram Jaccard self-join: size-banded tiles, bitmap bounds, exact intersection.

Two texts link when the Jaccard similarity of their sets of word shingles is at
least 75/100.  Sets that link must share one of their rarest ``n - ceil(0.75 n)
+ 1`` shingles under any fixed order, so texts that share such a shingle form a
tile.  The order puts shingles that are frequent (by a fixed-size sketch over
all texts) last, so common passages hardly ever form a tile.

1. Equal sets become one class.  Only classes go on.
2. Each tile proposes pairs with its first member (a star); linked classes
   become components.
3. Tiles that still hold several components compare the members outside the
   tile's main component first with a few members of it, and then those that are
   still outside with all others, by size band and in blocks of bounded size.
4. A proposed pair first meets the bound of the hashed bitmaps: with parity
   bitmaps x, y of sets A, B, the overlap is at most
   (|A| + |B| - popcount(x xor y)) / 2.  Pairs that pass are settled by
   intersecting the sorted arrays of 64-bit shingle hashes.

No link between different components is lost: a pair is dropped only by size,
by the bound, by the exact count, or because both are in one component already.
Links inside a component are not all listed.  Hash collisions of 64 bits are the
only source of error.

Defined results: a null or empty text, or one without words, has no shingles,
links with nothing and is its own component.  Repeated rows and ties are equal
sets, hence linked.  A null doc_id is no component's name: its row is named by
the others that it links with, or by null.  Texts are read whole, however long.
Columns other than doc_id and text are never read.  An empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import Bloom, Workspace, components, docs_of, lists, map_arrow, relabel, release, small_batches

SLOTS_LOG2 = 20  #: counters of the frequency sketch (fixed size)
HOT = 32  #: a counter below this says nothing about its shingles
BLOCK = 2048  #: members of a frequent shingle's tile that are compared at once
SMALL = 8  #: a tile of at most so many members carries no bitmaps; its pairs meet them afterwards, once each
MAX_BITS = 8192  #: widest bitmap
LOWEST = 8  #: a member carries its so many lowest tokens, to tell whether a pair also meets in an earlier tile
_BAND = np.log(4 / 3)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> tn.U64(64 - SLOTS_LOG2)).astype(np.int64)


def set_id(s: np.ndarray) -> int:
    """64-bit identity of a set of hashes."""
    total = tn.mix(s * tn.U64(0xD6E8FEB86659FD93)).sum(dtype=tn.U64) + tn.U64(len(s))
    return int(tn.mix(np.array([total], tn.U64)).view(np.int64)[0])


def band(n):
    """Size band: linked sets are in the same or in neighbouring bands."""
    return np.floor(np.log(np.maximum(n, 1)) / _BAND + 1e-9).astype(np.int32)


def width(b) -> np.ndarray:
    """Bits of the bitmap of a band: about twice its largest set, a power of two."""
    return np.minimum(2 ** np.ceil(np.log2(2 * np.exp((np.asarray(b) + 1) * _BAND))).astype(np.int64), MAX_BITS).clip(64)


def bitmap(s: np.ndarray, bits: int) -> bytes:
    """Parity of the hashes on each bit."""
    at = (s & tn.U64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def fold(maps: np.ndarray, nbytes: int) -> np.ndarray:
    """Parity bitmaps (a row each) of half the width, again and again."""
    while maps.shape[-1] > nbytes:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] ^ maps[..., half:]
    return maps


def bound(na, nb, odd):
    """Most shingles that sets of these sizes share if their bitmaps differ in ``odd`` bits."""
    return (na + nb - odd) // 2


def similar(na, nb, shared):
    """Jaccard similarity of at least 75/100, in integers."""
    return 100 * shared >= 75 * (na + nb - shared)


def frequency_classes(docs: DataFrame) -> np.ndarray:
    """For each sketch slot, the log2 of its shingles' document count, 0 if not frequent.

    Tasks send only counters that stand out of their own rows; the result has
    2**SLOTS_LOG2 bytes at any input size.
    """

    def count(batches):
        total = np.zeros(1 << SLOTS_LOG2, np.int64)
        for _, texts in tn.chunks(batches):
            sets = tn.shingle_sets(texts)
            if sets:
                total += np.bincount(_slots(np.concatenate(sets)), minlength=1 << SLOTS_LOG2)
        mean = total.mean()
        at = np.flatnonzero(total >= max(3, mean + 6 * np.sqrt(mean) + 1))
        yield {"slot": at, "c": total[at]}

    rows = map_arrow(docs, count, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).where(F.col("c") >= HOT).toPandas()
    classes = np.zeros(1 << SLOTS_LOG2, np.uint8)
    classes[rows["slot"].to_numpy(np.int64)] = np.log2(rows["c"].to_numpy(np.float64)).astype(np.uint8)
    return classes


def sets_and_bits(docs: DataFrame) -> DataFrame:
    """``doc_id, sid, n, bits`` of each document; its set's bitmap once per task and set."""

    def run(batches):
        seen: set[int] = set()
        for batch, texts in tn.chunks(batches):
            ids, ns, bits = [], [], []
            for s in tn.shingle_sets(texts):
                ids.append(set_id(s))
                ns.append(len(s))
                new = len(s) and ids[-1] not in seen
                bits.append(bitmap(s, int(width(band(len(s))))) if new else None)
                if new:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(ids[-1])
            yield {"doc_id": batch.column("doc_id").cast(pa.int64()), "sid": ids, "n": ns, "bits": bits}

    return map_arrow(docs, run, "doc_id long, sid long, n long, bits binary")


def prefixes(docs: DataFrame, classes) -> DataFrame:
    """``sid, n, token, salt``: the rarest shingles of each set, once per task and set."""

    def run(batches):
        cls = np.frombuffer(classes.value, np.uint8)
        seen: set[int] = set()
        for _, texts in tn.chunks(batches):
            ids, ns, toks, salts, cut = [], [], [], [], [0]
            for s in tn.shingle_sets(texts):
                n = len(s)
                sid = set_id(s)
                if n and sid not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(sid)
                    ids.append(sid)
                    ns.append(n)
                    c = cls[_slots(s)]
                    p = n - (75 * n + 99) // 100 + 1
                    at = np.argsort(c, kind="stable")[:p] if c.any() else np.arange(p)
                    c = c[at].astype(np.int64)
                    parts = np.where(c >= 11, 1 << np.clip(c - 10, 0, 14), 0)
                    salt = np.where(parts > 0, 1 + (sid & 0x7FFFFFFF) % np.maximum(parts, 1), 0)
                    toks.append(s[at].view(np.int64))
                    salts.append(salt.astype(np.int16))
                    cut.append(cut[-1] + p)
            if ids:
                yield {"sid": ids, "n": ns, "token": lists(cut, np.concatenate(toks), pa.int64()), "salt": lists(cut, np.concatenate(salts), pa.int16())}

    return map_arrow(docs, run, "sid long, n long, token array<long>, salt array<short>")


def shared_tokens(feats: DataFrame) -> DataFrame:
    """Members of tiles that have two or more: token, salt, sid, n and the tile's first member."""

    def run(batches):
        lead, shown, last = None, False, None  # the open tile's first row, whether it is out, and the last sid
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            token, salt, sid, n = cols if lead is None else [np.r_[x, y].astype(y.dtype) for x, y in zip(lead, cols, strict=True)]
            new = np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]
            once = new | np.r_[True, sid[1:] != sid[:-1]]
            if lead is not None and not new[1]:
                once[1] = sid[1] != last
            last = sid[-1]
            token, salt, sid, n, new = token[once], salt[once], sid[once], n[once], new[once]
            first = np.flatnonzero(new)
            size = np.diff(np.r_[first, len(token)])
            group = np.repeat(np.arange(len(first)), size)
            out = (size[group] > 1) | (salt > 0)
            open_shown = bool(out[first[-1]]) or (shown and len(first) == 1)
            if shown:
                out[0] = False
            at, top = np.flatnonzero(out), first[group]
            top = top[at]
            yield {"token": token[at], "salt": salt[at], "sid": sid[at], "n": n[at], "lead": sid[top], "lead_n": n[top]}
            k = first[-1]
            lead, shown = (token[k], salt[k], sid[k], n[k]), open_shown

    rows = feats.select("sid", "n", F.explode(F.arrays_zip("token", "salt")).alias("t")).select("t.token", "t.salt", "sid", "n")
    rows = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "sid")
    return map_arrow(rows, run, "token long, salt short, sid long, n long, lead long, lead_n long")


def _with_end(batches):
    for b in batches:
        if b.num_rows:
            yield b
    yield None


_SIZES = "4 * least({0}, {1}) >= 3 * greatest({0}, {1})"


def first_pairs(live: DataFrame) -> DataFrame:
    """Stars: each member with its tile's first, and the firsts of a split tile with the first of all."""
    star = live.where("sid <> lead").where(_SIZES.format("n", "lead_n")).select(F.col("lead").alias("a"), F.col("lead_n").alias("na"), F.col("sid").alias("b"), F.col("n").alias("nb"))
    leads = live.where("salt > 0").select("token", "lead", "lead_n").distinct()
    top = leads.groupBy("token").agg(F.min(F.struct("lead", "lead_n")).alias("top"))
    between = leads.join(top, "token").where("lead <> top.lead").where(_SIZES.format("lead_n", "top.lead_n")).select(F.col("top.lead").alias("a"), F.col("top.lead_n").alias("na"), F.col("lead").alias("b"), F.col("lead_n").alias("nb"))
    return star.unionByName(between).distinct()


def pass_bound(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs whose bitmaps leave enough overlap possible."""

    def run(batches):
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            odd = np.zeros(len(na), np.int64)
            for k, (x, y) in enumerate(zip(b.column("xa").to_pylist(), b.column("xb").to_pylist(), strict=True)):
                short = min(len(x), len(y))
                odd[k] = np.bitwise_count(fold(np.frombuffer(x, np.uint8), short) ^ fold(np.frombuffer(y, np.uint8), short)).sum()
            keep = np.flatnonzero(similar(na, nb, bound(na, nb, odd)))
            yield {"a": b.column("a").to_numpy()[keep], "b": b.column("b").to_numpy()[keep]}

    both = pairs.join(bits.select(F.col("sid").alias("a"), F.col("bits").alias("xa")), "a").join(bits.select(F.col("sid").alias("b"), F.col("bits").alias("xb")), "b")
    return map_arrow(both.select("a", "na", "b", "nb", "xa", "xb"), run, "a long, b long")


def set_arrays(docs: DataFrame, need: DataFrame) -> DataFrame:
    """The sorted hash arrays of the sets ``need(sid, mark)``, made from the texts again.

    ``mark`` hashes the id of a document that has the set; only those are cut into shingles.
    """

    handle = docs.sparkSession.sparkContext.broadcast(need_blooms(need))

    def run(batches):
        bloom, marks = blooms(handle.value)
        seen = set()
        for _, texts in tn.chunks(marked_only(batches, marks)):
            sids, arrays = [], []
            for s in tn.shingle_sets(texts):
                sid = set_id(s)
                if len(s) and sid not in seen and bloom.has(np.array([sid], np.int64))[0]:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(sid)
                    sids.append(sid)
                    arrays.append(s.tobytes())
            if sids:
                yield {"sid": sids, "hashes": arrays}

    found = map_arrow(docs.withColumn("mark", F.xxhash64(F.col("doc_id").cast("long"))), run, "sid long, hashes binary")
    return found.join(need, "sid", "left_semi").dropDuplicates(["sid"])


def need_blooms(need: DataFrame) -> tuple:
    """Of ``sid`` and of ``mark``, to be broadcast (1 MB each)."""
    return tuple((b.words.tobytes(), b.log2) for b in (Bloom.of(need, "sid"), Bloom.of(need, "mark")))


def blooms(sent: tuple) -> list[Bloom]:
    return [Bloom(np.frombuffer(words, np.uint32), log2) for words, log2 in sent]


def marked_only(batches, marks: Bloom):
    """The rows whose ``mark`` may be wanted."""
    for b in batches:
        keep = marks.has(b.column("mark").to_numpy())
        if keep.any():
            yield b.filter(pa.array(keep))


def settle(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose exact Jaccard similarity is high enough, by intersecting ``arrays(sid, hashes)``.

    A pair's partners meet in the group of its ``a``, in blocks of the ``b`` side,
    so a set with many partners is spread over many tasks.
    """

    def run(batches):
        key, mine = None, None
        for b in batches:
            out_a, out_b = [], []
            rows = zip(b.column("a").to_pylist(), b.column("part").to_pylist(), b.column("sid").to_pylist(), b.column("hashes"), strict=True)
            for a, part, sid, hashes in rows:
                s = np.frombuffer(hashes.as_buffer(), tn.U64)
                if (a, part) != key:
                    if sid != a:
                        raise ValueError("a group must begin with its own set")
                    key, mine = (a, part), s
                elif sid != a:
                    short, long = (s, mine) if len(s) <= len(mine) else (mine, s)
                    at = np.searchsorted(long, short)
                    at[at == len(long)] = 0
                    if similar(len(s), len(mine), int((long[at] == short).sum())):
                        out_a.append(a)
                        out_b.append(sid)
            if out_a:
                yield {"a": out_a, "b": out_b}

    part = F.pmod(F.xxhash64("b"), F.lit(64)).cast("int")
    members = pairs.select("a", part.alias("part"), F.col("b").alias("sid"), F.lit(1).alias("late"))
    own = members.select("a", "part", F.col("a").alias("sid"), F.lit(0).alias("late")).distinct()
    degree = pairs.groupBy("a").count().where("count > 512").select("a").withColumn("many", F.lit(True))
    rows = members.unionByName(own).join(degree, "a", "left").withColumn("part", F.when(F.col("many"), F.col("part")).otherwise(0)).select("a", "part", "sid", "late").distinct()
    rows = rows.join(arrays, "sid").repartition("a", "part").sortWithinPartitions("a", "part", "late")
    return map_arrow(rows.select("a", "part", "sid", "hashes"), run, "a long, b long")


def open_tiles(tiles: DataFrame, comp: DataFrame) -> DataFrame:
    """Members ``token, sid, n, comp, main, g`` of the tiles with several components and at least three members.

    Two members alone have met in the star.
    """
    rows = tiles.select("token", "sid", "n").join(comp.withColumnRenamed("id", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component")
    per = rows.groupBy("token", "comp").agg(F.count("*").alias("k"))
    mixed = per.groupBy("token").agg(F.count("*").alias("kinds"), F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("g")).where("kinds > 1 and g > 2")
    return rows.join(mixed.select("token", F.col("main.comp").alias("main"), "g"), "token")


def main_pairs(rows: DataFrame, tested: DataFrame, turn: int, seeds: int = 4) -> DataFrame:
    """Pairs of members outside their tile's main component with a few members of it, chosen by hash, others in each turn.

    In a large group of near copies nearly all members link with some of these, so
    that few are left to be compared with all.
    """
    some = [F.min(F.struct(F.xxhash64(F.col("sid"), F.lit(turn * seeds + k)).alias("h"), "sid", "n")).alias(f"m{k}") for k in range(seeds)]
    centers = rows.where("comp = main").groupBy("token").agg(*some).select("token", F.explode(F.array_distinct(F.array(*[F.struct(f"m{k}.sid", f"m{k}.n") for k in range(seeds)]))).alias("c"))
    pairs = rows.where("comp <> main").join(centers, "token").where(_SIZES.format("n", "c.n"))
    low, high = F.least(F.struct("sid", "n"), F.col("c")), F.greatest(F.struct("sid", "n"), F.col("c"))
    pairs = pairs.select(low.alias("x"), high.alias("y")).select(F.col("x.sid").alias("a"), F.col("x.n").alias("na"), F.col("y.sid").alias("b"), F.col("y.n").alias("nb")).distinct()
    return pairs.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def met_before(token: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the rows of ``x`` and ``y`` (lowest tokens, padded with ``token``) share a token below ``token``.

    A pair is compared in every tile that both are in, so that the lowest of these
    always proposes it.
    """
    seen = np.zeros(len(x), bool)
    for k in range(x.shape[1]):
        seen |= ((x[:, k, None] == y) & (y < token)).any(axis=1)
    return seen


def remaining_pairs(work: Workspace, rows: DataFrame, bits: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs across components in tiles that still hold several, by size band and block, past the bound.

    Sets that share many tokens meet in many tiles; as a rule only the tile of
    the lowest common token proposes the pair.
    """

    def run(batches, with_bits):
        held = None  # the open tile
        for b in _with_end(batches):
            new = [] if b is None else [b]
            t = pa.Table.from_batches(new if held is None else [*held.to_batches(), *new]) if new or held is not None else None
            if t is None:
                return
            token, bnd, blk = (t[c].to_numpy() for c in ("token", "band", "blk"))
            edge = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (bnd[1:] != bnd[:-1]) | (blk[1:] != blk[:-1])])
            if b is None:
                yield from tiles(t, edge, with_bits)
                return
            yield from tiles(t.slice(0, edge[-1]), edge[:-1], with_bits)
            held = t.slice(edge[-1])
            if held.num_rows > 4 * BLOCK:  # its targets come first: keep them, and work off the asking rows
                yield from tiles(held, np.array([0]), with_bits)
                held = held.filter(pc.equal(held["asks"], 0))

    def tiles(t, edge, with_bits):
        if t.num_rows < 2:
            return
        token, sid, n, comp_, asks, home, minor = (t[c].to_numpy() for c in ("token", "sid", "n", "comp", "asks", "home", "minor"))
        lowest = t["lowest"].combine_chunks()
        size, ask = np.diff(np.r_[edge, len(sid)]), np.add.reduceat(asks, edge)
        use = (ask > 0) & (ask < size) & (np.minimum.reduceat(comp_, edge) != np.maximum.reduceat(comp_, edge))
        bits, out = t["bits"].combine_chunks() if with_bits else None, []
        for lo, m in zip(edge[use].tolist(), size[use].tolist(), strict=True):
            if with_bits:
                raw = bits.slice(lo, m).to_pylist()
                short = min(map(len, raw))
                maps = np.stack([fold(np.frombuffer(x, np.uint8), short) for x in raw])
                maps = maps.view(np.uint64) if short % 8 == 0 else maps
            s, k, c, h, mi = (x[lo : lo + m] for x in (sid, n, comp_, home, minor))
            tok = int(token[lo])
            low = np.full((m, LOWEST), tok, np.int64)
            for r, x in enumerate(lowest.slice(lo, m).to_pylist()):
                low[r, : len(x)] = x
            to, q = np.flatnonzero(asks[lo : lo + m] == 0), np.flatnonzero(asks[lo : lo + m] == 1)
            for part in np.array_split(q, 1 + len(q) * len(to) // 200_000):
                x, y = np.repeat(part, len(to)), np.tile(to, len(part))
                ok = (c[x] != c[y]) & (h[x] | h[y]) & (4 * np.minimum(k[x], k[y]) >= 3 * np.maximum(k[x], k[y])) & (~mi[y] | (s[x] < s[y]))
                x, y = x[ok], y[ok]
                if with_bits and len(x):
                    odd = np.bitwise_count(maps[x] ^ maps[y]).sum(axis=1, dtype=np.int64)
                    ok = similar(k[x], k[y], bound(k[x], k[y], odd))
                    x, y = x[ok], y[ok]
                if len(x):
                    first = ~met_before(tok, low[x], low[y])
                    x, y = x[first], y[first]
                    swap = s[x] > s[y]
                    x, y = np.where(swap, y, x), np.where(swap, x, y)
                    out.append(np.stack([s[x], k[x], s[y], k[y]]))
        if out:
            yield dict(zip(("a", "na", "b", "nb"), np.unique(np.concatenate(out, axis=1), axis=1), strict=True))

    lowest = rows.groupBy("sid").agg(F.slice(F.sort_array(F.collect_set("token")), 1, LOWEST).alias("lowest"))
    rows = rows.join(lowest, "sid").withColumn("minor", F.col("comp") != F.col("main")).withColumn("blocks", F.ceil(F.col("g") / BLOCK).cast("int")).drop("main")
    own = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(_BAND)) + F.lit(1e-9)).cast("int")
    rows = rows.withColumn("own", own).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    rows = rows.withColumn("home", F.col("own") == F.col("band")).drop("own")
    target = rows.withColumn("asks", F.lit(0)).withColumn("blk", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    asking = rows.where("minor").withColumn("asks", F.lit(1)).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = target.unionByName(asking)
    columns, ddl = ["token", "band", "blk", "asks", "sid", "n", "comp", "home", "minor", "lowest"], "a long, na long, b long, nb long"

    def dealt(tiles, more=()):
        return tiles.select(*columns, *more).repartition("token", "band", "blk").sortWithinPartitions("token", "band", "blk", "asks")

    def fresh(pairs):
        return pairs.distinct().join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")

    # one after the other, so that the shuffles of both never lie on disk together
    few = map_arrow(dealt(both.where(F.col("g") <= SMALL)), partial(run, with_bits=False), ddl)
    few = work.save(pass_bound(fresh(few), bits), "few")
    release(work.spark)
    many = map_arrow(dealt(both.where(F.col("g") > SMALL).join(bits, "sid"), ["bits"]), partial(run, with_bits=True), ddl)
    return few.unionByName(fresh(many).select("a", "b")).distinct()


def needed(work: Workspace, pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """``sid, mark`` of the sets in the pairs, saved."""
    return work.save(marks.join(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid", "left_semi"), "need")


def link_sets(work: Workspace, feats: DataFrame, arrays, tokens: DataFrame | None = None) -> DataFrame:
    """``id, component`` of the sets that link, of ``feats(sid, bits)`` and ``tokens(sid, n, token, salt)``.

    Sets that share a token are compared; ``arrays(pairs)`` gives the sorted hashes
    of the sets in pairs.  ``feats`` must be a saved table; it is deleted once read.
    Without ``tokens`` it has these columns, too.
    """
    live = work.save(shared_tokens(feats.where("bits is not null") if tokens is None else tokens), "live")
    release(work.spark)
    ids = live.select("sid").distinct()
    bits = work.save(feats.where("bits is not null").select("sid", "bits").join(ids, "sid", "left_semi").dropDuplicates(["sid"]), "bits")
    work.drop(feats)
    likely = work.save(pass_bound(first_pairs(live), bits), "likely")
    links = work.save(settle(likely, arrays(likely)), "links")
    release(work.spark)
    comp = work.save(components(work, links), "first")
    tiles = work.save(open_tiles(live, comp), "open")
    work.drop(live)
    many, turn, found, links = bits.count(), 0, None, links.limit(0)
    # again while that still joins much (a tenth of the sets): the rest is then compared with all
    while found is None or 10 * found > many:
        rest = work.save(pass_bound(main_pairs(tiles, likely, turn), bits), "main")
        more = work.save(settle(rest, arrays(rest)), "more")
        likely, links, found, turn = likely.unionByName(rest), links.unionByName(more), more.count(), turn + 1
        if found:
            comp = relabel(work, comp, more)
            before, tiles = tiles, work.save(open_tiles(tiles, comp), "open")
            work.drop(before)
    release(work.spark)
    rest = work.save(remaining_pairs(work, tiles, bits, likely), "rest")
    links = links.unionByName(settle(rest, arrays(rest)))
    # ids of one name are connected, so the names and the links since the first components have all
    comp = work.save(components(work, comp.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links)), "comp")
    release(work.spark)
    return comp


def jaccard_join(docs: DataFrame, name: str = "jaccard") -> DataFrame:
    """``doc_id, n_shingles, component_id, n_copies`` for each row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable by links; ``n_copies`` counts
    the rows with an equal set.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs_of(docs, "doc_id", "text")
    work = Workspace(spark, name)
    classes = spark.sparkContext.broadcast(frequency_classes(docs).tobytes())
    # the tokens go straight into their shuffle: saved, they would be most of the disk
    feats = work.save(sets_and_bits(docs), "features")
    sets = work.save(feats.select("doc_id", "sid", "n"), "sets")
    classes_of = work.save(sets.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "copies")
    comp = link_sets(work, feats, lambda pairs: set_arrays(docs, needed(work, pairs, classes_of.select("sid", F.xxhash64("first").alias("mark")))), prefixes(docs, classes))
    named = work.save(classes_of.join(comp.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid")), "classes")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    named = named.join(least, "component").select("sid", "least", "copies")
    out = sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(named, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("n_copies"))
