"""Resharding by minimum-cost flow.

Documents lie in shards as saved files.  Given old shards of any sizes and new
shards with equal capacities (the law ``bytes``: sizes near equal), the moves are
planned on blocks: texts with the same hash modulo ``BLOCKS`` form a block, so
equal texts stay together.  A block larger than a quarter of a new shard is cut
into pieces by another hash of the text, never by anything else, so equal texts
still share a shard.  Only a group of equal texts that is larger than its share
can make a shard larger than the others, by no more than that group's size.

The transport problem from old to new shards is a minimum-cost flow (staying is
free, a moved byte costs one), solved by successive shortest paths.  A shard's
files hold ranges of blocks; each edge's flow is filled with blocks from one end
of these ranges, so the moved blocks lie in few files.  Only files that hold a
moved block are rewritten; the others stay as they are.  The block table has a
bounded size, so the planning runs on the driver.

Defined results: a null text has size 1 like an empty one and crc32 0, and shares
its shard.  Rows that share a doc_id are placed one by one, by their texts.  A very
long text is a block's part like any other.  Columns other than doc_id and text are
never read.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, docs_of

BLOCKS, PIECES, RANKS = 8192, 1024, 512
#: Ranges of blocks (folders) of a shard at least and at most, and the bytes that one should have.
LEAST_RANGES, MOST_RANGES, RANGE_BYTES = 16, 1024, 256 << 20
#: Bytes of text that one task writes at most before a range is dealt to several.
TASK_BYTES = 16 << 20


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> np.ndarray:
    """Flow[i, j] of all supply at the least total ``cost(i, j)``, by successive shortest paths."""
    n, m = len(supply), len(capacity)
    flow = np.zeros((n, m), np.int64)
    left, room = np.array(supply, np.int64), np.array(capacity, np.int64)
    c = np.array([[cost(i, j) for j in range(m)] for i in range(n)], np.int64)
    if left.sum() > room.sum():
        raise ValueError("the capacities are too small")
    while left.any():
        # Bellman-Ford over sources with supply left, residual edges forward and back
        dist_s = np.where(left > 0, 0, 1 << 40)
        dist_t, via_t, via_s = np.full(m, 1 << 40), np.full(m, -1), np.full(n, -1)
        for _ in range(n + m):
            step = dist_s[:, None] + c
            best = step.argmin(axis=0)
            better = step[best, np.arange(m)] < dist_t
            dist_t[better], via_t[better] = step[best, np.arange(m)][better], best[better]
            back = np.where(flow > 0, dist_t[None, :] - c, 1 << 40)
            pick = back.argmin(axis=1)
            less = back[np.arange(n), pick] < dist_s
            dist_s[less], via_s[less] = back[np.arange(n), pick][less], pick[less]
            if not better.any() and not less.any():
                break
        t = int(np.where(room > 0, dist_t, 1 << 41).argmin())
        path, amount, j = [], room[t], t
        while True:
            i = int(via_t[j])
            path.append((i, j, 1))
            if via_s[i] < 0:
                amount = min(amount, left[i])
                break
            j = int(via_s[i])
            path.append((i, j, -1))
            amount = min(amount, flow[i, j])
        for i, j, sign in path:
            flow[i, j] += sign * amount
        left[path[-1][0]] -= amount
        room[t] -= amount
    return flow


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def plan(units: list[tuple[int, int, int, int]], old: int, new: int) -> dict[int, int]:
    """New shard of each unit, from (unit, old shard, range of the shard, bytes)."""
    capacity = capacities(sum(u[3] for u in units), new)
    supply = [sum(u[3] for u in units if u[1] == i) for i in range(old)]
    flow = min_cost_flow(supply, capacity, lambda i, j: 0 if i == j else 1)
    place, got = {}, np.zeros(new, np.int64)
    for i in range(old):
        goal = {j: int(flow[i, j]) for j in range(new) if j != i and flow[i, j]}
        # from the last range on: to each goal until the next unit would leave it further from its flow
        rows = sorted((u for u in units if u[1] == i), key=lambda u: (u[2], u[0]), reverse=True)
        for unit, _, _, size in rows:
            fits = [j for j, x in goal.items() if 2 * x >= size > 0]
            j = max(fits, key=lambda j: goal[j]) if fits else i if i < new else int((got - capacity).argmin())
            if j in goal:
                goal[j] -= size
            place[unit] = j
            got[j] += size
    _even_out(units, place, got)
    return place


def _even_out(units, place, got) -> None:
    """Move units from the fullest shard that can give to the emptiest while that narrows the gap; out of files that change anyway if possible.

    Every move lowers the sum of the squared sizes, so this ends.
    """
    if not units:
        return
    touched = {(i, r) for unit, i, r, _ in units if place[unit] != i}
    small = max(1, int(got.sum()) // (100 * len(got)))
    by_shard: dict[int, list] = {}
    for unit, i, r, size in units:
        by_shard.setdefault(place[unit], []).append((size, unit, (i, r) in touched))
    while True:
        lo = int(got.argmin())
        for hi in np.argsort(-got).tolist():  # a shard with one oversized unit can give nothing: the next may
            gap = int(got[hi] - got[lo])
            fits = [x for x in by_shard.get(hi, []) if 0 < x[0] < gap]
            fits = [x for x in fits if x[2]] or (fits if gap > small else [])
            if fits:
                break
        else:
            return
        best = min(fits, key=lambda x: (abs(gap - 2 * x[0]), x[1]))
        by_shard[hi].remove(best)
        by_shard.setdefault(lo, []).append(best)
        place[best[1]] = lo
        got[hi] -= best[0]
        got[lo] += best[0]


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _block() -> Column:
    return F.pmod(F.xxhash64(_text()), F.lit(BLOCKS)).cast("int")


def _size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def lay_out(docs: DataFrame, shards: int, work: Workspace) -> tuple[str, list[tuple[int, int]], int]:
    """Write an old layout: a folder per shard and range of blocks; path, (block, bytes) and the ranges of a shard.

    A range that is large, as it has a block with many copies, is written by several tasks.
    """
    path = work.path("old")
    sizes = [(int(r.block), int(r.bytes)) for r in docs.groupBy(_block().alias("block")).agg(F.sum(_size()).alias("bytes")).collect()]  # BLOCKS rows at most
    total = sum(b for _, b in sizes)
    ranges = min(MOST_RANGES, max(LEAST_RANGES, total // (shards * RANGE_BYTES)))
    load: dict[tuple[int, int], int] = {}
    for block, size in sizes:
        key = block % shards, block // shards * ranges // (BLOCKS // shards + 1)
        load[key] = load.get(key, 0) + size
    parts = {s * ranges + r: 1 + size // TASK_BYTES for (s, r), size in load.items() if size > TASK_BYTES}
    shard, span = F.pmod("block", F.lit(shards)), F.floor(F.floor(F.col("block") / shards) * ranges / (BLOCKS // shards + 1))
    rows = docs.withColumn("block", _block()).withColumn("shard", shard.cast("int")).withColumn("span", span.cast("int"))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64(_text(), F.lit(1)), F.lit(PIECES)).cast("int"))
    many = F.lit(1)
    if parts:
        table = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
        many = F.coalesce(F.try_element_at(table, F.col("shard") * ranges + F.col("span")), F.lit(1))
    deal = F.pmod(F.xxhash64("doc_id"), many)
    n = max(len(load), sum(parts.values()), 1)
    rows.withColumn("deal", deal).repartition(n, "shard", "span", "deal").drop("deal").write.partitionBy("shard", "span").parquet(path)
    return path, sizes, ranges


def reshard(docs: DataFrame, old_shards: int, new_shards: int) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, read from the files of the new layout."""
    spark = docs.sparkSession
    work = Workspace(spark, "shards")
    docs = docs_of(docs, "doc_id", "text")
    path, sizes, ranges = lay_out(docs, old_shards, work)
    schema = "doc_id long, text string, block int, piece int, shard int, span int"
    old = spark.read.schema(schema).parquet(path)
    span = lambda block: block // old_shards * ranges // (BLOCKS // old_shards + 1)
    hot = {b for b, size in sizes if 4 * new_shards * size > sum(x for _, x in sizes)}
    units = [(b, b % old_shards, span(b), size) for b, size in sizes if b not in hot]
    is_hot = F.col("block").isin(sorted(hot)) if hot else F.lit(False)
    unit = F.when(is_hot, F.col("block") + BLOCKS * (1 + F.col("piece"))).otherwise(F.col("block")).cast("int")
    if hot:  # at most 4 * new_shards blocks of PIECES pieces
        spans = F.col("shard") * ranges + F.col("span")
        pieces = old.where(spans.isin(sorted({b % old_shards * ranges + span(b) for b in hot})) & is_hot).groupBy("block", unit.alias("unit")).agg(F.sum(_size()).alias("bytes"))
        units += [(r.unit, r.block % old_shards, span(r.block), r.bytes) for r in pieces.collect()]
    place = plan(units, old_shards, new_shards)
    moves = [(u, place[u]) for u, i, _, _ in units if place[u] != i]
    touched = sorted({i * ranges + r for u, i, r, _ in units if place[u] != i})
    changes = (F.col("shard") * ranges + F.col("span")).isin(touched) if touched else F.lit(False)  # on folders' names only
    table = spark.createDataFrame(moves or [(-1, 0)], "unit int, to int")  # at most BLOCKS + 4 * new_shards * PIECES rows
    new_path = work.path("new")
    moving = old.where(changes).withColumn("unit", unit).join(F.broadcast(table), "unit", "left").withColumn("shard", F.coalesce("to", "shard"))
    moving.select("doc_id", "text", "block", "piece", "shard", "span").write.partitionBy("shard", "span").parquet(new_path)
    result = old.where(~changes).unionByName(spark.read.schema(schema).parquet(new_path))
    # slots: a rank inside a small piece of a shard, after the pieces before it
    rows = result.select("doc_id", _size().alias("size"), F.crc32(_text().cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.pmod(F.xxhash64("doc_id", "block"), F.lit(RANKS)).alias("rank_in"))
    count = rows.groupBy("shard", "rank_in").agg(F.count("*").alias("n"))
    before = count.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("rank_in")) - F.col("n")).drop("n")
    inner = F.row_number().over(Window.partitionBy("shard", "rank_in").orderBy("doc_id", "text_crc32")) - 1
    out = rows.withColumn("inner", inner).join(before, ["shard", "rank_in"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.col("inner")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
