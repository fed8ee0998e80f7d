"""Sparse Merkle trie over 256-bit keys: roots, proofs and their verification.

A subtree without keys is empty; one with a single key is that key's leaf,
``H(key | value | height)`` with the height's low byte; any other is ``H(left |
right)``, an empty child being one zero byte.  The root depends on the set of keys
and values only.  Keys are folded per prefix of 16 bits in parallel, these nodes per
prefix of 8 bits; the driver joins the 256 results.  The nodes at these depths can
be kept, so that an update folds only what it touches and a proof looks them up.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import cut

EMPTY, HEIGHT, TOP, DEEP = b"\0", 256, 8, 16


def _h(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()


def _bit(key: bytes, i: int) -> int:
    return key[i >> 3] >> (7 - (i & 7)) & 1


def leaf_hash(key: bytes, value: bytes, depth: int) -> bytes:
    return _h(key, value, bytes([(HEIGHT - depth) & 255]))


@dataclass
class Tree:
    """A subtree: number of keys, and its hash or its only leaf."""

    n: int
    hash: bytes = b""
    key: bytes = b""
    value: bytes = b""

    def at(self, depth: int) -> bytes:
        """The node's hash when its root is at this depth."""
        return EMPTY if self.n == 0 else leaf_hash(self.key, self.value, depth) if self.n == 1 else self.hash


def join(left: Tree, right: Tree, depth: int) -> Tree:
    """The subtree at ``depth`` with these children."""
    n = left.n + right.n
    if n < 2:
        return left if left.n else right
    return Tree(n, _h(left.at(depth + 1), right.at(depth + 1)))


def fold(leaves: list[tuple[bytes, bytes]], depth: int = 0) -> Tree:
    """The subtree of sorted leaves that agree on the first ``depth`` bits."""
    if not leaves:
        return Tree(0)
    if len(leaves) == 1:
        return Tree(1, b"", *leaves[0])
    lo, hi = 0, len(leaves)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if _bit(leaves[mid][0], depth) == 0 else (lo, mid)
    return join(fold(leaves[:lo], depth + 1), fold(leaves[lo:], depth + 1), depth)


NODE = "prefix string, n long, hash string, key string, value string"
_COLUMNS = [x.split()[0] for x in NODE.split(", ")]


def _row(prefix: str, t: Tree) -> tuple:
    return prefix, t.n, t.hash.hex(), t.key.hex(), t.value.hex()


def _tree(r) -> Tree:
    return Tree(r["n"], bytes.fromhex(r["hash"]), bytes.fromhex(r["key"]), bytes.fromhex(r["value"]))


def _by_prefix(rows: DataFrame, digits: int, fold_one) -> DataFrame:
    """Nodes of each prefix of so many hex digits: rows are dealt by prefix, sorted, and folded as they stream.

    ``fold_one`` gets a prefix and its rows; one prefix is held at a time.
    """
    name = rows.columns[0]

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([pa.field("prefix", pa.string()), pa.field("n", pa.int64()), *[pa.field(c, pa.string()) for c in _COLUMNS[2:]]])
        prefix, held = None, []

        def out(done):
            return pa.RecordBatch.from_pydict(dict(zip(_COLUMNS, zip(*done, strict=True), strict=True)), schema=schema)

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                p = r[name][:digits]
                if p != prefix:
                    if held:
                        done.append(_row(prefix, fold_one(prefix, held)))
                    prefix, held = p, []
                held.append(r)
            if done:
                yield out(done)
        if held:
            yield out([_row(prefix, fold_one(prefix, held))])

    # the first digits spread the prefixes evenly, as keys are hashes
    return rows.repartition(F.substring(name, 1, digits)).sortWithinPartitions(name).mapInArrow(run, NODE)


def _fold_leaves(prefix: str, rows: list[dict]) -> Tree:
    return fold([(bytes.fromhex(r["key"]), bytes.fromhex(r["value"])) for r in rows], 4 * len(prefix))


def _fold_children(prefix: str, rows: list[dict]) -> Tree:
    found = {r["prefix"]: _tree(r) for r in rows}
    return _join_all([found.get(f"{prefix}{k:02x}", Tree(0)) for k in range(1 << TOP)], 4 * len(prefix))


def nodes(leaves: DataFrame) -> DataFrame:
    """``prefix, n, hash, key, value``: the nodes at depths DEEP, TOP and 0 of ``leaves(key, value)`` in hex, saved.

    Leaves are folded per prefix of DEEP bits, then 256 nodes each per prefix of TOP
    bits, then these.  Empty subtrees have no row.
    """
    deep = cut(_by_prefix(leaves.select("key", "value"), DEEP // 4, _fold_leaves), "nodes")
    top = cut(_by_prefix(deep, TOP // 4, _fold_children), "nodes")
    return deep.unionByName(top).unionByName(_top(top))


def _top(top: DataFrame) -> DataFrame:
    t = _join_all(_collected(top), 0)
    return top.sparkSession.createDataFrame([_row("", t)] if t.n else [], NODE)


def update(old: DataFrame, leaves: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new nodes, new leaves) after ``changes(key, value)``: upserts, and deletions where ``value`` is null.

    Only the prefixes of changed keys are folded again, then the prefixes above them;
    each key occurs once in ``changes``.
    """
    changes = cut(changes.select("key", "value"), "changes")
    fresh = leaves.select("key", "value").join(changes.select("key"), "key", "left_anti").unionByName(changes.where("value is not null"))
    at = F.length("prefix")
    out = []
    rows, digits = fresh, DEEP // 4
    while digits:
        touched = changes.select(F.substring("key", 1, digits).alias("touched")).distinct()
        name = rows.columns[0]
        some = rows.join(touched, F.substring(name, 1, digits) == F.col("touched"), "left_semi")
        again = _by_prefix(some, digits, _fold_leaves if name == "key" else _fold_children)
        level = old.where(at == digits).join(touched, F.col("prefix") == F.col("touched"), "left_anti").unionByName(again)
        rows, digits = cut(level, "nodes"), digits - TOP // 4
        out.append(rows)
    found = out[0]
    for level in out[1:]:
        found = found.unionByName(level)
    return found.unionByName(_top(out[-1])), fresh


def _join_all(trees: list[Tree], depth: int) -> Tree:
    """Neighbouring subtrees, a power of two of them, joined up to the node at ``depth``."""
    level = depth + (len(trees) - 1).bit_length()
    while len(trees) > 1:
        level -= 1
        trees = [join(a, b, level) for a, b in zip(trees[::2], trees[1::2], strict=True)]
    return trees[0]


def _collected(parts: DataFrame) -> list[Tree]:
    found = {int(r.prefix, 16): _tree(r) for r in parts.collect()}  # 256 rows at most
    return [found.get(k, Tree(0)) for k in range(1 << TOP)]


def root_of(nodes: DataFrame) -> str | None:
    """The root in hex; null for no leaves."""
    r = nodes.where("prefix = ''").first()
    return _tree(r).at(0).hex() if r else None


def root(leaves: DataFrame) -> str | None:
    return root_of(nodes(leaves))


def audit(leaves: list[tuple[bytes, bytes]], key: bytes, depth: int = 0) -> tuple[list[bytes], Tree]:
    """Siblings from the deepest up, and the subtree (empty or one leaf) that ends the key's path."""
    return Subtree(leaves, depth).audit(key)


class Subtree:
    """Sorted leaves that agree on the first ``depth`` bits, folded once; proofs then only look nodes up."""

    def __init__(self, leaves: list[tuple[bytes, bytes]], depth: int):
        self.leaves, self.depth, self.known = leaves, depth, {}

    def _split(self, lo: int, hi: int, depth: int) -> int:
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if _bit(self.leaves[mid][0], depth) == 0 else (lo, mid)
        return lo

    def node(self, lo: int, hi: int, depth: int) -> tuple[Tree, int]:
        """The subtree of leaves lo .. hi-1 and where its right half begins."""
        if hi - lo < 2:
            return (Tree(1, b"", *self.leaves[lo]) if hi > lo else Tree(0)), hi
        got = self.known.get((lo, hi, depth))
        if got is None:
            mid = self._split(lo, hi, depth)
            got = self.known[lo, hi, depth] = join(self.node(lo, mid, depth + 1)[0], self.node(mid, hi, depth + 1)[0], depth), mid
        return got

    def audit(self, key: bytes) -> tuple[list[bytes], Tree]:
        path, lo, hi, depth = [], 0, len(self.leaves), self.depth
        while hi - lo > 1:
            mid = self.node(lo, hi, depth)[1]
            right = _bit(key, depth)
            other = (lo, mid) if right else (mid, hi)
            path.append(self.node(*other, depth + 1)[0].at(depth + 1))
            (lo, hi), depth = (mid, hi) if right else (lo, mid), depth + 1
        return path[::-1], self.node(lo, hi, depth)[0]


def proofs(queries: DataFrame, leaves: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """``key, path, included, proof_key, proof_value`` (hex; path from leaf to root) for ``queries(key)``.

    Queries meet the leaves of their prefix of DEEP bits, which is folded once; the
    siblings above come from the saved ``nodes`` (at most 2**DEEP + 2**TOP rows, which
    is the size of the broadcast).
    """
    saved = nodes(leaves) if saved is None else saved
    table = {r.prefix: (r.n, r.hash, r.key, r.value) for r in saved.where("prefix <> ''").collect()}
    handle = leaves.sparkSession.sparkContext.broadcast(table)
    schema = "key string, path array<string>, included boolean, proof_key string, proof_value string"
    digits, known = DEEP // 4, {}

    def levels(parent: str) -> list[list[Tree]]:
        """The nodes below ``parent``, from TOP bits deeper up to its two children."""
        if parent not in known:
            get = lambda p: Tree(t[0], *map(bytes.fromhex, t[1:])) if (t := handle.value.get(p)) else Tree(0)
            level, depth = [get(f"{parent}{c:02x}") for c in range(1 << TOP)], 4 * len(parent) + TOP
            known[parent] = [level]
            while len(level) > 2:
                depth -= 1
                level = [join(a, b, depth) for a, b in zip(level[::2], level[1::2], strict=True)]
                known[parent].append(level)
        return known[parent]

    def above(prefix: str) -> list[tuple[bytes, Tree]]:
        """(sibling hash, sibling), from depth DEEP up."""
        out = []
        for at in range(digits, 0, -(TOP // 4)):
            k = int(prefix[at - TOP // 4 : at], 16)
            for up, level in enumerate(levels(prefix[: at - TOP // 4])):
                other = level[k >> up ^ 1]
                out.append((other.at(4 * at - up), other))
        return out

    def answer(prefix: str, keys: list[str], rows: list[tuple[bytes, bytes]]) -> list[tuple]:
        tree, upper, out = Subtree(rows, 4 * digits), above(prefix), []
        for hexkey in keys:
            key = bytes.fromhex(hexkey)
            path, end = tree.audit(key)
            n = len(rows)
            for sibling, other in upper:
                # a lone leaf rises until some sibling has keys; an empty place takes a sibling's lone leaf
                if n + other.n > 1 or path:
                    path.append(sibling)
                elif n == 0 and other.n == 1:
                    end = other
                n += other.n
            out.append((hexkey, [p.hex() for p in path], end.n == 1 and end.key == key, end.key.hex() if end.n else None, end.value.hex() if end.n else None))
        return out

    def run(batches):
        import pyarrow as pa

        kinds = pa.schema([("key", pa.string()), ("path", pa.list_(pa.string())), ("included", pa.bool_()), ("proof_key", pa.string()), ("proof_value", pa.string())])
        prefix, keys, rows = None, [], []
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["p"] != prefix:
                    done += answer(prefix, keys, rows) if keys else []
                    prefix, keys, rows = r["p"], [], []
                if r["value"] is None:
                    keys.append(r["key"])
                else:
                    rows.append((bytes.fromhex(r["key"]), bytes.fromhex(r["value"])))
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(kinds.names, zip(*done, strict=True), strict=True)), schema=kinds)
        if keys:
            yield pa.RecordBatch.from_pydict(dict(zip(kinds.names, zip(*answer(prefix, keys, rows), strict=True), strict=True)), schema=kinds)

    part = F.substring("key", 1, digits).alias("p")
    asked = queries.select("key").distinct().select(part, "key", F.lit(None).cast("string").alias("value"))
    some = leaves.select(part, "key", "value").join(asked.select("p").distinct(), "p", "left_semi")
    both = some.unionByName(asked).repartition("p").sortWithinPartitions("p", "key")
    return both.mapInArrow(run, schema)


def verify_inclusion(root_hex: str, path: list[str], key: str, value: str) -> bool:
    k = bytes.fromhex(key)
    node = leaf_hash(k, bytes.fromhex(value), len(path))
    return _climb(node, path, k).hex() == root_hex


def _climb(node: bytes, path: list[str], key: bytes) -> bytes:
    for i, sibling in enumerate(path):
        s = bytes.fromhex(sibling)
        node = _h(s, node) if _bit(key, len(path) - 1 - i) else _h(node, s)
    return node


def verify_absence(root_hex: str | None, path: list[str], key: str, proof_key: str | None, proof_value: str | None) -> bool:
    """An empty tree, an empty place, or another key's leaf on the way."""
    if root_hex is None:
        return True
    k = bytes.fromhex(key)
    if proof_key is None:
        return _climb(EMPTY, path, k).hex() == root_hex
    other = bytes.fromhex(proof_key)
    return other != k and all(_bit(other, i) == _bit(k, i) for i in range(len(path))) and verify_inclusion(root_hex, path, proof_key, proof_value)


def compress(path: list[str]) -> tuple[str, list[str], int]:
    """Bitmap of the siblings that are not empty, those siblings, and the path's length."""
    return "".join("0" if p == "00" else "1" for p in path), [p for p in path if p != "00"], len(path)


def expand(bits: str, siblings: list[str], length: int) -> list[str]:
    rest = iter(siblings)
    return [next(rest) if b == "1" else "00" for b in bits[:length]]


def verify_inclusion_compressed(root_hex: str, bits: str, siblings: list[str], length: int, key: str, value: str) -> bool:
    return verify_inclusion(root_hex, expand(bits, siblings, length), key, value)


def verify_absence_compressed(root_hex: str | None, bits: str, siblings: list[str], length: int, key: str, proof_key: str | None, proof_value: str | None) -> bool:
    return verify_absence(root_hex, expand(bits, siblings, length), key, proof_key, proof_value)


def get(leaves: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, value`` of the asked keys; a null value for those that are not there."""
    return keys.select("key").distinct().join(leaves.select("key", "value"), "key", "left")
