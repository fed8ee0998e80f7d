"""Identifiers: SHA-256 in lower-case hex, shards, glued lists, presence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha_id(text: Column) -> Column:
    return F.sha2(text, 256)


def shard(hex_id: Column, bits: int = 5) -> Column:
    """The most significant bits of an id."""
    return F.shiftright(F.conv(F.substring(hex_id, 1, 2), 16, 10).cast("int"), 8 - bits)


def shard_low(hex_id: Column, bits: int = 5) -> Column:
    """The high bits of an id's last byte."""
    return F.shiftright(F.conv(F.substring(hex_id, 63, 2), 16, 10).cast("int"), 8 - bits)


def glue(ids: Column) -> Column:
    """Distinct ids of an array, sorted, concatenated."""
    return F.concat_ws("", F.array_sort(F.array_distinct(ids)))


def split_ids(glued: Column) -> Column:
    """Array of the 64-digit ids of a glued list; null for an empty one."""
    n = (F.length(glued) / 64).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(glued, i * 64 + 1, F.lit(64))))


def list_digest(glued: Column) -> Column:
    """SHA-256 of the bytes of a glued list; null stays null."""
    return F.sha2(F.unhex(glued), 256)


def partition_bits(count: int) -> int:
    """Bits that number ``count`` partitions."""
    return max(0, (count - 1).bit_length())
