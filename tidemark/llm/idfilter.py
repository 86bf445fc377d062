"""Membership filters as DataFrames, sized from the number of members.

A filter is rows of (slot, 4 KB bitmap) with BITS_A_MEMBER bits a member and one hash: one
other row in BITS_A_MEMBER passes. It is broadcast, so it has MOST_BITS bits (64 MB) at
most; for more members than that there is no filter, and the exact join that follows every
use does the whole work. A filter never loses a member.

Rows travel as one struct beside the key, so no column of theirs can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITMAP = 8 * 4096
BITS_A_MEMBER, LEAST_BITS, MOST_BITS = 16, 1 << 18, 1 << 29


def bits(members: int) -> int | None:
    """Bits of a filter for so many members, a power of two; None where it would be too large to broadcast."""
    need = max(LEAST_BITS, 1 << (members * BITS_A_MEMBER - 1).bit_length()) if members else LEAST_BITS
    return need if need <= MOST_BITS else None


def _place(key: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size))


def build(members: DataFrame, key: str, size: int) -> DataFrame:
    place = members.select(_place(F.col(key), size).alias("at"))
    return place.groupBy((F.col("at") / BITMAP).cast("int").alias("slot")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP).alias("bitmap"))


def flagged(rows: DataFrame, key: Column, members: DataFrame, member: str) -> DataFrame:
    """(row, key, maybe): each row as a struct, its key and whether that may be a member. ``members`` is a written table."""
    packed = rows.select(F.struct("*").alias("row"), key.alias("key"))
    if (size := bits(members.count())) is None:
        return packed.withColumn("maybe", F.lit(True))
    return _flagged(packed, build(members, member, size), size)


def screened(rows: DataFrame, key: Column, filters: DataFrame, size: int) -> DataFrame:
    """The rows that pass a stored filter of ``size`` bits."""
    return _flagged(rows.select(F.struct("*").alias("row"), key.alias("key")), filters, size).where("maybe").select("row.*")


def _flagged(packed: DataFrame, filters: DataFrame, size: int) -> DataFrame:
    at = packed.withColumn("at", _place(F.col("key"), size)).withColumn("slot", (F.col("at") / BITMAP).cast("int"))
    byte = F.expr("cast(conv(hex(substring(bitmap, cast(at % 32768 as int) div 8 + 1, 1)), 16, 10) as int)")
    hit = F.call_function("shiftright", byte, F.expr("cast(at % 8 as int)")).bitwiseAND(F.lit(1)) == 1
    joined = at.join(F.broadcast(filters), "slot", "left")
    return joined.select("row", "key", F.coalesce(hit, F.lit(False)).alias("maybe"))


def semi(rows: DataFrame, key: Column, members: DataFrame, member: str) -> DataFrame:
    """Rows whose key is a member; only rows that pass the filter are shuffled."""
    some = flagged(rows, key, members, member).where("maybe")
    return some.join(members.select(F.col(member).alias("key")).distinct(), "key", "left_semi").select("row.*")


def anti(rows: DataFrame, key: Column, members: DataFrame, member: str) -> DataFrame:
    """Rows whose key is no member: those the filter excludes stay where they are."""
    marked = flagged(rows, key, members, member)
    rest = marked.where("maybe").join(members.select(F.col(member).alias("key")).distinct(), "key", "left_anti")
    return marked.where("not maybe").select("row.*").unionByName(rest.select("row.*"))
