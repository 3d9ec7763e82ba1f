"""Bitmaps as one row per written bit (key, off, bit, version); pages of 32768 bits, 4096 bytes, exist where a bit was written.

A null key is a key; a null bit counts as 0; writes with a null or negative offset are refused; of two writes of a bit at one version the 1 stands; keys without writes have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import per_key
from .scan import previous

PAGE = 32768


def state(bits: DataFrame) -> DataFrame:
    """(key, off, bit): the last write of each bit."""
    return bits.filter("off >= 0").groupBy("key", "off").agg(F.max(F.struct("version", "bit")).alias("r")).select("key", "off", "r.bit")


def setbit(bits: DataFrame) -> DataFrame:
    """(key, off, version, old): the bit before each write; negative offsets are refused."""
    x = previous(bits.filter("off >= 0"), ["key", "off"], "version", "bit", "__b")
    return x.select("key", "off", "version", F.coalesce("__b", F.lit(0)).cast("bigint").alias("old"))


def length(now: DataFrame) -> DataFrame:
    """(key, bytes): allocated bytes; a page is as long as its last written bit's byte."""
    return now.groupBy("key").agg((F.max(F.floor(F.col("off") / 8)) + 1).cast("bigint").alias("bytes"))


def bitcount(now: DataFrame, first: int | None = None, last: int | None = None, unit: str = "BYTE") -> DataFrame:
    """(key, n) of the set bits from first to last inclusive, in bytes or bits; negative ends count from the allocated end; an empty range is 0."""
    if first is None:
        return now.groupBy("key").agg(F.sum("bit").cast("bigint").alias("n"))
    size = F.col("bytes") * (8 if unit == "BIT" else 1)
    a: Column = F.greatest(F.lit(first) if first >= 0 else size + first, F.lit(0))
    z: Column = F.lit(last) if last >= 0 else size + last
    at = F.col("off") if unit == "BIT" else F.floor(F.col("off") / 8)
    inside = (at >= a) & (at <= z)
    if min(first, last) < 0:  # only these need the allocated end
        now = per_key(now, length(now), ["key"])
    return now.groupBy("key").agg(F.count(F.when(inside & (F.col("bit") == 1), 1)).alias("n"))


def pages(now: DataFrame) -> DataFrame:
    """(key, page, n): set bits per page, packed and counted in the JVM."""
    set_ = now.filter("bit = 1").select("key", F.floor(F.col("off") / PAGE).alias("page"), (F.col("off") % PAGE).cast("bigint").alias("at"))
    return set_.groupBy("key", "page").agg(F.bitmap_count(F.bitmap_construct_agg("at")).alias("n"))
