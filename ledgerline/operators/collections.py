"""Hashes, sets, sorted sets: one state per member, counted, intersected or ranged.

A null key or member is a value of its own; a null ``deleted`` counts as not deleted; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .strings import live_before


def created(log: DataFrame) -> DataFrame:
    """(key, version, sub, created): whether each write made its record (HSET, SADD and ZADD count these)."""
    return live_before(log).filter(~F.col("deleted")).select("key", "version", "sub", (~F.col("was")).alias("created"))


def removed(log: DataFrame) -> DataFrame:
    """(key, version, sub, removed): whether each delete found its record (HDEL, SREM and ZREM count these)."""
    return live_before(log).filter("deleted").select("key", "version", "sub", F.col("was").alias("removed"))


def members(state: DataFrame) -> DataFrame:
    return state.select("key", "sub")


def size(state: DataFrame) -> DataFrame:
    """(key, n): HLEN, SCARD."""
    return state.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def intersect(state: DataFrame, keys: list[str]) -> DataFrame:
    """Members (sub) that all of the sets hold: one aggregate, however many sets; a missing set makes it empty."""
    wanted = sorted(set(keys))
    return state.filter(F.col("key").isin(wanted)).select("key", "sub").distinct().groupBy("sub").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == len(wanted)).select("sub")


def score_range(state: DataFrame, low: float, high: float) -> DataFrame:
    """Live members with low <= score <= high, both ends included, infinities allowed; NaN scores never match."""
    return state.filter(~F.isnan("score") & F.col("score").between(low, high))
