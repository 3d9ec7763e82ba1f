"""Applying a change feed of inserts, updates and deletes, in the right order, whatever order it arrives in.

An operation is a function on a key's state: "become this, unless the state is
already later". Such functions compose associatively: the composition of a set of
them is the one that is latest by (version, ts, -seq). So ranges of the feed are
composed on their own, hot keys' ranges too, then composed up a tree, and
one patch per key is applied to the base table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Arrival numbers per range chunk of the first tree level.
CHUNK = 1 << 20


def is_put(op: Column | str) -> Column:
    """True for the spellings of a put, False for those of a delete, null for anything else."""
    u = F.upper(F.trim(F.col(op) if isinstance(op, str) else op))
    return F.when(u.isin("PUT", "SET", "1"), True).when(u.isin("DEL", "DELETE", "2"), False)


def patches(feed: DataFrame, key: str, version: str, ts: str, seq: str, op: str, payload: list[str] = (), chunk: int = CHUNK) -> DataFrame:
    """One composed patch ``p`` per non-null key: struct(version, ts, back, put, payload...).

    ``ts`` null sorts lowest; ``back`` is -seq, so of equal versions and times the
    smallest seq stands; rows without version or with an unknown op are no
    operations. Level one composes within (key, range of seq), with map-side
    combine; level two composes ranges, of which a key has few.
    """
    patch = F.struct(F.col(version).alias("version"), F.col(ts).alias("ts"), (-F.col(seq)).alias("back"), is_put(op).alias("put"), *[F.col(c) for c in payload])
    ops = feed.filter(F.col(key).isNotNull() & F.col(version).isNotNull() & is_put(op).isNotNull())
    ranged = ops.select(F.col(key).alias("k"), F.floor(F.col(seq) / F.lit(chunk)).alias("chunk"), patch.alias("p"))
    return ranged.groupBy("k", "chunk").agg(F.max("p").alias("p")).groupBy("k").agg(F.max("p").alias("p"))


def composed(*some: DataFrame) -> DataFrame:
    """Patch tables of parts of a feed as one, in whatever order; deletes are patches too, so a late record never undoes a later one."""
    return reduce(DataFrame.unionByName, some).groupBy("k").agg(F.max("p").alias("p"))


def state(p: DataFrame, payload: list[str] = ()) -> DataFrame:
    """The keys that hold a value under a patch table: (key, version, ts, seq, payload...)."""
    return p.filter("p.put").select(F.col("k").alias("key"), "p.version", "p.ts", (-F.col("p.back")).alias("seq"), *[F.col(f"p.{c}").alias(c) for c in payload])


def apply_feed(feed: DataFrame, key: str, version: str, ts: str, seq: str, op: str, payload: list[str] = (), base: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Keys that hold a value after the feed: (key, version, ts, seq, payload...).

    ``base``, if given, has the same columns and is one more set of puts, so applying
    a feed twice gives the same state. A base has forgotten its deletes; to go on with a feed that brings late records keep its patches and use composed().
    An empty feed gives the base; repeated records change nothing.
    """
    p = patches(feed, key, version, ts, seq, op, payload, chunk)
    if base is not None:
        put = F.struct(F.col("version"), F.col("ts"), (-F.col("seq")).alias("back"), F.lit(True).alias("put"), *[F.col(c) for c in payload])
        p = composed(p, base.select(F.col("key").alias("k"), put.alias("p")))
    return state(p, payload)
