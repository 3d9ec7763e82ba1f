"""Lists: pushes and pops at both ends, replayed without folding a list in one task.

The length is a reflected walk (the running sum of pushes minus pops, less its least
value below 0), so which pops met an empty list follows from a running minimum. The
others move head or tail; an element is known by the position it was pushed to, and a
pop takes the last element pushed to its position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import join_on, materialize, per_key
from .scan import one_range, prefix_scan, previous


def placed(ops: DataFrame, width: int = 1 << 18) -> DataFrame:
    """ops (key, version, op, elem) with push, hit (the op changed the list) and place; unknown ops are left out."""
    ops = ops.filter(F.col("op").isin("LPUSH", "RPUSH", "LPOP", "RPOP")).select("key", "version", "op", "elem")
    push, left = F.col("op").endswith("PUSH"), F.col("op").startswith("L")
    one = one_range(ops, "version", width)
    walk = prefix_scan(ops, ["key"], "version", {"s": F.when(push, 1).otherwise(-1)}, {"s": "low"}, width, one)
    hit = push | (F.col("s") + 1 > F.col("low"))  # a pop of a list that was longer than 0
    walk = walk.select("key", "version", "op", "elem", push.alias("push"), hit.alias("hit"))
    if not one:  # in ranges a scan reads its input twice, so the two in a row are parted by a written table
        walk = materialize(walk, "walk")
    moves = {"h": F.when(F.col("hit") & left, F.when(push, -1).otherwise(1)).otherwise(0), "t": F.when(F.col("hit") & ~left, F.when(push, 1).otherwise(-1)).otherwise(0)}
    at = prefix_scan(walk, ["key"], "version", moves, None, width, one)
    place = F.when(left, F.when(push, F.col("h")).otherwise(F.col("h") - 1)).otherwise(F.when(push, F.col("t") - 1).otherwise(F.col("t")))
    return at.select("key", "version", "op", "elem", "push", "hit", place.alias("place"))


def standing(ops: DataFrame, now: int, as_of: int | None = None) -> DataFrame:
    """The operations that still count: those up to ``as_of``, and per key after its last DEL, and after its last EXPIRE if the time in its elem has come.

    An EXPIRE holds for the elements that are there; later pushes have no expiry. A null key is a key.
    """
    if as_of is not None:
        ops = ops.filter(F.col("version") <= as_of)
    at = F.struct("version", F.col("elem").cast("bigint").alias("at"))
    ends = ops.filter(F.col("op").isin("DEL", "EXPIRE")).groupBy("key").agg(F.max(F.when(F.col("op") == "DEL", F.col("version"))).alias("del"), F.max(F.when(F.col("op") == "EXPIRE", at)).alias("e"))
    over = ends.select("key", F.greatest("del", F.when(F.col("e.at") <= now, F.col("e.version"))).alias("over"))
    return per_key(ops, over, ["key"], "left").filter(F.coalesce(F.col("version") > F.col("over"), F.lit(True))).drop("over")


def ttl(ops: DataFrame, now: int) -> DataFrame:
    """(key, ttl) of the lists that hold something, by their first element: -1 without expiry, else seconds left."""
    live = standing(ops, now)
    head = contents(live).filter("pos = 0").select("key", "version")
    last = live.filter("op = 'EXPIRE'").groupBy("key").agg(F.max(F.struct("version", F.col("elem").cast("bigint").alias("at"))).alias("e"))
    left = F.when(F.col("e.version") > F.col("version"), F.col("e.at") - now).otherwise(F.lit(-1))
    return join_on(head, last, ["key"], "left").select("key", left.cast("bigint").alias("ttl"))


def pops(ops: DataFrame) -> DataFrame:
    """(key, version, op, result) of each pop; of an empty list null."""
    at = materialize(placed(ops), "placed")
    took = previous(at.filter("hit"), ["key", "place"], "version", "elem", "result").filter(~F.col("push"))
    return took.select("key", "version", "op", "result").unionByName(at.filter("not hit").select("key", "version", "op", F.lit(None).cast("string").alias("result")))


def contents(ops: DataFrame) -> DataFrame:
    """(key, pos, elem, n, version): what each list holds, pos from 0 at the head, n its length, version that of the push; empty lists have no rows."""
    last = placed(ops).filter("hit").groupBy("key", "place").agg(F.max(F.struct("version", "push", "elem")).alias("r")).filter("r.push")
    ends = last.groupBy("key").agg(F.min("place").alias("head"), F.count(F.lit(1)).alias("n"))
    return per_key(last, ends, ["key"]).select("key", (F.col("place") - F.col("head")).cast("bigint").alias("pos"), F.col("r.elem").alias("elem"), "n", F.col("r.version").alias("version"))


def lrange(held: DataFrame, first: int, last: int) -> DataFrame:
    """Elements from first to last inclusive; negative ends count from the tail; out of range is cut."""
    a = F.greatest(F.lit(first) if first >= 0 else F.col("n") + first, F.lit(0))
    z = F.lit(last) if last >= 0 else F.col("n") + last
    return held.filter((F.col("pos") >= a) & (F.col("pos") <= z)).select("key", (F.col("pos") - a).cast("bigint").alias("i"), "elem")
