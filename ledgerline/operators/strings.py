"""Strings, counters and expiry.

A null key is a key; a null delta adds nothing; a null ``deleted`` counts as not deleted; an ``expires_at`` of null or 0 is never.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ID
from ..shared import materialize
from .resolve import alive, newest
from .scan import WIDTH, one_range, prefix_scan, previous


def expiry(option: Column, amount: Column, at: Column) -> Column:
    """expires_at of SET at second ``at``: EX seconds, PX milliseconds, EXAT, PXAT; millis are cut to whole seconds; no option is 0."""
    millis = F.floor(amount / 1000)
    return F.when(option == "EX", at + amount).when(option == "PX", at + millis).when(option == "EXAT", amount).when(option == "PXAT", millis).otherwise(F.lit(0)).cast("bigint")


def setex(seconds: Column, at: Column) -> Column:
    """expires_at of SETEX; seconds <= 0 mean none."""
    return F.when(seconds > 0, at + seconds).otherwise(F.lit(0)).cast("bigint")


def counter_value(text: Column) -> Column:
    """A counter's text as bigint: '' and null are 0, anything but an optional sign and digits in range is null (an error)."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast("bigint")).when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))


def incr(ops: DataFrame, key: str, version: str, reset: str, delta: str) -> DataFrame:
    """``ops`` with ``n``, the counter after each: sums since the last reset (which sets to its delta). Sums past 64 bits fail."""
    one = one_range(ops, version, WIDTH)
    seg = prefix_scan(ops, [key], version, {"__seg": F.col(reset).cast("bigint")}, one=one)
    # in ranges a scan reads its input twice, so the two in a row are parted by a written table
    return prefix_scan(seg if one else materialize(seg, "seg"), [key, "__seg"], version, {"n": F.col(delta)}, one=one).drop("__seg")


def live_before(log: DataFrame, out: str = "was") -> DataFrame:
    """``log`` with whether the record was there just before each row (expiry aside)."""
    x = previous(log, ID, "version", "deleted", "__d")
    return x.withColumn(out, F.coalesce(~F.col("__d"), F.lit(False))).drop("__d")


def expire(log: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """State after EXPIRE of (key, seconds): (dtype, key, sub, value, expires_at, found) of the records of requested keys.

    A string asked with seconds <= 0 loses its expiry; a collection's members all take now + seconds, so
    with seconds <= 0 they expire at once. Keys without live record give a row with found false.
    """
    state = newest(log).filter(alive(now))
    hit = requests.join(state, "key", "left")
    at = F.when((F.col("dtype") == "s") & (F.col("seconds") <= 0), F.lit(0)).otherwise(F.lit(now) + F.col("seconds")).cast("bigint")
    found = F.col("dtype").isNotNull()
    return hit.select("dtype", "key", "sub", "value", F.when(found, at).alias("expires_at"), found.alias("found"))
