"""Point, as-of, prefix and snapshot reads: all are the newest row per record, filtered.

Null parts of a record's identity are values of their own; a null version is older than any other and lies
past every as-of cut; of equal versions the row with the greatest other columns stands; empty logs give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.glob import matches
from ..schema import ID, STRING
from .scan import prefix_scan


def newest(log: DataFrame, as_of: int | None = None, by: list[str] = ID, order: list[str] = ("version",)) -> DataFrame:
    """The row of the greatest version (<= as_of) per record, with map-side combine; ties by the other columns, nulls lowest."""
    if as_of is not None:
        log = log.filter(F.col("version") <= as_of)
    rest = [c for c in log.columns if c not in by and c not in order]
    return log.groupBy(*by).agg(F.max(F.struct(*order, *rest)).alias("__r")).select(*by, "__r.*").select(*log.columns)


def alive(now: int | Column | None) -> Column:
    """Not deleted and, where now is given, not expired: expired iff now >= expires_at > 0; null never expires."""
    there = ~F.coalesce(F.col("deleted"), F.lit(False))
    if now is None:
        return there
    now = F.lit(now) if isinstance(now, int) else now
    at = F.coalesce("expires_at", F.lit(0))
    return there & ((at == 0) | (now < at))


def resolve(log: DataFrame, as_of: int | None = None, now: int | None = None, tombstones: bool = False) -> DataFrame:
    """State of the log: live records, or with ``tombstones`` deleted ones too (expired ones never)."""
    state = newest(log, as_of)
    if tombstones:
        return state.filter(F.col("deleted") | alive(now))
    return state.filter(alive(now))


def merge(*logs: DataFrame) -> DataFrame:
    """Several sources as one: every version."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def history(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """All versions with their position in (key ascending, version descending) per record."""
    if as_of is not None:
        log = log.filter(F.col("version") <= as_of)
    # null versions are the oldest, so they come last here
    down = log.withColumn("__down", F.coalesce(-F.col("version"), F.lit((1 << 63) - 1)))
    return prefix_scan(down, ID, "__down", {"pos": F.lit(1)}).drop("__down")


def physical_name(dtype: Column, key: Column, sub: Column) -> Column:
    """The flat name of a record: type and key, and the member for collections, parted by ':'."""
    return F.when(dtype == STRING, F.concat_ws(":", dtype, key)).otherwise(F.concat_ws(":", dtype, key, sub))


def names(state: DataFrame, glob: str = "*") -> DataFrame:
    """Logical names that match: each once over all types, empty ones skipped."""
    return state.filter((F.col("key") != "") & matches("key", glob)).select("key").distinct()


def page(state: DataFrame, cursor: str | None, count: int = 10, glob: str = "*") -> DataFrame:
    """The next ``count`` names after ``cursor`` (None: the first), with their place; keyset pagination, so a page costs a top-k."""
    n = names(state, glob)
    if cursor is not None:
        n = n.filter(F.col("key") > cursor)
    n = n.orderBy("key").limit(count)
    return n.withColumn("pos", F.row_number().over(W.orderBy("key")).cast("bigint"))  # over at most ``count`` rows


def mget(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pos, key, value, present) for each wanted (pos, key), duplicates kept; a missing key has value null, an empty value is ''."""
    s = state.filter(F.col("dtype") == STRING).select("key", "value", F.lit(True).alias("present"))
    return wanted.join(s, "key", "left").select("pos", "key", "value", F.coalesce("present", F.lit(False)).alias("present"))


def ttl(log: DataFrame, now: int, as_of: int | None = None) -> DataFrame:
    """(key, ttl) of strings: -2 gone or expired, -1 without expiry, else seconds left."""
    at = F.coalesce("expires_at", F.lit(0))
    return newest(log.filter(F.col("dtype") == STRING), as_of).select("key", F.when(~alive(now), F.lit(-2)).when(at == 0, F.lit(-1)).otherwise(at - now).cast("bigint").alias("ttl"))
