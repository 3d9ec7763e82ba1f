"""Ordered running sums and minima that don't put a hot key's rows into one task. A null key is a key; rows of null order come first.

Where all orders lie in one range (found by a minimum and a maximum, which Parquet answers from few
bytes) a window is enough; else ranges' totals are scanned and joined on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..shared import join_on, materialize

#: Order numbers per range chunk.
WIDTH = 1 << 18


def _range(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width))


def one_range(df: DataFrame, order: str, width: int) -> bool:
    """Whether all orders, nulls aside, lie in one range, so that no key has more rows than a range may hold."""
    r = df.agg(F.min(order).alias("a"), F.max(order).alias("z"), F.count(F.when(F.col(order).isNull(), 1)).alias("n")).first()
    return r["n"] == 0 and (r["a"] is None or r["a"] // width == r["z"] // width)


def prefix_scan(df: DataFrame, key: list[str], order: str, sums: dict[str, Column], lows: dict[str, str] | None = None, width: int = WIDTH, one: bool | None = None) -> DataFrame:
    """``df`` with running sums per key in ascending ``order``, each including its row; null adds nothing.

    ``lows`` names, for some of the sums, a column for the least running sum before the row (at most
    0, with which each key starts). Rows are cut into ranges of ``order``; within a range a window runs, and ranges'
    totals, few per key, are scanned and joined on. Equal orders are summed in one
    step only if ``order`` is unique per key, which callers ensure. ``one`` tells, where known, what one_range() would find.
    """
    lows = lows or {}
    if one_range(df, order, width) if one is None else one:
        return _single(df, key, order, sums, lows)
    cut = df.withColumn("__c", _range(order, width))
    inner = W.partitionBy(*key, "__c").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    for n, c in sums.items():
        cut = cut.withColumn(f"__s_{n}", F.coalesce(F.sum(c).over(inner), F.lit(0)))
    earlier = W.partitionBy(*key, "__c").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    for n in lows:
        cut = cut.withColumn(f"__m_{n}", F.min(f"__s_{n}").over(earlier))
    if not lows:
        totals = df.withColumn("__c", _range(order, width)).groupBy(*key, "__c").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    else:  # its input has the window's partitioning already
        totals = cut.groupBy(*key, "__c").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()], *[F.min(f"__s_{n}").alias(f"__l_{n}") for n in lows])
    outer = W.partitionBy(*key).orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    for n in sums:
        totals = totals.withColumn(f"__b_{n}", F.coalesce(F.sum(f"__t_{n}").over(outer), F.lit(0)))
    for n in lows:
        totals = totals.withColumn(f"__a_{n}", F.coalesce(F.min(F.col(f"__b_{n}") + F.col(f"__l_{n}")).over(outer), F.lit(0)))
    keep = [*key, "__c", *[f"__b_{n}" for n in sums], *[f"__a_{n}" for n in lows]]
    out = join_on(cut, totals.select(*keep), [*key, "__c"])
    return out.select(
        *df.columns, *[(F.col(f"__b_{n}") + F.col(f"__s_{n}")).alias(n) for n in sums],
        *[F.least(F.col(f"__a_{n}"), F.col(f"__b_{n}") + F.col(f"__m_{n}"), F.lit(0)).alias(to) for n, to in lows.items()],
    )


def _single(df: DataFrame, key: list[str], order: str, sums: dict[str, Column], lows: dict[str, str]) -> DataFrame:
    upto = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = df.select("*", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"__s_{n}") for n, c in sums.items()])
    least = [F.least(F.coalesce(F.min(f"__s_{n}").over(before), F.lit(0)), F.lit(0)).alias(to) for n, to in lows.items()]
    return out.select(*df.columns, *[F.col(f"__s_{n}").alias(n) for n in sums], *least)


def previous(df: DataFrame, key: list[str], order: str, col: str, out: str, width: int = WIDTH, one: bool | None = None) -> DataFrame:
    """``df`` with ``out``: ``col`` of the row before, per key in ascending ``order``; null for the first. Ranges as in prefix_scan."""
    if one_range(df, order, width) if one is None else one:
        return df.withColumn(out, F.lag(col).over(W.partitionBy(*key).orderBy(order)))
    cut = df.withColumn("__c", _range(order, width))
    inner = W.partitionBy(*key, "__c").orderBy(order)
    cut = cut.withColumn("__p", F.lag(col).over(inner)).withColumn("__f", F.row_number().over(inner) == 1)
    last = df.select(*key, _range(order, width).alias("__c"), F.struct(order, F.col(col).alias("__v")).alias("__r")).groupBy(*key, "__c").agg(F.max("__r").alias("__r"))
    last = last.withColumn("__q", F.lag("__r.__v").over(W.partitionBy(*key).orderBy("__c"))).select(*key, "__c", "__q")
    return join_on(cut, last, [*key, "__c"]).select(*df.columns, F.when(F.col("__f"), F.col("__q")).otherwise(F.col("__p")).alias(out))


def ranked(df: DataFrame, key: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``, 1, 2, ... per key in ascending ``order`` (unique per key).

    Rows are range-partitioned by key and order, numbered within a range, and ranges' counts carried on,
    so a key with a third of the rows is sorted in many tasks.
    """
    cut = materialize(df.repartitionByRange(*key, *order).withColumn("__c", F.spark_partition_id()), "ranges")
    within = cut.withColumn("__i", F.row_number().over(W.partitionBy(*key, "__c").orderBy(*order)))
    counts = cut.groupBy(*key, "__c").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*key).orderBy("__c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__b", before).drop("__n")
    return join_on(within, counts, [*key, "__c"]).select(*df.columns, (F.col("__i") + F.col("__b")).cast("bigint").alias(out))
