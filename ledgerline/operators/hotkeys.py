"""Per-key results under extreme skew, by eager aggregation through the join.

Both inputs are aggregated by key before they meet (map-side combine leaves at
most one row per key and task to the shuffle), the compact states join one to one,
and join results follow algebraically: the joined row count is the product of
the two counts, a left sum counts once per right row, and so on. No task ever
holds a key's rows, so there is nothing to salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def states(df: DataFrame, key: str, sums: dict[str, Column] | None = None, prefix: str = "") -> DataFrame:
    """Per key (null is a key here) its row count ``{prefix}n`` and sums ``{prefix}name``."""
    extra = sums or {}
    return df.select(F.col(key).alias("k"), *[c.alias(prefix + n) for n, c in extra.items()]).groupBy("k").agg(F.count(F.lit(1)).alias(prefix + "n"), *[F.sum(prefix + n).alias(prefix + n) for n in extra])


def eager_join(left: DataFrame, right: DataFrame, key: str, left_sums: dict[str, Column] | None = None, right_sums: dict[str, Column] | None = None) -> DataFrame:
    """Per key of either side: l_n, r_n, sums, and what the row-level join would give.

    ``pairs`` = l_n * r_n rows; ``j_l_x`` = sum of l_x over the joined rows = l_x * r_n;
    ``j_r_y`` likewise; these three are decimals of 38 digits, and sums are taken of whole numbers. Null keys keep their counts but join nothing (pairs 0). A key
    of one side only has count 0 on the other.
    """
    a, b = states(left, key, left_sums, "l_"), states(right, key, right_sums, "r_")
    both = a.withColumnRenamed("k", "lk").join(b.withColumnRenamed("k", "rk"), F.col("lk").eqNullSafe(F.col("rk")), "full_outer")
    both = both.withColumn("key", F.coalesce("lk", "rk"))
    n = {s: F.coalesce(F.col(f"{s}_n"), F.lit(0)) for s in "lr"}
    wide = {s: F.when(F.col("key").isNotNull(), n[s]).otherwise(F.lit(0)).cast("decimal(19,0)") for s in "lr"}  # products of two hot counts leave 64 bits
    return both.select(
        "key", n["l"].alias("l_n"), n["r"].alias("r_n"), (wide["l"] * wide["r"]).alias("pairs"),
        *[F.col("l_" + x) for x in left_sums or {}], *[F.col("r_" + x) for x in right_sums or {}],
        *[(F.coalesce(F.col("l_" + x), F.lit(0)).cast("decimal(19,0)") * wide["r"]).alias("j_l_" + x) for x in left_sums or {}],
        *[(F.coalesce(F.col("r_" + x), F.lit(0)).cast("decimal(19,0)") * wide["l"]).alias("j_r_" + x) for x in right_sums or {}],
    )


def hot_keys(joined: DataFrame, names: tuple[str, str], percent: int) -> DataFrame:
    """(tbl, key) of the non-null keys with at least ``percent`` percent of all rows of a side (null keys count as rows)."""
    sides = joined.select("key", F.explode(F.array(*[F.struct(F.lit(t).alias("tbl"), F.col(c).alias("n")) for t, c in zip(names, ("l_n", "r_n"))])).alias("x")).select("x.tbl", "key", "x.n")
    # a key with p percent of the rows is among at most 100 / p: the totals are two rows, so this broadcast is of fixed size
    totals = sides.groupBy("tbl").agg(F.sum("n").alias("total"))
    return sides.join(F.broadcast(totals), "tbl").filter(F.col("key").isNotNull() & (F.col("n") > 0) & (F.col("n") * 100 >= F.col("total") * percent)).select("tbl", "key")
