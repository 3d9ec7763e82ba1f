"""Differences between two copies of a table by characteristic-polynomial set reconciliation.

Each copy is reduced to 61-bit hashes of its standing rows, split into buckets by
key. A bucket's set is summarised by its characteristic polynomial at a few
points; from the quotient of two copies' values the rational function of the
differing hashes is interpolated. Its degree bound doubles until two spare points
verify it; a bucket that needs more than LAST_BOUND is split by further bits of its keys' hashes, and
its parts double on, so the work stays in proportion to the differences. Only evaluation vectors of a few longs per bucket cross between the
copies; only keys of recovered hashes are fetched and compared field by field.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import field
from ..shared import materialize, small_or_plain

FIRST_BOUND, LAST_BOUND, SPARE = 8, 64, 2
#: Parts of a bucket whose bound ran out.
SPLIT = 4
ROWS_PER_BUCKET = 48


def _row_hash(key: str, fields: list[str]) -> Column:
    # nulls leave Spark's xxhash64 unchanged, so each field also adds its null flag
    return F.pmod(F.xxhash64(key, *[x for f in fields for x in (F.col(f), F.col(f).isNull())]), F.lit(int(field.P)))


def _sets(df: DataFrame, key: str, fields: list[str], order: str, buckets: int) -> DataFrame:
    """One row per bucket: its standing rows' hashes and, beside each, the key's hash.

    The first aggregate keeps one row per key with map-side combine, so a key that
    holds a third of the rows reaches the shuffle once per task. A bucket's list is
    bounded: keys in it are distinct and spread by hash.
    """
    standing = (
        df.filter(F.col(key).isNotNull())
        .select(F.col(key).alias("k"), F.struct(F.col(order).alias("o"), _row_hash(key, fields).alias("h")).alias("r"))
        .groupBy("k").agg(F.max("r").alias("r"))
        .select(F.xxhash64("k").alias("kh"), F.col("r.h").alias("h"))
    )
    return (
        standing.withColumn("bucket", F.pmod(F.xxhash64("kh"), F.lit(buckets)))
        .groupBy("bucket").agg(F.collect_list(F.struct("h", "kh")).alias("rows"))
        .select("bucket", F.col("rows.h").alias("h"), F.col("rows.kh").alias("kh"))
    )


def _evaluator(n: int, turn: int = 0):
    at = field.points(n, turn)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def evaluate(lists: pd.Series) -> pd.Series:
        sizes = lists.map(len).to_numpy()
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate(lists.to_list()).astype(np.uint64) if len(lists) else np.zeros(0, np.uint64)
        return pd.Series(list(field.char_poly(flat, offsets, at).astype(np.int64)))

    return evaluate


_SOLVED = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("p", T.ArrayType(T.LongType())), T.StructField("q", T.ArrayType(T.LongType()))])


def interpolate(fa: np.ndarray, fb: np.ndarray, size_gap: np.ndarray, bound: int, turn: int = 0) -> list[tuple[bool, np.ndarray, np.ndarray]]:
    """Of each bucket the monic polynomials whose quotient agrees with fa / fb at all points, if the bound suffices."""
    z = field.points(bound + SPARE, turn)
    out: list = [(False, None, None)] * len(size_gap)
    ratio = field.mul(fa, field.inverse(fb))
    for gap in np.unique(size_gap):
        m = bound - (bound - int(gap)) % 2
        da, db = (m + int(gap)) // 2, (m - int(gap)) // 2
        if da < 0 or db < 0:
            continue
        rows = np.flatnonzero(size_gap == gap)
        f = ratio[rows]
        powers = np.stack([field.power(z, i) for i in range(max(da, db) + 1)], axis=1)  # points x powers
        n = len(z)
        a = np.broadcast_to(powers[None, :m, :da], (len(rows), m, da))
        b = field.sub(np.zeros((1, 1, 1), np.uint64), field.mul(f[:, :m, None], powers[None, :m, :db]))
        right = field.sub(field.mul(f[:, :m], powers[None, :m, db]), powers[None, :m, da])
        x, fits = field.solve(np.concatenate([a, b, right[:, :, None]], axis=2))
        one = np.ones((len(rows), 1), np.uint64)
        p, q = np.concatenate([x[:, :da], one], axis=1), np.concatenate([x[:, da:], one], axis=1)
        for j in range(n):  # the spare points verify; the others show points that meet an element
            pz, qz = field.horner(p, np.full(len(rows), z[j])), field.horner(q, np.full(len(rows), z[j]))
            fits &= field.mul(pz, fb[rows, j]) == field.mul(qz, fa[rows, j])
            fits &= (fa[rows, j] != 0) & (fb[rows, j] != 0)
        for i, r in enumerate(rows):
            out[r] = (bool(fits[i]), p[i].astype(np.int64), q[i].astype(np.int64))
    return out


def _solver(bound: int, turn: int = 0):
    @F.pandas_udf(_SOLVED)
    def solved(fa: pd.Series, fb: pd.Series, gap: pd.Series) -> pd.DataFrame:
        found = interpolate(np.stack(fa.to_list()).astype(np.uint64), np.stack(fb.to_list()).astype(np.uint64), gap.to_numpy(), bound, turn) if len(gap) else []
        return pd.DataFrame({"ok": [x[0] for x in found], "p": [x[1] for x in found], "q": [x[2] for x in found]})

    return solved


@F.pandas_udf(T.ArrayType(T.LongType()))
def _roots(hashes: pd.Series, marks: pd.Series, poly: pd.Series) -> pd.Series:
    """The marks of the hashes at which the bucket's polynomial is zero."""
    if not len(hashes):
        return pd.Series([], dtype=object)
    sizes = hashes.map(len).to_numpy()
    widest = max(poly.map(len))
    coeffs = np.stack([np.pad(np.asarray(c), (0, widest - len(c))) for c in poly]).astype(np.uint64)
    at = np.concatenate(hashes.to_list()).astype(np.uint64)
    zero = field.horner(np.repeat(coeffs, sizes, axis=0), at) == 0
    ends = np.cumsum(sizes)
    return pd.Series([np.asarray(m)[z] for m, z in zip(marks, np.split(zero, ends[:-1]))])


def _split(sets: DataFrame, todo: DataFrame, left_over: int, turn: int) -> DataFrame:
    """The buckets ``todo`` of one copy, each in SPLIT parts by another hash of its keys."""
    one = sets.join(small_or_plain(todo, left_over, 16), "bucket", "left_semi").select("bucket", F.explode(F.arrays_zip("h", "kh")).alias("x"))
    part = F.pmod(F.xxhash64("x.kh", F.lit(turn)), F.lit(SPLIT))
    return one.groupBy((F.col("bucket") * SPLIT + part).alias("bucket")).agg(F.collect_list("x").alias("x")).select("bucket", F.col("x.h").alias("h"), F.col("x.kh").alias("kh"))


def differing_keys(left: DataFrame, right: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """Hashes ``kh`` of the keys whose standing rows differ (a superset by hash chance only)."""
    # bucket counts follow the data, so a bucket stays as small at any size; counts come from the files' footers
    buckets = max(1, -(-max(left.count(), right.count()) // ROWS_PER_BUCKET))
    a, b = (materialize(_sets(x, key, fields, order, buckets), "sets") for x in (left, right))
    found, todo, left_over, bound, turn = [], None, 0, FIRST_BOUND, 0
    while True:
        evaluate = _evaluator(bound + SPARE, turn)
        sides = []
        for x, n in ((a, "a"), (b, "b")):
            if todo is not None:
                x = x.join(small_or_plain(todo, left_over, 16), "bucket", "left_semi")
            sides.append(x.select("bucket", evaluate("h").alias("f" + n), F.size("h").alias("n" + n)))
        ones = F.array_repeat(F.lit(1).cast("bigint"), bound + SPARE)
        met = sides[0].join(sides[1], "bucket", "full_outer").select(
            "bucket", F.coalesce("fa", ones).alias("fa"), F.coalesce("fb", ones).alias("fb"),
            (F.coalesce("na", F.lit(0)) - F.coalesce("nb", F.lit(0))).alias("gap"))
        same = F.col("fa") == F.col("fb")
        solved = materialize(met.filter(~same).select("bucket", _solver(bound, turn)("fa", "fb", "gap").alias("s")).select("bucket", "s.*"), "solved")
        good = solved.filter("ok")
        for x, poly in ((a, "p"), (b, "q")):
            found.append(x.join(good.select("bucket", F.col(poly).alias("poly")), "bucket").select(F.explode(_roots("h", "kh", "poly")).alias("kh")))
        todo = solved.filter(~F.col("ok")).select("bucket")
        left_over = todo.count()
        if not left_over:
            break
        bound *= 2
        if bound > LAST_BOUND:  # the parts start again, at other points, in case one met an element
            bound, turn = FIRST_BOUND, turn + 1
            a, b = (materialize(_split(x, todo, left_over, turn), "sets") for x in (a, b))
            todo = None
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def differences(left: DataFrame, right: DataFrame, key: str, fields: list[str], order: str, names: tuple[str, str] = ("only_primary", "only_replica")) -> DataFrame:
    """One row (key, diff) per missing key or differing field.

    Of a key the row with the greatest ``order`` stands (of equal orders the one
    with the greatest fields); null keys are left out; null equals null and
    differs from everything else, so null and '' differ; empty tables give no or
    only one-sided differences. Other columns, of whatever name, are not read.
    """
    kh = materialize(differing_keys(left, right, key, fields, order), "keys")
    rows = kh.count()
    sides = []
    for n, df in (("a", left), ("b", right)):
        wanted = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(key).alias("kh"), F.struct(F.col(order).alias("o"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]).alias("r"))
        wanted = wanted.join(small_or_plain(kh, rows, 16), "kh", "left_semi")
        sides.append(wanted.groupBy("k").agg(F.max("r").alias(n)))
    both = sides[0].join(sides[1], "k", "full_outer")
    checks = [F.when(F.col("b").isNull(), F.lit(names[0])), F.when(F.col("a").isNull(), F.lit(names[1]))]
    present = F.col("a").isNotNull() & F.col("b").isNotNull()
    checks += [F.when(present & ~F.col(f"a.f{i}").eqNullSafe(F.col(f"b.f{i}")), F.lit(f)) for i, f in enumerate(fields)]
    return both.select(F.col("k").alias("key"), F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("diff"))
