"""References to records that do not exist, at the time they were seen.

A Bloom filter of all parent keys is broadcast while it is small, else parted by its words: a reference it
rejects is an orphan for certain. The rest go through an exact as-of check on the
parents' timeline.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..shared import join_on, materialize

#: Up to this size the filter is broadcast; a larger one meets the references in a shuffle.
FILTER_BYTES = 32 << 20
WORD_BYTES = 16
#: Words of the filter with more than this part of the references are hot.
HOT_SHARE = 1000
BITS_PER_KEY = 16
PROBES = 5
#: A key's timeline is cut into time ranges of about CHUNK_ROWS rows of all keys, MOST_CHUNKS at most, so no task holds all rows of a hot key.
CHUNK_ROWS, MOST_CHUNKS = 200_000, 2048
#: Up to so many cuts are compared one by one in generated code.
CHUNKS = 96


def _hash(keys: list[str]) -> str:
    return "xxhash64(" + ", ".join(f"`{k}`" for k in keys) + ")"


def _mask(keys: list[str]) -> Column:
    """PROBES bits of one 64-bit word, from the low bits of a hash; the word's number comes from its high bits."""
    return F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned({_hash(keys)}, {6 * i}) & 63 as int))" for i in range(PROBES)))


def bloom(parents: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, int]:
    """Register-blocked Bloom filter as a table (w, m) of its words that are not empty, and the shift from hash to word.

    Each key sets PROBES bits of one word; words are OR-ed with map-side combine. ``rows`` (repeats
    counted) sets the number of words, about 64 / BITS_PER_KEY keys each; it has no upper end.
    """
    bits = max(6, math.ceil(math.log2(max(1, rows) * BITS_PER_KEY / 64)))
    words = parents.dropna(subset=keys).select(F.expr(f"shiftrightunsigned({_hash(keys)}, {64 - bits})").alias("w"), _mask(keys).alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    return words, 64 - bits


def probed(refs: DataFrame, keys: list[str], words: DataFrame, shift: int, count: int) -> DataFrame:
    """``refs`` with ``may_be``: false for certain when the filter holds no such key; bit operations only, no Python.

    ``count`` words of 16 bytes are broadcast while they are under FILTER_BYTES. A larger filter is parted
    by its word numbers and meets the references in a shuffle; words that hold more than a HOT_SHARE-th
    of all references, so at most HOT_SHARE, are few and broadcast, so no task gets a hot key's rows.
    """
    r = refs.select("*", F.expr(f"shiftrightunsigned({_hash(keys)}, {shift})").alias("__w"), _mask(keys).alias("__m"))

    def test(part: DataFrame, some: DataFrame) -> DataFrame:
        met = part.join(some.select(F.col("w").alias("__w"), "m"), "__w", "left")
        return met.withColumn("may_be", F.coalesce(F.col("m").bitwiseAND(F.col("__m")) == F.col("__m"), F.lit(False))).drop("m", "__w", "__m")

    if count * WORD_BYTES <= FILTER_BYTES:
        return test(r, F.broadcast(words))
    r = materialize(r, "refs")
    hot = r.groupBy("__w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * HOT_SHARE > r.count()).select("__w")
    hot = [x[0] for x in hot.collect()]  # at most HOT_SHARE numbers
    is_hot = F.col("__w").isin(hot)
    return test(r.filter(~is_hot), words).unionByName(test(r.filter(is_hot), F.broadcast(words.filter(F.col("w").isin(hot)))))


def micros(t: str | Column) -> Column:
    """A timestamp without zone as microseconds since 1970, whatever the session's zone."""
    c = F.col(t) if isinstance(t, str) else t
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def _place(cuts: list[int], c: Column, low: int = 0) -> Column:
    """The number of cuts <= c, as a balanced tree of comparisons that stays in generated code; many cuts are found in two steps."""
    if len(cuts) > CHUNKS:
        step = math.isqrt(len(cuts)) + 1
        fine = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in cuts[i : i + step]]) for i in range(0, len(cuts), step)])
        coarse = _place(cuts[step::step], c)
        return F.lit(low) + coarse * step + F.size(F.filter(F.element_at(fine, coarse + 1), lambda x: x <= c))
    if not cuts:
        return F.lit(low)
    m = len(cuts) // 2
    return F.when(c < F.lit(cuts[m]).cast("bigint"), _place(cuts[:m], c, low)).otherwise(_place(cuts[m + 1 :], c, low + m + 1))


def quantiles(us: Column) -> Column:
    """Quantiles of time from which timelines' cuts are taken; an aggregate, for observe() or agg()."""
    shares = F.expr("array(" + ", ".join(f"{i / MOST_CHUNKS}D" for i in range(1, MOST_CHUNKS)) + ")")
    return F.call_function("percentile_approx", us, shares, F.lit(10000))


def as_of(refs: DataFrame, parents: DataFrame, rows: int | None = None, times: list[int] | None = None) -> DataFrame:
    """refs (k, us, ...) with ``s``: the greatest ``s`` of the parents (k, us, s) whose us is not later.

    The timeline is cut at quantiles of time into chunks of about CHUNK_ROWS rows (``rows`` and ``times``, their
    number and quantiles, are found here unless given). All rows are shuffled once, by key and chunk. Per key and chunk one compact
    state is formed of the same shuffle; these states
    are scanned in order and carried into later chunks. So the rows of
    a hot key, on either side, are spread over chunks, and no pairs are formed.
    """
    if rows is None:
        rows, times = refs.select("us").unionByName(parents.select("us")).agg(F.count(F.lit(1)), quantiles(F.col("us"))).first()
    every = max(1, MOST_CHUNKS * CHUNK_ROWS // max(1, rows))
    at = sorted(set((times or [])[every - 1 :: every]))
    p = parents.select("k", "us", "s", F.lit(0).alias("kind"))
    r = refs.withColumn("kind", F.lit(1))
    events = r.unionByName(p, allowMissingColumns=True).withColumn("c", _place(at, F.col("us")))
    so_far = W.partitionBy("k", "c").orderBy("us", "kind").rowsBetween(W.unboundedPreceding, 0)
    here = events.withColumn("s", F.max("s").over(so_far))
    if at:
        # the hash of all columns keeps this branch's shuffle the same as the other's, so that it runs once
        compact = here.groupBy("k", "c").agg(F.max("s").alias("s"), F.max("kind").alias("wants"), F.max(F.xxhash64(*events.columns)).alias("all"))
        before = W.partitionBy("k").orderBy("c").rowsBetween(W.unboundedPreceding, -1)
        carry = compact.withColumn("carry", F.max("s").over(before)).filter(F.col("carry").isNotNull() & (F.col("wants") == 1) & F.col("all").isNotNull()).select("k", "c", "carry")
        here = join_on(here, carry, ["k", "c"], "left").withColumn("s", F.greatest("s", "carry")).drop("carry")
    return here.filter("kind = 1").drop("kind", "c")


def orphans(refs: DataFrame, ref_keys: list[str], seen: str, parents: DataFrame, parent_keys: list[str], since: str, state: Column, alive: Column, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and ``seen`` of references whose parent is not there at ``seen``.

    ``state`` is an orderable column of the parents, ``alive`` a condition on the greatest
    state ``s`` so far and the reference's time ``us``. A reference with a null key
    column refers to nothing and is no case; one with null ``seen`` is an orphan, for
    nothing is known to be there; parents with a null key or time are no parents.
    Repeated parent rows change nothing; an empty parent table makes all orphans.

    References are probed once and written with their flag; only those that the filter lets through are shuffled.
    """
    r = refs.dropna(subset=ref_keys).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(ref_keys)], F.col(seen).alias("__seen"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(keep)])
    p = parents.dropna(subset=[*parent_keys, since]).select(*[F.col(c).cast(refs.schema[k].dataType).alias(f"__k{i}") for i, (c, k) in enumerate(zip(parent_keys, ref_keys))], micros(since).alias("us"), state.alias("s"))
    ks = [f"__k{i}" for i in range(len(ref_keys))]
    out = [F.col("__seen").alias(seen), *[F.col(f"__o{i}").alias(c) for i, c in enumerate(keep)]]
    rows = parents.count()  # from the files' footers
    words, shift = bloom(p, ks, rows)
    seen_ = Observation()
    flagged = probed(r, ks, words, shift, min(rows, 1 << (64 - shift))).withColumn("held", F.col("may_be") & F.col("__seen").isNotNull()).drop("may_be")
    flagged = materialize(flagged.observe(seen_, F.sum(F.col("held").cast("bigint")).alias("n"), quantiles(F.when(F.col("held"), micros("__seen"))).alias("times")), "probed", ["held"])
    n, times = seen_.get["n"] or 0, seen_.get["times"]
    certain = flagged.filter("not held").select(*out)
    if not n:
        return certain
    held = flagged.filter("held")
    key = F.struct(*ks)
    checked = as_of(held.select(key.alias("k"), micros("__seen").alias("us"), "__seen", *[f"__o{i}" for i in range(len(keep))]), p.select(key.alias("k"), "us", "s"), n + rows, times)
    return certain.unionByName(checked.filter(~F.coalesce(alive, F.lit(False))).select(*out))


def per_period(found: DataFrame) -> DataFrame:
    """Counts of orphan rows (ref_table, period, ptr_id) per table and day."""
    return found.groupBy("ref_table", "period").agg(F.count(F.lit(1)).alias("n_orphans"))
