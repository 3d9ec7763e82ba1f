"""Snapshots, serializable validation, watermarks and atomic batches.

Transactions with a null timestamp are left out; a null key is no candidate for a conflict, and in outcomes a key of its own; null versions are no versions; empty tables give
no rows, totals and watermarks of 0; repeated rows of a transaction's key change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize
from .resolve import alive, newest
from .scan import prefix_scan


def overlay(snapshot: DataFrame, writes: DataFrame, key: str = "key") -> DataFrame:
    """What a transaction reads: its own buffered writes (key, value, deleted) over the snapshot (key, value)."""
    both = snapshot.select(key, F.lit(0).alias("own"), "value", F.lit(False).alias("deleted")).unionByName(writes.select(key, F.lit(1).alias("own"), "value", "deleted"))
    return both.groupBy(key).agg(F.max(F.struct("own", "deleted", "value")).alias("r")).filter(~F.col("r.deleted")).select(key, "r.value", (F.col("r.own") == 1).alias("own"))


def conflict_candidates(txns: DataFrame, span: int) -> DataFrame:
    """(txn, other): transactions on one key of which the other's commit lies in (read_ts, commit_ts).

    txns (txn, key, read_ts, commit_ts) with commit_ts - read_ts <= span. Commits are cut into ranges of
    ``span``, and a transaction meets those of its own and the range before, so a hot
    key is spread over ranges; what is emitted are the conflicts themselves.
    """
    txns = txns.dropna(subset=["txn", "read_ts", "commit_ts"])
    a = txns.select("txn", "key", "read_ts", "commit_ts", F.explode(F.array(F.floor(F.col("commit_ts") / span), F.floor(F.col("commit_ts") / span) - 1)).alias("c"))
    b = txns.select(F.col("txn").alias("other"), F.col("key").alias("k"), F.col("commit_ts").alias("t"), F.floor(F.col("commit_ts") / span).alias("d"))
    return a.join(b, (F.col("key") == F.col("k")) & (F.col("c") == F.col("d")) & (F.col("t") > F.col("read_ts")) & (F.col("t") < F.col("commit_ts"))).select("txn", "other", "key")


#: Timestamps per chunk of the commit order, at least; a chunk is as wide as the longest transaction.
WIDTH = 1 << 17
_RESULT = "c bigint, txn bigint, first boolean, key string, commit_ts bigint, written boolean, committed boolean"


def outcomes(txns: DataFrame, width: int = WIDTH) -> DataFrame:
    """(txn, committed): first-committer-wins validation in commit order, for transactions of any number of keys.

    A transaction aborts iff some key it touches, read or written, was written by a transaction committed after its read_ts; one that
    only read never aborts. txns (txn, key, read_ts, commit_ts, writes): a row per transaction and touched key.

    What a transaction sees goes back no further than its read_ts, so commit order is cut into chunks no narrower than the longest transaction, and a chunk needs
    of the one before only its last commits per key. All chunks are first validated side by side as if nothing came before;
    then those whose last commits before them turn out otherwise than assumed are validated again, until none is left. Whatever key is hot, no task
    has more than a chunk's rows; chains of conflicts die out soon, so few chunks are run again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last, txn, rows, out = None, {}, None, [], []

        def close() -> None:
            if txn is None:
                return
            ok = not any(w for _, _, _, w in rows) or all(k not in last or last[k] <= r for k, r, _, _ in rows)
            for i, (k, _, t, w) in enumerate(rows):
                if ok and w:
                    last[k] = t
                out.append((at, txn, i == 0, k, t, bool(w), ok))
            rows.clear()

        for b in batches:
            for c, kind, x, k, r, t, w in zip(*(b[n].tolist() for n in ("c", "kind", "txn", "key", "read_ts", "commit_ts", "writes"))):
                if c != at or kind == 1 and x != txn:
                    close()
                    if c != at:
                        at, last = c, {}
                    txn = x if kind == 1 else None
                if kind == 0:
                    last[k] = t
                else:
                    rows.append((k, r, t, w))
            if out:
                yield pd.DataFrame(out, columns=["c", "txn", "first", "key", "commit_ts", "written", "committed"])
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=["c", "txn", "first", "key", "commit_ts", "written", "committed"])

    ready = txns.dropna(subset=["txn", "read_ts", "commit_ts"]).select(F.lit(1).alias("kind"), "txn", F.col("key").cast("string").alias("key"), "read_ts", "commit_ts", F.coalesce("writes", F.lit(False)).alias("writes"))
    span = ready.agg(F.max(F.col("commit_ts") - F.col("read_ts"))).first()[0] or 0
    width = max(width, span, 1)
    ready = ready.withColumn("c", F.floor(F.col("commit_ts") / F.lit(width)))

    def validated(part: DataFrame, before: DataFrame | None) -> DataFrame:
        if before is not None:
            part = part.unionByName(before.select("c", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("txn"), "key", F.lit(None).cast("bigint").alias("read_ts"), "commit_ts", F.lit(False).alias("writes")))
        return part.repartition("c").sortWithinPartitions("c", "kind", "commit_ts", "txn").mapInPandas(run, _RESULT)

    def tail(done: DataFrame) -> DataFrame:
        ends = (F.col("c") + 1) * width
        return done.filter(F.col("written") & F.col("committed") & (F.col("commit_ts") > ends - span)).groupBy((F.col("c") + 1).alias("c"), "key").agg(F.max("commit_ts").alias("commit_ts"))

    def digest(before: DataFrame, name: str) -> DataFrame:
        return before.groupBy("c").agg(F.struct(F.bit_xor(F.xxhash64("key", "commit_ts")), F.count(F.lit(1))).alias(name))

    done, used = materialize(validated(ready, None), "txns"), None
    while True:
        before = materialize(tail(done).join(done.select("c").distinct(), "c", "left_semi"), "tails")
        now = digest(before, "now")
        if used is None:
            todo = now.select("c")
        else:
            todo = now.join(digest(used, "then"), "c", "full_outer").filter(~F.col("now").eqNullSafe(F.col("then"))).select("c")
        todo = materialize(todo, "todo")
        if todo.isEmpty():
            return done.filter("first").select("txn", "committed")
        again = validated(ready.join(todo, "c", "left_semi"), before.join(todo, "c", "left_semi"))
        done, used = materialize(done.join(todo, "c", "left_anti").unionByName(again), "txns"), before


def applied_watermark(versions: DataFrame, version: str = "version") -> DataFrame:
    """The largest V such that 1..V are all there: one less than the first gap; over range totals, so no task orders all rows.

    Works on distinct positive versions; without version 1 it is 0.
    """
    width = 1 << 16
    v = versions.filter(F.col(version) > 0).select(F.col(version).alias("v")).distinct().withColumn("c", F.floor((F.col("v") - 1) / width))
    full = v.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    # ranges that are full and follow each other from the first: their running count equals their end
    runs = prefix_scan(full.withColumn("one", F.lit(1)), ["one"], "c", {"upto": F.col("n")})
    first_open = runs.filter((F.col("upto") != (F.col("c") + 1) * width)).agg(F.min("c").alias("c"))
    inside = v.join(F.broadcast(first_open), "c")  # the rows of one range at most
    ranked = prefix_scan(inside.withColumn("one", F.lit(1)), ["one"], "v", {"i": F.lit(1)})
    partial = ranked.filter(F.col("i") == F.col("v") - F.col("c") * width).agg(F.max("v").alias("v"))
    whole = runs.filter(F.col("upto") == (F.col("c") + 1) * width).agg(F.max("upto").alias("v"))
    return partial.unionByName(whole).agg(F.coalesce(F.max("v"), F.lit(0)).cast("bigint").alias("watermark"))


def torn_batches(entries: DataFrame, batch: str, version: str) -> DataFrame:
    """(batch, entries, versions, torn): a batch is whole iff all its entries carry one version."""
    return entries.groupBy(F.col(batch).alias("batch_id")).agg(F.count(F.lit(1)).alias("entries"), F.count_distinct(version).alias("versions")).withColumn("torn", F.col("versions") != 1)


def snapshot_total(log: DataFrame, as_of: int, value: str) -> DataFrame:
    return newest(log, as_of).filter(alive(None)).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias("total"))
