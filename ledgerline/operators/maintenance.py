"""Compaction, manifest, ingestion, value-log, recovery and restore, as queries over the log and its tables.

Rows of null version or time are kept by no cut that asks for it; tables with a null bound meet no other;
null sizes count 0 bytes; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..shared import per_key
from .resolve import alive, newest



def retained(log: DataFrame, by: list[str], horizon: int, version: str = "version") -> DataFrame:
    """Rows compaction keeps: every version past the horizon, and per record the newest not past it."""
    old = newest(log.filter(F.col(version) <= horizon), by=by, order=[version])
    return log.filter(F.col(version) > horizon).unionByName(old)


def bottom_drop(kept: DataFrame, by: list[str], now: int) -> DataFrame:
    """At the bottom level a record whose only kept row is dead goes too.

    A record is dead and alone iff its rows are one and none is alive: a count per record with map-side combine, met by salted rows.
    """
    n = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.max(alive(now)).alias("__any"))
    return per_key(kept, n, by).filter((F.col("__n") > 1) | F.col("__any")).drop("__n", "__any")


def tombstoned(kept: DataFrame, now: int) -> DataFrame:
    """Compaction writes an expired put as a tombstone: the same record and version, deleted, without value or expiry left to read."""
    late = F.coalesce((F.col("expires_at") > 0) & (F.col("expires_at") <= now), F.lit(False)) & ~F.coalesce("deleted", F.lit(False))
    return kept.withColumn("value", F.when(~late, F.col("value"))).withColumn("deleted", F.col("deleted") | late)


#: Share of tombstones over which a table is due; level 0 is due from so many tables; levels; growth from level to level.
DUE, L0_TABLES, LEVELS, RATIO = 0.40, 4, 5, 10


def level_limits(last_size: int, base: int, levels: int = LEVELS, ratio: int = RATIO) -> list[int]:
    """Sizes of the levels, from the deepest up: what is there, at least base x ratio, and a ``ratio``-th a level; one that comes to no more than ``base`` has none (0)."""
    out = [0] * levels
    out[-1] = max(last_size, base * ratio)
    for at in range(levels - 2, 0, -1):
        share = out[at + 1] // ratio
        out[at] = share if share > base else 0
    return out


def pick(tables: DataFrame, base: int, number: str = "t", level: str = "level", size: str = "rows", dead: str = "dead") -> tuple[int, int | None] | None:
    """What to compact: (level, table), (level, None) for a whole level, or None.

    First, from the deepest level but one upwards, the level's first table of more than DUE tombstones. Else the level
    that is fullest: level 0 by its tables, from L0_TABLES on, deeper ones by their size over their limit, where more than full. Levels are few, so what comes to the driver is a row each.
    """
    rows = tables.groupBy(level).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"), F.min(F.when(F.col(dead) > DUE * F.col(size), F.col(number))).alias("due"))
    by = {r[level]: r for r in rows.collect()}
    for at in range(LEVELS - 2, -1, -1):
        if at in by and by[at]["due"] is not None:
            return at, by[at]["due"]
    best, score = None, 1.0
    if 0 in by and by[0]["n"] >= L0_TABLES:
        best, score = 0, by[0]["n"] / L0_TABLES
    limits = level_limits(by[LEVELS - 1]["size"] if LEVELS - 1 in by else 0, base)
    for at in range(1, LEVELS - 1):
        if at in by and limits[at] and by[at]["size"] / limits[at] > score:
            best, score = at, by[at]["size"] / limits[at]
    return None if best is None else (best, None)


def live_tables(manifest: DataFrame) -> DataFrame:
    """(seq, level, min_key, max_key) of tables whose last record, in order of arrival, is an addition; a deletion of an unknown table changes nothing."""
    last = manifest.filter(F.col("seq").isNotNull()).groupBy("seq").agg(F.max(F.struct("man_id", F.upper(F.trim("action")).alias("a"), "level", "min_key", "max_key")).alias("r"))
    return last.filter("r.a = 'A'").select("seq", "r.level", "r.min_key", "r.max_key")


def overlaps(tables: DataFrame, low: str, high: str, number: str) -> DataFrame:
    """Pairs a < b of tables whose closed ranges [low, high] meet, ranges being numbers.

    Ranges are put into cells as wide as the mean range, so tables meet only where they share a
    cell; a pair counts in the cell of the later start only, so each appears once.
    """
    width = max(1, int(tables.agg(F.avg(F.col(high) - F.col(low))).first()[0] or 1))
    cells = tables.select(F.col(number).alias("t"), F.col(low).alias("lo"), F.col(high).alias("hi"), F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))).alias("cell"))
    a, b = cells, cells.select(F.col("t").alias("u"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), "cell")
    met = a.join(b, "cell").filter((F.col("t") < F.col("u")) & (F.col("lo") <= F.col("hi2")) & (F.col("lo2") <= F.col("hi")) & (F.floor(F.greatest("lo", "lo2") / width) == F.col("cell")))
    return met.select(F.col("t").alias("a"), F.col("u").alias("b"))


def self_overlap(tables: DataFrame, low: str, high: str, number: str) -> DataFrame:
    """Tables of an ingest that begin before an earlier one ends (by start, end, number): the ingest is refused."""
    w = W.orderBy(low, high, number).rowsBetween(W.unboundedPreceding, -1)  # one row per ingested table
    return tables.withColumn("__p", F.max(high).over(w)).filter(F.col("__p") >= F.col(low)).drop("__p")


def target_level(new: DataFrame, tables: DataFrame, low: str, high: str, number: str, level: str, deepest: int) -> DataFrame:
    """(number, target): the deepest level at which no table meets the new one before a level that does, else 0."""
    both = new.select(F.col(number).alias("n"), F.col(low).alias("lo"), F.col(high).alias("hi"))
    width = max(1, int(tables.agg(F.avg(F.col(high) - F.col(low))).first()[0] or 1))
    cell = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))).alias("cell")
    a = both.select("*", cell("lo", "hi"))
    b = tables.select(F.col(level).alias("level"), F.col(low).alias("lo2"), F.col(high).alias("hi2"), cell(low, high))
    hit = a.join(b, "cell").filter((F.col("lo") <= F.col("hi2")) & (F.col("lo2") <= F.col("hi"))).groupBy("n").agg(F.min("level").alias("first"))
    return both.join(hit, "n", "left").select(F.col("n").alias(number), F.greatest(F.coalesce(F.col("first") - 1, F.lit(deepest)), F.lit(0)).cast("bigint").alias("target"))


def adaptive_threshold(samples: DataFrame, size: str, order: str, per: int, low: int, high: int) -> DataFrame:
    """(window, threshold): of every ``per`` samples in order the element at floor(n * 0.75) of the sorted sizes, kept within low and high.

    Groups are of ``per`` samples, so each is sorted on its own.
    """
    g = samples.filter(F.col(size).isNotNull()).select(F.floor(F.col(order) / per).alias("window"), F.col(size).alias("size")).groupBy("window").agg(F.array_sort(F.collect_list("size")).alias("s"))
    return g.select("window", F.least(F.greatest(F.element_at("s", (F.floor(F.size("s") * 0.75) + 1).cast("int")), F.lit(low)), F.lit(high)).cast("bigint").alias("threshold"))


def vlog_once(entries: DataFrame) -> DataFrame:
    """Entries each once: of rows with one (fid, voffset, appended_at) that not dropped or dropped last, then of the greatest size, then other columns."""
    rest = [c for c in entries.columns if c not in ("fid", "voffset", "appended_at", "dropped_at", "vsize")]
    order = F.struct(F.col("dropped_at").isNull().alias("open"), "dropped_at", "vsize", *rest)
    return entries.groupBy("fid", "voffset", "appended_at").agg(F.max(order).alias("r")).select("fid", "voffset", "appended_at", "r.dropped_at", "r.vsize", *[F.col(f"r.{c}").alias(c) for c in rest])


def gc_rewrite(entries: DataFrame, fid: int, now: Column) -> DataFrame:
    """(fid, voffset, key, vsize, to_fid, to_offset): the entries of a segment that are live at ``now``, one after the other in a new segment past the last.

    A segment is bounded (128 MiB), so its entries are ordered in one task.
    """
    top = entries.agg(F.max("fid")).first()[0]
    here = vlog_once(entries.filter(F.col("fid") == fid)).filter(F.col("dropped_at").isNull() | (F.col("dropped_at") > now))
    size = F.coalesce("vsize", F.lit(0)).cast("bigint")
    upto = F.coalesce(F.sum(size).over(W.partitionBy("fid").orderBy("voffset", "appended_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return here.select("fid", "voffset", "key", size.alias("vsize"), F.lit(top + 1).cast("bigint").alias("to_fid"), upto.alias("to_offset"))


def still_referenced(entries: DataFrame, pointers: DataFrame) -> DataFrame:
    """(fid, pointers, removable): how many entries some pointer of any version still names; a segment may be removed only without any."""
    named = pointers.dropna(subset=["fid", "voffset"]).select("fid", "voffset").distinct()
    n = entries.select("fid", "voffset").distinct().join(named.withColumn("named", F.lit(1)), ["fid", "voffset"], "left").groupBy("fid").agg(F.count("named").alias("pointers"))
    return n.withColumn("removable", F.col("pointers") == 0)


def discard_stats(entries: DataFrame, now: Column) -> DataFrame:
    """(fid, live_bytes, dead_bytes, ratio) per value-log segment; of entries reported several times the one dropped last, then the largest, counts."""
    once = vlog_once(entries)
    dead = F.col("dropped_at").isNotNull() & (F.col("dropped_at") <= now)
    size = F.coalesce("vsize", F.lit(0)).cast("bigint")
    x = once.groupBy("fid").agg(F.sum(F.when(dead, 0).otherwise(size)).cast("bigint").alias("live_bytes"), F.sum(F.when(dead, size).otherwise(0)).cast("bigint").alias("dead_bytes"))
    return x.withColumn("ratio", F.coalesce(F.col("dead_bytes") / F.nullif(F.col("live_bytes") + F.col("dead_bytes"), F.lit(0)), F.lit(0.0)))


def valid_prefix(log: DataFrame, order: str, bad: Column) -> DataFrame:
    """Records before the first bad one: a minimum and a filter, no ordered pass over the log."""
    first = log.filter(bad).agg(F.min(order).alias("b")).first()[0]
    return log if first is None else log.filter(F.col(order) < first)


def newest_checkpoints(names: DataFrame, keep: int) -> DataFrame:
    """(name, kept): the ``keep`` greatest names stay; names are few, one per checkpoint."""
    return names.withColumn("kept", F.row_number().over(W.orderBy(F.desc("name"))) <= keep)


def restore_until(log: DataFrame, until: int, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(state, counts of kept and skipped) of a restore to second ``until``; records without a time (0) are always kept."""
    keep = (F.col("ts_s") == 0) | (F.col("ts_s") <= until)
    counts = log.agg(F.sum(keep.cast("bigint")).alias("kept"), F.sum((~keep).cast("bigint")).alias("skipped"))
    return newest(log.filter(keep), by=by).filter(alive(None)), counts


