"""The queries p1 to p5 over the store tables, and their SQL where it is quick on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hotkeys, incremental, orphans, patches, reconcile
from ..shared import read, shared_path


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.differences(read(spark, d, "snap_primary"), read(spark, d, "snap_replica"), "key", ["value", "expires_at"], "row_no")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return patches.apply_feed(read(spark, d, "wal_log"), "key", "version", "ts", "lsn", "op").select("key", F.col("seq").alias("lsn"))


def p2_current_state(spark: SparkSession, d: str) -> DataFrame:
    """The rebuilt table: keys with value, by the same patches."""
    return patches.apply_feed(read(spark, d, "wal_log"), "key", "version", "ts", "lsn", "op", ["value", "expires_at"]).select("key", F.col("seq").alias("lsn"), "version", "value", "expires_at")


def p2_in_parts(spark: SparkSession, d: str) -> DataFrame:
    """The same table from patches of three parts of the feed, each composed by itself, as runs over a growing feed keep them."""
    wal = read(spark, d, "wal_log")
    parts = [patches.patches(wal.filter(F.col("lsn") % 3 == i), "key", "version", "ts", "lsn", "op", ["value", "expires_at"]) for i in range(3)]
    return patches.state(patches.composed(*parts), ["value", "expires_at"]).select("key", F.col("seq").alias("lsn"), "version", "value", "expires_at")


def _key_states(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.eager_join(
        read(spark, d, "wal_log"), read(spark, d, "batch_writes"), "key",
        {"bytes": F.octet_length("value").cast("bigint")}, {"bytes": F.octet_length("value").cast("bigint"), "deletes": F.col("deleted").cast("bigint")},
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    states = hotkeys.eager_join(read(spark, d, "wal_log"), read(spark, d, "batch_writes"), "key")
    return hotkeys.hot_keys(states, ("wal_log", "batch_writes"), 2)


def p3_key_report(spark: SparkSession, d: str) -> DataFrame:
    """Per key of either table: rows, value bytes, deletes, and the size and byte sums of the row-level join, these exact in decimal digits."""
    wide = [F.col(c).cast("string").alias(c) for c in ("pairs", "j_l_bytes", "j_r_bytes")]
    return _key_states(spark, d).select("key", "l_n", "r_n", "l_bytes", "r_bytes", "r_deletes", *wide)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    refs = read(spark, d, "value_pointers")
    until = F.coalesce(orphans.micros("dropped_at"), F.lit((1 << 63) - 1))
    vlog = orphans.orphans(refs, ["fid", "voffset"], "seen_at", read(spark, d, "vlog_entries"), ["fid", "voffset"], "appended_at", until, F.col("s") > F.col("us"), ["ptr_id"])
    last = F.struct(orphans.micros("logged_at").alias("at"), F.col("man_id"), F.coalesce(F.upper(F.trim("action")) == "A", F.lit(False)).alias("there"))
    sst = orphans.orphans(refs, ["sst_seq"], "seen_at", read(spark, d, "sst_manifest"), ["seq"], "logged_at", last, F.col("s.there"), ["ptr_id"])
    period = F.date_format("seen_at", "yyyy-MM-dd").alias("period")
    return vlog.select(F.lit("vlog_entries").alias("ref_table"), period, "ptr_id").unionByName(sst.select(F.lit("sst_manifest").alias("ref_table"), period, "ptr_id"))


def p4_per_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans.per_period(p4_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The run after those of the log: their saved state is taken over once, then one run goes from its tree."""
    wal = read(spark, d, "wal_log").filter((F.col("version") != 0) & F.col("key").isNotNull())
    repl = read(spark, d, "repl_feed")
    records = wal.select(F.lit("wal_log").alias("feed"), F.col("version").alias("seq"), "key", "arrived_at").unionByName(
        repl.select(F.lit("repl_feed").alias("feed"), "seq", "key", "arrived_at"))
    return incremental.pending(records, incremental.speaking_runs(read(spark, d, "repl_runs")), shared_path(spark, "runs"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_current_state, p2_in_parts, p3_found, p3_key_report, p4_found, p4_per_period, p5_found)}

_P1 = """
with p as (select key, value, expires_at from (select *, row_number() over (partition by key order by row_no desc) rn from snap_primary where key is not null) x where rn = 1),
r as (select key, value, expires_at from (select *, row_number() over (partition by key order by row_no desc) rn from snap_replica where key is not null) x where rn = 1)
select key, 'only_primary' as diff from p where key not in (select key from r)
union all select key, 'only_replica' as diff from r where key not in (select key from p)
union all select p.key, 'value' as diff from p join r on p.key = r.key where p.value is distinct from r.value
union all select p.key, 'expires_at' as diff from p join r on p.key = r.key where p.expires_at is distinct from r.expires_at"""

_LAST = """(select *, row_number() over (partition by key order by version desc, ts desc nulls last, lsn) rn from wal_log where key is not null) x
where rn = 1 and upper(trim(op)) in ('PUT', 'SET', '1')"""

_P4 = """
with o as (
select 'vlog_entries' as ref_table, seen_at, ptr_id from value_pointers p where fid is not null and voffset is not null and not exists (
  select 1 from vlog_entries v where v.fid = p.fid and v.voffset = p.voffset and v.appended_at <= p.seen_at and (v.dropped_at is null or v.dropped_at > p.seen_at))
union all
select 'sst_manifest' as ref_table, seen_at, ptr_id from (
  select p.ptr_id, p.seen_at, arg_max(upper(m.action), {'a': m.logged_at, 'b': m.man_id}) act
  from value_pointers p left join sst_manifest m on m.seq = p.sst_seq and m.logged_at <= p.seen_at where p.sst_seq is not null group by 1, 2) x
where act is distinct from 'A')
"""

SQL = {
    "p1_found": _P1,
    "p2_found": f"select key, lsn from {_LAST}",
    "p2_current_state": f"select key, lsn, version, value, expires_at from {_LAST}",
    "p2_in_parts": f"select key, lsn, version, value, expires_at from {_LAST}",
    "p3_found": """
select tbl, key from (
select 'wal_log' as tbl, key, count(*) n, sum(count(*)) over () total from wal_log group by key
union all select 'batch_writes' as tbl, key, count(*) n, sum(count(*)) over () total from batch_writes group by key) x
where key is not null and n * 100 >= total * 2""",
    "p3_key_report": """
with l as (select key, count(*) n, sum(strlen(value)) b from wal_log group by key),
r as (select key, count(*) n, sum(strlen(value)) b, sum(case deleted when true then 1 when false then 0 end) x from batch_writes group by key)
select coalesce(l.key, r.key) as key, cast(coalesce(l.n, 0) as bigint) as l_n, cast(coalesce(r.n, 0) as bigint) as r_n,
  cast(case when coalesce(l.key, r.key) is null then 0 else cast(coalesce(l.n, 0) as hugeint) * coalesce(r.n, 0) end as varchar) as pairs,
  cast(l.b as bigint) as l_bytes, cast(r.b as bigint) as r_bytes, cast(r.x as bigint) as r_deletes,
  cast(case when coalesce(l.key, r.key) is null then 0 else cast(coalesce(l.b, 0) as hugeint) * coalesce(r.n, 0) end as varchar) as j_l_bytes,
  cast(case when coalesce(l.key, r.key) is null then 0 else cast(coalesce(r.b, 0) as hugeint) * coalesce(l.n, 0) end as varchar) as j_r_bytes
from l full outer join r on l.key is not distinct from r.key""",
    "p4_found": _P4 + "select ref_table, strftime(seen_at, '%Y-%m-%d') as period, ptr_id from o",
    "p4_per_period": _P4 + "select ref_table, strftime(seen_at, '%Y-%m-%d') as period, cast(count(*) as bigint) as n_orphans from o group by 1, 2",
    "p5_found": """
with last as (select *, row_number() over (partition by feed, run_id order by attempt desc) rn from repl_runs),
ok as (select * from last where rn = 1 and lower(status) = 'ok'),
e as (select 'wal_log' as feed, version as seq, key, min(arrived_at) a from wal_log where version <> 0 and key is not null group by all
  union all select 'repl_feed' as feed, seq, key, min(arrived_at) a from repl_feed where seq is not null group by all)
select feed, seq, key from e where not exists (
  select 1 from ok where ok.feed = e.feed and ok.from_seq < e.seq and e.seq <= ok.to_seq and e.a <= ok.started_at)""",
}
