"""Queries of transactions, maintenance, replication and publish/subscribe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import feeds, maintenance as M, txn as X
from ..operators import resolve as R
from ..operators.incremental import speaking_runs
from ..operators.orphans import micros
from ..operators.scan import prefix_scan
from ..schema import NOW
from ..shared import materialize
from . import logs as L

READ_AT, HORIZON, SPAN, BACKLOG = 6000, 4000, 200, 10000
UNTIL = 1705000000


# transactions
def view_snapshot_sum(s: SparkSession, d: str) -> DataFrame:
    log = L.strings(s, d).withColumn("cents", F.round(F.col("score") * 100).cast("bigint"))
    return X.snapshot_total(log, READ_AT, "cents")


def read_your_writes(s: SparkSession, d: str) -> DataFrame:
    """A transaction at READ_AT that has written every 5th user and deleted every 7th."""
    snap = R.resolve(L.strings(s, d), as_of=READ_AT).select("key", "value")
    u = L.events(s, d).select("user_id", "u").distinct()
    own = u.filter("user_id % 5 = 0 or user_id % 7 = 0").select(F.concat(F.lit("u:"), "u").alias("key"), F.lit("mine").alias("value"), (F.col("user_id") % 7 == 0).alias("deleted"))
    return X.overlay(snap, own)


def _txns(s: SparkSession, d: str) -> DataFrame:
    return L.events(s, d).select(F.col("version").alias("txn"), F.concat(F.lit("u:"), "u").alias("key"), (F.col("version") - SPAN).alias("read_ts"), F.col("version").alias("commit_ts"), (F.col("et") != "view").alias("writes"))


def ssi_candidates(s: SparkSession, d: str) -> DataFrame:
    return X.conflict_candidates(_txns(s, d), SPAN)


def ssi_outcome(s: SparkSession, d: str) -> DataFrame:
    x = X.outcomes(_txns(s, d).withColumn("writes", F.lit(True)))
    return x.select("txn", "committed")


def multi_exec_outcome(s: SparkSession, d: str) -> DataFrame:
    """As ssi_outcome, where views only read: they never abort and leave no history."""
    return X.outcomes(_txns(s, d))


def ssi_multi(s: SparkSession, d: str) -> DataFrame:
    """Each event reads two keys, its user's and one of 211 groups'; all but views write the first, purchases the second too."""
    e = L.events(s, d).select(F.col("version").alias("txn"), (F.col("version") - SPAN).alias("read_ts"), F.col("version").alias("commit_ts"), "et", F.explode(F.array(
        F.struct(F.concat(F.lit("u:"), "u").alias("key"), (F.col("et") != "view").alias("writes")),
        F.struct(F.concat(F.lit("g:"), (F.col("event_id") * 31 % 211).cast("string")).alias("key"), (F.col("et") == "purchase").alias("writes")))).alias("x"))
    return X.outcomes(e.select("txn", "x.key", "read_ts", "commit_ts", "x.writes"))


def ssi_history_trim(s: SparkSession, d: str) -> DataFrame:
    """Committed keys still in the history when the oldest reader is at HORIZON."""
    return _txns(s, d).filter(F.col("writes") & (F.col("commit_ts") >= HORIZON)).groupBy("key").agg(F.max("commit_ts").alias("last_commit"), F.count(F.lit(1)).alias("n"))


def commit_at(s: SparkSession, d: str) -> DataFrame:
    """State when every 10th write was committed at a timestamp 100000 later, given by its caller."""
    log = L.strings(s, d).withColumn("version", F.col("version") + F.when(F.col("version") % 10 == 0, 100000).otherwise(0))
    return R.resolve(log, now=NOW).select("key", "value", "version")


def applied_watermark(s: SparkSession, d: str) -> DataFrame:
    return X.applied_watermark(L.events(s, d).filter("version % 7919 <> 0"))


def min_read_ts(s: SparkSession, d: str) -> DataFrame:
    """Of the readers that signed up and did not yet end in an error the oldest, else the last version."""
    e = L.events(s, d)
    last = e.groupBy("u").agg(F.max(F.when(F.col("et") == "signup", F.col("version"))).alias("began"), F.max(F.when(F.col("et") == "error", F.col("version"))).alias("ended"), F.max("version").alias("v"))
    open_ = F.when(F.coalesce(F.col("began") > F.coalesce("ended", F.lit(0)), F.lit(False)), F.col("began"))
    return last.agg(F.coalesce(F.min(open_), F.max("v")).alias("min_read_ts"))


def batch_atomicity(s: SparkSession, d: str) -> DataFrame:
    return X.torn_batches(L.read(s, d, "batch_writes"), "batch_id", "version")


# maintenance
def compact_retention(s: SparkSession, d: str) -> DataFrame:
    return M.retained(L.strings(s, d), ["dtype", "key", "sub"], HORIZON).select("key", "version", "deleted")


def compact_expired(s: SparkSession, d: str) -> DataFrame:
    """What compaction at HORIZON writes at NOW: expired puts as tombstones."""
    kept = M.tombstoned(M.retained(L.strings(s, d), ["dtype", "key", "sub"], HORIZON), NOW)
    return kept.select("key", "version", "value", "deleted")


def compact_bottom_drop(s: SparkSession, d: str) -> DataFrame:
    """The bottom level drops only while no reader is active, so the horizon is the log's last version."""
    by, log = ["dtype", "key", "sub"], L.strings(s, d)
    last = log.agg(F.max("version")).first()[0] or 0
    return M.bottom_drop(M.retained(log, by, last), by, NOW).select("key", "version")


def _tables(s: SparkSession, d: str) -> DataFrame:
    """lineitem as tables: level linenumber mod 3, cut by order key."""
    li = L.read(s, d, "lineitem").withColumn("level", (F.col("l_linenumber") % 3).cast("bigint"))
    li = li.withColumn("tno", F.floor((F.col("l_orderkey") + 137 * F.col("level")) / 500))
    t = li.groupBy("level", "tno").agg(F.min("l_orderkey").alias("mn"), F.max("l_orderkey").alias("mx"), F.count(F.lit(1)).alias("rows"), F.sum((F.col("l_returnflag") == "R").cast("bigint")).alias("dead"))
    return t.withColumn("t", F.col("level") * 1000000 + F.col("tno"))


def tombstone_ratio(s: SparkSession, d: str) -> DataFrame:
    return _tables(s, d).select("t", "level", "rows", "dead", (F.col("dead") > M.DUE * F.col("rows")).alias("due"))


BASE = 50


def _picked(s: SparkSession, tables: DataFrame) -> DataFrame:
    got = M.pick(tables, BASE)
    return s.createDataFrame([got] if got else [], "level bigint, t bigint")


def compaction_pick(s: SparkSession, d: str) -> DataFrame:
    """The table to compact for its tombstones, or the fullest level."""
    return _picked(s, _tables(s, d))


def compaction_pick_level(s: SparkSession, d: str) -> DataFrame:
    """The same without tombstones, so by levels' sizes."""
    return _picked(s, _tables(s, d).withColumn("dead", F.lit(0)))


def level_scores(s: SparkSession, d: str) -> DataFrame:
    """Level 0: tables over 4; below: rows over 1000 x 10 ** level. A score over 1 is due."""
    t = _tables(s, d).groupBy("level").agg(F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"))
    limit = F.when(F.col("level") == 0, F.lit(4.0)).when(F.col("level") == 1, F.lit(10000.0)).otherwise(F.lit(100000.0))
    return t.select("level", "tables", "rows", (F.when(F.col("level") == 0, F.col("tables")).otherwise(F.col("rows")) / limit).alias("score"))


def overlapping_tables(s: SparkSession, d: str) -> DataFrame:
    return M.overlaps(_tables(s, d), "mn", "mx", "t")


def ingest_self_overlap(s: SparkSession, d: str) -> DataFrame:
    return M.self_overlap(_tables(s, d).filter("level < 2"), "mn", "mx", "t").select("t", "mn", "mx")


def ingest_target_level(s: SparkSession, d: str) -> DataFrame:
    t = _tables(s, d)
    new = t.filter("level = 0").select(F.col("t").alias("n"), (F.col("mn") + 250).alias("lo"), (F.col("mn") + 260).alias("hi"))
    return M.target_level(new.select("n", F.col("lo").alias("mn"), F.col("hi").alias("mx")), t.filter("level > 0 and tno % 3 > 0"), "mn", "mx", "n", "level", 4)


def adaptive_threshold(s: SparkSession, d: str) -> DataFrame:
    return M.adaptive_threshold(L.events(s, d).withColumn("size", F.floor(F.col("v") * 10).cast("bigint")), "size", "event_id", 2048, 128, 1 << 20)


def value_separation(s: SparkSession, d: str) -> DataFrame:
    """Writes whose value reaches the threshold of the samples before go to the value log."""
    th = adaptive_threshold(s, d).select((F.col("window") + 1).alias("window"), "threshold")
    e = L.events(s, d).select("version", F.floor(F.col("event_id") / 2048).alias("window"), F.floor(F.col("v") * 10).cast("bigint").alias("size"))
    return e.join(th, "window", "left").groupBy("window").agg(F.sum((F.col("size") >= F.coalesce("threshold", F.lit(128))).cast("bigint")).alias("separated"), F.count(F.lit(1)).alias("n"))


def _vlog(s: SparkSession, d: str) -> DataFrame:
    v = L.read(s, d, "vlog_entries")
    return M.discard_stats(v.select("fid", "voffset", "vsize", micros("appended_at").alias("appended_at"), micros("dropped_at").alias("dropped_at")), F.lit(NOW * 1000000))


def vlog_discard_stats(s: SparkSession, d: str) -> DataFrame:
    return _vlog(s, d).select(F.col("fid").cast("bigint").alias("fid"), "live_bytes", "dead_bytes")


def vlog_gc_candidate(s: SparkSession, d: str) -> DataFrame:
    """The segment to collect: most dead bytes, at a ratio of at least 0.01."""
    return _vlog(s, d).filter("ratio >= 0.01").orderBy(F.desc("dead_bytes"), "fid").limit(1).select(F.col("fid").cast("bigint").alias("fid"), "dead_bytes")


def vlog_gc_rewrite(s: SparkSession, d: str) -> DataFrame:
    """The live entries of the candidate, in their new places."""
    best = vlog_gc_candidate(s, d).first()
    v = L.read(s, d, "vlog_entries").select(F.col("fid").cast("bigint").alias("fid"), "voffset", "vsize", "key", micros("appended_at").alias("appended_at"), micros("dropped_at").alias("dropped_at"))
    return M.gc_rewrite(v, best["fid"] if best else -1, F.lit(NOW * 1000000)).select("fid", "voffset", "key", "vsize", "to_fid", "to_offset")


def vlog_still_referenced(s: SparkSession, d: str) -> DataFrame:
    return M.still_referenced(L.read(s, d, "vlog_entries"), L.read(s, d, "value_pointers")).select(F.col("fid").cast("bigint").alias("fid"), "pointers", "removable")


def wal_valid_prefix(s: SparkSession, d: str) -> DataFrame:
    return M.valid_prefix(L.events(s, d), "version", F.col("version") % 4096 == 0).agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("last"))


def recover_state(s: SparkSession, d: str) -> DataFrame:
    """Replay: an expired put is a tombstone; tombstones are kept."""
    state = R.newest(L.strings(s, d))
    return state.select("key", "version", (~R.alive(NOW)).alias("tombstone"))


def manifest_live(s: SparkSession, d: str) -> DataFrame:
    return M.live_tables(L.read(s, d, "sst_manifest")).select("seq", F.col("level").cast("bigint").alias("level"), "min_key", "max_key")


def checkpoint_prune(s: SparkSession, d: str) -> DataFrame:
    runs = L.read(s, d, "repl_runs").filter("finished_at is not null").select(F.date_format("finished_at", "yyyyMMdd").alias("name")).distinct()
    return M.newest_checkpoints(runs, 5)


def pitr_state(s: SparkSession, d: str) -> DataFrame:
    return M.restore_until(L.strings(s, d), UNTIL, ["dtype", "key", "sub"])[0].select("key", "value", "version")


def pitr_stats(s: SparkSession, d: str) -> DataFrame:
    return M.restore_until(L.strings(s, d), UNTIL, ["dtype", "key", "sub"])[1]


def encrypt_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Values sealed with AES-GCM under a 16-byte key and opened again; whether the sealed one hides the value, and whether another key is refused."""
    key, other = F.lit("0123456789abcdef"), F.lit("0123456789abcdeX")
    # written, so that opening does not meet the sealing in one plan
    sealed = materialize(L.strings(s, d).select("key", "version", "value", F.aes_encrypt("value", key, F.lit("GCM")).alias("sealed")), "sealed")
    hidden = ~F.contains(F.hex("sealed"), F.hex("value")) & (F.octet_length("sealed") == F.octet_length("value") + 28)
    refused = F.try_aes_decrypt("sealed", other, F.lit("GCM")).isNull()
    return sealed.select("key", "version", F.aes_decrypt("sealed", key, F.lit("GCM")).cast("string").alias("value"), hidden.alias("hidden"), refused.alias("refused"))


def op_stats(s: SparkSession, d: str) -> DataFrame:
    from ..operators.patches import is_put

    op = F.when(is_put("op"), "put").when(~is_put("op"), "delete").otherwise("other")
    return L.read(s, d, "wal_log").groupBy(F.coalesce("dtype", F.lit("none")).alias("dtype"), op.alias("op")).agg(F.count(F.lit(1)).alias("n"))


# feeds
def _subscriptions(s: SparkSession, d: str) -> DataFrame:
    """Per user from each signup to the user's next error, on the channel of user mod 10."""
    e = L.events(s, d)
    nxt = F.min(F.when(F.col("et") == "error", F.col("version"))).over(W.partitionBy("u").orderBy("version").rowsBetween(1, W.unboundedFollowing))
    return e.withColumn("until", nxt).filter("et = 'signup'").select((F.col("user_id") % 10).alias("channel"), F.col("version").alias("since"), "until")


def pubsub_delivered(s: SparkSession, d: str) -> DataFrame:
    m = L.events(s, d).select("version", (F.col("user_id") % 10).alias("channel"), F.col("version").alias("t"))
    return feeds.delivered(m, _subscriptions(s, d)).select("version", "channel", "n")


def subscription_count(s: SparkSession, d: str) -> DataFrame:
    """Per client the number of subscriptions after each change."""
    e = L.events(s, d).filter("et in ('signup', 'error')")
    x = prefix_scan(e, ["u"], "version", {"n": F.when(F.col("et") == "signup", 1).otherwise(-1)})
    return x.select(F.col("u").alias("client"), "version", F.col("n").cast("bigint").alias("n"))


def psync_since(s: SparkSession, d: str) -> DataFrame:
    f = L.read(s, d, "repl_feed")
    top = f.agg(F.max("seq")).first()[0] or 0
    return feeds.since(f.select("pos", "op", "key", "val", "expires_at", "seq"), top - 5000, BACKLOG).select("seq", "op", "key", "val")


def psync_decision(s: SparkSession, d: str) -> DataFrame:
    """Each run of the log as a replica that asks for what comes after its to_seq."""
    top = L.read(s, d, "repl_feed").agg(F.max("seq")).first()[0] or 0
    asked = L.read(s, d, "repl_runs").filter("feed = 'repl_feed'").select("run_id", F.col("to_seq").alias("last")).distinct()
    return feeds.backlog_decision(asked, top, BACKLOG)


def snapshot_plus_tail(s: SparkSession, d: str) -> DataFrame:
    """A snapshot at READ_AT and the tail buffered meanwhile give the same state as the whole log."""
    log = L.strings(s, d)
    snap = R.newest(log, as_of=READ_AT)
    return R.resolve(R.merge(snap, log.filter(F.col("version") > READ_AT - 500)), now=NOW).select("key", "value", "version")


def replica_apply(s: SparkSession, d: str) -> DataFrame:
    return feeds.replica_state(L.read(s, d, "repl_feed").select("pos", "op", "key", "val", "expires_at", "seq"), NOW)


def successful_runs(s: SparkSession, d: str) -> DataFrame:
    return speaking_runs(L.read(s, d, "repl_runs")).select("feed", "from_seq", "to_seq")


QUERIES = {
    f.__name__: f
    for f in (
        view_snapshot_sum, read_your_writes, ssi_candidates, ssi_outcome, multi_exec_outcome, ssi_multi, ssi_history_trim, commit_at, applied_watermark, min_read_ts, batch_atomicity,
        compact_retention, compact_expired, compact_bottom_drop, tombstone_ratio, compaction_pick, compaction_pick_level, level_scores, overlapping_tables, ingest_self_overlap, ingest_target_level, adaptive_threshold, value_separation,
        vlog_discard_stats, vlog_gc_candidate, vlog_gc_rewrite, vlog_still_referenced, wal_valid_prefix, recover_state, manifest_live, checkpoint_prune, pitr_state, pitr_stats, encrypt_roundtrip, op_stats,
        pubsub_delivered, subscription_count, psync_since, psync_decision, snapshot_plus_tail, replica_apply, successful_runs,
    )
}

_S = L.with_(L.STRINGS)
_E = L.with_()
_tab = "tab as (select *, level * 1000000 + tno as t from (select level, (l_orderkey + 137 * level) // 500 as tno, min(l_orderkey) mn, max(l_orderkey) mx, count(*) as n, sum(case when l_returnflag = 'R' then 1 else 0 end) dead from (select *, cast(l_linenumber % 3 as bigint) as level from lineitem) x group by 1, 2) y)"
_TAB = f"with {_tab} "
_thr = "thr as (select event_id // 2048 as w, cast(least(greatest(list_sort(list(cast(floor(v * 10) as bigint)))[cast(floor(count(*) * 0.75) as bigint) + 1], 128), 1048576) as bigint) as threshold from e group by 1)"
_once = "(select * from (select *, row_number() over (partition by fid, voffset, appended_at order by dropped_at is null desc, dropped_at desc, vsize desc nulls last, key desc nulls last) rn from vlog_entries) y where rn = 1) x"
_vl = f"vl as (select fid, cast(sum(case when dropped_at is not null and dropped_at <= timestamp '2024-01-28 00:00:00' then 0 else coalesce(vsize, 0) end) as bigint) live_bytes, cast(sum(case when dropped_at is not null and dropped_at <= timestamp '2024-01-28 00:00:00' then coalesce(vsize, 0) else 0 end) as bigint) dead_bytes from {_once} group by fid)"


def _outcome(only: str) -> str:
    """Commit order folded per key by a recursion."""
    return f"""{L.with_()}, o as (select concat('u:', u) as key, version as ver, et, row_number() over (partition by u order by version) i from e {only}),
f as (select key, cast(0 as bigint) as i, cast(-1000000 as bigint) as l, cast(null as bigint) as txn, true as ok from (select distinct key from o) k
 union all select o.key, o.i, case when f.l > o.ver - {SPAN} then f.l else o.ver end, o.ver, f.l <= o.ver - {SPAN} from f join o on o.key = f.key and o.i = f.i + 1)
select txn, ok as committed from f where txn is not null"""


def _pick(dead: str) -> str:
    """Levels 0 to 2 of 5 are there, so the limits of levels 1 to 4 are of base x ratio, upwards: 0, 0, 0, 10 x base; with level 4 empty only level 0 can be over its limit."""
    return f"""{_TAB}, due as (select level, t from tab where {dead} > 0.4::double * n order by level desc, t limit 1)
select level, t from due union all select cast(0 as bigint) as level, cast(null as bigint) as t from tab where level = 0 and not exists (select 1 from due) having count(*) >= 4"""


_put = "upper(trim(op)) in ('PUT', 'SET', '1')"
_del = "upper(trim(op)) in ('DEL', 'DELETE', '2')"
SQL = {
    "view_snapshot_sum": f"{_S} select cast(count(*) as bigint) as n, cast(coalesce(sum(cast(round(score * 100) as bigint)), 0) as bigint) as total from {L.newest_sql('strings', f'version <= {READ_AT}')} z where not deleted",
    "read_your_writes": f"""{_S}, own as (select distinct concat('u:', u) as key, user_id % 7 = 0 as gone from e where user_id % 5 = 0 or user_id % 7 = 0)
select key, 'mine' as value, true as own from own where not gone union all select key, value, false as own from {L.newest_sql('strings', f'version <= {READ_AT}')} z where not deleted and key not in (select key from own)""",
    "ssi_candidates": f"{_E} select a.version as txn, b.version as other, concat('u:', a.u) as key from e a join e b on a.u = b.u and b.version > a.version - {SPAN} and b.version < a.version",
    "ssi_outcome": _outcome(""),
    "multi_exec_outcome": _outcome("where et <> 'view'") + " union all select version as txn, true as committed from e where et = 'view'",
    "ssi_multi": f"""{_E}, o as (select version as ver, concat('u:', u) as k1, et <> 'view' as w1, concat('g:', cast(event_id * 31 % 211 as varchar)) as k2, et = 'purchase' as w2 from e),
f as (select cast(0 as bigint) as ver, [{{'k': '', 't': cast(-1000000 as bigint)}}] as h, true as ok union all
 select o.ver, case when x.ok then list_concat(list_filter(f.h, lambda y: y.t > o.ver - {SPAN}), case when o.w1 then [{{'k': o.k1, 't': o.ver}}] else [] end, case when o.w2 then [{{'k': o.k2, 't': o.ver}}] else [] end) else f.h end, x.ok
 from f join o on o.ver = f.ver + 1, lateral (select not o.w1 and not o.w2 or len(list_filter(f.h, lambda y: y.t > o.ver - {SPAN} and (y.k = o.k1 or y.k = o.k2))) = 0 as ok) x)
select ver as txn, ok as committed from f where ver > 0""",
    "ssi_history_trim": f"{_E} select concat('u:', u) as key, max(version) as last_commit, cast(count(*) as bigint) as n from e where et <> 'view' and version >= {HORIZON} group by u",
    "commit_at": f"{_S}, moved as (select * replace (version + case when version % 10 = 0 then 100000 else 0 end as version) from strings) select key, value, version from {L.newest_sql('moved')} z where {L.LIVE}",
    "applied_watermark": f"{_E} select cast(coalesce(max(version), 0) as bigint) as watermark from (select version, row_number() over (order by version) rn from e where version % 7919 <> 0) x where rn = version",
    "min_read_ts": f"{_E} select coalesce(min(case when began > coalesce(ended, 0) then began end), max(v)) as min_read_ts from (select u, max(case when et = 'signup' then version end) began, max(case when et = 'error' then version end) ended, max(version) v from e group by u) x",
    "batch_atomicity": "select batch_id, cast(count(*) as bigint) as entries, cast(count(distinct version) as bigint) as versions, count(distinct version) <> 1 as torn from batch_writes group by batch_id",
    "compact_retention": f"{_S} select key, version, deleted from (select *, row_number() over (partition by key, version <= {HORIZON} order by version desc) rn from strings) x where version > {HORIZON} or rn = 1",
    "compact_bottom_drop": f"{_S} select key, version from {L.newest_sql('strings')} z where {L.LIVE}",
    "compact_expired": f"{_S} select key, version, case when deleted or expires_at = 0 or expires_at > {NOW} then value end as value, deleted or (expires_at > 0 and expires_at <= {NOW}) as deleted from (select *, row_number() over (partition by key, version <= {HORIZON} order by version desc) rn from strings) x where version > {HORIZON} or rn = 1",
    "compaction_pick": _pick("dead"),
    "compaction_pick_level": _pick("0"),
    "vlog_gc_rewrite": f"""with {_vl}, best as (select fid from vl where dead_bytes >= 0.01 * (live_bytes + dead_bytes) order by dead_bytes desc, fid limit 1),
o as (select * from {_once} where fid = (select fid from best) and (dropped_at is null or dropped_at > timestamp '2024-01-28 00:00:00'))
select cast(fid as bigint) as fid, voffset, key, cast(coalesce(vsize, 0) as bigint) as vsize, (select cast(max(fid) + 1 as bigint) from vlog_entries) as to_fid,
  cast(coalesce(sum(coalesce(vsize, 0)) over (order by voffset, appended_at rows between unbounded preceding and 1 preceding), 0) as bigint) as to_offset from o""",
    "vlog_still_referenced": """select cast(v.fid as bigint) as fid, cast(count(p.fid) as bigint) as pointers, count(p.fid) = 0 as removable from (select distinct fid, voffset from vlog_entries) v
left join (select distinct fid, voffset from value_pointers where fid is not null and voffset is not null) p on p.fid = v.fid and p.voffset = v.voffset group by v.fid""",
    "tombstone_ratio": f"{_TAB} select t, level, n as rows, cast(dead as bigint) as dead, dead > 0.4::double * n as due from tab",
    "level_scores": f"{_TAB} select level, cast(count(*) as bigint) as tables, cast(sum(n) as bigint) as rows, case level when 0 then count(*) / 4.0::double when 1 then cast(sum(n) as bigint) / 10000.0::double else cast(sum(n) as bigint) / 100000.0::double end as score from tab group by level",
    "overlapping_tables": f"{_TAB} select a.t as a, b.t as b from tab a join tab b on a.t < b.t and a.mn <= b.mx and b.mn <= a.mx",
    "ingest_self_overlap": f"{_TAB} select t, mn, mx from (select *, max(mx) over (order by mn, mx, t rows between unbounded preceding and 1 preceding) p from tab where level < 2) x where p >= mn",
    "ingest_target_level": f"{_TAB} select n.t as n, cast(greatest(coalesce(min(o.level) - 1, 4), 0) as bigint) as target from (select t, mn + 250 as lo, mn + 260 as hi from tab where level = 0) n left join (select * from tab where level > 0 and tno % 3 > 0) o on n.lo <= o.mx and o.mn <= n.hi group by n.t",
    "adaptive_threshold": f"{L.with_(_thr)} select w as \"window\", threshold from thr",
    "value_separation": f"{L.with_(_thr)} select e.event_id // 2048 as \"window\", cast(sum(case when floor(v * 10) >= coalesce(threshold, 128) then 1 else 0 end) as bigint) as separated, cast(count(*) as bigint) as n from e left join thr on thr.w + 1 = e.event_id // 2048 group by 1",
    "vlog_discard_stats": f"with {_vl} select cast(fid as bigint) as fid, live_bytes, dead_bytes from vl",
    "vlog_gc_candidate": f"with {_vl} select cast(fid as bigint) as fid, dead_bytes from vl where dead_bytes >= 0.01 * (live_bytes + dead_bytes) order by dead_bytes desc, fid limit 1",
    "wal_valid_prefix": f"{_E} select cast(count(*) as bigint) as n, max(version) as last from (select *, sum(case when version % 4096 = 0 then 1 else 0 end) over (order by version) b from e) x where b = 0",
    "recover_state": f"{_S} select key, version, not ({L.LIVE}) as tombstone from {L.newest_sql('strings')} z",
    "manifest_live": "select seq, cast(level as bigint) as level, min_key, max_key from (select *, row_number() over (partition by seq order by man_id desc) rn from sst_manifest) x where rn = 1 and upper(action) = 'A'",
    "checkpoint_prune": "select name, row_number() over (order by name desc) <= 5 as kept from (select distinct strftime(finished_at, '%Y%m%d') as name from repl_runs where finished_at is not null) x",
    "pitr_state": f"{_S} select key, value, version from {L.newest_sql('strings', f'ts_s <= {UNTIL}')} z where not deleted",
    "pitr_stats": f"{_E} select cast(count(case when ts_s <= {UNTIL} then 1 end) as bigint) as kept, cast(count(case when ts_s > {UNTIL} then 1 end) as bigint) as skipped from e",
    "encrypt_roundtrip": f"{_S} select key, version, value, true as hidden, true as refused from strings",
    "op_stats": f"select coalesce(dtype, 'none') as dtype, case when {_put} then 'put' when {_del} then 'delete' else 'other' end as op, cast(count(*) as bigint) as n from wal_log group by 1, 2",
    "pubsub_delivered": f"""{_E}, sub as (select user_id % 10 as channel, version as since, (select min(b.version) from e b where b.u = a.u and b.et = 'error' and b.version > a.version) as until from e a where et = 'signup')
select e.version, e.user_id % 10 as channel, cast(count(sub.since) as bigint) as n from e left join sub on sub.channel = e.user_id % 10 and sub.since <= e.version and (sub.until is null or e.version < sub.until) group by 1, 2""",
    "subscription_count": f"{_E} select u as client, version, cast(sum(case when et = 'signup' then 1 else -1 end) over (partition by u order by version) as bigint) as n from e where et in ('signup', 'error')",
    "psync_since": f"select seq, op, key, val from (select *, row_number() over (partition by seq order by pos) rn, (select max(seq) from repl_feed) m from repl_feed) x where rn = 1 and seq > greatest(m - 5000, m - {BACKLOG})",
    "psync_decision": f"select run_id, last, last > 0 and last <= m and last + 1 >= greatest(1, m - {BACKLOG} + 1) as partial from (select distinct run_id, to_seq as last, (select max(seq) from repl_feed) m from repl_runs where feed = 'repl_feed') x",
    "snapshot_plus_tail": f"{_S} select key, value, version from {L.newest_sql('strings')} z where {L.LIVE}",
    "replica_apply": f"select key, val, coalesce(expires_at, 0) as expires_at, seq from (select *, row_number() over (partition by key order by seq desc, pos) rn from repl_feed where key is not null and ({_put} or {_del})) x where rn = 1 and {_put} and (coalesce(expires_at, 0) = 0 or expires_at > {NOW})",
    "successful_runs": "select feed, from_seq, to_seq from (select *, row_number() over (partition by feed, run_id order by attempt desc, lower(status) = 'ok' desc) rn from repl_runs) x where rn = 1 and lower(status) = 'ok'",
}
