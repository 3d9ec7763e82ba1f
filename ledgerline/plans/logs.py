"""Operation logs derived from the driver's tables, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lists import contents
from ..operators.scan import previous
from ..schema import BITMAP, HASH, LIST, SET, STRING, ZSET
from ..shared import read


def seconds(c: str) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select((F.col("event_id") + 1).alias("version"), "event_id", F.col("user_id").cast("string").alias("u"), F.col("user_id"), F.col("event_type").alias("et"), F.col("value").alias("v"), seconds("ts").alias("ts_s"))


def _log(e: DataFrame, dtype: str, key: Column, sub: Column, value: Column, score: Column, deleted: Column, expires: Column) -> DataFrame:
    return e.select(F.lit(dtype).alias("dtype"), key.alias("key"), sub.alias("sub"), value.alias("value"), score.cast("double").alias("score"), deleted.alias("deleted"), expires.cast("bigint").alias("expires_at"), "version", "ts_s")


def strings(spark: SparkSession, d: str) -> DataFrame:
    """u:<user>: error deletes, view sets for value hours, others set."""
    e = events(spark, d)
    ex = F.when(F.col("et") == "view", F.col("ts_s") + F.floor(F.col("v") * 3600).cast("bigint")).otherwise(F.lit(0))
    return _log(e, STRING, F.concat(F.lit("u:"), "u"), F.lit(""), F.concat(F.lit("v"), F.col("event_id").cast("string")), F.col("v"), F.col("et") == "error", ex)


def hashes(spark: SparkSession, d: str) -> DataFrame:
    """h:<user>, field event type: error deletes the user's previous field."""
    e = previous(events(spark, d), ["u"], "version", "et", "prev")
    gone = F.col("et") == "error"
    return _log(e, HASH, F.concat(F.lit("h:"), "u"), F.when(gone, F.coalesce("prev", F.lit("none"))).otherwise(F.col("et")), F.concat(F.lit("f"), F.col("event_id").cast("string")), F.col("v"), gone, F.lit(0))


def sets(spark: SparkSession, d: str) -> DataFrame:
    """s:<type>, member the user: values under 5 remove."""
    return _log(events(spark, d), SET, F.concat(F.lit("s:"), "et"), F.concat(F.lit("m"), "u"), F.lit(""), F.col("v"), F.col("v") < 5, F.lit(0))


def big_sets(spark: SparkSession, d: str) -> DataFrame:
    """Additions with a value over 100 only, so that intersections differ, and all removals."""
    return sets(spark, d).filter((F.col("score") > 100) | F.col("deleted"))


def zsets(spark: SparkSession, d: str) -> DataFrame:
    """board:<user mod 3>, member the user, score the value: error removes."""
    return _log(events(spark, d), ZSET, F.concat(F.lit("board:"), (F.col("user_id") % 3).cast("string")), F.concat(F.lit("m"), "u"), F.lit(""), F.col("v"), F.col("et") == "error", F.lit(0))


def bits(spark: SparkSession, d: str) -> DataFrame:
    """b:<type>, offset 37 x user: value under 5 clears. Columns key, off, bit, version."""
    return events(spark, d).select(F.concat(F.lit("b:"), "et").alias("key"), (F.col("user_id") * 37).alias("off"), F.when(F.col("v") < 5, 0).otherwise(1).cast("bigint").alias("bit"), "version")


def bit_log(spark: SparkSession, d: str) -> DataFrame:
    b = bits(spark, d)
    return b.select(F.lit(BITMAP).alias("dtype"), "key", F.col("off").cast("string").alias("sub"), F.col("bit").cast("string").alias("value"), F.col("bit").cast("double").alias("score"), F.lit(False).alias("deleted"), F.lit(0).cast("bigint").alias("expires_at"), "version", F.lit(0).cast("bigint").alias("ts_s"))


def deques(spark: SparkSession, d: str) -> DataFrame:
    """q:<user>: click RPUSH, signup LPUSH, view RPOP, error LPOP. Columns key, version, op, elem."""
    op = F.create_map(*[F.lit(x) for p in (("click", "RPUSH"), ("signup", "LPUSH"), ("view", "RPOP"), ("error", "LPOP")) for x in p])[F.col("et")]
    return events(spark, d).select(F.concat(F.lit("q:"), "u").alias("key"), "version", op.alias("op"), F.col("event_id").cast("string").alias("elem")).filter("op is not null")


def list_log(spark: SparkSession, d: str) -> DataFrame:
    """What the lists hold at the end: a row per element, at its position."""
    held = contents(deques(spark, d))
    return held.select(F.lit(LIST).alias("dtype"), "key", F.col("pos").cast("string").alias("sub"), F.col("elem").alias("value"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("deleted"), F.lit(0).cast("bigint").alias("expires_at"), "version", F.lit(0).cast("bigint").alias("ts_s"))


def counters(spark: SparkSession, d: str) -> DataFrame:
    """c:<user>: signup SETs 0, others add floor(value). Columns key, version, reset, delta, expires_at."""
    e = events(spark, d)
    return e.select(F.concat(F.lit("c:"), "u").alias("key"), "version", (F.col("et") == "signup").alias("reset"), F.when(F.col("et") == "signup", 0).otherwise(F.floor("v")).cast("bigint").alias("delta"), "ts_s")


def all_types(spark: SparkSession, d: str) -> DataFrame:
    out = strings(spark, d)
    for x in (hashes, sets, zsets, bit_log, list_log):
        out = out.unionByName(x(spark, d))
    return out


_T = "cast(floor(epoch(ts)) as bigint)"
_COLS = "version, ts_s"
E = f"e as (select event_id + 1 as version, event_id, cast(user_id as varchar) as u, user_id, event_type as et, value as v, {_T} as ts_s from events)"
STRINGS = f"""strings as (select 's' as dtype, concat('u:', u) as key, '' as sub, concat('v', cast(event_id as varchar)) as value, v as score, et = 'error' as deleted,
  case when et = 'view' then ts_s + cast(floor(v * 3600) as bigint) else cast(0 as bigint) end as expires_at, {_COLS} from e)"""
HASHES = f"""hashes as (select 'h' as dtype, concat('h:', u) as key, case when et = 'error' then coalesce(prev, 'none') else et end as sub, concat('f', cast(event_id as varchar)) as value, v as score,
  et = 'error' as deleted, cast(0 as bigint) as expires_at, {_COLS} from (select *, lag(et) over (partition by u order by version) prev from e) x)"""
SETS = f"sets as (select 't' as dtype, concat('s:', et) as key, concat('m', u) as sub, '' as value, v as score, v < 5 as deleted, cast(0 as bigint) as expires_at, {_COLS} from e)"
ZSETS = f"zsets as (select 'z' as dtype, concat('board:', cast(user_id % 3 as varchar)) as key, concat('m', u) as sub, '' as value, v as score, et = 'error' as deleted, cast(0 as bigint) as expires_at, {_COLS} from e)"
BITS = "bits as (select concat('b:', et) as key, user_id * 37 as off, cast(case when v < 5 then 0 else 1 end as bigint) as bit, version from e)"
BIT_LOG = "bit_log as (select 'b' as dtype, key, cast(off as varchar) as sub, cast(bit as varchar) as value, cast(bit as double) as score, false as deleted, cast(0 as bigint) as expires_at, version, cast(0 as bigint) as ts_s from bits)"
DEQUES = "deques as (select concat('q:', u) as key, version, case et when 'click' then 'RPUSH' when 'signup' then 'LPUSH' when 'view' then 'RPOP' when 'error' then 'LPOP' end as op, cast(event_id as varchar) as elem from e where et in ('click', 'signup', 'view', 'error'))"
COUNTERS = "counters as (select concat('c:', u) as key, version, et = 'signup' as reset, case when et = 'signup' then cast(0 as bigint) else cast(floor(v) as bigint) end as delta, ts_s from e)"
# the list after each operation, by recursion over a key's operations
FOLD = """ops as (select *, row_number() over (partition by key order by version) i from deques),
df as (select key, cast(0 as bigint) as i, cast([] as varchar[]) as a, cast(null as varchar) as r, cast(0 as bigint) as version, '' as op from (select distinct key from ops) k
 union all select ops.key, ops.i, case ops.op when 'RPUSH' then list_append(df.a, ops.elem) when 'LPUSH' then list_prepend(ops.elem, df.a) when 'RPOP' then df.a[1:len(df.a)-1] else df.a[2:len(df.a)] end,
  case ops.op when 'RPOP' then df.a[len(df.a)] when 'LPOP' then df.a[1] end, ops.version, ops.op from df join ops on ops.key = df.key and ops.i = df.i + 1),
held as (select key, unnest(a) as elem, cast(generate_subscripts(a, 1) - 1 as bigint) as pos, len(a) as n from (select key, arg_max(a, i) a from df group by key) x)"""
LIST_LOG = "list_log as (select 'l' as dtype, key, cast(pos as varchar) as sub, elem as value, cast(null as double) as score, false as deleted, cast(0 as bigint) as expires_at, cast(elem as bigint) + 1 as version, cast(0 as bigint) as ts_s from held)"
_ALL = "all_types as (select * from strings union all select * from hashes union all select * from sets union all select * from zsets union all select * from bit_log union all select * from list_log)"


def with_(*ctes: str) -> str:
    return "with recursive " + ", ".join((E, *ctes)) + " "


ALL = ", ".join((STRINGS, HASHES, SETS, ZSETS, BITS, BIT_LOG, DEQUES, FOLD, LIST_LOG, _ALL))


def newest_sql(log: str, where: str = "true") -> str:
    """The newest row per record of a log CTE."""
    return f"(select * from (select *, row_number() over (partition by dtype, key, sub order by version desc) rn from {log} where {where}) n where rn = 1)"


LIVE = "not deleted and (expires_at = 0 or 1706400000 < expires_at)"
