"""Queries of the read path: point, as-of, history, prefix, key scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve as R
from ..schema import NOW
from . import logs as L

AS_OF = 4000


def get_latest(s: SparkSession, d: str) -> DataFrame:
    return R.resolve(L.strings(s, d), now=NOW).select("key", "value", "version")


def get_asof(s: SparkSession, d: str) -> DataFrame:
    return R.resolve(L.strings(s, d), as_of=AS_OF, now=NOW).select("key", "value", "version")


def get_with_version(s: SparkSession, d: str) -> DataFrame:
    return R.resolve(L.all_types(s, d), now=NOW).select("dtype", "key", "sub", "value", "version")


def current_version(s: SparkSession, d: str) -> DataFrame:
    return L.events(s, d).agg(F.max("version").alias("current_version"))


def prefix_scan(s: SparkSession, d: str) -> DataFrame:
    log = L.all_types(s, d).filter((F.col("dtype") == "h") & F.col("key").startswith("h:1"))
    return R.resolve(log, now=NOW).select("key", "sub", "value")


def merge_sources(s: SparkSession, d: str) -> DataFrame:
    log = L.strings(s, d)
    return R.resolve(R.merge(log.filter("version % 3 = 0"), log.filter("version % 3 = 1"), log.filter("version % 3 = 2")), now=NOW).select("key", "value", "version")


def version_history(s: SparkSession, d: str) -> DataFrame:
    return R.history(L.strings(s, d)).select("key", "version", "value", "deleted", F.col("pos").cast("bigint").alias("pos"))


def version_history_asof(s: SparkSession, d: str) -> DataFrame:
    return R.history(L.strings(s, d), AS_OF).select("key", "version", "value", "deleted", F.col("pos").cast("bigint").alias("pos"))


def _names(s: SparkSession, d: str, glob: str) -> DataFrame:
    return R.names(R.resolve(L.all_types(s, d), now=NOW), glob)


def scan_keys_physical(s: SparkSession, d: str) -> DataFrame:
    state = R.resolve(L.all_types(s, d), now=NOW).select(R.physical_name(F.col("dtype"), F.col("key"), F.col("sub")).alias("name"))
    return state.filter(R.matches("name", "h:h:1*:[cv]*"))


def keys_glob(s: SparkSession, d: str) -> DataFrame:
    return _names(s, d, "u:1*")


def glob_class(s: SparkSession, d: str) -> DataFrame:
    return _names(s, d, "u:[^0-4]*")


def glob_qmark(s: SparkSession, d: str) -> DataFrame:
    return _names(s, d, "?:?[13]")


def glob_escape(s: SparkSession, d: str) -> DataFrame:
    return _names(s, d, "\\u:\\1?")


def scan_page_first(s: SparkSession, d: str) -> DataFrame:
    return R.page(R.resolve(L.all_types(s, d), now=NOW), None, 10)


def scan_page_next(s: SparkSession, d: str) -> DataFrame:
    return R.page(R.resolve(L.all_types(s, d), now=NOW), "h:12", 10, "*:*")


def snapshot_full(s: SparkSession, d: str) -> DataFrame:
    return R.resolve(L.strings(s, d), now=NOW, tombstones=True).select("key", F.when(~F.col("deleted"), F.col("value")).alias("value"), "deleted", "expires_at", "version")


def _wanted(s: SparkSession, d: str) -> DataFrame:
    """Two requests per customer, u:<custkey> and u:<nationkey>, so with misses and repeats."""
    asked = F.posexplode(F.array(F.col("c_custkey"), F.col("c_nationkey").cast("bigint"))).alias("i", "k")
    return L.read(s, d, "customer").select("c_custkey", asked).select((F.col("c_custkey") * 2 + F.col("i")).alias("pos"), F.concat(F.lit("u:"), F.col("k").cast("string")).alias("key"))


def mget(s: SparkSession, d: str) -> DataFrame:
    return R.mget(R.resolve(L.strings(s, d), now=NOW), _wanted(s, d))


def exists_keys(s: SparkSession, d: str) -> DataFrame:
    return _wanted(s, d).join(R.resolve(L.strings(s, d), now=NOW), "key", "left_semi").select("pos", "key")


def exists_any_type(s: SparkSession, d: str) -> DataFrame:
    state = R.resolve(L.all_types(s, d), now=NOW).filter("dtype <> 'b' or value = '1'")
    return state.select("key").distinct()


def collection_members(s: SparkSession, d: str) -> DataFrame:
    return R.resolve(L.all_types(s, d).filter("dtype <> 's'"), now=NOW).groupBy("key").agg(F.count(F.lit(1)).alias("members"))


def ttl(s: SparkSession, d: str) -> DataFrame:
    return R.ttl(L.strings(s, d), NOW)


QUERIES = {f.__name__: f for f in (get_latest, get_asof, get_with_version, current_version, prefix_scan, merge_sources, version_history, version_history_asof, scan_keys_physical, keys_glob, glob_class, glob_qmark, glob_escape, scan_page_first, scan_page_next, snapshot_full, mget, exists_keys, exists_any_type, collection_members, ttl)}

_S = L.with_(L.STRINGS)
_A = L.with_(L.ALL)
_live = f"{L.newest_sql('all_types')} z where {L.LIVE}"
_names_sql = f"{_A} select distinct key from {_live} and key <> ''"
_wanted_sql = "w as (select c_custkey * 2 as pos, concat('u:', cast(c_custkey as varchar)) as key from customer union all select c_custkey * 2 + 1 as pos, concat('u:', cast(c_nationkey as varchar)) as key from customer)"
_slive = f"{L.newest_sql('strings')} z where {L.LIVE}"

SQL = {
    "get_latest": f"{_S} select key, value, version from {_slive}",
    "get_asof": f"{_S} select key, value, version from {L.newest_sql('strings', f'version <= {AS_OF}')} z where {L.LIVE}",
    "get_with_version": f"{_A} select dtype, key, sub, value, version from {_live}",
    "current_version": "select max(event_id) + 1 as current_version from events",
    "prefix_scan": f"{_A} select key, sub, value from {_live} and dtype = 'h' and key like 'h:1%'",
    "merge_sources": f"{_S} select key, value, version from {_slive}",
    "version_history": f"{_S} select key, version, value, deleted, cast(row_number() over (partition by key order by version desc) as bigint) as pos from strings",
    "version_history_asof": f"{_S} select key, version, value, deleted, cast(row_number() over (partition by key order by version desc) as bigint) as pos from strings where version <= {AS_OF}",
    "scan_keys_physical": f"{_A} select name from (select case when dtype = 's' then concat(dtype, ':', key) else concat(dtype, ':', key, ':', sub) end as name from {_live}) y where name glob 'h:h:1*:[cv]*'",
    "keys_glob": f"{_names_sql} and key glob 'u:1*'",
    "glob_class": f"{_names_sql} and key glob 'u:[!0-4]*'",
    "glob_qmark": f"{_names_sql} and key glob '?:?[13]'",
    "glob_escape": f"{_names_sql} and key glob 'u:1?'",
    "scan_page_first": f"{_A} select key, cast(row_number() over (order by key) as bigint) as pos from (select distinct key from {_live} order by key limit 10) y",
    "scan_page_next": f"{_A} select key, cast(row_number() over (order by key) as bigint) as pos from (select distinct key from {_live} and key > 'h:12' order by key limit 10) y",
    "snapshot_full": f"{_S} select key, case when not deleted then value end as value, deleted, expires_at, version from {L.newest_sql('strings')} z where deleted or {L.LIVE}",
    "mget": f"{L.with_(L.STRINGS, _wanted_sql)} select w.pos, w.key, z.value, z.key is not null as present from w left join (select * from {_slive}) z on w.key = z.key",
    "exists_keys": f"{L.with_(L.STRINGS, _wanted_sql)} select pos, key from w where key in (select key from {_slive})",
    "exists_any_type": f"{_A} select distinct key from {_live} and (dtype <> 'b' or value = '1')",
    "collection_members": f"{_A} select key, cast(count(*) as bigint) as members from {_live} and dtype <> 's' group by key",
    "ttl": f"{_S} select key, cast(case when deleted or (expires_at > 0 and 1706400000 >= expires_at) then -2 when expires_at = 0 then -1 else expires_at - 1706400000 end as bigint) as ttl from {L.newest_sql('strings')} z",
}
