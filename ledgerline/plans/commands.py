"""Queries of the command surface: strings, counters, expiry, hashes, lists, sets, sorted sets, bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bitmaps as B
from ..operators import collections as C
from ..operators import lists as Q
from ..operators import resolve as R
from ..operators import strings as S
from ..operators.scan import prefix_scan, previous, ranked
from ..schema import NOW
from . import logs as L

FLUSHED = 5000


# strings, counters, expiry
def set_lww(s: SparkSession, d: str) -> DataFrame:
    return R.resolve(L.strings(s, d)).select("key", "value", "version")


def _options(s: SparkSession, d: str) -> DataFrame:
    """SETs with an option by event id: EX, PX, EXAT, PXAT or none, amount from the value."""
    e = L.events(s, d)
    option = F.element_at(F.array(*[F.lit(x) for x in ("EX", "PX", "EXAT", "PXAT", "")]), (F.col("event_id") % 5 + 1).cast("int"))
    amount = F.floor(F.col("v") * 1000).cast("bigint") + F.when(option.isin("EXAT"), F.col("ts_s")).when(option == "PXAT", F.col("ts_s") * 1000).otherwise(F.lit(0))
    return e.select("version", F.concat(F.lit("u:"), "u").alias("key"), option.alias("option"), amount.alias("amount"), "ts_s")


def set_with_ttl(s: SparkSession, d: str) -> DataFrame:
    o = _options(s, d)
    log = o.select(F.lit("s").alias("dtype"), "key", F.lit("").alias("sub"), F.lit(False).alias("deleted"), S.expiry(F.col("option"), F.col("amount"), F.col("ts_s")).alias("expires_at"), "version")
    return R.resolve(log, now=NOW).select("key", "expires_at", "version")


def setex(s: SparkSession, d: str) -> DataFrame:
    e = L.events(s, d)
    log = e.select(F.lit("s").alias("dtype"), F.concat(F.lit("u:"), "u").alias("key"), F.lit("").alias("sub"), F.lit(False).alias("deleted"), S.setex(F.floor((F.col("v") - 50) * 36000).cast("bigint"), F.col("ts_s")).alias("expires_at"), "version")
    return R.resolve(log, now=NOW).select("key", "expires_at", "version")


def getdel(s: SparkSession, d: str) -> DataFrame:
    """GETDEL of every live key: the value and the tombstone's version, one past the log's last."""
    log = L.strings(s, d)
    last = log.agg(F.max("version")).first()[0]
    return R.resolve(log, now=NOW).select("key", "value", F.lit(last + 1 if last is not None else 1).cast("bigint").alias("tombstone"))


def _doomed(s: SparkSession, d: str) -> DataFrame:
    return L.read(s, d, "customer").select(F.concat(F.element_at(F.array(F.lit("u:"), F.lit("h:"), F.lit("none:")), (F.col("c_custkey") % 3 + 1).cast("int")), F.col("c_custkey").cast("string")).alias("key")).distinct()


def del_count(s: SparkSession, d: str) -> DataFrame:
    state = R.resolve(L.all_types(s, d), now=NOW)
    return _doomed(s, d).join(state, "key", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def del_effect(s: SparkSession, d: str) -> DataFrame:
    return R.resolve(L.all_types(s, d), now=NOW).join(_doomed(s, d), "key", "left_anti").select("dtype", "key", "sub", "version")


def mset_atomic(s: SparkSession, d: str) -> DataFrame:
    """Batches as MSETs: one version each, of a key twice in a batch the last stands; reported copies change nothing."""
    b = L.read(s, d, "batch_writes").filter("key is not null").select("key", "version", "ord", "bw_id", "value", F.coalesce("deleted", F.lit(False)).alias("deleted"))
    return R.newest(b, by=["key"], order=["version", "ord", "bw_id"]).filter("not deleted").select("key", "value", "version")


def incr_running(s: SparkSession, d: str) -> DataFrame:
    return S.incr(L.counters(s, d), "key", "version", "reset", "delta").select("key", "version", "n")


def incr_final(s: SparkSession, d: str) -> DataFrame:
    x = S.incr(L.counters(s, d), "key", "version", "reset", "delta")
    return x.groupBy("key").agg(F.max(F.struct("version", "n")).alias("r")).select("key", "r.n")


def incr_invalid(s: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(F.lit(""), F.lit(" 12 "), F.lit("x1"), F.lit("9223372036854775808"), F.col("event_id").cast("string"), F.concat(F.lit("-"), F.col("event_id").cast("string"))), (F.col("event_id") % 6 + 1).cast("int"))
    n = S.counter_value(text)
    return L.events(s, d).select("version", n.isNotNull().alias("ok"), (n + 1).alias("n"))


def _asked(s: SparkSession, d: str, log: DataFrame) -> DataFrame:
    k = log.select("key").distinct()
    return k.select("key", ((F.length("key") % 3 - 1) * 10000).cast("bigint").alias("seconds"))


def expire_string(s: SparkSession, d: str) -> DataFrame:
    log = L.strings(s, d)
    return S.expire(log, _asked(s, d, log), NOW).select("key", "value", "expires_at", "found")


def expire_collection(s: SparkSession, d: str) -> DataFrame:
    log = L.hashes(s, d)
    return S.expire(log, _asked(s, d, log), NOW).select("key", "sub", "value", "expires_at", "found")


def expire_list(s: SparkSession, d: str) -> DataFrame:
    log = L.list_log(s, d)
    return S.expire(log, _asked(s, d, log), NOW).select("key", "sub", "value", "expires_at", "found")


def expire_due(s: SparkSession, d: str) -> DataFrame:
    """Tombstones of a sweep five days past NOW."""
    return R.newest(L.strings(s, d)).filter((~F.col("deleted")) & F.col("expires_at").between(1, NOW + 432000)).select("key", "expires_at", "version")


def delete_existed(s: SparkSession, d: str) -> DataFrame:
    return C.removed(L.strings(s, d)).select("key", "version", F.col("removed").alias("existed"))


def skipwal_recovery(s: SparkSession, d: str) -> DataFrame:
    """State after a crash: writes without log (every 7th) survive only up to the last flush."""
    return R.resolve(L.strings(s, d).filter((F.col("version") % 7 != 0) | (F.col("version") <= FLUSHED)), now=NOW).select("key", "value", "version")


# hashes
def hset_created(s: SparkSession, d: str) -> DataFrame:
    return C.created(L.hashes(s, d)).groupBy("key").agg(F.sum(F.col("created").cast("bigint")).alias("created"), F.count(F.lit(1)).alias("writes"))


def hget(s: SparkSession, d: str) -> DataFrame:
    return R.resolve(L.hashes(s, d).filter("sub = 'view'"), now=NOW).select("key", "value")


def hdel(s: SparkSession, d: str) -> DataFrame:
    return C.removed(L.hashes(s, d))


def hgetall(s: SparkSession, d: str) -> DataFrame:
    return R.resolve(L.hashes(s, d), now=NOW).select("key", F.col("sub").alias("field"), "value")


def hlen(s: SparkSession, d: str) -> DataFrame:
    return C.size(R.resolve(L.hashes(s, d), now=NOW))


def hkeys(s: SparkSession, d: str) -> DataFrame:
    return ranked(R.resolve(L.hashes(s, d), now=NOW).select("key", F.col("sub").alias("field")), ["key"], ["field"], "pos")


# lists
def _pushes(s: SparkSession, d: str, op: str) -> DataFrame:
    return L.deques(s, d).withColumn("op", F.lit(op))


def lpush_order(s: SparkSession, d: str) -> DataFrame:
    return Q.contents(_pushes(s, d, "LPUSH")).select("key", "pos", "elem")


def rpush_order(s: SparkSession, d: str) -> DataFrame:
    return Q.contents(_pushes(s, d, "RPUSH")).select("key", "pos", "elem")


def push_len(s: SparkSession, d: str) -> DataFrame:
    """The length that each push returns."""
    return prefix_scan(_pushes(s, d, "RPUSH"), ["key"], "version", {"n": F.lit(1)}).select("key", "version", "n")


def deque_replay(s: SparkSession, d: str) -> DataFrame:
    return Q.contents(L.deques(s, d)).select("key", "pos", "elem")


def pop_results(s: SparkSession, d: str) -> DataFrame:
    return Q.pops(L.deques(s, d))


def llen(s: SparkSession, d: str) -> DataFrame:
    return Q.contents(L.deques(s, d)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def lrange_pos(s: SparkSession, d: str) -> DataFrame:
    return Q.lrange(Q.contents(L.deques(s, d)), 1, 4)


def lrange_neg(s: SparkSession, d: str) -> DataFrame:
    return Q.lrange(Q.contents(L.deques(s, d)), -3, -1)


def lrange_clamp(s: SparkSession, d: str) -> DataFrame:
    return Q.lrange(Q.contents(L.deques(s, d)), -1000, 1000)


# sets
def sadd_added(s: SparkSession, d: str) -> DataFrame:
    return C.created(L.sets(s, d)).filter("created").select("key", "sub", "version")


def srem_effect(s: SparkSession, d: str) -> DataFrame:
    return C.removed(L.sets(s, d))


def smembers(s: SparkSession, d: str) -> DataFrame:
    return ranked(R.resolve(L.sets(s, d)).select("key", F.col("sub").alias("member")), ["key"], ["member"], "pos")


def sismember(s: SparkSession, d: str) -> DataFrame:
    state = R.resolve(L.sets(s, d)).filter("key = 's:click'").select("sub", F.lit(1).alias("is"))
    return L.events(s, d).select(F.concat(F.lit("m"), "u").alias("sub")).distinct().join(state, "sub", "left").select(F.col("sub").alias("member"), F.coalesce("is", F.lit(0)).cast("bigint").alias("is_member"))


def scard(s: SparkSession, d: str) -> DataFrame:
    return C.size(R.resolve(L.sets(s, d)))


def sinter_2(s: SparkSession, d: str) -> DataFrame:
    return C.intersect(R.resolve(L.big_sets(s, d)), ["s:click", "s:view"]).select(F.col("sub").alias("member"))


def sinter_n(s: SparkSession, d: str) -> DataFrame:
    return C.intersect(R.resolve(L.big_sets(s, d)), ["s:click", "s:view", "s:purchase", "s:signup"]).select(F.col("sub").alias("member"))


# sorted sets
def zadd_added(s: SparkSession, d: str) -> DataFrame:
    return C.created(L.zsets(s, d)).filter("created").select("key", "sub", "version")


def zadd_update(s: SparkSession, d: str) -> DataFrame:
    """Writes that move a member that is there to another score: (key, sub, version, old, score)."""
    z = L.zsets(s, d).withColumn("at", F.when(~F.col("deleted"), F.col("score")))
    return previous(z, ["key", "sub"], "version", "at", "old").filter("not deleted and old <> score").select("key", "sub", "version", "old", "score")


def zscore(s: SparkSession, d: str) -> DataFrame:
    return R.resolve(L.zsets(s, d)).select("key", "sub", "score")


def _ranked(x: DataFrame) -> DataFrame:
    return ranked(x.select("key", F.col("sub").alias("member"), "score"), ["key"], ["score", "member"], "pos")


def zrangebyscore(s: SparkSession, d: str) -> DataFrame:
    return _ranked(C.score_range(R.resolve(L.zsets(s, d)), 20.0, 90.0))


def zrange_inf(s: SparkSession, d: str) -> DataFrame:
    return _ranked(C.score_range(R.resolve(L.zsets(s, d)), float("-inf"), float("inf")))


def zrem_effect(s: SparkSession, d: str) -> DataFrame:
    return C.removed(L.zsets(s, d))


# bitmaps
def setbit_old(s: SparkSession, d: str) -> DataFrame:
    return B.setbit(L.bits(s, d))


def getbit(s: SparkSession, d: str) -> DataFrame:
    asked = L.read(s, d, "customer").select(F.col("c_custkey").alias("off"))
    now = B.state(L.bits(s, d)).filter("key = 'b:click'")
    return asked.join(now, "off", "left").select("off", F.coalesce("bit", F.lit(0)).cast("bigint").alias("bit"))


def bitcount(s: SparkSession, d: str) -> DataFrame:
    return B.bitcount(B.state(L.bits(s, d)))


def bitcount_pages(s: SparkSession, d: str) -> DataFrame:
    return B.pages(B.state(L.bits(s, d)))


def bitcount_byte_range(s: SparkSession, d: str) -> DataFrame:
    return B.bitcount(B.state(L.bits(s, d)), 10, 400)


def bitcount_bit_range(s: SparkSession, d: str) -> DataFrame:
    return B.bitcount(B.state(L.bits(s, d)), 100, 3000, "BIT")


def bitcount_neg(s: SparkSession, d: str) -> DataFrame:
    return B.bitcount(B.state(L.bits(s, d)), -300, -2)


def bitmap_delete(s: SparkSession, d: str) -> DataFrame:
    return B.bitcount(B.state(L.bits(s, d)).filter("key <> 'b:click'"))


QUERIES = {
    f.__name__: f
    for f in (
        set_lww, set_with_ttl, setex, getdel, del_count, del_effect, mset_atomic, incr_running, incr_final, incr_invalid, expire_string, expire_collection, expire_list, expire_due, delete_existed, skipwal_recovery,
        hset_created, hget, hdel, hgetall, hlen, hkeys, lpush_order, rpush_order, push_len, deque_replay, pop_results, llen, lrange_pos, lrange_neg, lrange_clamp,
        sadd_added, srem_effect, smembers, sismember, scard, sinter_2, sinter_n, zadd_added, zadd_update, zscore, zrangebyscore, zrange_inf, zrem_effect,
        setbit_old, getbit, bitcount, bitcount_pages, bitcount_byte_range, bitcount_bit_range, bitcount_neg, bitmap_delete,
    )
}

_S, _H, _T, _Z, _A = L.with_(L.STRINGS), L.with_(L.HASHES), L.with_(L.SETS), L.with_(L.ZSETS), L.with_(L.ALL)
_NOW = "1706400000"


def _new(log: str, where: str = "true") -> str:
    return f"{L.newest_sql(log, where)} z"


def _was(log: str) -> str:
    return f"(select *, coalesce(not lag(deleted) over (partition by dtype, key, sub order by version), false) was from {log}) w"


_doomed_sql = "doomed as (select distinct concat(case c_custkey % 3 when 0 then 'u:' when 1 then 'h:' else 'none:' end, cast(c_custkey as varchar)) as key from customer)"
_incr = f"{L.with_(L.COUNTERS)}, i as (select key, version, cast(sum(delta) over (partition by key, seg order by version) as bigint) as n from (select *, sum(case when reset then 1 else 0 end) over (partition by key order by version) seg from counters) x) "
_big = "(score > 100 or deleted)"
_deq = L.with_(L.DEQUES, L.FOLD)
_bits = L.with_(L.BITS, "st as (select key, off, bit from (select *, row_number() over (partition by key, off order by version desc) rn from bits) x where rn = 1)", "ln as (select key, max(off // 8) + 1 as bytes from st group by key)")


def _bc(cond: str) -> str:
    return f"{_bits} select ln.key, cast(count(case when st.bit = 1 and {cond} then 1 end) as bigint) as n from ln join st on st.key = ln.key group by ln.key"


def _expire(log: str, cols: str, prelude: str) -> str:
    return f"""{prelude} select {cols}, case when z.dtype is not null then cast(case when z.dtype = 's' and r.s <= 0 then 0 else {_NOW} + r.s end as bigint) end as expires_at, z.dtype is not null as found
from (select distinct key, (length(key) % 3 - 1) * 10000 s from {log}) r left join (select * from {_new(log)} where {L.LIVE}) z on z.key = r.key"""


_ranked_sql = "row_number() over (partition by key order by score, sub)"
SQL = {
    "set_lww": f"{_S} select key, value, version from {_new('strings')} where not deleted",
    "set_with_ttl": f"""{L.with_()} select key, expires_at, version from (select concat('u:', u) as key, version, row_number() over (partition by u order by version desc) rn, cast(case event_id % 5 when 0 then ts_s + cast(floor(v * 1000) as bigint)
 when 1 then ts_s + cast(floor(v * 1000) as bigint) // 1000 when 2 then ts_s + cast(floor(v * 1000) as bigint) when 3 then (ts_s * 1000 + cast(floor(v * 1000) as bigint)) // 1000 else 0 end as bigint) as expires_at from e) x
 where rn = 1 and (expires_at = 0 or {_NOW} < expires_at)""",
    "setex": f"""{L.with_()} select key, expires_at, version from (select concat('u:', u) as key, version, row_number() over (partition by u order by version desc) rn,
 cast(case when floor((v - 50) * 36000) > 0 then ts_s + cast(floor((v - 50) * 36000) as bigint) else 0 end as bigint) as expires_at from e) x where rn = 1 and (expires_at = 0 or {_NOW} < expires_at)""",
    "getdel": f"{_S} select key, value, (select max(version) + 1 from strings) as tombstone from {_new('strings')} where {L.LIVE}",
    "del_count": f"{L.with_(L.ALL, _doomed_sql)} select cast(count(*) as bigint) as n from doomed where key in (select key from {_new('all_types')} where {L.LIVE})",
    "del_effect": f"{L.with_(L.ALL, _doomed_sql)} select dtype, key, sub, version from {_new('all_types')} where {L.LIVE} and key not in (select key from doomed)",
    "mset_atomic": "select key, value, version from (select *, row_number() over (partition by key order by version desc, ord desc, bw_id desc) rn from batch_writes where key is not null) x where rn = 1 and not coalesce(deleted, false)",
    "incr_running": f"{_incr} select key, version, n from i",
    "incr_final": f"{_incr} select key, arg_max(n, version) as n from i group by key",
    "incr_invalid": f"""{L.with_()} select version, event_id % 6 in (0, 4, 5) as ok, cast(case event_id % 6 when 0 then 1 when 4 then event_id + 1 when 5 then 1 - event_id end as bigint) as n from e""",
    "expire_string": _expire("strings", "r.key, z.value", _S),
    "expire_collection": _expire("hashes", "r.key, z.sub, z.value", _H),
    "expire_list": _expire("list_log", "r.key, z.sub, z.value", L.with_(L.DEQUES, L.FOLD, L.LIST_LOG)),
    "expire_due": f"{_S} select key, expires_at, version from {_new('strings')} where not deleted and expires_at between 1 and {_NOW} + 432000",
    "delete_existed": f"{_S} select key, version, was as existed from {_was('strings')} where deleted",
    "skipwal_recovery": f"{_S} select key, value, version from {_new('strings', f'(version % 7 <> 0 or version <= {FLUSHED})')} where {L.LIVE}",
    "hset_created": f"{_H} select key, cast(sum(case when was then 0 else 1 end) as bigint) as created, cast(count(*) as bigint) as writes from {_was('hashes')} where not deleted group by key",
    "hget": f"{_H} select key, value from {_new('hashes')} where not deleted and sub = 'view'",
    "hdel": f"{_H} select key, version, sub, was as removed from {_was('hashes')} where deleted",
    "hgetall": f"{_H} select key, sub as field, value from {_new('hashes')} where not deleted",
    "hlen": f"{_H} select key, cast(count(*) as bigint) as n from {_new('hashes')} where not deleted group by key",
    "hkeys": f"{_H} select key, sub as field, cast(row_number() over (partition by key order by sub) as bigint) as pos from {_new('hashes')} where not deleted",
    "lpush_order": f"{L.with_(L.DEQUES)} select key, elem, cast(row_number() over (partition by key order by version desc) - 1 as bigint) as pos from deques",
    "rpush_order": f"{L.with_(L.DEQUES)} select key, elem, cast(row_number() over (partition by key order by version) - 1 as bigint) as pos from deques",
    "push_len": f"{L.with_(L.DEQUES)} select key, version, cast(row_number() over (partition by key order by version) as bigint) as n from deques",
    "deque_replay": f"{_deq} select key, pos, elem from held",
    "pop_results": f"{_deq} select key, version, op, r as result from df where op in ('LPOP', 'RPOP')",
    "llen": f"{_deq} select key, cast(count(*) as bigint) as n from held group by key",
    "lrange_pos": f"{_deq} select key, cast(pos - 1 as bigint) as i, elem from held where pos between 1 and 4",
    "lrange_neg": f"{_deq} select key, cast(pos - greatest(n - 3, 0) as bigint) as i, elem from held where pos >= n - 3",
    "lrange_clamp": f"{_deq} select key, pos as i, elem from held",
    "sadd_added": f"{_T} select key, sub, version from {_was('sets')} where not deleted and not was",
    "srem_effect": f"{_T} select key, version, sub, was as removed from {_was('sets')} where deleted",
    "smembers": f"{_T} select key, sub as member, cast(row_number() over (partition by key order by sub) as bigint) as pos from {_new('sets')} where not deleted",
    "sismember": f"{_T} select m.sub as member, cast(case when z.sub is null then 0 else 1 end as bigint) as is_member from (select distinct sub from sets) m left join (select * from {_new('sets')} where not deleted and key = 's:click') z on z.sub = m.sub",
    "scard": f"{_T} select key, cast(count(*) as bigint) as n from {_new('sets')} where not deleted group by key",
    "sinter_2": f"{_T}, b as (select * from {_new('sets', _big)} where not deleted) select sub as member from b where key = 's:click' intersect select sub from b where key = 's:view'",
    "sinter_n": f"{_T}, b as (select * from {_new('sets', _big)} where not deleted) select sub as member from b where key = 's:click' intersect select sub from b where key = 's:view' intersect select sub from b where key = 's:purchase' intersect select sub from b where key = 's:signup'",
    "zadd_added": f"{_Z} select key, sub, version from {_was('zsets')} where not deleted and not was",
    "zadd_update": f"{_Z} select key, sub, version, old, score from (select *, lag(case when not deleted then score end) over (partition by key, sub order by version) old from zsets) x where not deleted and old <> score",
    "zscore": f"{_Z} select key, sub, score from {_new('zsets')} where not deleted",
    "zrangebyscore": f"{_Z} select key, sub as member, score, cast({_ranked_sql} as bigint) as pos from {_new('zsets')} where not deleted and score between 20 and 90",
    "zrange_inf": f"{_Z} select key, sub as member, score, cast({_ranked_sql} as bigint) as pos from {_new('zsets')} where not deleted",
    "zrem_effect": f"{_Z} select key, version, sub, was as removed from {_was('zsets')} where deleted",
    "setbit_old": f"{_bits} select key, off, version, cast(lag(bit, 1, 0) over (partition by key, off order by version) as bigint) as old from bits",
    "getbit": f"{_bits} select c_custkey as off, coalesce(st.bit, 0) as bit from customer left join st on st.off = c_custkey and st.key = 'b:click'",
    "bitcount": f"{_bits} select key, cast(sum(bit) as bigint) as n from st group by key",
    "bitcount_pages": f"{_bits} select key, off // 32768 as page, cast(count(*) as bigint) as n from st where bit = 1 group by 1, 2",
    "bitcount_byte_range": _bc("off // 8 between 10 and 400"),
    "bitcount_bit_range": _bc("off between 100 and 3000"),
    "bitcount_neg": _bc("off // 8 between greatest(bytes - 300, 0) and bytes - 2"),
    "bitmap_delete": f"{_bits} select key, cast(sum(bit) as bigint) as n from st where key <> 'b:click' group by key",
}
