"""Store: commands by name over one operation log; each returns a DataFrame.

Every write gets the next version, a batch of writes one version. Written rows gather on the driver and join the
log as one frame; after FLUSH rows the log is written to the shared folder, so plans stay small however many commands ran.
"""

from __future__ import annotations

import inspect
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bitmaps, collections, lists, resolve
from .operators.lists import contents, lrange
from .operators.strings import counter_value
from .schema import LOG, RAW
from .shared import materialize

#: Rows gathered, or frames joined to the log, before it is written.
FLUSH, FRAMES = 1000, 16
#: Messages that wait for a subscriber; more are dropped.
BUFFER = 128
READS = {"get", "mget", "hget", "hgetall", "hlen", "hkeys", "llen", "lrange", "smembers", "sismember", "scard", "sinter", "zscore", "zrangebyscore", "getbit", "bitcount", "keys", "scan", "ttl", "exists", "info"}
#: Commands that touch keys other than their first argument, and which arguments these are.
_ALL_KEYS = {"mset": slice(None, None, 2), "del": slice(None), "mget": slice(None), "sinter": slice(None), "keys": slice(0), "scan": slice(0), "info": slice(0), "publish": slice(0)}


class Conflict(Exception):
    """A key that the transaction read or wrote was written by another one since it began."""


class _Rows:
    """A frame and the rows not yet in it."""

    def __init__(self, spark: SparkSession, frame: DataFrame, schema: object) -> None:
        self.spark, self.frame, self.schema, self.rows, self.frames = spark, frame, schema, [], 0

    def add(self, rows: list[tuple]) -> None:
        self.rows += rows
        if len(self.rows) >= FLUSH:
            self.frame, self.rows, self.frames = materialize(self.all(), "log"), [], 0

    def join(self, frame: DataFrame) -> None:
        self.frame, self.rows, self.frames = self.all().unionByName(frame), [], self.frames + 1
        if self.frames >= FRAMES:
            self.frame, self.frames = materialize(self.frame, "log"), 0

    def all(self) -> DataFrame:
        return self.frame.unionByName(self.spark.createDataFrame(self.rows, self.schema)) if self.rows else self.frame

    def copy(self) -> _Rows:
        out = _Rows(self.spark, self.frame, self.schema)
        out.rows, out.frames = list(self.rows), self.frames
        return out


class Tx:
    """Buffered writes over a snapshot: reads see own writes first, and every key read, found or not, is remembered."""

    def __init__(self, store: Store) -> None:
        self.store, self.read_version, self.reads, self.writes = store, store.version, set(), {}

    def get(self, key: str) -> str | None:
        if key in self.writes:
            return self.writes[key][0]
        self.reads.add(key)
        row = self.store.state("s", key, self.read_version).select("value").first()
        return row[0] if row else None

    def set(self, key: str, value: str, seconds: int = 0) -> None:
        self.writes[key] = (value, self.store.now + seconds if seconds > 0 else 0)

    def delete(self, key: str) -> None:
        self.writes[key] = (None, 0)


class Store:
    """Over a log DataFrame and, for lists, a table of list operations (key, version, op, elem).

    ``max_bytes``, if over 0, refuses puts once the keys and values written by this store come to more; deletes are always let through.
    """

    LIST_OPS = "key string, version bigint, op string, elem string"

    def __init__(self, spark: SparkSession, log: DataFrame | None = None, lists: DataFrame | None = None, now: int = 0, version: int | None = None, max_bytes: int = 0) -> None:
        self.spark, self.now, self.max_bytes, self.bytes = spark, now, max_bytes, 0
        self._log = _Rows(spark, log if log is not None else spark.createDataFrame([], LOG), LOG)
        self._lists = _Rows(spark, lists if lists is not None else spark.createDataFrame([], self.LIST_OPS), self.LIST_OPS)
        if version is None:
            version = max(x.agg(F.max("version")).first()[0] or 0 for x in (self.log, self.lists))
        self.version = version
        self._history: dict[str, int] = {}  # key -> last commit of a transaction; plain writes leave none
        self._queue: list[tuple] | None = None
        self._broken, self._began = False, 0
        self._subscribers: dict[str, dict[str, deque]] = {}

    @property
    def log(self) -> DataFrame:
        return self._log.all()

    @property
    def lists(self) -> DataFrame:
        return self._lists.all()

    def command(self, name: str, *args: object) -> DataFrame | list[DataFrame] | None:
        """Run a command, any letter case; an unknown one or a wrong count of arguments is an error. After MULTI commands queue until EXEC or DISCARD."""
        f: Callable | None = getattr(self, "do_" + name.lower(), None)
        try:
            if f is None:
                raise ValueError(f"ERR unknown command '{name}'")
            try:
                inspect.signature(f).bind(*args)
            except TypeError as x:
                raise ValueError(f"ERR wrong number of arguments for '{name}'") from x
        except ValueError:
            self._broken = self._queue is not None
            raise
        if self._queue is not None and name.lower() not in ("multi", "exec", "discard"):
            self._queue.append((name, *args))
            return self._one(reply="QUEUED")
        return f(*args)

    # helpers
    def state(self, dtype: str, key: str | None = None, as_of: int | None = None) -> DataFrame:
        log = self.log.filter(F.col("dtype") == dtype)
        return resolve.resolve(log if key is None else log.filter(F.col("key") == key), as_of, self.now)

    def _write(self, *rows: tuple) -> None:
        """rows (dtype, key, sub, value, score, deleted, expires_at), all at the next version; of a record twice the last stands."""
        last = {r[:3]: r for r in rows}
        more = sum(len(r[1] or "") + len(r[2] or "") + len(r[3] or "") for r in last.values())
        if 0 < self.max_bytes < self.bytes + more and not all(r[5] for r in last.values()):
            raise ValueError("ERR disk quota exceeded")
        self.bytes += more
        self.version += 1
        self._log.add([(*r, self.version, self.now) for r in last.values()])

    def _one(self, **values: object) -> DataFrame:
        kinds = {bool: "boolean", int: "bigint", float: "double", str: "string", type(None): "string"}
        return self.spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))

    def _new(self, dtype: str, key: str, subs: list[str]) -> int:
        return len(set(subs)) - self.state(dtype, key).filter(F.col("sub").isin(list(set(subs)))).count()

    def _held(self, keys: list[str] | None = None, as_of: int | None = None) -> DataFrame:
        """What the lists hold."""
        ops = self.lists if keys is None else self.lists.filter(F.col("key").isin(keys))
        return contents(lists.standing(ops, self.now, as_of))

    # keys without type
    def put(self, key: str, value: str, seconds: int = 0) -> None:
        self._write((RAW, key, "", value, None, False, self.now + seconds if seconds > 0 else 0))

    def get(self, key: str, as_of: int | None = None) -> DataFrame:
        return self.state(RAW, key, as_of).select("value")

    def delete(self, key: str) -> bool:
        """Whether the key was there."""
        was = not self.get(key).isEmpty()
        self._write((RAW, key, "", None, None, True, 0))
        return was

    # strings
    def do_set(self, key: str, value: str, *options: object) -> DataFrame:
        at, o = 0, [str(x).upper() for x in options]
        i = 0
        while i < len(o):
            if o[i] in ("SYNC", "SKIPWAL"):
                i += 1
                continue
            if o[i] not in ("EX", "PX", "EXAT", "PXAT") or i + 1 >= len(o):
                raise ValueError("ERR syntax error")
            n = int(o[i + 1])
            at = {"EX": self.now + n, "PX": self.now + n // 1000, "EXAT": n, "PXAT": n // 1000}[o[i]]
            i += 2
        self._write(("s", key, "", value, None, False, at))
        return self._one(reply="OK")

    def do_setex(self, key: str, seconds: int, value: str) -> DataFrame:
        self._write(("s", key, "", value, None, False, self.now + int(seconds) if int(seconds) > 0 else 0))
        return self._one(reply="OK")

    def do_get(self, key: str, as_of: int | None = None) -> DataFrame:
        return self.state("s", key, as_of).select("value")

    def do_getdel(self, key: str) -> DataFrame:
        old = self.do_get(key)
        self._write(("s", key, "", None, None, True, 0))
        return old

    def do_mset(self, *pairs: str) -> DataFrame:
        if not pairs or len(pairs) % 2:
            raise ValueError("ERR wrong number of arguments for 'MSET'")
        self._write(*[("s", k, "", v, None, False, 0) for k, v in zip(pairs[::2], pairs[1::2])])
        return self._one(reply="OK")

    def do_mget(self, *keys: str) -> DataFrame:
        return resolve.mget(self.state("s"), self.spark.createDataFrame(list(enumerate(keys)), "pos bigint, key string")).orderBy("pos")

    def do_incrby(self, key: str, delta: int) -> DataFrame:
        old = self.state("s", key).select(counter_value(F.col("value")).alias("n"), "value", "expires_at").first()
        if old and old["n"] is None:
            raise ValueError("ERR value is not an integer or out of range")
        n = (old["n"] if old else 0) + int(delta)
        if not -(1 << 63) <= n < 1 << 63:
            raise ValueError("ERR increment or decrement would overflow")
        self._write(("s", key, "", str(n), None, False, old["expires_at"] if old else 0))
        return self._one(n=n)

    def do_incr(self, key: str) -> DataFrame:
        return self.do_incrby(key, 1)

    def do_decr(self, key: str) -> DataFrame:
        return self.do_incrby(key, -1)

    def do_del(self, *keys: str) -> DataFrame:
        """Counts keys, of whatever type, that were there; all their records go at one version."""
        wanted = list(set(keys))
        rows = resolve.resolve(self.log.filter(F.col("key").isin(wanted)), now=self.now).select("dtype", "key", "sub")
        held = self._held(wanted).select("key").distinct()
        n = rows.select("key").union(held).distinct().count()
        self.version += 1
        gone = rows.select("dtype", "key", "sub", F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("deleted"), F.lit(0).cast("bigint").alias("expires_at"), F.lit(self.version).cast("bigint").alias("version"), F.lit(self.now).cast("bigint").alias("ts_s"))
        self._log.join(gone)
        self._lists.add([(k, self.version, "DEL", None) for k in wanted])
        return self._one(n=n)

    def do_exists(self, key: str) -> DataFrame:
        there = not resolve.resolve(self.log.filter(F.col("key") == key), now=self.now).filter("dtype <> 'b' or value = '1'").isEmpty()
        return self._one(n=int(there or not self._held([key]).isEmpty()))

    def do_expire(self, key: str, seconds: int) -> DataFrame:
        rows = resolve.resolve(self.log.filter(F.col("key") == key), now=self.now)
        held = not self._held([key]).isEmpty()
        n = int(held or not rows.isEmpty())
        self.version += 1
        at = F.when(F.col("dtype").isin("s", RAW) & F.lit(int(seconds) <= 0), F.lit(0)).otherwise(F.lit(self.now + int(seconds))).cast("bigint")
        self._log.join(rows.withColumn("expires_at", at).withColumn("version", F.lit(self.version).cast("bigint")))
        if held:
            self._lists.add([(key, self.version, "EXPIRE", str(self.now + int(seconds)))])
        return self._one(n=n)

    def do_ttl(self, key: str) -> DataFrame:
        rows = resolve.newest(self.log.filter(F.col("key") == key))
        left = F.when(F.coalesce("expires_at", F.lit(0)) == 0, F.lit(-1)).otherwise(F.col("expires_at") - self.now)
        first = rows.filter(resolve.alive(self.now)).orderBy("dtype", "sub").select(left.alias("n")).first() or lists.ttl(self.lists.filter(F.col("key") == key), self.now).select(F.col("ttl").alias("n")).first()
        return self._one(n=int(first["n"]) if first else -2)

    def do_keys(self, glob: str = "*") -> DataFrame:
        there = resolve.resolve(self.log, now=self.now).select("key").union(self._held().select("key"))
        return resolve.names(there, glob).orderBy("key")

    def do_scan(self, cursor: str | None = None, glob: str = "*", count: int = 10) -> DataFrame:
        there = resolve.resolve(self.log, now=self.now).select("key").union(self._held().select("key"))
        return resolve.page(there, cursor, int(count), glob)

    # hashes
    def do_hset(self, key: str, *pairs: str) -> DataFrame:
        if not pairs or len(pairs) % 2:
            raise ValueError("ERR wrong number of arguments for 'HSET'")
        n = self._new("h", key, list(pairs[::2]))
        self._write(*[("h", key, f, v, None, False, 0) for f, v in zip(pairs[::2], pairs[1::2])])
        return self._one(n=n)

    def do_hget(self, key: str, field: str) -> DataFrame:
        return self.state("h", key).filter(F.col("sub") == field).select("value")

    def do_hdel(self, key: str, *fields: str) -> DataFrame:
        return self._drop("h", key, fields)

    def do_hgetall(self, key: str) -> DataFrame:
        return self.state("h", key).select(F.col("sub").alias("field"), "value")

    def do_hlen(self, key: str) -> DataFrame:
        return self.state("h", key).agg(F.count(F.lit(1)).alias("n"))

    def do_hkeys(self, key: str) -> DataFrame:
        return self.state("h", key).select(F.col("sub").alias("field")).orderBy("field")

    def _drop(self, dtype: str, key: str, subs: tuple) -> DataFrame:
        n = self.state(dtype, key).filter(F.col("sub").isin(list(subs))).count()
        if subs:
            self._write(*[(dtype, key, x, None, None, True, 0) for x in subs])
        return self._one(n=n)

    # lists
    def _push(self, key: str, op: str, elems: tuple) -> DataFrame:
        rows = []
        for e in elems or (None,):
            self.version += 1
            rows.append((key, self.version, op, e))
        self._lists.add(rows)
        return self.do_llen(key)

    def do_lpush(self, key: str, *elems: str) -> DataFrame:
        return self._push(key, "LPUSH", elems)

    def do_rpush(self, key: str, *elems: str) -> DataFrame:
        return self._push(key, "RPUSH", elems)

    def _pop(self, key: str, op: str, at: int) -> DataFrame:
        got = lrange(self._held([key]), at, at).select(F.col("elem").alias("value"))
        got = self.spark.createDataFrame(got.collect(), "value string")  # one element
        self._push(key, op, ())
        return got

    def do_lpop(self, key: str) -> DataFrame:
        return self._pop(key, "LPOP", 0)

    def do_rpop(self, key: str) -> DataFrame:
        return self._pop(key, "RPOP", -1)

    def do_llen(self, key: str) -> DataFrame:
        return self._held([key]).agg(F.count(F.lit(1)).alias("n"))

    def do_lrange(self, key: str, first: int, last: int) -> DataFrame:
        return lrange(self._held([key]), int(first), int(last)).orderBy("i").select("i", "elem")

    # sets
    def do_sadd(self, key: str, *members: str) -> DataFrame:
        there = [r[0] for r in self.state("t", key).filter(F.col("sub").isin(list(members))).select("sub").collect()]
        new = sorted(set(members) - set(there))
        if new:
            self._write(*[("t", key, m, "", None, False, 0) for m in new])
        return self._one(n=len(new))

    def do_srem(self, key: str, *members: str) -> DataFrame:
        return self._drop("t", key, members)

    def do_smembers(self, key: str) -> DataFrame:
        return self.state("t", key).select(F.col("sub").alias("member")).orderBy("member")

    def do_sismember(self, key: str, member: str) -> DataFrame:
        return self.state("t", key).filter(F.col("sub") == member).agg(F.count(F.lit(1)).alias("n"))

    def do_scard(self, key: str) -> DataFrame:
        return self.state("t", key).agg(F.count(F.lit(1)).alias("n"))

    def do_sinter(self, *keys: str) -> DataFrame:
        return collections.intersect(self.state("t"), list(keys)).select(F.col("sub").alias("member")).orderBy("member")

    # sorted sets
    def do_zadd(self, key: str, *pairs: object) -> DataFrame:
        if not pairs or len(pairs) % 2:
            raise ValueError("ERR wrong number of arguments for 'ZADD'")
        scores = [float(x) for x in pairs[::2]]
        if any(x != x for x in scores):
            raise ValueError("ERR value is not a valid float")
        members = [str(m) for m in pairs[1::2]]
        n = self._new("z", key, members)
        self._write(*[("z", key, m, "", x + 0.0, False, 0) for x, m in zip(scores, members)])
        return self._one(n=n)

    def do_zscore(self, key: str, member: str) -> DataFrame:
        return self.state("z", key).filter(F.col("sub") == member).select("score")

    def do_zrangebyscore(self, key: str, low: float, high: float) -> DataFrame:
        return collections.score_range(self.state("z", key), float(low), float(high)).orderBy("score", "sub").select(F.col("sub").alias("member"), "score")

    def do_zrem(self, key: str, *members: str) -> DataFrame:
        return self._drop("z", key, members)

    # bitmaps
    def _bits(self, key: str) -> DataFrame:
        return self.state("b", key).select("key", F.col("sub").cast("bigint").alias("off"), F.col("value").cast("bigint").alias("bit"))

    def do_setbit(self, key: str, offset: int, bit: int) -> DataFrame:
        if int(offset) < 0 or int(bit) not in (0, 1):
            raise ValueError("ERR bit offset is not an integer or out of range")
        old = self.do_getbit(key, offset)
        old = self.spark.createDataFrame(old.collect(), "bit bigint")
        self._write(("b", key, str(int(offset)), str(int(bit)), None, False, 0))
        return old

    def do_getbit(self, key: str, offset: int) -> DataFrame:
        return self._bits(key).filter(F.col("off") == int(offset)).agg(F.coalesce(F.max("bit"), F.lit(0)).alias("bit"))

    def do_bitcount(self, key: str, *where: object) -> DataFrame:
        a = [int(x) for x in where[:2]]
        n = bitmaps.bitcount(self._bits(key), *a, *[str(x).upper() for x in where[2:]])
        return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    def do_info(self) -> DataFrame:
        return self.log.groupBy("dtype").agg(F.count(F.lit(1)).alias("writes"), F.sum(F.col("deleted").cast("bigint")).alias("deletes"))

    # publish and subscribe
    def do_subscribe(self, client: str, *channels: str) -> DataFrame:
        """(channel, n): after each channel how many the client has."""
        out = []
        for c in channels:
            self._subscribers.setdefault(c, {}).setdefault(client, deque())
            out.append((c, sum(client in x for x in self._subscribers.values())))
        return self.spark.createDataFrame(out, "channel string, n bigint")

    def do_unsubscribe(self, client: str, *channels: str) -> DataFrame:
        """As SUBSCRIBE; without channels from all."""
        out = []
        for c in channels or sorted(k for k, x in self._subscribers.items() if client in x):
            self._subscribers.get(c, {}).pop(client, None)
            out.append((c, sum(client in x for x in self._subscribers.values())))
        return self.spark.createDataFrame(out, "channel string, n bigint")

    def do_publish(self, channel: str, message: str) -> DataFrame:
        """To how many it was delivered: each at most once, and not to a subscriber with BUFFER messages waiting."""
        open_ = [q for q in self._subscribers.get(channel, {}).values() if len(q) < BUFFER]
        for q in open_:
            q.append(message)
        return self._one(n=len(open_))

    def received(self, client: str, channel: str) -> list[str]:
        """The messages that wait for a subscriber, who then has none."""
        q = self._subscribers.get(channel, {}).get(client, deque())
        out = list(q)
        q.clear()
        return out

    # transactions
    def begin(self) -> Tx:
        return Tx(self)

    def commit(self, tx: Tx) -> int:
        """All writes at one version, which it returns; Conflict if another transaction wrote a key of this one since it began. Without writes it never conflicts."""
        if not tx.writes:
            return self.version
        if any(self._history.get(k, 0) > tx.read_version for k in tx.reads | set(tx.writes)):
            raise Conflict
        self._write(*[("s", k, "", v, None, v is None, at) for k, (v, at) in tx.writes.items()])
        self._history |= dict.fromkeys(tx.writes, self.version)
        return self.version

    def update(self, change: Callable[[Tx], object]) -> object:
        """Run ``change`` in a transaction and commit; what it raises leaves nothing written."""
        tx = self.begin()
        out = change(tx)
        self.commit(tx)
        return out

    def view(self, look: Callable[[Tx], object]) -> object:
        """Run ``look`` on a snapshot; it may not write."""
        tx = self.begin()
        out = look(tx)
        if tx.writes:
            raise ValueError("ERR read-only transaction")
        return out

    def do_multi(self) -> DataFrame:
        if self._queue is not None:
            raise ValueError("ERR MULTI calls can not be nested")
        self._queue, self._broken, self._began = [], False, self.version
        return self._one(reply="OK")

    def do_discard(self) -> DataFrame:
        if self._queue is None:
            raise ValueError("ERR DISCARD without MULTI")
        self._queue, self._broken = None, False
        return self._one(reply="OK")

    def do_exec(self) -> list[DataFrame] | None:
        """The queue's results, or None on a conflict."""
        if self._queue is None:
            raise ValueError("ERR EXEC without MULTI")
        queue, broken = self._queue, self._broken
        self._queue, self._broken = None, False
        if broken:
            raise ValueError("EXECABORT Transaction discarded because of previous errors.")
        return self.execute(queue, self._began)

    def execute(self, queue: list[tuple], read_version: int | None = None) -> list[DataFrame] | None:
        """MULTI ... EXEC: the queue's commands at once, or None if a key that any of them names was written by another transaction after ``read_version``.

        Plain writes make no conflict, and a queue that only reads never has one.
        """
        touched = {str(k) for c in queue for k in c[1:][_ALL_KEYS.get(c[0].lower(), slice(1))]}
        written = {str(k) for c in queue if c[0].lower() not in READS for k in c[1:][_ALL_KEYS.get(c[0].lower(), slice(1))]}
        if read_version is not None and written and any(self._history.get(k, 0) > read_version for k in touched):
            return None
        kept = (self._log.copy(), self._lists.copy(), self.version, self.bytes)
        try:
            out = [self.command(*c) for c in queue]
        except ValueError:
            self._log, self._lists, self.version, self.bytes = kept  # all or nothing
            raise
        self._history |= dict.fromkeys(written, self.version)
        return out
