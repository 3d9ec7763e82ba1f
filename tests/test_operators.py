import random
import re
from collections import deque
from datetime import datetime, timedelta, timezone

import pytest

from ledgerline.functions.glob import matches, to_regex
from ledgerline.operators import bitmaps, feeds, lists, maintenance, resolve, scan, strings, txn
from ledgerline.schema import LOG
from ledgerline.store import Store
from pyspark.sql import functions as F


def log(spark, rows):
    """rows (dtype, key, sub, value, score, deleted, expires_at, version)"""
    return spark.createDataFrame([(*r, 0) for r in rows], LOG)


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("user:*", ["user:1", "user:"], ["post:1"]), ("a?c", ["abc", "aéc"], ["ac", "abbc"]), ("[a-c]x", ["ax", "cx"], ["dx"]), ("[^a-c]x", ["dx"], ["ax"]),
        ("a\\*", ["a*"], ["ab"]), ("a[b", ["a[b"], ["ab"]), ("*", ["", "x\ny"], []), ("a.c", ["a.c"], ["abc"]), ("[a\\]]", ["a", "]"], ["b"]), ("(x)+", ["(x)+"], ["xx"]),
    ],
)
def test_glob(spark, glob, yes, no):
    assert [x for x in yes + no if re.match(to_regex(glob).replace(r"\z", r"\Z"), x)] == yes
    got = {r[0] for r in spark.createDataFrame([(x,) for x in yes + no], "n string").filter(matches("n", glob)).collect()}
    assert got == set(yes)


def test_reads(spark):
    x = log(spark, [("s", "a", "", "1", None, False, 0, 1), ("s", "a", "", "2", None, False, 0, 5), ("s", "b", "", "x", None, False, 0, 2), ("s", "b", "", None, None, True, 0, 3), ("s", "c", "", "old", None, False, 0, 1), ("s", "c", "", "new", None, False, 50, 4), ("s", "e", "", "", None, False, 0, 6)])
    val = lambda df: {r["key"]: r["value"] for r in df.collect()}
    assert val(resolve.resolve(x, now=49)) == {"a": "2", "c": "new", "e": ""}
    assert val(resolve.resolve(x, now=50)) == {"a": "2", "e": ""}  # an expired write hides the older one
    assert val(resolve.resolve(x, as_of=2, now=50)) == {"a": "1", "b": "x", "c": "old"}
    assert set(val(resolve.resolve(x, now=50, tombstones=True))) == {"a", "b", "e"}
    asked = spark.createDataFrame([(0, "a"), (1, "e"), (2, "zz"), (3, "a")], "pos bigint, key string")
    assert [(r["value"], r["present"]) for r in resolve.mget(resolve.resolve(x, now=50), asked).orderBy("pos").collect()] == [("2", True), ("", True), (None, False), ("2", True)]
    assert {r["key"]: r["ttl"] for r in resolve.ttl(x, 49).collect()} == {"a": -1, "b": -2, "c": 1, "e": -1}
    assert resolve.resolve(x.limit(0), now=1).collect() == []
    names = [r["key"] for r in resolve.page(resolve.resolve(x, now=1), None, 2).orderBy("pos").collect()]
    assert names == ["a", "c"] and [r["key"] for r in resolve.page(resolve.resolve(x, now=1), "c", 2).collect()] == ["e"]


@pytest.mark.parametrize("width", [3, 1 << 18])
def test_scans_over_ranges(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("ab"), v, rng.randrange(-3, 4)) for v in range(60)]
    got = scan.prefix_scan(spark.createDataFrame(rows, "k string, v bigint, x bigint"), ["k"], "v", {"s": F.col("x")}, {"s": "low"}, width)
    got = {r["v"]: (r["s"], r["low"], r["p"]) for r in scan.previous(got, ["k"], "v", "s", "p", width).collect()}
    for k in "ab":
        s, low, p = 0, 0, None
        for _, v, x in [r for r in rows if r[0] == k]:
            s += x
            assert got[v] == (s, low, p)
            low, p = min(low, s), s


@pytest.mark.parametrize("seed", [1, 2])
def test_lists_against_a_deque(spark, seed):
    rng = random.Random(seed)
    ops = [(rng.choice(["a", "b"]), v, rng.choice(["LPUSH", "RPUSH", "LPOP", "RPOP", "RPOP", "x"]), f"e{v}") for v in range(150)]
    held, popped = {"a": deque(), "b": deque()}, {}
    for k, v, op, e in ops:
        q = held[k]
        if op == "LPUSH":
            q.appendleft(e)
        elif op == "RPUSH":
            q.append(e)
        elif op in ("LPOP", "RPOP"):
            popped[v] = (q.popleft() if op == "LPOP" else q.pop()) if q else None
    df = spark.createDataFrame(ops, "key string, version bigint, op string, elem string")
    got = {k: [r["elem"] for r in lists.contents(df).filter(F.col("key") == k).orderBy("pos").collect()] for k in held}
    assert got == {k: list(q) for k, q in held.items()}
    assert {r["version"]: r["result"] for r in lists.pops(df).collect()} == popped


def test_counters_and_options(spark):
    t = spark.createDataFrame([("",), (None,), ("12",), (" 12",), ("-5",), ("1x",), ("9223372036854775808",), ("1\n",)], "t string")
    assert [r[0] for r in t.select(strings.counter_value(F.col("t"))).collect()] == [0, 0, 12, None, -5, None, None, None]
    o = spark.createDataFrame([("EX", 5), ("PX", 500), ("PX", 2500), ("EXAT", 77), ("PXAT", 77999), ("", 1)], "o string, n bigint")
    assert [r[0] for r in o.select(strings.expiry(F.col("o"), F.col("n"), F.lit(100))).collect()] == [105, 100, 102, 77, 77, 0]


def test_bitmaps(spark):
    b = spark.createDataFrame([("far", 3, 1, 1), ("far", 1000000007, 1, 2), ("edge", 32767, 1, 3), ("edge", 32768, 1, 4), ("edge", 32769, 1, 5), ("far", 3, 0, 6), ("far", -1, 1, 7)], "key string, off bigint, bit bigint, version bigint").filter("off >= 0")
    now = bitmaps.state(b)
    count = lambda *a: {r["key"]: r["n"] for r in bitmaps.bitcount(now, *a).collect()}
    assert count() == {"far": 1, "edge": 3}
    assert count(0, -1) == {"far": 1, "edge": 3} and count(4096, 4096) == {"far": 0, "edge": 2} and count(5, 2) == {"far": 0, "edge": 0}
    assert count(32768, 32768, "BIT") == {"far": 0, "edge": 1}
    assert {(r["key"], r["page"]): r["n"] for r in bitmaps.pages(now).collect()} == {("far", 30517): 1, ("edge", 0): 1, ("edge", 1): 2}
    assert {r["version"]: r["old"] for r in bitmaps.setbit(b).collect()}[6] == 1


def test_transactions(spark):
    t = [(1, "a", 0, 5, True), (2, "a", 4, 7, True), (3, "b", 4, 8, True), (4, "a", 6, 9, False), (4, "b", 6, 9, False), (5, "a", 8, 10, True), (5, "b", 8, 10, True)]
    df = spark.createDataFrame([("all", *r) for r in t], "part string, txn bigint, key string, read_ts bigint, commit_ts bigint, writes boolean")
    assert {r["txn"]: r["committed"] for r in txn.outcomes(df).collect()} == {1: True, 2: False, 3: True, 4: True, 5: True}
    skew = spark.createDataFrame([("all", 1, k, 0, 1, True) for k in "ab"] + [("all", 2, k, 0, 2, True) for k in "ab"], df.schema)
    assert sorted(r["committed"] for r in txn.outcomes(skew).collect()) == [False, True]  # write skew: one aborts
    for gaps, want in (([], 200000), ([131072], 131071), ([1], 0), ([70000, 150000], 69999), ([65536], 65535), ([65537], 65536)):
        v = spark.range(1, 200001).select(F.col("id").alias("version")).filter(~F.col("version").isin(gaps) if gaps else F.lit(True))
        assert txn.applied_watermark(v).first()[0] == want
    assert txn.applied_watermark(spark.range(0).select(F.col("id").alias("version"))).first()[0] == 0
    own = txn.overlay(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), spark.createDataFrame([("a", "9", False), ("b", None, True), ("c", "3", False)], "key string, value string, deleted boolean"))
    assert {r["key"]: r["value"] for r in own.collect()} == {"a": "9", "c": "3"}


@pytest.mark.parametrize("width", [1, 64, 1 << 15])
def test_transactions_of_many_keys_in_chunks(spark, width):
    rng = random.Random(width)
    last, rows, want = {}, [], {}
    for v in range(1, 400):
        read = v - rng.randrange(1, 12)
        keys = {rng.choice(["hot", "a", "b", "c", None, *map(str, range(20))]): rng.random() < 0.4 for _ in range(rng.randrange(1, 4))}
        ok = not any(keys.values()) or all(last.get(k, -99) <= read for k in keys)
        want[v] = ok
        if ok:
            last |= {k: v for k, w in keys.items() if w}
        rows += [(v, k, read, v, w, "x") for k, w in keys.items()] * rng.choice([1, 1, 2])
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "txn bigint, key string, read_ts bigint, commit_ts bigint, writes boolean, c string")
    got = txn.outcomes(df, width).collect()
    assert len(got) == len(want) and {r["txn"]: r["committed"] for r in got} == want and len(set(want.values())) == 2
    assert txn.outcomes(df.limit(0)).collect() == []


def test_maintenance(spark):
    x = log(spark, [("s", "a", "", str(v), None, False, 0, v) for v in (1, 2, 3, 4)] + [("s", "b", "", None, None, True, 0, 2)])
    kept = maintenance.retained(x, ["dtype", "key", "sub"], 2)
    assert sorted((r["key"], r["version"]) for r in kept.collect()) == [("a", 2), ("a", 3), ("a", 4), ("b", 2)]
    assert "b" not in {r["key"] for r in maintenance.bottom_drop(kept, ["dtype", "key", "sub"], 0).collect()}
    t = spark.createDataFrame([(1, 0, 10), (2, 10, 20), (3, 21, 22), (4, 5, 100)], "t bigint, lo bigint, hi bigint")
    assert {tuple(r) for r in maintenance.overlaps(t, "lo", "hi", "t").collect()} == {(1, 2), (1, 4), (2, 4), (3, 4)}
    assert {r["t"] for r in maintenance.self_overlap(t, "lo", "hi", "t").collect()} == {4, 2, 3}
    s = spark.createDataFrame([(i, i % 4) for i in range(4)], "o bigint, z bigint")
    assert maintenance.adaptive_threshold(s, "z", "o", 2048, 0, 100).first()["threshold"] == 3
    m = spark.createDataFrame([(1, "A", 0, 1, "a", "b"), (2, "d", 0, 1, None, None), (3, "a", 1, 2, "c", "d"), (4, "D", None, 9, None, None)], "man_id bigint, action string, level int, seq bigint, min_key string, max_key string")
    assert [r["seq"] for r in maintenance.live_tables(m).collect()] == [2]


def test_nulls_in_counters_bits_and_transactions(spark):
    c = spark.createDataFrame([("a", 1, False, None), ("a", 2, False, 5), (None, 3, False, 2), ("a", 4, True, 0), ("a", 5, None, 1)], "key string, version bigint, reset boolean, delta bigint")
    assert {r["version"]: r["n"] for r in strings.incr(c, "key", "version", "reset", "delta").collect()} == {1: 0, 2: 5, 3: 2, 4: 0, 5: 1}
    b = spark.createDataFrame([("k", 1, 1, 1), ("k", None, 1, 2), ("k", -4, 1, 3), (None, 2, None, 4), (None, 3, 1, 5)], "key string, off bigint, bit bigint, version bigint")
    assert {r["key"]: r["n"] for r in bitmaps.bitcount(bitmaps.state(b)).collect()} == {"k": 1, None: 1}
    assert {r["key"]: r["n"] for r in bitmaps.bitcount(bitmaps.state(b), 0, 9).collect()} == {"k": 1, None: 1}
    t = spark.createDataFrame([("p", 1, None, 0, 5, True), ("p", 2, None, 3, 7, True), ("p", 3, "a", None, 8, True), (None, 4, "a", 1, 9, True)], "part string, txn bigint, key string, read_ts bigint, commit_ts bigint, writes boolean")
    assert {r["txn"]: r["committed"] for r in txn.outcomes(t).collect()} == {1: True, 2: False, 4: True}
    assert txn.conflict_candidates(t, 100).collect() == []


def test_feeds(spark):
    m = spark.createDataFrame([(1, 5), (1, 6), (1, 9), (2, 5)], "channel bigint, t bigint")
    s = spark.createDataFrame([(1, 5, 9), (1, 6, None)], "channel bigint, since bigint, until bigint")
    assert {(r["channel"], r["t"]): r["n"] for r in feeds.delivered(m, s).collect()} == {(1, 5): 1, (1, 6): 2, (1, 9): 1, (2, 5): 0}
    r = spark.createDataFrame([(0,), (1,), (100,)], "last bigint")
    assert {x["last"]: x["partial"] for x in feeds.backlog_decision(r, 2, 4).collect()} == {0: False, 1: True, 100: False}


def test_store_commands(spark):
    s = Store(spark, now=1000)
    one = lambda *a: (lambda r: r[0] if r else None)(s.command(*a).first())
    col = lambda *a: [r[0] for r in s.command(*a).collect()]
    one("SET", "token", "abc")
    assert one("GETDEL", "token") == "abc" and one("GET", "token") is None
    assert one("INCRBY", "n", 10) == 10 and one("incr", "n") == 11 and one("DECR", "n") == 10
    one("SET", "e", "v", "EX", 5)
    assert one("TTL", "e") == 5 and one("TTL", "n") == -1 and one("TTL", "none") == -2
    with pytest.raises(ValueError, match="syntax"):
        s.command("SET", "e", "v", "NX")
    with pytest.raises(ValueError, match="unknown"):
        s.command("ZRANK", "e")
    with pytest.raises(ValueError, match="integer"):
        s.command("INCR", "e")
    assert one("HSET", "usr:1", "name", "alice", "role", "admin") == 2 and one("HSET", "usr:1", "name", "bob") == 0
    assert one("HDEL", "usr:1", "role") == 1 and one("HLEN", "usr:1") == 1 and one("HGET", "usr:1", "name") == "bob"
    assert one("SADD", "a", "1", "2", "3", "3") == 3 and one("SADD", "b", "2", "3", "4") == 3
    assert col("SINTER", "a", "b") == ["2", "3"] and col("SINTER", "a", "missing") == []
    assert one("LPUSH", "l", "a", "b") == 2 and [r["elem"] for r in s.command("LRANGE", "l", 0, -1).collect()] == ["b", "a"]
    assert one("RPOP", "l") == "a" and one("LPOP", "l") == "b" and one("LPOP", "l") is None and one("LLEN", "l") == 0
    one("ZADD", "z", -100.5, "neg", 0, "zero", 100.5, "pos", 1.7976931348623157e308, "max")
    assert col("ZRANGEBYSCORE", "z", -1000, 200) == ["neg", "zero", "pos"]
    assert one("SETBIT", "far", 1000000007, 1) == 0 and one("GETBIT", "far", 1000000007) == 1 and one("BITCOUNT", "far") == 1
    assert col("KEYS", "*") == ["a", "b", "e", "far", "n", "usr:1", "z"]
    assert one("DEL", "usr:1", "a", "nope") == 2 and one("HLEN", "usr:1") == 0
    v = s.version
    assert s.execute([("GET", "n"), ("INCR", "n")], v) is not None and s.execute([("INCR", "n")], v) is None and s.execute([("GET", "n")], v) is not None


def test_store_lists_expire_and_go(spark):
    s = Store(spark, now=1000)
    one = lambda *a: (lambda r: r[0] if r else None)(s.command(*a).first())
    one("RPUSH", "l", "a", "b")
    one("HSET", "l", "f", "v")
    v = s.version
    assert one("TTL", "l") == -1 and one("EXPIRE", "l", 60) == 1 and one("TTL", "l") == 60 and one("EXPIRE", "none", 5) == 0
    one("RPUSH", "l", "c")
    one("HDEL", "l", "f")
    assert one("TTL", "l") == 60
    s.now = 1060
    assert [r["elem"] for r in s.command("LRANGE", "l", 0, -1).collect()] == ["c"] and one("TTL", "l") == -1
    assert one("DEL", "l") == 1 and one("LLEN", "l") == 0 and one("EXISTS", "l") == 0 and one("TTL", "l") == -2
    assert [r["key"] for r in s.command("KEYS").collect()] == []
    s.now = 1000
    assert [r["elem"] for r in s._held(["l"], v).orderBy("pos").collect()] == ["a", "b"]  # as of before
    one("RPUSH", "l", "d")
    assert one("LPOP", "l") == "d" and one("LPOP", "l") is None


def test_store_transactions(spark):
    from ledgerline.store import Conflict

    s = Store(spark, now=0)
    s.update(lambda t: (t.set("a", "1"), t.set("b", "1")))
    x, y = s.begin(), s.begin()
    for t, k in ((x, "a"), (y, "b")):  # write skew: both read both
        assert (t.get("a"), t.get("b"), t.get("none")) == ("1", "1", None)
        t.set(k, "0")
        assert t.get(k) == "0"
    s.commit(x)
    with pytest.raises(Conflict):
        s.commit(y)
    z = s.begin()
    s.command("SET", "b", "plain")  # no transaction, so no conflict
    assert z.get("b") == "1"
    z.set("c", "2", 50)
    z.delete("a")
    v = s.commit(z)
    assert s.log.filter(F.col("version") == v).count() == 2 and s.command("GET", "a").isEmpty() and s.command("TTL", "c").first()[0] == 50
    w = s.begin()
    assert w.get("d") is None
    s.update(lambda t: t.set("d", "1"))
    w.set("e", "1")
    with pytest.raises(Conflict):  # a miss is a read
        s.commit(w)
    with pytest.raises(KeyError):
        s.update(lambda t: (t.set("f", "1"), {}["x"]))
    assert s.command("GET", "f").isEmpty() and s.view(lambda t: t.get("d")) == "1"
    # queues
    v = s.version
    s.execute([("SET", "b2", "x")], v)
    assert s.execute([("MSET", "q", "1", "b2", "9")], v) is None and s.execute([("SET", "u", "1"), ("DEL", "q", "b2")], v) is None
    assert s.execute([("MGET", "q", "b2")], v) is not None
    s.command("MULTI")
    with pytest.raises(ValueError, match="nested"):
        s.command("MULTI")
    assert s.command("SET", "m", "1").first()[0] == "QUEUED"
    s.command("DISCARD")
    assert s.command("GET", "m").isEmpty()
    s.command("MULTI")
    s.command("SET", "m", "1")
    with pytest.raises(ValueError, match="unknown"):
        s.command("NOPE")
    with pytest.raises(ValueError, match="EXECABORT"):
        s.command("EXEC")
    with pytest.raises(ValueError, match="without"):
        s.command("EXEC")
    s.command("MULTI")
    s.command("INCR", "n")
    s.command("INCR", "n")
    assert [r.first()[0] for r in s.command("EXEC")] == [1, 2]


def test_store_raw_keys_quota_channels_and_many_writes(spark, monkeypatch):
    import ledgerline.store as store

    s = Store(spark, now=10)
    s.put("raw", "v", 5)
    assert s.get("raw").first()[0] == "v" and s.command("GET", "raw").isEmpty() and [r["key"] for r in s.command("KEYS").collect()] == ["raw"]
    assert s.delete("raw") and not s.delete("raw") and s.command("TTL", "raw").first()[0] == -2
    q = Store(spark, max_bytes=10)
    q.command("SET", "k", "12345678")
    with pytest.raises(ValueError, match="quota"):
        q.command("SET", "k2", "1")
    assert q.command("DEL", "k").first()[0] == 1
    assert [tuple(r) for r in s.command("SUBSCRIBE", "c1", "x", "y").collect()] == [("x", 1), ("y", 2)]
    s.command("SUBSCRIBE", "c2", "x")
    assert s.command("PUBLISH", "x", "m").first()[0] == 2 and s.command("PUBLISH", "z", "m").first()[0] == 0 and s.received("c1", "x") == ["m"]
    assert [s.command("PUBLISH", "x", "m").first()[0] for _ in range(3)] == [2] * 3
    s._subscribers["x"]["c2"].extend(["m"] * store.BUFFER)
    assert s.command("PUBLISH", "x", "m").first()[0] == 1
    assert [tuple(r) for r in s.command("UNSUBSCRIBE", "c1").collect()] == [("x", 1), ("y", 0)]
    monkeypatch.setattr(store, "FLUSH", 3)
    monkeypatch.setattr(store, "FRAMES", 2)
    m = Store(spark)
    for i in range(7):
        m.command("SET", f"k{i % 4}", str(i))
    for i in range(3):
        m.command("DEL", f"k{i}")
    assert {r["key"]: r["value"] for r in m.state("s").collect()} == {"k3": "3"}
    with pytest.raises(ValueError, match="number of arguments"):
        m.command("GET")


def test_entry_is_complete():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 100
    assert {n for n in q if n not in sql} <= {n for n in q if re.match(r"p[678]_", n)}


def test_streams(spark, tmp_path):
    from ledgerline.sources import oplog
    from ledgerline.streaming import feeds as stream

    x = log(spark, [("s", f"k{i % 7}", "", f"v{i}", None, i % 5 == 0, 0, i) for i in range(1, 60)])
    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/out"
    for part in (0, 1, 2):
        x.filter(F.col("version") % 3 == part).coalesce(1).write.mode("append").parquet(src)
    stream.ingest(stream.read_stream(spark, src, 1), out, f"{tmp_path}/c1").awaitTermination()
    stream.ingest(stream.read_stream(spark, src, 1), out, f"{tmp_path}/c1").awaitTermination()  # a restart adds nothing
    assert spark.read.parquet(out).count() == 59
    want = {(r["key"], r["version"]) for r in resolve.resolve(x).collect()}
    stream.replicate(stream.read_stream(spark, src, 1), f"file://{tmp_path}/rep", f"{tmp_path}/c2", 0).awaitTermination()
    state = stream.replica(spark, f"file://{tmp_path}/rep")
    assert {(r["key"], r["version"]) for r in resolve.resolve(state).collect()} == want
    path = f"file://{tmp_path}/log"
    oplog.write_log(x, path)
    assert oplog.read_log(spark, path).count() == 59
    for n in ("c1", "c2", "c3"):
        oplog.checkpoint(x, f"file://{tmp_path}/cp", n)
    assert oplog.prune(spark, f"file://{tmp_path}/cp", 1) == ["c1", "c2"] and oplog.checkpoints(spark, f"file://{tmp_path}/cp") == ["c3"]
    oplog.archive(x, f"file://{tmp_path}/gz1")
    oplog.archive(x.filter("version > 30"), f"file://{tmp_path}/gz2")
    assert oplog.read_archives(spark, f"file://{tmp_path}/gz1", f"file://{tmp_path}/gz2").count() == 59
    new = oplog.ingest(log(spark, [("s", "k1", "", "bulk", None, False, 0, 0)]), x)
    assert resolve.resolve(x.unionByName(new)).filter("key = 'k1'").first()["value"] == "bulk"
    with pytest.raises(ValueError, match="overlap"):
        oplog.ingest(new, x, spark.createDataFrame([(1, "a", "m"), (2, "m", "z")], "number bigint, low string, high string"))
    assert not oplog.within_quota(spark, path, 10, 5) and oplog.within_quota(spark, path, 10, 0)
    oplog.clear(spark, path)
    assert oplog.read_log(spark, path).count() == 0


def test_a_snapshot_clears_a_replica_first(spark, tmp_path, monkeypatch):
    from ledgerline.streaming import feeds as stream

    monkeypatch.setattr(stream, "BUCKETS", 4)
    src, rep = f"file://{tmp_path}/src", f"file://{tmp_path}/rep"
    batches = [[("s", f"k{i}", "", "old", None, False, 0, i) for i in range(1, 9)], [("s", "k1", "", "new", None, False, 0, 10)], [("snapshot", None, "", None, None, False, 0, 20), ("s", "k2", "", "snap", None, False, 0, 20), ("s", "k3", "", "late", None, False, 0, 19)], [("s", "k9", "", "x", None, False, 0, 21)]]
    want = [8, 8, 1, 2]
    for n, rows in enumerate(batches):
        log(spark, rows).coalesce(1).write.mode("append").parquet(src)
        stream.replicate(stream.read_stream(spark, src, 1), rep, f"{tmp_path}/c", 0).awaitTermination()
        got = {r["key"]: r["value"] for r in resolve.resolve(stream.replica(spark, rep)).collect()}
        assert len(got) == want[n]
    assert got == {"k2": "snap", "k9": "x"}
    assert len(list((tmp_path / "rep").glob("batch=0/bucket=*"))) < 4  # replaced copies went


def test_ticks(spark, tmp_path):
    from ledgerline.streaming import feeds as stream

    seen = []
    q = stream.schedule(spark, seen.append, "500 milliseconds", f"{tmp_path}/c")
    try:
        for _ in range(120):
            if len(seen) > 2:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert seen[:3] == [0, 1, 2]


def test_levels_merge_what_overlaps(spark, tmp_path):
    from ledgerline.sources.oplog import Levels

    lv = Levels(spark, f"file://{tmp_path}/lv", table_rows=4)
    put = lambda keys, v, gone=False: log(spark, [("s", k, "", f"v{v}", None, gone, 0, v) for k in keys])
    want = {}
    lv.add(put("xyz", 1), 1)
    for v, keys in enumerate(["abc", "bcd", "cde", "def"], 2):
        lv.add(put(keys, v))
        want |= dict.fromkeys(keys, f"v{v}")
    want |= dict.fromkeys("xyz", "v1")
    far = next(p for n, p in lv._paths() if n == 1)
    state = lambda: {r["key"]: r["value"] for r in resolve.resolve(lv.read()).collect()}
    assert state() == want and lv.tick(10, 99) == 4 and state() == want
    tables = lv.tables().collect()
    assert {r["level"] for r in tables} == {1} and far in {r["table"] for r in tables}  # what did not meet stayed
    ends = sorted((r["low"], r["high"]) for r in tables)
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert lv.tick(10, 99) == 0
    lv.add(put("ab", 9, True), 1)
    assert lv.tick(10, 99) > 0 and "a" not in state() and "b" not in state()
    assert lv.ingest(put("m", 0)) == 4 and lv.ingest(put("m", 0)) == 3 and state()["m"] == "v0"
    with pytest.raises(ValueError, match="hold their values"):
        lv.ingest(put("n", 0).withColumn("pointer", F.lit(True)))


def test_picks_by_the_written_rules(spark):
    t = lambda *rows: spark.createDataFrame(rows, "t bigint, level int, rows bigint, dead bigint")
    assert maintenance.pick(t((1, 1, 10, 5), (2, 3, 10, 5), (3, 3, 10, 9)), 100) == (3, 2)  # deepest level, its first table over 0.4, not the worst
    assert maintenance.pick(t((1, 4, 10, 9), (2, 0, 10, 4)), 100) is None  # the last level and exactly 0.4 are not due
    assert maintenance.pick(t(*[(i, 0, 10, 0) for i in range(3)]), 100) is None and maintenance.pick(t(*[(i, 0, 10, 0) for i in range(4)]), 100) == (0, None)
    assert maintenance.level_limits(10**6, 100) == [0, 1000, 10000, 100000, 10**6] and maintenance.level_limits(0, 100) == [0, 0, 0, 0, 1000]
    rows = [(i, 0, 10, 0) for i in range(8)] + [(50, 4, 10**6, 0), (51, 2, 30000, 0), (52, 1, 1500, 0)]
    assert maintenance.pick(t(*rows), 100) == (2, None)


def test_value_log(spark):
    v = spark.createDataFrame([(1, 0, 1, None, 10, "a"), (1, 0, 1, 5, 10, "a"), (1, 10, 1, None, 7, "b"), (1, 10, 1, None, 9, "b"), (1, 19, 2, 3, 4, "c"), (2, 0, 1, None, None, None)], "fid bigint, voffset bigint, appended_at bigint, dropped_at bigint, vsize int, key string")
    got = {r["fid"]: (r["live_bytes"], r["dead_bytes"]) for r in maintenance.discard_stats(v, F.lit(9)).collect()}
    assert got == {1: (19, 4), 2: (0, 0)}
    moved = sorted((r["voffset"], r["vsize"], r["to_fid"], r["to_offset"]) for r in maintenance.gc_rewrite(v, 1, F.lit(9)).collect())
    assert moved == [(0, 10, 3, 0), (10, 9, 3, 10)]
    p = spark.createDataFrame([(1, 0), (1, 0), (1, 99), (None, 0)], "fid bigint, voffset bigint")
    assert {r["fid"]: (r["pointers"], r["removable"]) for r in maintenance.still_referenced(v, p).collect()} == {1: (1, False), 2: (0, True)}


def test_sealing_by_a_known_vector(spark):
    z = F.lit(bytearray(16))
    got = spark.range(1).select(F.hex(F.aes_encrypt(z, z, F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray(12)))).alias("x")).first()["x"].lower()
    # fixed values: the published test vector of AES-128-GCM for zero key, nonce and block
    assert got == "00" * 12 + "0388dace60b6a392f328c2b971b2fe78" + "ab6e47d42cec13bdf53a67b21257bddf"


def test_snapshot_restore_and_quota(spark, tmp_path):
    from ledgerline.sources import oplog

    x = log(spark, [("s", "a", "", "1", None, False, 0, 1), ("s", "a", "", "2", None, False, 0, 2)])
    path, snap = f"file://{tmp_path}/log", f"file://{tmp_path}/snap"
    oplog.snapshot(x, snap)
    oplog.write_log(log(spark, [("s", "z", "", "9", None, False, 0, 9)]), path)
    (tmp_path / "snap" / "header").rename(tmp_path / "kept")
    with pytest.raises(ValueError, match="whole"):
        oplog.restore(spark, snap, path)
    assert oplog.read_log(spark, path).first()["key"] == "z"  # nothing was cleared
    (tmp_path / "kept").rename(tmp_path / "snap" / "header")
    oplog.restore(spark, snap, path)
    assert [(r["key"], r["value"]) for r in oplog.read_log(spark, path).collect()] == [("a", "2")]
    with pytest.raises(ValueError, match="quota"):
        oplog.write_log(x, path, limit=1)
    oplog.write_log(x.withColumn("deleted", F.lit(True)), path, limit=1)
    assert oplog.read_log(spark, path).count() == 3


def test_expiry_timers(spark, tmp_path):
    from ledgerline.streaming import feeds as stream

    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    s0 = int(t0.timestamp())
    schema = "dtype string, key string, sub string, version bigint, expires_at bigint, deleted boolean, at timestamp"
    src = f"file://{tmp_path}/src"
    for n, rows in enumerate([[("s", "a", "", 1, s0 + 10, False), ("s", "b", "", 2, s0 + 10, False), ("s", "c", "", 3, 0, False)], [("s", "b", "", 4, 0, False)], [("s", "z", "", 5, 0, False)], [("s", "z", "", 6, 0, False)]]):
        at = [t0, t0 + timedelta(seconds=5), t0 + timedelta(seconds=60), t0 + timedelta(seconds=61)][n]
        spark.createDataFrame([(*r, at) for r in rows], schema).coalesce(1).write.mode("append").parquet(src)
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).withWatermark("at", "1 second")
    q = stream.expiry_timers(files).writeStream.format("memory").queryName("expired").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["key"], r["expired_at"]) for r in spark.table("expired").collect()] == [("a", s0 + 10)]


def test_null_keys_are_keys(spark):
    ops = spark.createDataFrame([(None, 1, "RPUSH", "a", "x"), (None, 2, "LPUSH", None, "x"), ("k", 3, "RPUSH", "c", "x"), (None, 4, "RPOP", None, "x"), (None, 5, None, "z", "x")], "key string, version bigint, op string, elem string, place string")
    assert {(r["key"], r["pos"], r["elem"]) for r in lists.contents(ops).collect()} == {(None, 0, None), ("k", 0, "c")}
    assert [(r["version"], r["result"]) for r in lists.pops(ops).collect()] == [(4, "a")]
    assert lists.contents(ops.limit(0)).collect() == []
    x = log(spark, [("s", None, "", "1", None, False, 0, 1), ("s", None, "", "2", None, None, None, 2), (None, "a", None, "3", None, True, 0, 3)])
    assert {r["value"] for r in resolve.resolve(x, now=1).collect()} == {"2"}
    assert sorted(r["pos"] for r in resolve.history(x).collect()) == [1, 1, 2]
    assert len(maintenance.bottom_drop(maintenance.retained(x, ["dtype", "key", "sub"], 9), ["dtype", "key", "sub"], 0).collect()) == 1
    r = scan.ranked(spark.createDataFrame([(None, 3), ("a", 1), (None, 1), ("a", 9)], "k string, v bigint"), ["k"], ["v"], "i")
    assert {tuple(x) for x in r.collect()} == {(None, 1, 1), (None, 3, 2), ("a", 1, 1), ("a", 9, 2)}
