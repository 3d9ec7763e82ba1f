import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerline.operators import hotkeys, incremental, orphans, patches
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)
FEED = "lsn bigint, op string, key string, version bigint, ts timestamp_ntz, value string, k string, p string, chunk bigint"


def feed(spark, rows):
    return spark.createDataFrame([(*r, "v" + str(r[0]), "x", "y", 0) for r in rows], FEED)


def deciding(rows):
    best = {}
    for lsn, op, key, version, ts in rows:
        if key is None or version is None or op not in ("PUT", "put", "SET", "1", "DEL", "del", "DELETE", "2"):
            continue
        rank = (version, ts or datetime.min, -lsn)
        if key not in best or rank > best[key][0]:
            best[key] = (rank, op in ("PUT", "put", "SET", "1"), lsn)
    return {(k, b[2]) for k, b in best.items() if b[1]}


def some_feed(seed, n=800):
    rng = random.Random(seed)
    return [(i, rng.choice(["PUT", "put", "SET", "1", "DEL", "del", "DELETE", "2", "?", None]), rng.choice([None, "hot", "hot", *[f"k{j}" for j in range(40)]]), rng.choice([None, 0, *range(1, 30)]), rng.choice([None, T0 + timedelta(seconds=rng.randrange(5))])) for i in range(n)]


def test_feed_in_any_order_twice_and_in_halves(spark):
    rows = some_feed(1)
    want = deciding(rows)
    run = lambda r, **kw: {(x["key"], x["seq"]) for x in patches.apply_feed(feed(spark, r), "key", "version", "ts", "lsn", "op", ["value"], chunk=64, **kw).collect()}
    shuffled = random.Random(2).sample(rows, len(rows))
    assert run(rows) == run(shuffled + rows) == want
    puts = [r for r in rows if r[1] in ("PUT", "put", "SET", "1")]
    base = patches.apply_feed(feed(spark, puts[:200]), "key", "version", "ts", "lsn", "op", ["value"])
    assert run(rows, base=base) == want
    assert run([]) == set()
    parts = [patches.patches(feed(spark, p), "key", "version", "ts", "lsn", "op", chunk=64) for p in (rows[500:], rows[:300], rows[200:600])]
    assert {(x["key"], x["seq"]) for x in patches.state(patches.composed(*parts)).collect()} == want  # late parts, deletes kept


def test_patches_compose_associatively():
    import itertools

    ops = [(1, "a", True), (2, "b", False), (2, "c", True)]
    compose = max
    for x, y, z in itertools.permutations(ops):
        assert compose(compose(x, y), z) == compose(x, compose(y, z))


def test_eager_join_equals_row_join(spark):
    rng = random.Random(4)
    a = [(rng.choice(["hot"] * 9 + ["a", "b", None]), rng.choice([1, 2, None]), 0) for _ in range(300)]
    b = [(rng.choice(["hot", "a", "c", None]), rng.choice([5, None]), 0) for _ in range(60)]
    left, right = spark.createDataFrame(a, "key string, x bigint, n bigint"), spark.createDataFrame(b, "key string, y bigint, k bigint")
    got = {r["key"]: r for r in hotkeys.eager_join(left, right, "key", {"x": F.col("x")}, {"y": F.col("y")}).collect()}
    ca, cb = Counter(k for k, *_ in a), Counter(k for k, *_ in b)
    assert got.keys() == ca.keys() | cb.keys()
    for k, r in got.items():
        assert (r["l_n"], r["r_n"]) == (ca[k], cb[k])
        pairs = [(x, y) for p, x, _ in a for q, y, _ in b if p == q == k and k is not None]
        assert r["pairs"] == len(pairs)
        assert r["j_l_x"] == sum(x or 0 for x, _ in pairs) and r["j_r_y"] == sum(y or 0 for _, y in pairs)
    hot = {(r["tbl"], r["key"]) for r in hotkeys.hot_keys(hotkeys.eager_join(left, right, "key"), ("a", "b"), 20).collect()}
    assert hot == {(t, k) for t, c, n in (("a", ca, 300), ("b", cb, 60)) for k, v in c.items() if k is not None and v * 100 >= n * 20}
    assert hotkeys.hot_keys(hotkeys.eager_join(left.limit(0), right.limit(0), "key"), ("a", "b"), 2).collect() == []


REFS = "id bigint, fid int, off bigint, seen timestamp_ntz, us bigint, s string"
PARENTS = "fid int, off bigint, since timestamp_ntz, until timestamp_ntz, us bigint, k string"


def at(n):
    return None if n is None else T0 + timedelta(seconds=n)


def orphan_ids(spark, refs, parents, **kw):
    r = spark.createDataFrame([(i, f, o, at(t), 1, "z") for i, f, o, t in refs], REFS)
    p = spark.createDataFrame([(f, o, at(a), at(z), 1, "z") for f, o, a, z in parents], PARENTS)
    state = F.coalesce(orphans.micros("until"), F.lit((1 << 63) - 1))
    return sorted(x["id"] for x in orphans.orphans(r, ["fid", "off"], "seen", p, ["fid", "off"], "since", state, F.col("s") > F.col("us"), ["id"]).collect())


def brute_orphans(refs, parents):
    there = lambda f, o, t: t is not None and any(x == f and y == o and a is not None and a <= t and (z is None or z > t) for x, y, a, z in parents)
    return sorted(i for i, f, o, t in refs if f is not None and o is not None and not there(f, o, t))


@pytest.mark.parametrize(("filter_bytes", "chunk_rows"), [(32 << 20, 200_000), (8, 10), (8, 1)])
def test_orphans_against_brute_force(spark, monkeypatch, filter_bytes, chunk_rows):
    monkeypatch.setattr(orphans, "FILTER_BYTES", filter_bytes)  # 8: the filter is parted, hot words apart
    monkeypatch.setattr(orphans, "CHUNK_ROWS", chunk_rows)
    monkeypatch.setattr(orphans, "HOT_SHARE", 4)
    rng = random.Random(6)
    parents = [(rng.choice([1, 2, None]), rng.choice([None, *range(12)]), rng.choice([None, *range(100)]), None) for _ in range(120)]
    parents = [(f, o, a, rng.choice([None, a + rng.randrange(20) if a is not None else None])) for f, o, a, _ in parents] * 2
    refs = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([0, 0, 0, None, *range(15)]), rng.choice([None, *range(110)])) for i in range(500)]
    assert orphan_ids(spark, refs, parents) == brute_orphans(refs, parents)
    assert orphan_ids(spark, refs, []) == brute_orphans(refs, [])
    assert orphan_ids(spark, [], parents) == []


@pytest.mark.parametrize("filter_bytes", [32 << 20, 8])
def test_bloom_has_no_false_negatives_and_few_false_positives(spark, monkeypatch, filter_bytes):
    monkeypatch.setattr(orphans, "FILTER_BYTES", filter_bytes)
    p = spark.range(5000).select(F.col("id").alias("a"))
    words, shift = orphans.bloom(p, ["a"], 5000)
    asked = spark.range(15000).select(F.col("id").alias("a"))
    flagged = orphans.probed(asked, ["a"], words, shift, 5000).collect()
    hit = {r["a"] for r in flagged if r["may_be"]}
    assert len(flagged) == 15000 and hit >= set(range(5000))
    assert len(hit) - 5000 < 0.05 * 10000


def test_many_cuts_are_placed_like_few(spark):
    rng = random.Random(5)
    cuts = sorted(rng.sample(range(3000), 700))
    df = spark.range(-5, 3010)
    got = df.select("id", orphans._place(cuts, F.col("id")).alias("c")).collect()
    assert all(r["c"] == sum(x <= r["id"] for x in cuts) for r in got)


def test_pending_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    entries = [("f", rng.randrange(1, 3000), rng.choice([None, "a", "b"]), at(rng.choice([None, *range(100)]))) for _ in range(1500)]
    entries += rng.sample(entries, 300) + [("g", 5, "a", at(1)), ("f", None, "a", at(1))]
    runs = []
    for run in range(14):
        lo = rng.randrange(2500)
        for attempt in range(rng.randrange(1, 4)):
            runs += [(run, attempt, "f", lo, lo + rng.randrange(600), at(rng.randrange(100)), at(100), rng.choice(["ok", "OK", "failed", None]))] * rng.choice([1, 2])
    schema = "run_id bigint, attempt int, feed string, from_seq bigint, to_seq bigint, started_at timestamp_ntz, finished_at timestamp_ntz, status string"
    last = {}
    for r in runs:
        if r[0] not in last or r[1] > last[r[0]][1]:
            last[r[0]] = r
    ok = [r for r in last.values() if (r[7] or "").lower() == "ok"]
    done = {(f, q, k) for f, q, k, a in entries if q is not None and any(r[2] == f and r[3] < q <= r[4] and a is not None and a <= r[5] for r in ok)}
    want = {(f, q, k) for f, q, k, _ in entries if q is not None} - done
    e = spark.createDataFrame(entries, "feed string, seq bigint, key string, arrived_at timestamp_ntz")
    pending = lambda e, runs, width: incremental.pending(e, incremental.speaking_runs(spark.createDataFrame(runs, schema)), f"file://{tmp_path}/{len(list(tmp_path.iterdir()))}", width)
    got = pending(e, runs, 64).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    none = pending(e, [], 8).count()
    assert none == len({(f, q, k) for f, q, k, _ in entries if q is not None})
    assert pending(e.limit(0), runs, 8).count() == 0


def test_tree_descends_to_changed_leaves_only(spark):
    e = spark.range(5000).select(F.lit("f").alias("feed"), F.col("id").alias("seq"), F.lit("k").alias("key"))
    changed = e.withColumn("key", F.when(F.col("seq").isin(17, 4999), "x").otherwise(F.col("key"))).filter("seq <> 2000")
    trees = [incremental.grown(incremental.leaves(x, "feed", "seq", ["key"], width=16), 3, 4) for x in (e, changed)]
    got = {r["node"] for r in incremental.changed_leaves(*trees, 3, 4).collect()}
    assert got == {1, 125, 312}
    assert incremental.changed_leaves(trees[0], trees[0], 3, 4).collect() == []


def test_publish_is_all_or_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    assert incremental.current(spark, root) is None and incremental.published(spark, root, "tree") is None
    e = spark.range(10).select(F.lit("f").alias("feed"), F.col("id").alias("seq"), F.lit("k").alias("key"))
    tree = incremental.leaves(e, "feed", "seq", ["key"])
    assert incremental.publish(e, tree, root) == 1
    # a run that died after it wrote its marker and before the rename, its name first of all
    e.withColumn("key", F.lit("DEAD")).write.parquet(f"{root}/v2-died/output")
    (tmp_path / "out" / "tmp-0000").write_text(f"{root}/v2-died")
    assert incremental.current(spark, root) == 1
    assert incremental.publish(e.limit(3), tree, root) == 2
    assert {r["key"] for r in incremental.published(spark, root, "output").collect()} == {"k"}
    assert incremental.published(spark, root, "output").count() == 3 and (tmp_path / "out" / "tmp-0000").exists()


def test_of_two_writers_with_one_base_one_commits(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    e = spark.range(10).select(F.lit("f").alias("feed"), F.col("id").alias("seq"), F.lit("k").alias("key"))
    tree = incremental.leaves(e, "feed", "seq", ["key"])
    assert incremental.publish(e, tree, root, 0) == 1
    with pytest.raises(RuntimeError, match="another run"):
        incremental.publish(e.limit(2), tree, root, 0)
    assert incremental.current(spark, root) == 1 and incremental.published(spark, root, "output").count() == 10
    assert not list((tmp_path / "out").glob("tmp-*"))


def test_many_runs_are_kept_in_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "PARTS", 2)
    root = f"file://{tmp_path}/runs"
    e = spark.range(60).select(F.lit("f").alias("feed"), F.col("id").alias("seq"), F.lit("k").alias("key"))
    for v in range(1, 5):
        assert incremental.take(e.filter(F.col("seq") < 10 * v), "feed", "seq", ["key"], root) == v
        assert {r["seq"] for r in incremental.published(spark, root, "output").collect()} == set(range(10 * v - 10, 10 * v))
        assert len(incremental._marker(spark, root, v)[2]) <= 2


def test_runs_take_each_record_once(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    rows = [("f", i, f"k{i}") for i in range(400)] + [("f", 3, None), ("g", None, "x")]
    df = lambda r: spark.createDataFrame(r, "feed string, seq bigint, key string")
    run = lambda r: incremental.take(df(r), "feed", "seq", ["key"], root, width=16)
    out = lambda v: {tuple(r) for r in incremental.published(spark, root, "output", v).collect()}
    run(rows[:200] + rows[:50])
    run(rows)
    assert out(1) == set(rows[:200]) and out(2) == set(rows[200:401])
    df([("f", 999, "z")]).write.parquet(f"{root}/v3-died/output")
    run([*rows, ("f", 7, "changed"), ("f", 5000, "late")])
    assert out(3) == {("f", 7, "changed"), ("f", 5000, "late")}
    run([*rows, ("f", 7, "changed"), ("f", 5000, "late")])
    assert out(4) == set()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["PUT", "DEL", "2", "1"]), st.sampled_from(["a", "b", None]), st.integers(0, 3), st.sampled_from([None, T0])), max_size=25))
def test_feed_property(spark, ops):
    rows = [(i, *o) for i, o in enumerate(ops)]
    got = patches.apply_feed(feed(spark, rows), "key", "version", "ts", "lsn", "op", chunk=4).collect()
    assert {(r["key"], r["seq"]) for r in got} == deciding(rows)
