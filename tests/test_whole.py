"""Queries that take in the whole log, held against a fold of the smallest tables in Python."""

from datetime import datetime
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def events():
    """(version, user, type, value, second) in order of version."""
    p = Path(SF, "events.parquet")
    return duckdb.sql(f"select event_id + 1, user_id, event_type, value, cast(floor(epoch(ts)) as bigint) from '{p}{'/*.parquet' if p.is_dir() else ''}' order by 1").fetchall()


def run(spark, name):
    return [r.asDict() for r in e.queries()[name](spark, SF).collect()]


def set_state(events, over=None):
    """Members by set; with ``over`` additions up to it are passed by, removals are not."""
    held = {}
    for _, u, et, v, _ in events:
        if v < 5:
            held.setdefault(et, set()).discard(f"m{u}")
        elif over is None or v > over:
            held.setdefault(et, set()).add(f"m{u}")
    return held


def list_state(events):
    """What each list holds, as (version of the push, event id)."""
    held = {}
    for v, u, et, *_ in events:
        x = held.setdefault(f"q:{u}", [])
        if et in ("click", "signup"):
            x.insert(len(x) if et == "click" else 0, (v, str(v - 1)))
        elif et in ("view", "error") and x:
            x.pop(-1 if et == "view" else 0)
    return {k: x for k, x in held.items() if x}


def test_sets_of_the_whole_log(spark, events):
    held = set_state(events)
    assert {(r["key"], r["member"]) for r in run(spark, "smembers")} == {(f"s:{t}", m) for t, x in held.items() for m in x}
    assert {r["key"]: r["n"] for r in run(spark, "scard")} == {f"s:{t}": len(x) for t, x in held.items() if x}
    assert {r["member"]: r["is_member"] for r in run(spark, "sismember")} == {f"m{u}": int(f"m{u}" in held["click"]) for _, u, *_ in events}


def test_intersections_keep_removals(spark, events):
    held = set_state(events, 100)
    assert {r["member"] for r in run(spark, "sinter_2")} == held["click"] & held["view"]
    assert {r["member"] for r in run(spark, "sinter_n")} == held["click"] & held["view"] & held["purchase"] & held["signup"]


def write_events(at, rows):
    """events of {version: (user, type)}, in one second of value 9."""
    ts = pa.array([datetime(2024, 1, 1)] * len(rows), pa.timestamp("us"))
    pq.write_table(pa.table({"event_id": [v - 1 for v in rows], "ts": ts, "user_id": [u for u, _ in rows.values()], "event_type": [t for _, t in rows.values()], "value": [9.0] * len(rows), "props": ["{}"] * len(rows)}), at / "events.parquet")


def test_bottom_level_of_the_whole_log(spark, tmp_path):
    # past the constant horizon of 4000: a put over a tombstone, a tombstone over a put, a new record
    write_events(tmp_path, {1: (7, "error"), 2: (8, "click"), 4500: (7, "click"), 4501: (8, "error"), 4502: (9, "click")})
    got = {(r["key"], r["version"]) for r in e.queries()["compact_bottom_drop"](spark, str(tmp_path)).collect()}
    assert got == {("u:7", 4500), ("u:9", 4502)}


def test_lists_are_among_all_types(spark, events):
    held = list_state(events)
    lists = lambda name, col="key": {r[col] for r in run(spark, name) if r[col].startswith("q:")}
    assert held and lists("exists_any_type") == set(held)
    assert {r["key"]: r["members"] for r in run(spark, "collection_members") if r["key"].startswith("q:")} == {k: len(x) for k, x in held.items()}
    assert {(r["key"], r["sub"], r["value"], r["version"]) for r in run(spark, "get_with_version") if r["dtype"] == "l"} == {(k, str(i), el, v) for k, x in held.items() for i, (v, el) in enumerate(x)}
    assert lists("glob_qmark") == {k for k in held if len(k) == 4 and k[3] in "13"}


def test_scan_names_lists(spark):
    from ledgerline.store import Store

    s = Store(spark, now=0)
    s.command("SET", "a", "1")
    s.command("RPUSH", "b", "x")
    s.command("RPUSH", "c", "x")
    s.command("RPOP", "c")
    assert [r["key"] for r in s.command("SCAN").orderBy("pos").collect()] == ["a", "b"]
    assert [r["key"] for r in s.command("SCAN", "a").collect()] == ["b"]


def test_keys_past_the_first_hundreds_are_asked_for(spark, tmp_path):
    write_events(tmp_path, {1: (2, "click"), 2: (42, "click"), 3: (420, "click"), 4: (421, "click"), 5: (402, "error")})
    n = [2, 42, 402, 420, 421, 999]
    pq.write_table(pa.table({"c_custkey": n, "c_nationkey": pa.array([2] * len(n), pa.int32())}), tmp_path / "customer.parquet")
    q = lambda name: e.queries()[name](spark, str(tmp_path)).collect()
    there = {2: "v0", 42: "v1", 420: "v2", 421: "v3"}
    assert {(r["pos"], r["key"], r["value"], r["present"]) for r in q("mget")} == {(2 * k + i, f"u:{x}", there.get(x), x in there) for k in n for i, x in enumerate((k, 2))}
    assert {(r["pos"], r["key"]) for r in q("exists_keys")} == {(2 * k + i, f"u:{x}") for k in n for i, x in enumerate((k, 2)) if x in there}
    assert {(r["key"], r["value"], r["tombstone"]) for r in q("getdel")} == {(f"u:{u}", v, 6) for u, v in there.items()}
    # DEL of none:2, u:42, u:402, u:420, h:421 and u:999
    assert [r["n"] for r in q("del_count")] == [3]
    left = {r["key"] for r in q("del_effect")}
    assert {"u:2", "u:421", "h:2", "h:42", "h:420"} <= left and not left & {"u:42", "u:420", "h:421"}
