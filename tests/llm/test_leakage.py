import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import leakage
from ledgerline.llm.fmindex import Bits, FMIndex, Wavelet, suffix_order

WORDS = ["".join(random.Random(i).choice("abcdefghijklmnoprstuvw") for _ in range(3 + i % 6)) for i in range(400)]
FILL = [f"qx{i}y" for i in range(300)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=120))
def test_suffix_order(t):
    t = np.array([*t, 0], dtype=np.int64)
    assert suffix_order(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=200), st.integers(0, 9))
def test_wavelet_matrix(s, c):
    w = Wavelet(np.array(s), 10)
    i = np.arange(len(s) + 1)
    assert w.rank(np.full(len(i), c), i).tolist() == [s[:k].count(c) for k in i]
    sym, before = w.access(i[:-1])
    assert sym.tolist() == s and before.tolist() == [s[:k].count(x) for k, x in enumerate(s)]
    b = Bits(np.array(s) > 4)
    assert b.rank(i).tolist() == [sum(x > 4 for x in s[:k]) for k in i]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=150), st.lists(st.lists(st.integers(1, 4), min_size=2, max_size=2), min_size=1, max_size=6))
def test_search_finds_every_occurrence(t, patterns):
    which, where = FMIndex(np.array(t), 5, sample=4).search(np.array(patterns))
    got = sorted(zip(which.tolist(), where.tolist()))
    assert got == sorted((k, i) for k, p in enumerate(patterns) for i in range(len(t) - 1) if t[i : i + 2] == p)


def brute(item, doc):
    """Whether some stretch of 20 or more item words, first and last agreeing, has an edit distance of at most a tenth to some stretch of the document."""
    n, far = len(doc), 10**6
    for a in range(len(item)):
        d = [far] + [0 if item[a] == x else far for x in doc]
        for i in range(a + 1, len(item)):
            k = i - a + 1
            if k >= 20 and any(item[i] == doc[j] and d[j] * 10 <= k for j in range(n)):
                return True
            new = [d[0] + 1]
            for j in range(n):
                new.append(min(d[j] + (item[i] != doc[j]), d[j + 1] + 1, new[j] + 1))
            d = new
    return False


def edited(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        k, how = rng.randrange(1, len(ws) - 1), rng.randrange(3)
        if how == 0:
            ws[k] = "zzz"
        elif how == 1:
            del ws[k]
        else:
            ws.insert(k, "yyy")
    return ws


def test_stretch_against_brute_force():
    rng = random.Random(1)
    seen = set()
    for _ in range(150):
        item = [rng.choice(WORDS) for _ in range(45)]
        n = rng.choice([15, 19, 20, 21, 30, 45])
        at = rng.randrange(46 - n)
        doc = FILL[:10] + edited(rng, item[at : at + n], rng.randrange(0, 6)) + FILL[10:20]
        known = leakage.Items([(1, " ".join(item))])
        got = bool(leakage.search_shard([(7, [w.encode() for w in doc])], known))
        want = brute(item, doc)
        seen.add(want)
        assert got == want
    assert seen == {True, False}


def test_disguises(spark):
    rng = random.Random(2)
    item = [rng.choice(WORDS) for _ in range(60)]
    q = item[5:35]
    shown = {
        1: " ".join(q).upper(), 2: ", ".join(q), 3: "\n".join(q), 4: " ".join(q[:10]) + " " + q[10][:2] + "-\n" + q[10][2:] + " " + " ".join(q[11:]),
        5: " ".join(q[:12]) + "\n\nCourt of X — AB-1234/56 — page 7\n\n" + " ".join(q[12:]), 6: " ".join(q[:9]) + " (12) " + " ".join(q[9:]),
        7: " ".join(q).translate({ord("a"): "а", ord("e"): "е", ord("o"): "ο"}), 8: "​".join(" ".join(q)), 9: "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in " ".join(q)),
        10: " ".join(q[:19]), 11: "", 12: None, 13: " ".join(FILL), 14: " ".join(FILL * 200) + " " + " ".join(q), 15: " ".join(q[:4] + ["aa"] + q[5:9] + ["bb"] + q[10:14] + ["cc"] + q[15:19] + ["dd"] + q[20:24] + ["ee"] + q[25:]),
    }
    docs = spark.createDataFrame([(k, v, "x") for k, v in shown.items()], "doc_id bigint, text string, words string").repartition(3)
    items = spark.createDataFrame([(5, " ".join(item), "t"), (6, "too short", "t"), (7, None, "t")], "item_id bigint, text string, task string")
    got = leakage.leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, 5) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 14)}
    spans = {r["doc_id"]: [tuple(x) for x in r["words"]] for r in got}
    assert spans[1] == [(0, 30)] and spans[14] == [(len(FILL) * 200, len(FILL) * 200 + 30)]
    assert leakage.leaks(docs.limit(0), items).collect() == [] and leakage.leaks(docs, items.limit(0)).collect() == []


def test_merge():
    assert leakage.merge([(5, 9), (0, 2), (2, 4), (8, 12)]) == [(0, 4), (5, 12)]


@pytest.mark.parametrize("chars", [50, 10**6])
def test_shards_do_not_change_the_result(spark, monkeypatch, chars):
    rng = random.Random(3)
    item = [rng.choice(WORDS) for _ in range(40)]
    docs = [(i, " ".join(rng.sample(FILL, 20) + (item[:25] if i % 3 == 0 else item[:8]) + rng.sample(FILL, 20))) for i in range(30)]
    known = leakage.Items([(1, " ".join(item))])
    rows, shard = [], []
    for d in docs:
        shard.append((d[0], leakage.words(d[1])))
        if sum(map(len, (b" ".join(w) for _, w in shard))) > chars:
            rows += leakage.search_shard(shard, known)
            shard = []
    rows += leakage.search_shard(shard, known) if shard else []
    assert {r[0] for r in rows} == set(range(0, 30, 3))


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    item = [rng.choice(WORDS) for _ in range(30)]
    docs = [(i, " ".join(FILL[: rng.randrange(200)] + item + FILL[:150] + item[:19] + FILL[:50])) for i in range(12)] + [(50, " ".join(FILL * 3))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    whole = sorted(leakage.leaks(df, items).collect())
    known = leakage.Items([(1, " ".join(item))])
    monkeypatch.setattr(leakage, "PIECE", 100)
    out = set()
    for d, t in docs:
        for at, ws in leakage.pieces(leakage.words(t), 60):
            out |= {(d, at + a, at + z) for _, _, a, z in leakage.search_shard([(0, ws)], known)}
    got = {d: leakage.merge([(a, z) for e, a, z in out if e == d]) for d in {e for e, _, _ in out}}
    assert got == {r[0]: [tuple(x) for x in r[2]] for r in whole} and len(whole) == 12


def test_many_different_words():
    t = np.concatenate([np.random.default_rng(1).integers(1, 1 << 30, 300), np.arange(1, 40), np.arange(1, 40), [1 << 22, 0]])
    assert suffix_order(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["ab", "Cd", " ", "-", "-\n", "\n", "​", "e", "́", "ﬁ", "а", "(12)", "1234", "12345", "\n3. ", "¶ 4 ", "[5]", ". 6) ", "1999", "—", "X — AB-1 — page 7", "\n\nX y — AB-1/2 — page 7\n\n", ".", "_", "Ｗ", "\xad", "²"]), max_size=30))
def test_traced_words_are_the_words(parts):
    t = "".join(parts)
    got = leakage.traced(t)
    assert [w for w, _, _ in got] == leakage.words(t)
    assert all(a < z <= len(t) for _, a, z in got)


def test_cut_spans_leave_the_rest(spark):
    rng = random.Random(6)
    item = [rng.choice(WORDS) for _ in range(40)]
    quote = " ".join(item[3:9] + ["and", "also"] + item[9:20]) + "\n\nCourt — AB-12/3 — page 3\n\n" + " ".join(item[20:35]).replace("e", "е")
    text = "Vorher wird é gesagt. " + quote + " Nachher nichts."
    df = spark.createDataFrame([(1, text), (2, "nothing")], "doc_id bigint, text string")
    (r,) = leakage.leaks(df, spark.createDataFrame([(9, " ".join(item))], "item_id bigint, text string"), chars=True).collect()
    ((a, z),) = r["chars"]
    assert text[a:z] == quote and text[:a] + text[z:] == "Vorher wird é gesagt.  Nachher nichts."


def test_numbers_are_words_and_paragraphs_marks_are_not():
    w = lambda t: b" ".join(leakage.words(t)).decode()
    assert w("In 1999 he paid 20 marks.\n12. Then\n(3) more ¶ 4 and [55] ended. 6) So") == "in 1999 he paid 20 marks then more and ended so"
    assert w("1999 was\n2001 is") == "1999 was 2001 is"
    rng = random.Random(9)
    ws = rng.sample(WORDS, 18)
    item = ws[:6] + ["1998"] + ws[6:12] + ["2003"] + ws[12:]
    known = leakage.Items([(1, " ".join(item))])
    hit = lambda t: bool(leakage.search_shard([(7, leakage.words(t))], known))
    assert len(item) == 20 and hit("said: " + " ".join(item) + " so")
    assert hit("\n\n".join([" ".join(item[:5]), "12. " + " ".join(item[5:11]), "(13) " + " ".join(item[11:16]), "¶ 14 " + " ".join(item[16:])]))
    assert not hit(" ".join(x for i, v in enumerate(item) for x in ([v, str(1990 + i)] if i % 2 else [v])))  # ten years put in are ten differences
    assert not hit(" ".join(item[:6] + ["1997"] + item[7:13] + ["2004", "x"] + item[14:]))


def test_items_in_groups_and_spans_merged_per_document(spark, monkeypatch):
    rng = random.Random(11)
    a = [rng.choice(WORDS) for _ in range(60)]
    items = spark.createDataFrame([(1, " ".join(a[:40])), (2, " ".join(a[20:])), (3, " ".join(FILL[:50]))], "item_id bigint, text string")
    lead = "Vorab: "
    docs = spark.createDataFrame([(1, lead + " ".join(a) + " ende"), (2, " ".join(FILL[:30])), (3, "none")], "doc_id bigint, text string")
    whole = sorted((r["doc_id"], r["item_id"]) for r in leakage.leaks(docs, items).collect())
    monkeypatch.setattr(leakage, "ITEM_BYTES", 100)
    assert sorted((r["doc_id"], r["item_id"]) for r in leakage.leaks(docs, items).collect()) == whole == [(1, 1), (1, 2), (2, 3)]
    got = {r["doc_id"]: (r["item_ids"], [tuple(x) for x in r["chars"]]) for r in leakage.removals(docs, items).collect()}
    assert got == {1: ([1, 2], [(len(lead), len(lead) + len(" ".join(a)))]), 2: ([3], [(0, len(" ".join(FILL[:30])))])}
