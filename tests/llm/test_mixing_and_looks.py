import random

import numpy as np
import pytest

from ledgerline.llm import lookalike, mixing
from ledgerline.llm.tokens import Chunks


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ab", "a​b"), ("ab", "a­b"), ("a b", "a b"), ("a b", "a b"), ("a b", "a　b"), ("a-b", "a‑b"), ("a-b", "a－b"), ("abc", "ａｂｃ"), ("Cop", "Сор"), ("file", "ﬁle"),
        ("é", "é"), ("K", "K"), (";", ";"), ("...", "…"), ("a\nb", "a\r\nb"), ("a\nb", "a b"), ("ë", "ё"), ("ö", "ӧ"), ("ǆ", "dž"), ("x", "﻿x"), ("ọ̈", "ọ̈"),
    ],
)
def test_same_look(a, b):
    assert lookalike.same_look(a) == lookalike.same_look(b)


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("2", "²"), ("e", "é"), ("é", "è"), ("a b", "a  b"), ("a\nb", "a\n\nb"), ("a-b", "a–b"), ("a-b", "a—b"), ("n", "ñ"), ("1", "l"), ("ω", "w"), ("a.", "a"), ("x₂", "x2"), ("№", "No"), ("д", "g"), ("½", "1/2"), ("ⅷ", "VIII"), ("𝐀", "A"), ("①", "1")])
def test_another_look(a, b):
    assert lookalike.same_look(a) != lookalike.same_look(b)


def test_form_is_idempotent():
    rng = random.Random(1)
    signs = [chr(n) for n in [*range(0x20, 0x600), *range(0x1E00, 0x2100), *range(0xFB00, 0xFB10), *range(0xFF00, 0xFFEF)]]
    for _ in range(300):
        t = lookalike.same_look("".join(rng.choices(signs, k=30)))
        assert lookalike.same_look(t) == t


def test_folded_forms_agree_wherever_visible_ones_do():
    assert lookalike.folded(lookalike.same_look("Ｓtraße Ⅷ x²")) == lookalike.folded(lookalike.same_look("STRASSE viii X2"))
    rng = random.Random(7)
    signs = [chr(n) for n in [*range(0x20, 0x600), *range(0x13A0, 0x13F6), *range(0x1E00, 0x2200), *range(0xFB00, 0xFFEF)]]
    for _ in range(2000):
        t = "".join(rng.choices(signs, k=4))
        form = lookalike.same_look(t)
        assert lookalike.folded(lookalike.same_look(form)) == lookalike.folded(form)


def test_pairs_against_brute_force(spark):
    rng = random.Random(2)
    base = ["one two", "One two", "first ﬁle", "", "é"]
    hide = [lambda t: t, lambda t: t.replace(" ", " "), lambda t: "​" + t, lambda t: t.replace("o", "о")]
    docs = [(i, rng.choice(hide)(rng.choice(base)), "x") for i in range(60)] + [(200, "ONE TWO", "x"), (100, None, "x"), (101, "x" * 100000, "y"), (102, "x" * 100000 + "‍", "y")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, look string")
    made = lookalike.digests(df)
    got = [tuple(r) for r in lookalike.lookalike_pairs(made).collect()]
    known = [(i, t, lookalike.same_look(t)) for i, t, _ in docs if t is not None]
    want = {(a, b) for a, t, f in known for b, u, g in known if a < b and f == g and t != u}
    assert len(got) == len(want) and set(got) == want
    got = {r["doc"]: (r["class"], r["texts"]) for r in lookalike.classes(made).collect()}
    assert got == {i: (min(j for j, _, f in known if f == g), len({t for _, t, f in known if f == g})) for i, _, g in known if i in {x for p in want for x in p}}
    assert lookalike.lookalike_pairs(lookalike.digests(df.limit(0))).collect() == []


def test_token_counts_are_exact():
    c, rng = Chunks(), random.Random(3)
    parts = ["word", "Ünï", " ", "  ", "\n", "\n\n", "\t", " ", ",", "it's", "12", "x²", "—", "ﬁ", "á", "'", " \n", " ", "\x1c"]
    for _ in range(2000):
        t = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        assert c.measure(t)[0] == len(c.encoding.encode_ordinary(t)), repr(t)


def test_posteriors_keep_their_means():
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.2] * 5, 20000)
    q = mixing.rounded(p, rng.random(20000))
    assert (q.sum(axis=1) == mixing.PARTS).all() and (q >= 0).all()
    assert np.abs(q.mean(axis=0) / mixing.PARTS - p.mean(axis=0)).max() < 0.01


def texts(n_by_source, seed=1):
    rng, out, k = random.Random(seed), [], 0
    for s, n in n_by_source.items():
        for _ in range(n):
            out.append((k, " ".join(rng.choice([f"{s}word{rng.randrange(9)}", "the", "of", "law"]) for _ in range(rng.randrange(5, 60))) + f" {k}", rng.choice([s, s.upper(), f" {s} "])))
            k += 1
    return out


def test_mixture(spark):
    docs = [*texts({"aa": 300, "bb": 120, "cc": 20}), (9000, "null source", None), (9001, "", "aa"), (9002, None, "aa")]
    docs += [(9100 + i, docs[0][1], "aa") for i in range(5)]  # one text many times is one text
    mixes = [("m", "aa", 0.5, 2), ("m", "BB ", 0.3, 2), ("m", "cc", 0.2, 3), ("gone", "aa", 0.5, 1), ("gone", "missing", 0.5, 4)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, source string, tokens bigint")
    goal = spark.createDataFrame(mixes, "mix string, source string, target_share double, max_repeats int")
    m = mixing.Mixture(df, goal)
    assert m.model.accuracy > 0.9 > m.model.prior_accuracy
    report = {(r["mix"], r["source"]): r for r in m.report().collect()}
    for s, share in (("aa", 0.5), ("bb", 0.3), ("cc", 0.2)):
        assert abs(report["m", s]["actual_share"] - share) < 0.02 and report["m", s]["reachable"]
        assert abs(report["m", s]["expected_tokens"] / report["m", s]["wanted_tokens"] - 1) < 0.2
    assert not report["gone", "missing"]["reachable"] and report["gone", "missing"]["used_tokens"] == 0
    chosen = m.selection().collect()
    caps = {("m", "aa"): 2, ("m", "bb"): 2, ("m", "cc"): 3, ("gone", "aa"): 1}
    assert all(1 <= r["repeats"] <= caps[r["mix"], r["source"]] for r in chosen)
    assert len({(r["mix"], r["doc_id"]) for r in chosen}) == len(chosen) and not {r["doc_id"] for r in chosen} & {9000, 9001, 9002, *range(9100, 9105)}


def test_mixture_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    goal = spark.createDataFrame([("m", "aa", 1.0, 2)], "mix string, source string, target_share double, max_repeats int")
    m = mixing.Mixture(df, goal)
    assert m.selection().collect() == [] and [r["used_tokens"] for r in m.report().collect()] == [0]
    some = spark.createDataFrame([(1, "x y", "aa")], df.schema)
    assert mixing.Mixture(some, goal.limit(0)).selection().collect() == []


def test_settled_rates_meet_the_target_or_the_cap():
    r, t = np.array([0.0, 0.2, 1.0]), np.array([10.0, 20.0, 30.0])
    assert abs((mixing.settled(r, t, 2.0, 50.0) * t).sum() - 50) < 1e-6
    assert mixing.settled(r, t, 1.0, 100.0).tolist() == [1.0] * 3 and mixing.settled(r, t, 1.0, 0).tolist() == [0.0] * 3


def test_many_sources_keep_cells_few():
    assert mixing.parts_for(8) == 8 and mixing.parts_for(2) == 8 and mixing.parts_for(5000) == 1
    for k in (30, 100, 1000):
        n = mixing.parts_for(k)
        assert n == 1 or mixing.math.comb(n + k - 1, k - 1) <= mixing.CELLS
    q = mixing.rounded(np.full((50, 30), 1 / 30), np.linspace(0, 0.99, 50), 3)
    assert (q.sum(axis=1) == 3).all()


def test_projected_gradient_meets_reachable_targets():
    rng = np.random.default_rng(3)
    q = rng.dirichlet([0.3] * 3, 40)
    t = rng.uniform(10, 50, 40)
    want = (0.4 * t) @ q
    r = mixing.fitted(q, np.full(40, 2.0), t, want, 500)
    assert np.abs((r * t) @ q / want - 1).max() < 0.05 and (r >= 0).all() and (r <= 2).all()


def test_a_given_total_tells_what_cannot_be_reached(spark):
    docs = [*texts({"aa": 200, "bb": 20})]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    goal = spark.createDataFrame([("m", "aa", 0.5, 1), ("m", "bb", 0.5, 2)], "mix string, source string, target_share double, max_repeats int")
    r = {x["source"]: x for x in mixing.Mixture(df, goal, total=mixing.ALL).report().collect()}
    assert r["aa"]["reachable"] and not r["bb"]["reachable"]
    assert r["bb"]["used_tokens"] == 2 * r["bb"]["available_tokens"] and abs(r["aa"]["used_tokens"] / r["aa"]["wanted_tokens"] - 1) < 0.02


def test_one_text_of_many_documents_and_a_repeated_row(spark):
    docs = [(5, "a b c", "aa"), (3, "a b c", "bb"), (3, "a b c", "bb"), (9, "d e", "aa")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    m = mixing.fit(df, "doc_id", "text", "source")
    assert sorted((r["doc"], r["source"]) for r in mixing.measured(df, m, "doc_id", "text", "source").collect()) == [(3, "bb"), (9, "aa")]
