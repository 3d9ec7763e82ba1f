import random

import numpy as np
import pytest

from ledgerline.functions import field
from ledgerline.operators import reconcile

SCHEMA = "row_no bigint, key string, value string, expires_at bigint, k string, bucket bigint, kh bigint, h string"


def rows(pairs):
    return [(i, k, v, e, "x", 1, None, "y") for i, (k, v, e) in enumerate(pairs)]


def brute(a, b):
    def stand(t):
        return {k: (v, e) for _, k, v, e, *_ in sorted(t, key=lambda r: r[0]) if k is not None}

    a, b = stand(a), stand(b)
    out = {(k, "only_primary") for k in a.keys() - b.keys()} | {(k, "only_replica") for k in b.keys() - a.keys()}
    for k in a.keys() & b.keys():
        out |= {(k, n) for n, x, y in zip(("value", "expires_at"), a[k], b[k]) if x != y}
    return out


def found(spark, a, b):
    x = reconcile.differences(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "key", ["value", "expires_at"], "row_no").collect()
    assert len(x) == len({tuple(r) for r in x})
    return {tuple(r) for r in x}


def test_field_against_integers():
    rng, p = random.Random(1), int(field.P)
    a = [rng.randrange(p) for _ in range(500)] + [0, 1, p - 1]
    b = [rng.randrange(p) for _ in range(500)] + [p - 1, p - 1, p - 1]
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    assert field.mul(x, y).tolist() == [i * j % p for i, j in zip(a, b)]
    assert field.sub(x, y).tolist() == [(i - j) % p for i, j in zip(a, b)]
    assert field.inverse(x).tolist() == [pow(i, -1, p) if i else 0 for i in a]


@pytest.mark.parametrize(("only_a", "only_b"), [(0, 0), (3, 0), (0, 4), (4, 4), (1, 6)])
def test_interpolation_recovers_sets(only_a, only_b):
    rng = random.Random(only_a * 10 + only_b)
    draw = lambda n: [rng.randrange(1, int(field.P)) for _ in range(n)]
    same, a, b = draw(40), draw(only_a), draw(only_b)
    z = field.points(10)
    fa, fb = (field.char_poly(np.array(same + x, np.uint64), np.array([0, 40 + len(x)]), z) for x in (a, b))
    ((ok, p, q),) = reconcile.interpolate(fa, fb, np.array([only_a - only_b]), 8)
    assert ok
    for x, poly in ((a, p), (b, q)):
        at = np.array(same + x, np.uint64)
        zero = field.horner(np.tile(poly.astype(np.uint64), (len(at), 1)), at) == 0
        assert set(at[zero].tolist()) >= set(x) and not set(at[zero].tolist()) & set(same)


def test_a_bound_too_small_is_noticed():
    rng = random.Random(5)
    a = np.array([rng.randrange(1, int(field.P)) for _ in range(12)], np.uint64)
    fa = field.char_poly(a, np.array([0, 12]), field.points(10))
    ((ok, _, _),) = reconcile.interpolate(fa, np.ones_like(fa), np.array([12]), 8)
    assert not ok


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = [(f"k{i}", rng.choice(["", None, "v", str(i)]), rng.choice([None, 0, i])) for i in range(900)]
    other = [(k, rng.choice([v, v, v, v, v, v, "", None, "w"]), rng.choice([e, e, e, e, 0, None])) for k, v, e in base if rng.random() > 0.03]
    other += [(f"n{i}", "x", 0) for i in range(20)]
    a = base + [(None, "z", 1)] * 5 + rng.sample(base, 100) + [("k1", str(i), 0) for i in range(500)]
    b = other + rng.sample(other, 50)
    a, b = rows(a), rows(b)
    assert found(spark, a, b) == brute(a, b)


def test_everything_differs_and_empty_copies(spark):
    a = rows([(f"k{i}", "a", 0) for i in range(400)])
    b = rows([(f"k{i}", "b", 0) for i in range(400)])
    assert found(spark, a, b) == brute(a, b)
    assert found(spark, a, []) == brute(a, [])
    assert found(spark, [], []) == set()
    assert found(spark, a, a[::-1]) == set()


@pytest.mark.parametrize("differ", [500, 37])
def test_a_bucket_of_many_differences_is_split(spark, monkeypatch, differ):
    monkeypatch.setattr(reconcile, "ROWS_PER_BUCKET", 5000)  # all in one bucket
    turns = []
    split = reconcile._split
    monkeypatch.setattr(reconcile, "_split", lambda *x: turns.append(x[-1]) or split(*x))
    a = rows([(f"k{i}", "a", 0) for i in range(1200)])
    b = rows([(f"k{i}", "b" if i < differ else "a", 0) for i in range(1200)] + [("more", "x", 1)])
    assert found(spark, a, b) == brute(a, b)
    assert (max(turns) if turns else 0) >= (2 if differ == 500 else 1)


def test_points_of_another_turn():
    assert not set(field.points(66).tolist()) & set(field.points(66, 1).tolist())
