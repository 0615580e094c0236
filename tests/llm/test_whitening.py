"""Whitening against fractions and numpy."""

from fractions import Fraction

import numpy as np
import pytest

from passagebase.llm import whitening as W

DDL = "vec_id long, embedding array<float>, component string, n string"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], v, "x", "y") for i, v in enumerate(vectors)], DDL).repartition(3)


def whole(x):
    n, s = len(x), [int(v) for v in x.sum(axis=0)]
    return n, s, [sum((n * int(a) - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]


def test_against_fractions_and_numpy(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(150, 10)) * np.linspace(3, 0.2, 10)).astype(np.float32)
    got = W.whiten(frame(spark, vectors.tolist())).collect()
    x = np.floor(1024 * vectors.astype(np.float64)).astype(np.int64) + 100_000
    n, s, deviations = whole(x)
    exact = [[Fraction(sum((n * int(r[i]) - s[i]) * (n * int(r[j]) - s[j]) for r in x), n**3) for j in range(10)] for i in range(10)]
    v = np.array(exact, dtype=float)
    values, vecs = np.linalg.eigh(v)
    values, vecs = values[::-1], vecs[:, ::-1]
    assert len(got) == 150 * 8
    for r in got:
        k = r["component"] - 1
        assert (r["n"], r["deviation"], r["deviation_text"]) == (n, deviations[r["vec_id"]], str(deviations[r["vec_id"]]))
        assert r["explained"] == pytest.approx(values[k] / np.trace(v), rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(abs((x[r["vec_id"]] - np.array(s) / n) @ vecs[:, k]) / np.sqrt(values[k]), abs=1e-8)
        assert r["identity_error"] < 1e-9


def test_rows_that_do_not_count(spark):
    good = [[1.0, 2.0], [2.0, 0.5], [-3.0, 0.25], [-3.0, 0.25]]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0]]
    got = W.whiten(frame(spark, good + bad, ids=[7, None, 9, 9, 1, 2, 3, 4, 5, 6])).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == [("7", 1), ("7", 2), ("9", 1), ("9", 1), ("9", 2), ("9", 2), ("None", 1), ("None", 2)]
    assert {r["n"] for r in got} == {4} and got[0]["identity_error"] < 1e-9


def test_empty_table_and_one_row(spark):
    assert W.whiten(frame(spark, [[1.0, 2.0]]).where("vec_id > 5")).count() == 0
    assert W.whiten(frame(spark, [[1.0, 2.0]]).where("vec_id > 5")).columns == W.whiten(frame(spark, [[1.0, 2.0]])).columns
    one = W.whiten(frame(spark, [[1.0, 2.0]])).collect()
    assert [(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in one] == [(0.0, 0.0, 0, 1.0)] * 2


def test_limbs_put_together_give_the_number():
    rng = np.random.default_rng(2)
    for y in (rng.integers(-(1 << 62), 1 << 62, (40, 5)), np.array([[0, -1, 2047, -2048, 2048]]), np.array([[1 << 90, -(1 << 90) - 3, 5, 0, -1]], dtype=object)):
        back = sum(part.astype(np.int64).astype(object) << (W.LIMB_BITS * i) for i, part in enumerate(W.limbs(y)))
        assert (back == y.astype(object)).all()


def test_products_are_exact_over_folds_and_beyond_a_long():
    rng = np.random.default_rng(3)
    for y in (rng.integers(-(1 << 40), 1 << 40, (50, 4)), rng.integers(-(1 << 62), 1 << 62, (50, 4)).astype(object) * 12345):
        made = W.Products(4, fold_rows=16)
        for at in range(0, 50, 7):
            made.add(y[at : at + 7])
        made.fold()
        assert (made.total == y.astype(object).T.dot(y.astype(object))).all()


def test_large_entries_go_beyond_a_long(spark):
    vectors = [[1e30, 1.0], [-1e30, 2.0], [3.0, 4.0]]
    got = {r["vec_id"]: r for r in W.whiten(frame(spark, vectors)).where("component = 1").collect()}
    x = np.array([[(1 << 52) + 100_000, 1024 + 100_000], [-(1 << 52) + 100_000, 2048 + 100_000], [3 * 1024 + 100_000, 4096 + 100_000]], dtype=object)
    _, _, deviations = whole(x)
    assert [got[i]["deviation_text"] for i in range(3)] == [str(d) for d in deviations]
    assert got[0]["deviation"] is None and got[2]["deviation"] == deviations[2]


def test_digits():
    for value in (0, 5, -5, (1 << 30) - 1, -(1 << 95) + 7):
        assert sum(p << (W.DIGIT_BITS * d) for _, d, p in W.digits([value])) == value
