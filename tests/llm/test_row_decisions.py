"""Stages decide rows, not ids: null ids and one id with several texts."""

from collections import Counter

import corpus_pipeline as P

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def run(spark, stage, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DDL)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    return Counter((r.doc_id, r.text) for r in out.collect())


def test_exact_copies(spark):
    rows = [(7, "a"), (7, "b"), (9, "B"), (None, "a"), (None, "own"), (None, "pair"), (None, "PAIR"), (4, "Case"), (4, "cASE"), (4, "other")]
    got = run(spark, P.exact_copies, rows)
    assert {(7, "a"), (9, "B"), (None, "own"), (4, "other")} <= set(got)
    assert sum(got.values()) == 6 and sum(n for (_, t), n in got.items() if t.lower() in ("pair", "case")) == 2


def test_language(spark):
    rows = [(1, "some words here"), (1, "12 34"), (None, None), (None, "more words there"), (None, "!!"), (2, "")]
    assert run(spark, P.language, rows) == Counter({(1, "some words here"): 1, (None, "more words there"): 1})


def test_near_copies(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(7, text("a")), (7, text("b")), (3, text("b") + " tail"), (None, text("c")), (None, text("a") + " tail"), (5, text("d"))]
    assert run(spark, P.near_copies, rows) == Counter({(7, text("a")): 1, (3, text("b") + " tail"): 1, (None, text("c")): 1, (5, text("d")): 1})
