"""The pipeline's stages against brute force on a small corpus: each is judged on what it was given."""

import importlib.util
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P

needs_tokenizers = pytest.mark.skipif(importlib.util.find_spec("public_tokenizers") is None, reason="no tokenizer files here")
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = np.random.default_rng(11)
    vocabulary = ["".join(r.choice(list("abcdefghijklmnop"), 5)) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary, n))
    rows = [(i, text(60 + i % 50), "en" if i % 2 else "de", f"s{i % 3}") for i in range(80)]
    rows += [(100 + i, rows[i][1].upper(), "en", "s1") for i in range(10)]  # exact copies
    rows += [(200 + i, rows[20 + i][1] + " tail", "en", "s2") for i in range(10)]  # near copies
    rows += [(300, None, "en", "s0"), (301, "", None, None), (302, "12 34 !!", "de", "s1"), (303, rows[5][1], "en", "s0"), (303, rows[5][1], "en", "s0")]
    return [(i, t, g, s, len(t or "")) for i, t, g, s in rows]


def near_groups(rows):
    """Documents that stay by the stage's own rule: five-word shingle sets with a similarity of 0.8 or more are linked."""

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for _, t, *_ in rows]
    label = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return set(label)


@needs_tokenizers
def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), DDL)
    seen = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = [tuple(r) for r in docs.collect()]
    assert Counter(seen["language"]) == Counter(r for r in corpus() if r[1] and any(c.isalpha() for c in r[1]))
    best = {}
    for r in seen["language"]:
        best[r[1].lower()] = max(best.get(r[1].lower(), -1), r[0])
    assert sorted(r[0] for r in seen["exact_copies"]) == sorted(best.values())
    assert {r[0] for r in seen["near_copies"]} == near_groups(seen["exact_copies"]) and len(seen["near_copies"]) == len({r[0] for r in seen["near_copies"]})
    times = Counter(seen["mixture"])
    assert set(times) <= set(seen["near_copies"]) and max(times.values()) <= 2
    words = sum(len(r[1].split()) for r in seen["near_copies"])
    assert sum(len(r[1].split()) for r in seen["mixture"]) == pytest.approx(1.5 * words, rel=0.05)
    whole = {r[0]: r[4] for r in seen["packing"]}
    tokens = Counter()
    for r in seen["packing"]:
        tokens[r[0]] += r[2]
    copies = Counter(r[0] for r in seen["mixture"])
    assert tokens == Counter({i: whole[i] * n for i, n in copies.items()})


@needs_tokenizers
def test_stages_on_an_empty_table_and_with_clashing_columns(spark):
    extra = ["sha", "node", "root", "key", "pattern", "order", "size", "kept", "fp", "uid", "tail", "score"]
    rows = [(*r, *["clash"] * len(extra)) for r in corpus()[:12]] + [(None, "no id here at all", "en", None, 3, *["clash"] * len(extra))]
    docs = spark.createDataFrame(rows, f"{DDL}, " + ", ".join(f"{c} string" for c in extra))
    for name, stage in P.STAGES:
        assert stage(spark, docs.where("false"), "").count() == 0
        got = stage(spark, docs, "")
        if name != "packing":
            assert got.columns == docs.columns and {r.sha for r in got.collect()} <= {"clash"}
        assert got.where("doc_id is null").count() >= (name != "mixture")
