import os
import random
import re

import numpy as np
import pytest

from passagebase.llm import secrets


def test_keys_without_digits_and_joined_by_dots_are_candidates():
    text = "left here QwErTyUiOpAsDfGh alone, then abcde.fghij.klmno and short.one"
    assert [text[a:b] for a, b in secrets.candidates(text)] == ["QwErTyUiOpAsDfGh", "abcde.fghij.klmno"]


def test_threshold_keeps_the_wanted_recall():
    network = secrets.CharacterNetwork()
    z = np.concatenate([np.linspace(-3, 1, 100), np.linspace(-2, 2, 100)])
    network.logits = lambda x, counts: z
    y = np.repeat([0.0, 1.0], 100)
    views = [np.zeros((1, secrets.WINDOW), np.uint8)] * 200
    network.calibrate(views, y, 0.99)
    assert (network.probabilities(None, None)[y == 1] >= network.threshold).mean() >= 0.99


@pytest.mark.parametrize("size", [12, 24, 25, 40, 76, 77, 500])
def test_a_view_shows_the_whole_candidate_and_both_sides(size):
    """Pooling over a view's windows equals one convolution over all of its characters."""
    r = np.random.default_rng(size)
    value = "".join(r.choice(list("abcXYZ019+/"), size))
    text = f"é first words and key -> {value}\" and what follows it"
    start = text.index(value)
    x = np.frombuffer(secrets.view(text, start, start + size), np.uint8).reshape(-1, secrets.WINDOW)
    step = secrets.WINDOW - secrets.WIDTH + 1
    flat = np.concatenate([x[0], *(w[secrets.WIDTH - 1 :] for w in x[1:])])
    raw = text[start - secrets.BEFORE : start + size + secrets.AFTER].encode("ascii", "replace")
    want = secrets.character_classes()[np.frombuffer(raw, np.uint8)].copy()
    want[secrets.BEFORE : secrets.BEFORE + size] += 16
    assert flat[: len(want)].tolist() == want.tolist() and (flat[len(want) :] == 14).all() and len(flat) - len(want) < step
    network = secrets.CharacterNetwork()
    whole = network.bias + sum(network.kernel[k][flat[k : k + len(flat) - secrets.WIDTH + 1]] for k in range(secrets.WIDTH))
    logit = (np.maximum(whole.max(axis=0), 0) * network.out).sum() + network.shift[0]
    assert np.allclose(network.logits(x, np.array([len(x)])), logit)


def test_views_are_pooled_apart():
    text = "a " + "Q1w2E3r4T5y6" * 12 + " b " + "plainwordsonly" + " c"
    views = [np.frombuffer(secrets.view(text, *m.span()), np.uint8).reshape(-1, secrets.WINDOW) for m in re.finditer(r"\w{12,}", text)]
    network = secrets.CharacterNetwork()
    both = network.logits(*secrets.stacked(views))
    assert len(views[0]) > 1 and np.allclose(both, [network.logits(v, np.array([len(v)]))[0] for v in views])


def test_touched_is_the_plain_overlap():
    r = np.random.default_rng(5)
    for _ in range(200):
        base = sorted(((int(r.integers(3)), a, a + int(r.integers(1, 12))) for a in r.integers(0, 60, r.integers(0, 6)).tolist()), key=lambda s: (s[1], s[0]))
        spans = [(a, a + int(r.integers(1, 12))) for a in r.integers(0, 60, 8).tolist()]
        assert secrets.touched(base, spans) == [any(a < e and s < b for _, s, e in base) for a, b in spans]


TABLE = "/root/testdata/sf0.1/documents.parquet"


@pytest.mark.skipif(not os.path.exists(TABLE), reason="tables are not here")
def test_unmarked_keys_planted_in_given_texts_are_found(spark):
    """Keys of four alphabets in every tenth of 4,000 given texts: at least 85 of 100 found, next to nothing else reported."""
    r = random.Random(3)
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    forms = [(digits + "abcdef", 20, ""), (digits + "ABCDEF", 32, ""), (small + small.upper() + digits, 32, ""), (small + small.upper() + digits + "+/", 43, "=")]
    rows, want = [], {}
    for i, d in enumerate(spark.read.parquet(TABLE).orderBy("doc_id").limit(4000).select("doc_id", "text").collect()):
        text = d.text
        if i % 10 == 0:
            letters, n, end = forms[i // 10 % 4]
            key, words = "".join(r.choice(letters) for _ in range(n)) + end, text.split(" ")
            words.insert(r.randint(0, len(words)), key)
            text = " ".join(words)
            want[d.doc_id] = (i // 10 % 4, f"model:{text.index(key)}:{text.index(key) + len(key)}")
        rows.append((d.doc_id, text))
    found, others = [0] * 4, 0
    for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        model = [s for s in x.spans.split(",") if s.startswith("model")]
        form, span = want.get(x.doc_id, (0, None))
        found[form] += span in model
        others += len(model) - (span in model)
    assert sum(found) >= 0.85 * len(want) and min(found) >= 75 and others <= 4, (found, others)


def test_runs_that_change_often_are_no_examples():
    shapes = {"thisisaword": (0.0, 0), "ALLCAPITALS": (0.0, 1), "2669109448945250": (0.0, 2), "user.name12.example": (0.125, 0), "Qx3Z8vT1kLm0QT": (0.9, 1)}
    for run, (share, most) in shapes.items():
        text = f"left {run} right"
        x = np.frombuffer(secrets.view(text, 5, 5 + len(run)), np.uint8).reshape(-1, secrets.WINDOW)
        got = secrets.shape(secrets.characters(x))
        assert got[1] == most and (got[0] <= secrets.MIXED) == (share <= secrets.MIXED)


def labelled(n):
    """Rows with words, numbers and marked keys; one word and one marked value are far longer than 16 windows."""
    r = random.Random(7)
    letters, rows = "abcdefghijklmnopqrstuvwxyz", []
    for i in range(n):
        word, number = "".join(r.choice(letters) for _ in range(14)), r.randint(10**13, 10**14)
        key = "".join(r.choice("0123456789abcdef") for _ in range(40))
        rows.append((i, f"some {word} and {number} then {word.upper()} end" + (f" token={key}" if i % 3 == 0 else "")))
    return [*rows, (n, "a " + "w" * 3000 + " b"), (n + 1, "secret: " + "".join(r.choice(letters + "0123456789") for _ in range(3000)))]


def test_every_example_is_learned_from(spark):
    rows = labelled(60)
    found = secrets.findings(spark.createDataFrame(rows, "doc_id long, text string"))
    got = secrets.examples(found)
    want = set()
    for _, text in rows:
        base = secrets.base_spans(text)
        want |= {secrets.view(text, b - len(secrets.ASSIGN.match(text, a)[2]) if k == 0 else a, b) for k, a, b in base}
        want |= {secrets.view(text, a, b) for (a, b), c in zip(secrets.candidates(text), secrets.touched(base, secrets.candidates(text)), strict=True) if not c}
    assert sorted(bytes(x.view) for x in got.collect()) == sorted(want) and max(map(len, want)) > 50 * secrets.WINDOW
    counts = {x.label: x["count"] for x in got.groupBy("label").count().collect()}
    dealt = secrets.deal(got, counts, 3, 4).collect()
    assert {bytes(x.view) for x in dealt} == want
    assert {(x.part, x.round, x.label) for x in dealt} == {(p, r, k) for p in range(3) for r in range(4) for k in counts}


def test_batches_go_through_all_views():
    kinds = [[np.full((1 + i % 2, secrets.WINDOW), 16 + k, np.uint8) for i in range(n)] for k, n in enumerate((700, 3, 0, 90))]
    for v in (x for k in kinds for x in k):
        v[:, -20:] = 14
    seen = set()
    for views, bare, want, weight in secrets.batches_of(kinds, 2, np.random.default_rng(1)):
        assert len(views) == len(bare) == len(want) and abs(weight.sum() - 1) < 1e-9 and abs(weight[want == 1].sum() - 0.5) < 1e-9
        seen |= set(map(id, views))
    assert {id(v) for v in kinds[0] + kinds[1]} <= seen


def test_training_in_several_parts_finds_keys(spark, monkeypatch):
    for name, value in (("PART", 300), ("ROUNDS", 2), ("STEPS", 300)):
        monkeypatch.setattr(secrets, name, value)
    rows = labelled(150) + [(1000 + i, f"left QzX9{i}8vT1kLm0QTb7Rw2Yp right") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.spans for x in secrets.scan(docs).collect()}
    assert got == {x.doc_id: x.spans for x in secrets.scan(docs.repartition(5)).collect()}
    assert all("model" in got[1000 + i] for i in range(9)) and not any("model" in s for i, s in got.items() if i < 1000)
