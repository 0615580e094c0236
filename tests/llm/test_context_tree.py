"""The context tree against a plain program that walks one context at a time."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from passagebase.llm import context_tree
from passagebase.llm.common import word_parts

DDL = "doc_id long, text string, score string, gram string, n string, row string"
DEPTH = context_tree.DEPTH


def coded(text):
    return b"".join(w.lower() + b" " for w in text.encode().split()) + b"\n"


def steps(text):
    """(context of DEPTH bytes, bits so far with a leading one, next bit) of each decision."""
    raw = b"\n" * DEPTH + coded(text)
    for i in range(DEPTH, len(raw)):
        node = 1
        for k in range(7, -1, -1):
            bit = raw[i] >> k & 1
            yield raw[i - DEPTH : i], node, bit
            node = node * 2 + bit


def plain_scores(rows):
    seen, below = defaultdict(lambda: [0, 0]), defaultdict(set)
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            for context, node, bit in steps(t or ""):
                for d in range(DEPTH + 1):
                    own = context[DEPTH - d :]
                    seen[own, node][bit] += 1
                    if d:
                        below[own[1:], node].add(own)

    def estimated(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    known = {}

    def mixed(context, node):
        """(log probability of all decisions seen here, weight of the own estimate)."""
        if (context, node) not in known:
            own = estimated(*seen[context, node])
            if len(context) == DEPTH:
                known[context, node] = own, 1.0
            else:
                deeper = sum(mixed(c, node)[0] for c in below[context, node])
                both = np.logaddexp(own, deeper) - math.log(2)
                known[context, node] = both, math.exp(own - math.log(2) - both)
        return known[context, node]

    def chance(context, node, d=0):
        own = context[DEPTH - d :]
        if (own, node) not in seen:
            return None
        z, o = seen[own, node]
        here, deeper = (o + 0.5) / (z + o + 1), chance(context, node, d + 1) if d < DEPTH else None
        w = mixed(own, node)[1]
        return here if deeper is None else w * here + (1 - w) * deeper

    out = []
    for i, t in rows:
        total = 0.0
        for context, node, bit in steps(t or ""):
            p = chance(context, node)
            p = 0.5 if p is None else p
            total += math.log10(p if bit else 1 - p)
        out.append((str(i), round(total, 2)))
    return sorted(out)


def table():
    r = np.random.default_rng(3)
    syllables = ["the", "an", "er", "in", "ß", "été", "q"]
    rows = [(i, " ".join("".join(r.choice(syllables, r.integers(1, 4))) for _ in range(r.integers(1, 30)))) for i in range(40)]
    return [*rows, (None, "no id"), (50, None), (51, ""), (52, " \t\n"), (53, "THE an\tthe\x0ban"), (53, "THE an\tthe\x0ban"), (54, "unseen ЖЖ 汉字")]


@pytest.mark.parametrize("at_once", [context_tree.CELLS_AT_ONCE, 150])
def test_scores_against_the_plain_program(spark, monkeypatch, at_once):
    monkeypatch.setattr(context_tree, "_TOGETHER", 40)
    monkeypatch.setattr(context_tree, "_PIECE", 64)
    rows = table()
    docs = spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in rows], DDL)
    got = context_tree.score_texts(docs, cells_at_once=at_once).collect()
    want = plain_scores(rows)
    for (i, s), (j, t) in zip(sorted((str(r.doc_id), r.score) for r in got), want, strict=True):
        assert i == j and s == pytest.approx(t, abs=0.02)


def test_long_texts_are_coded_alike_in_parts(monkeypatch):
    text = b"  Some words and a_very_long_word_here \t\n then more\x0c"
    for size in (1, 7, 1000):
        assert b"".join(word_parts(text, size)) == text
        monkeypatch.setattr(context_tree, "word_parts", lambda x, size=size: word_parts(x, size))
        parts = list(context_tree.buffers(text))
        assert b"".join(p[DEPTH:] for p in parts) == coded(text.decode())
        whole = context_tree.grams([b"\n" * DEPTH + coded(text.decode())])
        assert np.array_equal(context_tree.grams(parts), whole)


def test_order_of_words_counts_and_unseen_training_is_even(spark):
    rows = [(i, "one two three four " * 5) for i in range(30)]
    docs = spark.createDataFrame([*rows, (100, "one two three four"), (101, "four three two one")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in context_tree.score_texts(docs).collect()}
    assert got[100] > got[101]
    none = context_tree.score_texts(docs.where("false").unionByName(spark.createDataFrame([(None, "ab")], "doc_id long, text string"))).first()
    assert none.score == pytest.approx(8 * 4 * math.log10(0.5)) and none.train_tokens == 0


def test_log_gamma():
    assert np.allclose(context_tree.log_gamma(np.array([0.5, 1.5, 40.0])), [math.lgamma(x) for x in (0.5, 1.5, 40.0)])
