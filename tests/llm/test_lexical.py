"""Ranked search against scores of all pairs."""

import math
import random
import re
from collections import Counter

import pytest

from passagebase.llm import lexical as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    counts = [Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in counts]
    big_n, big_l = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for at, (doc, _) in enumerate(docs):
            score = 0
            for t, times in Counter(terms(text)).items():
                if tf := counts[at][t]:
                    m = 100 - 75 + (75 * n[at] * big_n) // big_l
                    score += times * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if none else doc, -s) for i, (s, none, doc) in enumerate(sorted(found)[:k])]
    return sorted(map(repr, out))


def rows(got):
    return sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in got.collect())


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, query int").repartition(3)
    return d, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc string")


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(150)] + ["the"] * 60 + ["Größe", "语", "A1"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    docs += docs[:9] + [(None, docs[3][1]), (n, None), (n + 1, ""), (n + 2, "the " * 30_000), (n + 3, "-- !!"), (5, "other text w1")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))) for i in range(12)]
    items += [(50, docs[7][1]), (51, "the the THE"), (52, None), (53, "?"), (54, "nowhere"), (None, "w3 w4 w3"), (1, "w9")]
    return docs, items


@pytest.mark.parametrize(("seed", "k", "bucket", "vocabulary", "together"), [(1, 10, 1 << 20, 1 << 20, 512), (2, 3, 7, 1 << 20, 512), (3, 4, 50, 0, 20)])
def test_same_as_all_pairs(spark, seed, k, bucket, vocabulary, together):
    """Many buckets; a vocabulary that is joined; queries in turns."""
    docs, items = corpus(seed)
    got = X.rank_documents(*frames(spark, docs, items), k=k, bucket=bucket, vocabulary=vocabulary, together=together)
    assert rows(got) == brute(docs, items, k)


def test_empty_tables(spark):
    d, i = frames(spark, [(1, "one two"), (2, "two")], [(1, "one")])
    assert X.rank_documents(d.where("doc_id > 9"), i).count() == 0
    assert X.rank_documents(d, i.where("item_id > 9")).count() == 0
    assert rows(X.rank_documents(d, i)) == brute([(1, "one two"), (2, "two")], [(1, "one")], 10)


def test_terms():
    for text in ("Ab-cd_9é語 x\x7fy\n\x85z", "", "ÀÉ [\\]^`{|}~", "İstanbul ẞ"):
        assert [t.decode() for t in X.terms_of(text.encode())] == terms(text)
