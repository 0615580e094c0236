from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from passagebase.llm import near_copies as near

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DDL)


def jaccard(a, b):
    x, y = (set(near.shingles((t or "").encode()).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def brute_stay(rows):
    sets = [set(near.shingles((t or "").encode()).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    first = {}
    for (i, t), x in zip(rows, label, strict=True):
        k = (i is None, i or 0, t or "")
        first[x] = min(first.get(x, k), k)
    return Counter(map(str, ((None if none else i, t) for none, i, t in first.values())))


def planted(seed, groups=120):
    """Texts and copies with words replaced, of similarities from about 0.7 to 0.95."""
    r = np.random.default_rng(seed)
    vocabulary = ["".join(r.choice(list("abcdefghijklmnop"), 5)) for _ in range(900)]
    rows = []
    for g in range(groups):
        words = list(r.choice(vocabulary, 150 + 3 * g))
        rows.append((2 * g, " ".join(words)))
        for at in r.choice(len(words), int(len(words) * 0.005 * (1 + g % 7)), replace=False):
            words[at] = "new" + words[at]
        rows.append((2 * g + 1, " ".join(words)))
    return rows


def test_copies_between_08_and_09_go_and_others_stay(spark):
    rows = planted(1)
    near_08 = [jaccard(a[1], b[1]) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert sum(0.8 <= s < 0.9 for s in near_08) > 20 and sum(s < 0.8 for s in near_08) > 10
    out = P.near_copies(spark, frame(spark, rows), "")
    assert Counter(str((x.doc_id, x.text)) for x in out.collect()) == brute_stay(rows)


@pytest.mark.parametrize("blocks", [32 << 20, 20_000])
def test_large_groups_and_rows_decided_one_by_one(spark, monkeypatch, blocks):
    monkeypatch.setattr(near, "BLOCK_BYTES", blocks)
    monkeypatch.setattr(near, "BLOCK_ROWS", 7)
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):  # each copy is a step away from the one before it: the ends are far apart
        words = list(words)
        words[int(r.integers(0, 200))] = f"x{i}"
        rows.append((1000 - i, " ".join(words)))
    other = [" ".join(r.choice(words, 80)) for _ in range(4)]
    rows += [(None, rows[0][1] + " tail"), (None, other[0]), (None, other[1]), (1000, other[2]), (3000, other[3])]
    out = P.near_copies(spark, frame(spark, rows), "")
    got = Counter(str((x.doc_id, x.text)) for x in out.collect())
    assert got == brute_stay(rows) and sum(got.values()) == 5


def test_ring_filter_equals_the_full_check():
    from passagebase.llm.near_dedup import ring_close, ring_distances, wide_simhash

    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([r.choice(base, 300 - k, replace=False), r.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in range(0, 120, 2)]
    rings = np.stack([wide_simhash(s, near.RING_WORDS) for s in sets])
    for one in rings:
        d = ring_distances(one, rings)
        assert (ring_close(one, rings, near.RING_BITS) == (d <= near.RING_BITS)).all()
    assert len({bool(x) for x in ring_close(rings[0], rings, near.RING_BITS)}) == 2


def test_two_cliques_that_meet_in_other_groups(spark):
    """A chain of groups of near copies whose members share different keys is one component."""
    r = np.random.default_rng(9)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(250):
        own = list(words)
        for at in r.choice(150, 5, replace=False):
            own[at] = f"v{i}x{at}"
        rows.append((i, " ".join(own)))
    out = P.near_copies(spark, frame(spark, rows), "")
    assert Counter(str((x.doc_id, x.text)) for x in out.collect()) == brute_stay(rows)


def test_segment_keys_equal_a_plain_count():
    """Fingerprint bits, surest bits and keys against plain Python over the mixed hashes."""
    from passagebase.llm.near_dedup import _mixers, bit_sums, majority_words, wide_simhash

    hashes = near.shingles(" ".join(f"w{i % 333}" for i in range(700)).encode())
    segments, mask = 5, (1 << 64) - 1
    counts = np.zeros((segments, 64), dtype=int)
    for h in hashes.tolist():
        for i, (one, two) in enumerate(_mixers(segments).tolist()):
            x = h * one & mask
            x = (x ^ (x >> 29)) * two & mask
            x ^= x >> 32
            counts[i] += [(x >> b) & 1 for b in range(64)]
    sums = bit_sums(hashes, segments)
    assert sums.tolist() == counts.ravel().tolist()
    words = [sum(1 << b for b in range(64) if 2 * c[b] > len(hashes)) for c in counts]
    assert majority_words(sums, len(hashes)).tolist() == words
    assert wide_simhash(hashes, 2).tolist() == words[:2]
    symbols = []
    for c in counts.tolist():
        best = max(range(64), key=lambda b: (abs(2 * c[b] - len(hashes)), -b))
        symbols.append(2 * best + (2 * c[best] > len(hashes)))
    for span in (2, 3):
        expect = []
        for i in range(segments):
            k = i
            for j in range(span):
                k = k * 128 + symbols[(i + j) % segments]
            expect.append(k)
        assert near.segment_keys(sums, len(hashes), span).tolist() == expect


@pytest.mark.parametrize("plan", [p[1:] for p in near.KEY_PLANS])
def test_sets_at_08_meet_in_segments_and_pass_the_chain(plan):
    segments, span = plan
    r, met, pairs = np.random.default_rng(3), 0, 300
    for k in range(pairs):
        n = 30 + k
        common = int(np.ceil(2 * n * 0.8 / 1.8))
        base = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        sums = [near.bit_sums(s, segments) for s in (base[:n], np.concatenate([base[:common], base[n : 2 * n - common]]))]
        same = np.equal(*(near.segment_keys(s, n, span) for s in sums))
        differ = np.bitwise_count(np.bitwise_xor(*(near.majority_words(s, n) for s in sums))).astype(int)
        met += bool((same & (differ <= near.CHAIN_BITS) & (differ + np.roll(differ, -1) <= 2 * near.CHAIN_BITS)).any())
    assert met >= pairs - 2


def test_chain_partners_equal_all_pairs():
    r = np.random.default_rng(6)
    group = np.sort(r.integers(0, 12, 400) ** 2 // 9)
    n = r.integers(10, 60, 400)
    n = n[np.lexsort((n, group))]
    base = r.integers(0, 1 << 63, 3)
    one, two = (base[r.integers(0, 3, 400)] ^ np.array([sum(1 << int(b) for b in r.choice(63, k, replace=False)) for k in r.integers(0, 16, 400)]) for _ in range(2))
    plain = np.zeros(400, dtype=bool)
    for i in range(400):
        for j in range(400):
            if i != j and group[i] == group[j] and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) - 1e-6:
                a, b = (bin(int(x[i] ^ x[j])).count("1") for x in (one, two))
                plain[i] |= min(n[i], n[j]) < near.RING_LEAST or (a <= near.CHAIN_BITS and a + b <= 2 * near.CHAIN_BITS)
    dense = np.unique(group, return_inverse=True)[1]
    assert (near.chain_partners(dense, n, one, two, 0.8) == plain).all() and 0 < plain.sum() < 400


def test_small_sets_meet_at_their_least_hashes(spark):
    """Texts of 1 to 18 shingles, their similar partners beside them, among larger ones."""
    r = np.random.default_rng(8)
    rows = []
    for g in range(150):
        words = [f"v{r.integers(0, 10**9)}" for _ in range(5 + g % 20)]
        rows += [(3 * g, " ".join(words)), (3 * g + 1, " ".join([*words, "tail"])), (3 * g + 2, " ".join(words[1:] + ["other", "end"]))]
    out = P.near_copies(spark, frame(spark, rows), "")
    stay = brute_stay(rows)
    assert Counter(str((x.doc_id, x.text)) for x in out.collect()) == stay and len(stay) < 350


def test_keys_of_three_segments(spark, monkeypatch):
    monkeypatch.setattr(near, "KEY_PLANS", [(100, 56, 2), (None, 144, 3)])
    monkeypatch.setattr(near, "BLOCK_ROWS", 3)
    monkeypatch.setattr(near, "_HELD", 5)
    rows = planted(5, 60)
    out = P.near_copies(spark, frame(spark, rows + rows[:9]), "")
    stay = brute_stay(rows + rows[:9])
    assert set(map(str, ((x.doc_id, x.text) for x in out.collect()))) == set(stay)
