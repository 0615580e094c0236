import numpy as np
import pytest

from passagebase.llm.near_dedup import Forest, ring_links, segments, simhash_bytes


def brute_components(fps, max_bits):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            low = min(label[j] for j in np.flatnonzero(near[i]))
            if low < label[i]:
                label[i], changed = low, True
    return label


@pytest.mark.parametrize("max_bits", [0, 3, 4, 7])
@pytest.mark.parametrize("ball", [0, 300])
def test_ring_links_connect_what_brute_force_connects(max_bits, ball):
    r = np.random.default_rng(max_bits + ball)
    centres = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [c ^ np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(0, max_bits + 3), replace=False))) for c in centres for _ in range(6)]
    fps += [centres[0] ^ np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(0, 6), replace=False))) for _ in range(ball)]
    fps = np.unique(np.array(fps, dtype=np.uint64))
    forest = Forest(len(fps))
    for seg, (shift, width) in enumerate(segments(max_bits)):
        group = ((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1 if width < 64 else 2**64 - 1)).view(np.int64)
        for a, b in ring_links(fps, group, seg, max_bits):
            assert int(fps[a] ^ fps[b]).bit_count() <= max_bits
            forest.link(int(a), int(b))
    assert [forest.find(i) for i in range(len(fps))] == brute_components(fps, max_bits)


def test_simhash_cases():
    assert simhash_bytes(b"") == simhash_bytes(b" \t\n\x0b\x0c\r") == 0
    assert simhash_bytes(b"One two") == simhash_bytes(b"  one\nTWO ")
    assert simhash_bytes(b"a b c d e") != simhash_bytes(b"a b c d f")
