"""Min-cost flow against all whole-number flows of small cases."""

from itertools import product

import numpy as np
import pytest

from passagebase.llm import mixing


def price(used, size):
    """What `used` tokens of a pattern cost: its size once at 1, a second time at 3."""
    return min(used, size) + 3 * max(0, used - size)


def cheapest(capacity, quotas):
    """(most tokens, least cost for them) over all flows, pattern by pattern."""
    sources = list(quotas)
    best = {(0,) * len(sources): 0}
    for members, size in capacity.items():
        after = {}
        room = [range(2 * size + 1) if s in members else (0,) for s in sources]
        flows = [f for f in product(*room) if sum(f) <= 2 * size]
        for got, cost in best.items():
            for f in flows:
                now = tuple(a + b for a, b in zip(got, f, strict=True))
                if all(x <= quotas[s] for x, s in zip(now, sources, strict=True)):
                    after[now] = min(after.get(now, 1 << 30), cost + price(sum(f), size))
        best = after
    most = max(map(sum, best))
    return most, min(c for g, c in best.items() if sum(g) == most)


@pytest.mark.parametrize("seed", range(12))
def test_flow_costs_least(seed):
    r = np.random.default_rng(seed)
    patterns = [("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "b", "c")]
    capacity = {p: int(r.integers(1, 4)) for p in patterns if r.random() < 0.8} or {("a",): 2}
    quotas = {s: int(r.integers(0, 7)) for s in "abc"}
    flow = mixing.route(capacity, quotas)
    used = {p: sum(flow[p].values()) for p in capacity}
    assert all(set(f) <= set(p) for p, f in flow.items()) and all(used[p] <= 2 * n for p, n in capacity.items())
    assert all(sum(f.get(s, 0) for f in flow.values()) <= q for s, q in quotas.items())
    assert (sum(used.values()), sum(price(used[p], n) for p, n in capacity.items())) == cheapest(capacity, quotas)
