"""Language proportions against a plain expectation-maximisation and a plain choice of the language set."""

import math

import numpy as np
import pytest

from passagebase.llm import language_id


def plain(table, grams, steps=12):
    def fit(which):
        share = [1.0 / len(which)] * len(which)
        if len(which) > 1:
            for _ in range(steps):
                total = [0.0] * len(which)
                for g in grams:
                    p = [float(table[g, k]) * s for k, s in zip(which, share, strict=True)]
                    for i, x in enumerate(p):
                        total[i] += x / sum(p)
                share = [t / sum(total) for t in total]
        return share, sum(math.log(sum(float(table[g, k]) * s for k, s in zip(which, share, strict=True))) for g in grams) / language_id.OVERLAP

    full, _ = fit(list(range(table.shape[1])))
    order = sorted(range(len(full)), key=lambda k: (-full[k], k))
    chosen = order[:1]
    share, likelihood = fit(chosen)
    for k in range(2, len(order) + 1):
        more, gained = fit(order[:k])
        if gained - likelihood <= 0.5 * math.log(len(grams)) + 0.01 * len(grams) / language_id.OVERLAP:
            break
        chosen, share, likelihood = order[:k], more, gained
    best = max(range(len(chosen)), key=lambda i: (share[i], -chosen[i]))
    return chosen[best], share[best]


@pytest.mark.parametrize("seed", range(8))
def test_inference_equals_the_plain_one(seed):
    r = np.random.default_rng(seed)
    table = (r.dirichlet(np.full(60, 0.3), 4).T + 1e-4).astype(np.float32)
    parts = r.multinomial(300, r.dirichlet(np.full(4, 0.5)))
    grams = np.concatenate([r.choice(60, n, p=table[:, k].astype(float) / table[:, k].astype(float).sum()) for k, n in enumerate(parts)]).astype(np.int64)
    lang, share = language_id.infer(table, grams)
    want, part = plain(table, grams.tolist())
    assert lang == want and share == pytest.approx(part, abs=1e-6)
