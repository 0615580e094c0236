import numpy as np
import pytest
from pyspark.sql import functions as F

from passagebase.llm import queries, topk
from passagebase.llm.near_dedup import simhash_bytes


@pytest.mark.parametrize("n", [3, 500, 30_000])
def test_multi_index_against_brute_force(n):
    r = np.random.default_rng(n)
    codes = r.integers(0, 1 << 64, n, dtype=np.uint64)
    codes[n // 2 :] = codes[: n - n // 2] ^ np.uint64(5)
    codes[: n // 10] = codes[0]
    asked = np.concatenate([codes[:: max(1, n // 40)], r.integers(0, 1 << 64, 20, dtype=np.uint64)])
    query, row, distance = topk.MultiIndex(codes).search(asked, 10)
    want = []
    for i, q in enumerate(asked):
        d = np.bitwise_count(codes ^ q).astype(int)
        want += [(i, j, d[j]) for j in np.lexsort((np.arange(n), d))[:10]]
    assert list(zip(query.tolist(), row.tolist(), distance.tolist(), strict=True)) == want


@pytest.mark.parametrize("block_rows", [1000, 100])
def test_top_k_against_brute_force(spark, block_rows):
    r = np.random.default_rng(9)
    vocabulary = ["".join(r.choice(list("abcdefgh"), 4)) for _ in range(60)]
    rows = [(i, " ".join(r.choice(vocabulary, 5 + i % 30))) for i in range(300)]
    rows += [(400 + i, rows[50][1]) for i in range(15)] + [(None, rows[100][1]), (None, None), (500, ""), (500, ""), (550, rows[7][1] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("clash"))
    fps = [simhash_bytes((t or "").encode()) for _, t in rows]
    want = []
    for q, (i, _) in enumerate(rows):
        if i is not None and i % 50 == 0:
            near = sorted(((fp ^ fps[q]).bit_count(), j is None, j or 0) for (j, _), fp in zip(rows, fps, strict=True))[:10]
            want += [(i, k + 1, None if none else j, d) for k, (d, none, j) in enumerate(near)]
    got = topk.top_k(docs, block_rows=block_rows, slices=3).collect()
    assert sorted(map(str, ((x.query_id, x.rank, x.doc_id, x.distance) for x in got))) == sorted(map(str, want))
    assert topk.top_k(docs.limit(0)).collect() == [] and "op4_hamming_top_k" in queries.queries()
