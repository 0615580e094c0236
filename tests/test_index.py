"""The index in bucket folders: appended, compacted, read in part, cleaned of scopes; streams into and over it."""

import glob
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagebase.functions import text as T
from passagebase.operators import models
from passagebase.operators import retrieval as R
from passagebase.operators import sessions as O
from passagebase.operators import vectors as V
from passagebase.sources import index as X
from passagebase.streaming import ingest

ROWS = [(f"s{i % 5}", i, f"word{i % 3} common text number {i} word{i % 3}") for i in range(40)] + [("s0", 100, ""), ("s1", 101, "Common")]


def passages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "scope string, chunk_id long, text string")


def tables(index):
    """Rows of every table; means are sums in any order, so they are rounded."""
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    return {k: sorted(repr([plain(x) for x in r]) for r in v.select(*sorted(v.columns)).collect()) for k, v in index.items()}


def names(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/**/part-*", recursive=True)}


def test_batches_and_compaction_equal_a_rebuild(spark, tmp_path):
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    X.append(passages(spark), one)
    for i in range(4):
        X.append(passages(spark, ROWS[i::4]), many, i)
    want = tables(X.read(spark, one))
    assert tables(X.read(spark, many)) == want
    for upto in (1, 2, 2):
        X.compact(spark, many, upto)
        assert tables(X.read(spark, many)) == want
    X.append(passages(spark, ROWS[3::4]), many, 3)  # again: replaced, not added
    assert tables(X.read(spark, many)) == want
    assert not [n for n in names(many) if n.startswith("term_counts/") and "batch=3" not in n]


def test_postings_and_lengths(spark, tmp_path):
    X.append(passages(spark), str(tmp_path))
    index = X.read(spark, str(tmp_path))
    assert sorted(map(tuple, index["postings"].where("chunk_id = 4").select("term", "tf", "dl").collect())) == [("4", 1, 6), ("common", 1, 6), ("number", 1, 6), ("text", 1, 6), ("word1", 2, 6)]
    assert {r.chunk_id: r.dl for r in index["doc_len"].collect()}[100] == 0
    assert {r.scope: (r.n, round(r.avgdl, 6)) for r in index["scope_stats"].collect()}["s0"] == (9, round(48 / 9, 6))


def test_a_scoped_question_reads_its_buckets_only(spark, tmp_path):
    X.append(passages(spark), str(tmp_path))
    asked = spark.createDataFrame([("s3",)], "scope string")
    index = X.read(spark, str(tmp_path), asked)
    bucket = X.asked_buckets(asked)
    assert len(bucket) == 1
    for name in ("postings", "chunks", "term_stats", "scope_stats"):
        plan = index[name]._jdf.queryExecution().executedPlan().toString()
        scans = re.findall(r"PartitionFilters: \[([^\]]*)", plan)
        assert scans and all(re.search(rf"bucket#\d+ = {bucket[0]}\)", x) for x in scans), (name, scans)
    assert {r.scope for r in index["chunks"].select("scope").distinct().collect()} >= {"s3"}


def test_expired_scopes_leave_every_table_and_no_other_file_changes(spark, tmp_path):
    path = str(tmp_path)
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for _, i, _ in ROWS], "chunk_id long, vec array<double>")
    X.append(passages(spark, ROWS[::2]), path, 0, vectors=vectors)
    X.append(passages(spark, ROWS[1::2]), path, 1, vectors=vectors)
    X.compact(spark, path, 0)
    before = names(path)
    kept = spark.createDataFrame([("s0",), ("s2",), ("s4",)], "session_id string")
    gone = O.expired(passages(spark), kept)
    buckets = X.asked_buckets(gone)
    mine = {r.bucket for r in kept.select(X.bucket_of("session_id").alias("bucket")).collect()}
    X.drop_scopes(spark, path, gone)
    index = X.read(spark, path)
    for name in index:
        assert {r.scope for r in index[name].select("scope").distinct().collect()} == {"s0", "s2", "s4"}, name
    own = lambda files: {f for f in files if not any(f"bucket={b}/" in f for b in buckets)}
    assert own(before) == own(names(path))
    assert not any(f"bucket={b}/" in f for f in names(path) for b in set(buckets) - mine)
    want = [r for r in ROWS if r[0] in ("s0", "s2", "s4")]
    X.append(passages(spark, want), path + "/again", vectors=vectors)
    assert tables(X.read(spark, path)) == tables(X.read(spark, path + "/again"))
    X.drop_scopes(spark, path, gone)  # nothing left to do


def test_a_text_goes_to_the_model_once(spark, tmp_path):
    told = spark.sparkContext.accumulator(0)

    def model(texts):
        told.add(len(texts))
        return models.hashing_embedder(texts, 16)

    rows = [("a", 1, "one text"), ("a", 2, "one text"), ("b", 3, "one text"), ("b", 4, "another text")]
    X.append(passages(spark, rows), str(tmp_path), 0, model=model)
    assert told.value == 2
    X.append(passages(spark, [("c", 5, "one text"), ("c", 6, "another text")]), str(tmp_path), 1, model=model)
    assert told.value == 2
    X.append(passages(spark, [("c", 7, "a third text")]), str(tmp_path), 2, model=model)
    assert told.value == 3
    found = {r.chunk_id: r.vec for r in X.read(spark, str(tmp_path))["embeddings"].collect()}
    assert found[1] == found[3] == found[5] != found[7] and len(found) == 7
    assert sum(x * x for x in found[7]) == pytest.approx(1)


def all_ranks(chunks, questions, k):
    """The whole ranking of every scope in plain Python."""
    out = []
    for q, scope, vec in questions:
        own = [(c, v) for s, c, v in chunks if s == scope]
        cos = {c: round(float(np.dot(v, vec)), 12) if v is not None and vec is not None else 0.0 for c, v in own}
        out += [(q, c, i + 1) for i, c in enumerate(sorted(cos, key=lambda c: (-cos[c], c))[:k])]
    return sorted(out)


def some_vectors(seed=1, n=90):
    rng = np.random.default_rng(seed)
    unit = lambda: (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(size=4))
    twice = unit()
    chunks = [(f"s{i % 3}", i, None if i % 11 == 0 else twice if i % 7 == 0 else unit()) for i in range(n)]
    return chunks, [(q, f"s{q % 4}", None if q == 5 else unit()) for q in range(9)]


@pytest.mark.parametrize(("block", "q_block"), [(5, 2), (16, 100), (1000, 1)])
def test_blocks_rank_as_a_whole_ranking(spark, block, q_block):
    chunks, questions = some_vectors()
    c = spark.createDataFrame(chunks, "scope string, chunk_id long, vec array<double>")
    q = spark.createDataFrame(questions, "question_id long, scope string, vec array<double>")
    got = V.nearest(c, q, 7, block, q_block)
    assert sorted((r.question_id, r.chunk_id, r["rank"]) for r in got.collect()) == all_ranks(chunks, questions, 7)
    whole = {(a, b): r for a, b, r in all_ranks(chunks, questions, 1000)}
    wanted = [p for p in whole if sum(p) % 4 == 0]
    got = V.places(c, q, spark.createDataFrame(wanted, "question_id long, chunk_id long"), block, q_block)
    assert {(r.question_id, r.chunk_id): r["rank"] for r in got.collect()} == {p: whole[p] for p in wanted}


@pytest.mark.parametrize("k", [1, 3, 40])
def test_threshold_fusion_equals_full_fusion(spark, k):
    chunks, questions = some_vectors(2, 150)
    rng = np.random.default_rng(3)
    c = spark.createDataFrame(chunks, "scope string, chunk_id long, vec array<double>")
    q = spark.createDataFrame(questions, "question_id long, scope string, vec array<double>")
    scores = [(a, b, float(rng.integers(1, 9)) / 4) for a, s, _ in questions for sc, b, _ in chunks if s == sc and rng.random() < 0.6]
    hits = spark.createDataFrame(scores, "question_id long, chunk_id long, score double")
    by_vector = R.ranked(R.cosine(c, q).withColumn("cos", F.round("cos", 12)), "cos", [F.col("chunk_id")], ["question_id"], "embed_rank")
    by_word = R.ranked(hits, "score", [F.col("chunk_id")], ["question_id"], "bm25_rank")
    want = R.top(R.fuse(by_vector, by_word), k, ["chunk_id"])
    row = lambda r: (r.question_id, r.chunk_id, r["rank"], r.similarity_score, r.embed_rank, r.bm25_rank)
    got = R.hybrid(c, hits, q, k)
    assert sorted(map(row, got.collect())) == sorted(map(row, want.collect()))


def test_depth_is_deep_enough_and_no_deeper():
    for k in (1, 5, 30):
        p = R.depth(k)
        assert round(2 / (10 + p + 1), 6) < round(1 / (10 + k), 6) <= round(2 / (10 + p), 6)


def test_stream_of_files_by_folder(spark, tmp_path):
    for scope, name, text in (("a", "x.txt", "One sentence here. Another one.\n"), ("b", "x.txt", "Other words stand here.\n")):
        (tmp_path / "in" / scope).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / scope / name).write_text(text)
    run = lambda check: ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / check), model=models.hashing_embedder).awaitTermination()
    run("c1")
    first = tables(X.read(spark, str(tmp_path / "out")))
    assert len(first["chunks"]) == 2 and len(first["embeddings"]) == 2
    (tmp_path / "in" / "a" / "y.txt").write_text("A file that came later.\n")
    run("c1")
    run("c2")  # all files again, as batch 0: what it had written is replaced
    run("c3")
    index = X.read(spark, str(tmp_path / "out"))
    assert sorted((r.scope, r.source_file) for r in index["chunks"].collect()) == [("a", "x.txt"), ("a", "y.txt"), ("b", "x.txt")]
    assert {r.scope: r.n for r in index["scope_stats"].collect()} == {"a": 2, "b": 1}


def test_a_new_checkpoint_writes_what_is_new_and_replaces_nothing(spark, tmp_path):
    for folder, name in (("in", "x.txt"), ("in", "y.txt"), ("more", "z.txt")):
        (tmp_path / folder / "a").mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / "a" / name).write_text(f"A sentence of file {name[0]} here.\n")
    run = lambda source, check: ingest.ingest(spark, str(tmp_path / source), str(tmp_path / "out"), str(tmp_path / check)).awaitTermination()
    run("in", "c1")
    first = names(tmp_path / "out" / "chunks") | names(tmp_path / "out" / "postings")
    run("in", "c2")
    assert names(tmp_path / "out" / "chunks") | names(tmp_path / "out" / "postings") == first
    run("more", "c3")
    index = X.read(spark, str(tmp_path / "out"))
    assert sorted(r.source_file for r in index["chunks"].collect()) == ["x.txt", "y.txt", "z.txt"]
    assert {r.scope: r.n for r in index["scope_stats"].collect()} == {"a": 3}


def test_words_are_counted_in_arrow_as_expressions_have_them(spark):
    odd = ["\u0130x K2 \u212a a1\u00e9 b c_d a1 \u00c95 \U0001f600z9 a1", "z z Z", None, "", "...", "\u0391\u03a3 9 \u00df \ufb01 7", "a\u0000b\na\tb", "abc" * 3, "0"]
    rows = spark.createDataFrame(list(enumerate(odd)), "chunk_id long, text string").withColumn("scope", F.when(F.col("chunk_id") > 0, "s"))
    words = rows.select("scope", "chunk_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("scope", "chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    posts = R.postings(rows)
    assert sorted(map(repr, posts.collect())) == sorted(map(repr, words.collect()))
    assert [r.n for r in rows.select("chunk_id", R.token_count("text").alias("n")).orderBy("chunk_id").collect()] == [r.n for r in rows.select("chunk_id", F.size(T.tokens(F.col("text"))).alias("n")).orderBy("chunk_id").collect()]
    plan = posts._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_postings_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    plans, put = {}, X._put

    def seen(rows, path, *args, **kw):
        put(rows, path, *args, **kw)
        plans[os.path.basename(path)] = kw.get("spread", True)

    monkeypatch.setattr(X, "_put", seen)
    X.append(passages(spark), str(tmp_path))
    assert plans == {"chunks": True, "postings": False, "scope_counts": True, "term_counts": True}
    folders = {os.path.dirname(n) for n in names(tmp_path / "postings")}
    assert folders == {os.path.dirname(n) for n in names(tmp_path / "chunks")}


def test_a_batch_of_questions_that_runs_again_leaves_one_answer_each(spark, tmp_path):
    source, target = str(tmp_path / "q"), str(tmp_path / "a")
    spark.createDataFrame([(1, "one"), (1, "one"), (2, "two")], "question_id long, question string").write.parquet(source)
    stream = spark.readStream.schema("question_id long, question string").parquet(source)
    fail = [True]

    def answer(batch):
        out = batch.withColumn("answer", F.upper("question"))
        if fail.pop() if fail else False:
            out.write.mode("overwrite").parquet(f"{target}/batch=0")  # as if cut off after writing
            raise RuntimeError("lost")
        return out

    with pytest.raises(Exception, match="lost"):
        ingest.answer_stream(stream, answer, target, str(tmp_path / "c")).awaitTermination()
    ingest.answer_stream(stream, answer, target, str(tmp_path / "c")).awaitTermination()
    assert sorted((r.question_id, r.answer) for r in spark.read.parquet(target).collect()) == [(1, "ONE"), (2, "TWO")]


def test_grid_scores_and_ranks_each_chunk_size_once(spark, monkeypatch):
    """Settings that differ in the fusion alone share both rankings; each pool is what hybrid retrieval gives by itself."""
    from passagebase.operators import grid, vectors

    calls = {"bm25": 0, "nearest": 0}

    def counting(module, name):
        inner = getattr(module, name)

        def call(*args, **more):
            calls[name] += 1
            return inner(*args, **more)

        monkeypatch.setattr(module, name, call)

    r = np.random.default_rng(11)
    texts = [(f"s{i % 2}", i, " ".join(r.choice(["sun", "moon", "star", "sky", "sea", f"w{i}"], 8)), [float(x) for x in r.normal(size=3)]) for i in range(60)]
    c = spark.createDataFrame(texts, "scope string, chunk_id long, text string, vec array<double>").withColumn("vec", R.unit_vector(F.col("vec")))
    q = spark.createDataFrame([(i, f"s{i % 2}", f"moon w{i} sea", [1.0, float(i), 0.5]) for i in range(6)], "question_id long, scope string, question string, vec array<double>").withColumn("vec", R.unit_vector(F.col("vec")))
    settings = [grid.Setting("a", 50, candidates=6), grid.Setting("b", 50, rrf_k=60, candidates=9), grid.Setting("c", 50, rrf_k=1, candidates=4), grid.Setting("d", 90, candidates=3)]
    counting(R, "bm25")
    counting(vectors, "nearest")
    got = grid.pools(settings, q, lambda size: (c.select("scope", "chunk_id", "text"), c.select("scope", "chunk_id", "vec")), lambda question, text: F.length(text))
    assert calls == {"bm25": 2, "nearest": 2}
    hits = R.bm25(c, q.select("question_id", "scope", "question")).where("score > 0").withColumn("score", F.round("score", 9))
    for s in settings:
        want = R.hybrid(c, hits, q, s.depth(), s.rrf_k).select("question_id", "chunk_id", "rank", "cos").collect()
        own = got.where((F.col("max_tokens") == s.max_tokens) & (F.col("rrf_k") == s.rrf_k)).select("question_id", "chunk_id", "pool_rank", "cos").collect()
        assert sorted(map(tuple, own)) == sorted(map(tuple, want)) and own
