"""Hooks for models: embeddings as the model gives them, pairs cut and batched by length, answers asked once; folders and files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagebase.jobs.queries import queries
from passagebase.operators import chunking as C
from passagebase.operators import models as M
from passagebase.sources import tables as I

DIR = "/root/testdata/sf0.001"


def test_embedding_queries_against_the_model_itself(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in docs), M.hashing_embedder([r.text for r in docs]), strict=True))
    got = {r.chunk_id: r.embedding for r in queries()["e1_embed"](spark, DIR).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-5) for k in want)


def test_question_prefix_query(spark):
    items = spark.read.parquet(f"{DIR}/benchmark.parquet").collect()
    want = dict(zip((r.item_id for r in items), M.hashing_embedder(["Represent this question for searching relevant passages: " + r.text for r in items]), strict=True))
    got = {r.question_id: r.embedding for r in queries()["e3_question_prefix"](spark, DIR).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-5) for k in want)


def test_example_messages_query(spark):
    """System, user and assistant; the user's turn has the question's prompt, the target is a refusal or names a source."""
    asked = {r.item_id: r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    rows = queries()["d13_examples"](spark, DIR).collect()
    assert rows
    for r in rows:
        assert [m.role for m in r.messages] == ["system", "user", "assistant"]
        assert r.messages[1].content.startswith("PASSAGES:\n\n[CHUNK 1 | source: ") and f"QUESTION: {asked[r.question_id]}\n" in r.messages[1].content
        assert (r.kind == "squad_unanswerable") == (r.question_id % 3 == 0)
        assert ("Sources:" in r.messages[2].content) == (r.kind == "squad_answerable")


def test_pairs_are_cut_to_a_limit_and_batched_by_length(spark):
    sizes, questions = spark.sparkContext.accumulator(0), "what is asked here"
    longest = spark.sparkContext.accumulator(0)

    def model(asked, passages):
        assert len(asked) <= 8
        n = [C.default_tokens(p) for p in passages]
        sizes.add(sum(max(n) - x for x in n))
        longest.add(sum(C.default_tokens(q) + x > 60 for q, x in zip(asked, n, strict=True)))
        assert set(asked) <= {questions, ""}
        return [float(len(p.split())) for p in passages]

    rows = [(i, questions, " ".join(f"w{j}" for j in range(i % 80))) for i in range(400)] + [(400, None, "a b"), (401, questions, None)]
    df = spark.createDataFrame(rows, "i int, q string, p string").coalesce(1)
    got = {r.i: r.s for r in df.select("i", M.score_pairs(model, 8, limit=60)("q", "p").alias("s")).collect()}
    room = max(n for n in range(80) if int(n * 1.4) + 1 + C.default_tokens(questions) <= 60)
    assert got == {i: float(min(i % 80, room)) for i in range(400)} | {400: 2.0, 401: 0.0}
    assert longest.value == 0 and sizes.value <= 402  # by length, padding is about a token a pair


def test_a_question_over_the_limit_leaves_no_passage():
    assert M.cut_pair("q " * 50, "a b c", 5, C.each(C.default_tokens), 20) == ""
    assert M.cut_pair("q", "a b c", 5, C.each(C.default_tokens), 20) == "a b c"


def test_answered_prompts_are_not_asked_again(spark, tmp_path):
    asked, broken = spark.sparkContext.accumulator(0), tmp_path / "broken"
    broken.write_text("")

    def model(prompts):
        if "p 7" in prompts and broken.exists():
            raise RuntimeError("no answer")
        asked.add(len(prompts))
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(i, f"p {i % 20}") for i in range(60)] + [(99, None)], "i int, prompt string")
    path = str(tmp_path / "answers")
    with pytest.raises(Exception, match="no answer"):
        M.generate_once(df, "prompt", path, model, batch=1, tries=2, portion=2)
    first = asked.value
    stored = spark.read.parquet(path).count()
    broken.unlink()
    got = M.generate_once(df, "prompt", path, model, batch=1, portion=2).collect()
    assert {(r.prompt, r.response) for r in got} == {(f"p {i}", f"P {i}") for i in range(20)} | {(None, None)} and len(got) == 61
    assert asked.value - first == 20 - stored
    M.generate_once(df, "prompt", path, model, batch=1, portion=2).collect()
    assert asked.value - first == 20 - stored


def test_a_call_that_fails_is_tried_again_within_its_bound():
    left = [2]

    def model(prompts):
        left[0] -= 1
        if left[0] >= 0:
            raise RuntimeError("busy")
        return prompts

    assert M.persistent(model, 3)(["a"]) == ["a"]
    left[0] = 2
    with pytest.raises(RuntimeError):
        M.persistent(model, 2)(["a"])


def test_folder_scan_and_whole_texts(spark, tmp_path):
    for name, text in (("b.txt", "first\r\nsecond ñ"), ("A.TXT", ""), ("c.Pdf", "%PDF"), ("d.docx", "x"), ("e.png", "x"), ("none", "x"), (".hidden", "x")):
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "folder.txt").mkdir()
    known, other = I.scan_folder(spark, str(tmp_path))
    assert [r.name for r in known.collect()] == ["A.TXT", "b.txt", "c.Pdf", "d.docx"]
    assert [(r.name, r.length) for r in other.collect()] == [("e.png", 1), ("none", 1)]
    got = {r.source_file: r.text for r in I.read_texts(spark, str(tmp_path / "*.txt")).collect()}
    assert got["b.txt"] == "first\r\nsecond ñ"


def test_folder_queries_read_all_that_was_written(spark):
    """Files of the conversations: their sizes and texts are those of the lines written into them."""
    lines = spark.read.parquet(f"{DIR}/conversations.parquet").select(F.regexp_replace("text", r"\R", " ").alias("t")).collect()
    want = sorted(r.t for r in lines)
    assert sorted(x for r in queries()["s2_read_texts"](spark, DIR).collect() for x in r.text.splitlines()) == want
    scanned = queries()["s1_scan_folder"](spark, DIR).collect()
    assert all(r.supported for r in scanned) and sum(r.length for r in scanned) == sum(len(t.encode()) + 1 for t in want)


def test_documents_without_chunks_are_reported(spark):
    docs = spark.createDataFrame([("s", "a", "Some text here."), ("s", "b", " \n\t"), ("s", "c", None), ("s", "d", "12\n 7 \n"), ("t", "a", "")], "scope string, source_file string, text string")
    chunks = C.chunk_pages(C.unit_arrays(docs.where("text is not null")))
    assert sorted(map(tuple, C.without_chunks(docs, chunks).collect())) == [("s", "b", "no text"), ("s", "c", "no text"), ("s", "d", "no chunks"), ("t", "a", "no text")]
