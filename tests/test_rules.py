"""Rules on tiny inline frames; cases follow the blueprint's fixture list."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from passagebase.functions import text as T
from passagebase.operators import answering as A
from passagebase.operators import chunking as C
from passagebase.operators import retrieval as R
from passagebase.operators import scoring as S
from passagebase.operators import sessions as O
from passagebase.operators import trainset as D


def one(spark, value, column, ddl="c string"):
    return spark.createDataFrame([(value,)], ddl).select(column(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("5.0.0", "5.0"), ("8x8x8", "8 x 8x8"), ("1,234,567", "1234567"), ("0.9800", "0.98"), ("95.0%", "95"), ("C# and C++", "csharp and cplusplus"), ("224×224", "224 x 224"), ("a–b. End.", "a b end"), ("", "")],
)
def test_normalised(spark, raw, want):
    assert one(spark, raw, T.normalised) == want


def test_nfkc(spark):
    assert one(spark, "ﬁ １２ 10⁻⁴", lambda c: T.normalised(S.nfkc(c))) == "fi 12 10 4"


@pytest.mark.parametrize(("raw", "want"), [("summarize", True), ("what is this about", True), ("tl;dr", True), ("what is the refund policy of contoso europe", False), ("fee?", True), ("who are you", True)])
def test_broad(spark, raw, want):
    assert one(spark, raw, T.is_broad) is want


def test_word_edges_are_ascii(spark):
    """Accented letters end a word, as in the SQL: with Unicode edges 'éan' is one word and keeps its 'an'."""
    from passagebase.jobs.train import _plain

    assert one(spark, "Émentêan the Éen anêt", _plain) == "ment en t"
    assert one(spark, "grade: é4", S.grade) == 4


def test_rounding_keeps_the_sign(spark):
    """What SQL gives for numbers just below zero is -0.0; its text differs from that of 0.0."""
    values = [-3e-7, 3e-7, -0.0, 0.1234565, -0.1234565, 2.5e-6, -7.0000004, 1e300]
    got = spark.createDataFrame([(values,)], "v array<double>").select(F.transform("v", lambda x: R.rounded(x, 6)).alias("v")).first()["v"]
    want = duckdb.execute("select list_transform($1::double[], lambda x: round(x, 6))", [values]).fetchone()[0]
    assert list(map(repr, got[:2] + got[3:])) == list(map(repr, want[:2] + want[3:])) and math.isnan(one(spark, math.nan, lambda c: R.rounded(c, 6), "c double"))


@pytest.mark.parametrize("scoped", [True, False])
def test_scores_in_rows_are_those_of_joined_postings(spark, monkeypatch, scoped):
    """No words or scores are shuffled where weights are few; beyond that postings are joined, with the same scores."""
    words = ["la", "de", "key", "Zug", "x1", "été"]
    rows = [(f"s{i % 3}", i, " ".join(words[(i * j) % 6] for j in range(i % 7))) for i in range(40)] + [("s0", 40, None), (None, 41, "la de")]
    chunks = spark.createDataFrame(rows, "scope string, chunk_id long, text string")
    asked = spark.createDataFrame([(1, "s0", "la la de"), (2, "s1", "ZUG x1"), (3, "s9", "la"), (4, "s0", "none of it t"), (5, "s2", "")], "question_id long, scope string, question string")
    questions = asked if scoped else asked.drop("scope")
    narrow = R.bm25(chunks, questions)
    assert "Exchange" not in narrow._jdf.queryExecution().executedPlan().toString()
    got = {(r.question_id, r.scope, r.chunk_id): r.score for r in narrow.collect()}
    monkeypatch.setattr(R, "WEIGHTS", 1)
    want = {(r.question_id, r.scope, r.chunk_id): r.score for r in R.bm25(chunks, questions).collect()}
    assert len(want) > 10 and got == pytest.approx(want, abs=1e-12)


def test_only_texts_with_a_snippets_words_are_normalised(spark):
    """The same counts as from the normal forms of all texts, also for what they spell anew; few texts pass the words."""
    texts = ["We use C# and C++ at 8×8", "ﬁne 1,234.50 words", "fine words 1234.5", "The Fine words.", "abc# x2", None, "", "nothing here"]
    docs = spark.createDataFrame([("s", t) for t in texts] + [("t", "fine")], "scope string, text string")
    asked = [(1, "s", "c# and c++"), (2, "s", "8 x 8"), (3, "s", "fine 1234.5"), (4, "s", "FINE words"), (5, "s", "abcsharp"), (6, "u", "fine"), (7, "t", "words"), (8, "s", "1234.5"), (9, "s", None)]
    needles = spark.createDataFrame(asked, "id long, scope string, snippet string")
    pairs = needles.join(docs, "scope").withColumn("held", F.contains(S.bounded(F.col("text")), S.bounded(F.col("snippet"))))
    want = {r.id: r.n for r in pairs.groupBy("id").agg(F.count_if("held").alias("n")).collect()}
    assert sum(want.values()) > 7
    for few in (True, False):
        assert {r.id: r.held_by for r in S.evidence_in_texts(needles, docs, few).collect()} == want
    assert one(spark, " abcsharp x fine 12ab ", S.plain_words) == ["fine", "ab"]


def test_only_documents_that_items_name_are_normalised(spark):
    items = spark.createDataFrame([(1, 10, ["one two"]), (2, 30, ["gone"])], "id long, doc long, evidence array<string>")
    docs = spark.createDataFrame([(10, "One, two.", "x"), (20, "never named", "y")], "doc long, text string, other_text string")
    found = S.validate(items, docs)
    plan = found["lost"]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("ArrowEvalPython") < plan.index("LeftSemi")
    assert sorted((r.doc, r.snippets, r.lost) for r in found["lost"].collect()) == [(10, 1, 0), (30, 1, 1)]
    assert [r.doc for r in found["missing"].collect()] == [30]


def test_refusals(spark):
    assert one(spark, "I don’t have enough information.", T.is_strict_refusal)
    assert not one(spark, "It is not mentioned.", T.is_strict_refusal)
    assert one(spark, "It is not mentioned.", T.is_abstention)


@pytest.mark.parametrize(("raw", "want"), [("a|a|b", "a | b"), ("a||a", "a"), ("||", ""), (" x  y |z", "x y | z")])
def test_row_text(spark, raw, want):
    assert one(spark, raw, lambda c: T.row_text(F.split(c, r"\|"))) == want


def test_sentence_around(spark):
    text = "One two three four. The answer is forty two here. Last one has some words"
    df = spark.createDataFrame([(text, text.index("forty"), 5), (text, 0, 3), (text, text.index("Last"), 4), ("Hi there.", 0, 2)], "t string, s int, n int")
    got = [r[0] for r in df.select(T.sentence_around(F.col("t"), F.col("s"), F.col("n"))).collect()]
    assert got == ["The answer is forty two here.", "One two three four.", "Last one has some words", None]


@pytest.mark.parametrize("n", [0, 1, 450, 451, 500, 501, 951])
def test_word_windows(spark, n):
    docs = spark.createDataFrame([("s", "f", " ".join(f"w{i}" for i in range(n)))], "scope string, source_file string, text string")
    got = sorted((r.chunk_index, r.text) for r in C.word_windows(docs).collect())
    assert [i for i, _ in got] == list(range(math.ceil(n / 450)))
    assert [t.split() for _, t in got] == [[f"w{i}" for i in range(k * 450, min(n, k * 450 + 500))] for k in range(len(got))]


def test_pack_units_invariants():
    rows = [(1 + i // 20, f"Sentence number {i} has a few words in it.", False) for i in range(60)]
    rows.insert(30, (2, "2.1 A heading", True))
    chunks = C.pack_units(rows, limit=80, overlap=20)
    seen = " ".join(t for t, _, _ in chunks)
    assert all(f"number {i} " in seen for i in range(60))
    for text, pages, section in chunks:
        body = text.removeprefix("2.1 A heading\n")
        assert sum(C.default_tokens(x) + 1 for x in body.split("\n")) <= 80
        assert pages == sorted(set(pages))
        assert section in (None, "2.1 A heading")


@pytest.mark.parametrize(("before", "starts"), [(2, False), (3, True)])
def test_heading_starts_a_chunk_once_two_fifths_are_full(before, starts):
    rows = [(1, f"Sentence number {i} has a few words in it.", False) for i in range(before)] + [(1, "2.1 A heading", True), (1, "Body follows here.", False)]
    chunks = C.pack_units(rows, limit=80, overlap=20)
    assert len(chunks) == 1 + starts
    assert not starts or chunks[1][0] == "2.1 A heading\nBody follows here."  # no overlap into a heading


def test_split_long():
    pieces = C.split_long("w " * 200, C.each(C.default_tokens), 30)
    assert sum(len(p.split()) for p in pieces) == 200
    assert all(C.default_tokens(p) <= 30 for p in pieces)


def plain_bm25(docs, query):
    toks = [d.split() for d in docs]
    n, avgdl = len(docs), sum(map(len, toks)) / len(docs)
    df = Counter(t for d in toks for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: r if r >= 0 else floor for t, r in raw.items()}
    return [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for t in query.split()) for d in toks]


@pytest.mark.parametrize("docs", [["a b"], ["a b", "a c"], ["a b c", "a a d", "e", "", "b b b e f"], ["x y"] * 3])
def test_bm25_against_plain_python(spark, docs):
    c = spark.createDataFrame([("s", i, d) for i, d in enumerate(docs)], "scope string, chunk_id int, text string")
    q = spark.createDataFrame([(1, "s", "a b b zz")], "question_id int, scope string, question string")
    got = {r.chunk_id: r.score for r in R.bm25(c, q).collect()}
    want = plain_bm25(docs, "a b b zz")
    assert all(math.isclose(got.get(i, 0.0), w, abs_tol=1e-9) for i, w in enumerate(want))


def chunk(source, score, rank=1):
    return {"rank": rank, "source_file": source, "page": None, "text": "t", "embed_score": score, "similarity_score": 0.1}


CHUNK = "array<struct<rank:int,source_file:string,page:int,text:string,embed_score:double,similarity_score:double>>"


@pytest.mark.parametrize(
    ("scores", "status", "dropped"),
    [([0.5499], "below_floor", 0), ([0.55], "weak", 0), ([0.5999], "weak", 0), ([0.60], "answer", 0), ([0.8, 0.4], "answer", 1), ([], "below_floor", 0)],
)
def test_gate(spark, scores, status, dropped):
    q = spark.createDataFrame([("which tariff applies to contoso freight shipments", [chunk("f", s, i) for i, s in enumerate(scores)])], f"question string, chunks {CHUNK}")
    r = A.gate(q).first()
    assert (r.status, r.dropped) == (status, dropped)
    assert A.gate(q, use_gate=False).first().status == ("answer" if scores else "no_chunks")


@pytest.mark.parametrize(
    ("response", "names"),
    [("x\nSources:\na.pdf\nb.txt", ["a.pdf", "b.txt"]), ("x SOURCES: - budget.pdf\n* budget.pdf\n\n", ["budget.pdf"]), ("no list", []), ("x\nSources:\n", [])],
)
def test_cited(spark, response, names):
    assert one(spark, response, A.cited) == names


def test_cited_compat(spark):
    assert one(spark, "x\nSources:\nbudget.pdf", lambda c: A.cited(c, compat=True)) == ["dget.pdf"]


@pytest.mark.parametrize(("scores", "want"), [([0.9, 0.7], 0.8), ([0.9], 0.9), ([], 0.0), ([1.4], 1.0), ([0.4, 0.8, 0.6], 0.55)])
def test_confidence(spark, scores, want):
    assert one(spark, scores, A.confidence, "c array<double>") == pytest.approx(want)


def test_answers_end_to_end(spark):
    q = spark.createDataFrame([(1, "which tariff applies to contoso freight shipments", [chunk("a.pdf", 0.9)]), (2, "which tariff applies to contoso freight shipments", [chunk("a.pdf", 0.2)])], f"question_id int, question string, chunks {CHUNK}")
    fake = lambda prompts: ["Yes.\n\nSources:\na.pdf\nghost.pdf" for _ in prompts]
    got = {r.question_id: r for r in A.answer_questions(q, fake).collect()}
    assert got[1].sources_cited == ["a.pdf"]
    assert "ghost.pdf" in got[1].warning
    assert got[2].answer == A.REFUSAL and got[2].confidence == 0.0


def test_scores(spark):
    rows = [
        ("forty two", True, ["forty two"], None, None), ("forty", True, ["forty two"], None, None), ("red and blue", True, None, [["red"], ["blue"]], None),
        ("red", True, None, None, [["red"], ["blue"]]), ("a b c", True, None, None, [["a"], ["b"], ["c"], ["d"], ["e"]]), ("I cannot answer: forty two", True, ["forty two"], None, None), ("not mentioned", False, None, None, None),
    ]
    df = spark.createDataFrame(rows, "answer string, answerable boolean, answers array<string>, all_of array<array<string>>, key_points array<array<string>>")
    got = [(r.correct, r.partial) for r in S.score_answers(df).collect()]
    assert got == [(True, 1.0), (False, 0.0), (True, 1.0), (False, 0.5), (True, 0.6), (False, 1.0), (True, 1.0)]


def test_unlabelled_gold_is_an_error(spark):
    df = spark.createDataFrame([("x", True, None, None, None)], "answer string, answerable boolean, answers array<string>, all_of array<array<string>>, key_points array<array<string>>")
    with pytest.raises(Exception, match="no answers"):
        S.score_answers(df).collect()


def test_evidence_rank(spark):
    ev = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "alpha"), (2, "zeta"), (3, "alph")], "question_id int, snippet string")
    rt = spark.createDataFrame([(q, r, t) for q in (1, 2, 3) for r, t in ((1, "the alpha text"), (2, "with Beta."))], "question_id int, rank int, text string")
    assert {r.question_id: r.evidence_rank for r in S.evidence_ranks(ev, rt).collect()} == {1: 2, 2: None, 3: None}


def test_newest_sessions(spark):
    s = spark.createDataFrame([(f"s{i}", i) for i in range(8)] + [("demo", -1)], "session_id string, mtime int")
    assert {r.session_id for r in O.newest(s, 5).collect()} == {"s3", "s4", "s5", "s6", "s7", "demo"}


def test_ranked_others_and_pairs(spark):
    rows = spark.createDataFrame([("t", f"word{i} shared text", i) for i in range(5)] + [("alone", "x", 9)], "title string, context string, pos int")
    ctx = D.contexts(rows)
    q = spark.createDataFrame([(1, "t", 0, "word1 shared", True), (2, "t", 0, "word2", False), (3, "alone", 9, "x", True)], "question_id int, title string, context_id int, question string, answerable boolean")
    ranks = D.ranked_others(ctx, q.drop("answerable"))
    got = ranks.collect()
    assert {r.question_id for r in got} == {1, 2} and all(r.context_id != 0 for r in got) and len(got) == 8
    assert next(r.context_id for r in got if r.question_id == 1 and r.rank == 1) == 1
    pairs = D.pairs(q, ctx, D.hard_negatives(ranks)).groupBy("question_id", "label").count().collect()
    assert {(r.question_id, r.label, r["count"]) for r in pairs} == {(1, 1.0, 1), (1, 0.0, 3), (2, 0.0, 3), (3, 1.0, 1)}


def test_distractors_are_others_and_differ(spark):
    rows = spark.range(20).withColumnRenamed("id", "q")
    others = spark.range(50).selectExpr("id AS o", "id + 1000 AS b", "'x' AS base", "1 AS index")
    got = D.distractors(rows, "q", others, "o", 3).collect()
    of = {q: [r for r in got if r.q == q] for q in range(20)}
    assert all(sorted(r.pick for r in rs) == [1, 2, 3] and len({r.o for r in rs}) == 3 and q not in {r.o for r in rs} for q, rs in of.items())
    assert all(r.b == r.o + 1000 and r.base == "x" for r in got)
    few = D.distractors(rows, "q", others.where("o < 2"), "o", 3).groupBy("q").count().collect()
    assert all(r["count"] == (1 if r.q < 2 else 2) for r in few)
    assert D.distractors(rows, "q", others.where("false"), "o", 3).count() == 0


def test_sentence_around_with_a_mark_before_the_span(spark):
    text = "See v1.2 of the file now please."
    df = spark.createDataFrame([(text, text.index("2"), 1), ("\tOne two three four\n", 1, 3)], "t string, s int, n int")
    got = [r[0] for r in df.select(T.sentence_around(F.col("t"), F.col("s"), F.col("n"))).collect()]
    assert got == ["2 of the file now please.", "One two three four"]


def test_units_are_stripped_of_any_white_space(spark):
    docs = spark.createDataFrame([("s", "f", "a\n\t\n\tb\u00a0\n 12 \n")], "scope string, source_file string, text string")
    assert [r.unit for r in C.units(docs, ["scope"]).orderBy("pos").collect()] == ["a", "b"]
    assert [u.unit for u in C.unit_arrays(docs).first().units] == ["a", "b"]


def test_overlap_may_hold_a_heading_but_none_comes_before_one():
    words = lambda n: " ".join(["w"] * (n - 1)) + "."
    count = lambda s: len(s.split())
    rows = [(1, words(20), False), (1, "1. Head", True), (1, words(4), False), (1, words(9), False)]
    got = C.pack_units(rows, count, limit=32, overlap=9)
    assert [t.split("\n")[1:2] for t, _, _ in got][1] == [words(4)] and got[1][0].startswith("1. Head")
    assert len(C.pack_units([(1, words(20), False), (1, "1. Head", True), (1, words(9), False)], count, limit=32, overlap=30)) == 2


def test_words_of_an_over_long_sentence_join_the_open_piece():
    count = lambda s: len(s.split())
    assert C.split_long("A b. C d e f g h i.", C.each(count), 4) == ["A b.", "C d e f", "g h i."]
    assert C.split_long("A. C d e f g h i. J.", C.each(count), 4) == ["A.", "C d e f", "g h i. J."]


def test_answers_match_in_compatibility_form(spark):
    rows = spark.createDataFrame([("one", True, ["12 apples"], None, None, "１２ ａｐｐｌｅｓ"), ("all", True, None, [["ﬁve"], ["２"]], None, "five 2"), ("no", False, None, None, None, "not enough information")], "id string, answerable boolean, answers array<string>, all_of array<array<string>>, key_points array<array<string>>, answer string")
    got = S.score_answers(rows)
    assert got.columns[:6] == rows.columns and {r.id: r.correct for r in got.collect()} == {"one": True, "all": True, "no": True}
    assert got.where("id = 'all'").first().all_of == [["ﬁve"], ["２"]]


def test_json_arrays_and_saved_runs(spark, tmp_path):
    import json

    from passagebase.sources import tables as I

    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "query": "q", "type": "t", "_comment": "x"}, {"id": "2", "query": "r"}], indent=1))
    assert sorted((r.id, r.query, r.type) for r in I.read_json(spark, str(tmp_path / "c.json"), I.CASES).collect()) == [("1", "q", "t"), ("2", "r", None)]
    for k, only in (("a", False), ("b", True), ("c", None)):
        (tmp_path / f"run_{k}.json").write_text(json.dumps({"pipeline": k, "retrieval_only": only, "rows": [{"id": "1", "answer": k}, {"id": "2"}]}, indent=1))
    got = I.saved_rows(spark, [str(tmp_path / f"run_{k}.json") for k in "abc"]).collect()
    assert sorted((r.pipeline, r.id) for r in got) == [("a", "1"), ("a", "2"), ("c", "1"), ("c", "2")]
