"""Examples from corpora in their own shapes, on inline rows."""

import json

from passagebase.operators import answering as A
from passagebase.operators import corpora as K
from passagebase.sources import tables as I  # noqa: E741

LONG = "It was built in the year {} by the river people. Nobody lives there now."


def frame(spark, rows, schema):
    """Rows as they are read from a JSON file."""
    text = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    return text.selectExpr(f"from_json(value, '{schema}, id string, o string, n string') AS r").select("r.*")


def parts(row):
    return [m.content for m in row.messages]


def test_squad(spark):
    rows = []
    for i in range(12):
        context = LONG.format(1000 + i)
        answers = {"text": [str(1000 + i)], "answer_start": [context.index(str(1000 + i))]} if i % 3 else {"text": [], "answer_start": []}
        rows.append({"id": str(i), "o": "x", "title": f"Town {i % 2}", "context": context, "question": f"When {i}?", "answers": answers})
    rows.append({"id": "alone", "title": "One", "context": "Short.", "question": "q", "answers": {"text": ["Short"], "answer_start": [0]}})
    rows.append({"id": "null", "title": "One", "context": None, "question": "q", "answers": None})
    got = {r.id: r for r in K.squad_examples(frame(spark, rows, I.SQUAD), 100, 100).collect()}
    assert set(got) == {str(i) for i in range(12)}
    for i in range(12):
        _, user, target = parts(got[str(i)])
        assert user.count("[CHUNK ") in (3, 4, 5) and user.count(LONG.format(1000 + i)) == 1
        texts = [line for line in user.split("\n") if line.startswith("It was built")]
        assert len(set(texts)) == len(texts) and all((int(t.split("year ")[1][:4]) - i) % 2 == 0 for t in texts)
        pages = [x.split("]")[0] for x in user.split(" | page ")[1:]]
        assert len(set(pages)) == len(pages)
        if i % 3:
            assert target == f"It was built in the year {1000 + i} by the river people.\n\nSources:\nTown_{i % 2}.pdf"
        else:
            assert target == A.REFUSAL
    few = K.squad_examples(frame(spark, rows, I.SQUAD), 2, 1).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in few} == {"squad_answerable": 2, "squad_unanswerable": 1}
    assert K.squad_examples(frame(spark, rows[:0], I.SQUAD), 2, 1).collect() == []


def test_hotpot(spark):
    def row(i, answer, fact):
        titles = ["A b", "C", "D", "E", "F", "G"]
        return {"id": str(i), "question": "who?", "answer": answer, "context": {"title": titles, "sentences": [[f"{t} first {i}.", f"{t} says that Anna {i} did it."] for t in titles]}, "supporting_facts": {"title": ["A b", "C", "Z"], "sent_id": [0, fact, 0]}}

    rows = [row(i, f"Anna {i}", 1) for i in range(6)] + [row(10, "yes", 1), row(11, "Anna 11", 7), row(12, "Bert", 1)]
    got = {r.id: r for r in K.hotpot_examples(frame(spark, rows, I.HOTPOT), 6, 100).collect()}
    assert len(got) == 9
    for i in range(6):
        _, user, target = parts(got[str(i)])
        assert got[str(i)].kind == "hotpot_answerable" and user.count("[CHUNK ") in (4, 5)
        assert f"C first {i}." in user and f"A b first {i}." in user
        assert target == f"C says that Anna {i} did it.\n\nSources:\nA_b.pdf\nC.pdf"
    for i in (10, 11, 12):
        _, user, target = parts(got[str(i)])
        assert got[str(i)].kind == "hotpot_missing" and target == A.REFUSAL and user.count("[CHUNK ") == 4
        assert "C first" not in user and "A b first" not in user
    kinds = {r.kind: r["count"] for r in K.hotpot_examples(frame(spark, rows, I.HOTPOT), 4, 3).groupBy("kind").count().collect()}
    assert kinds == {"hotpot_answerable": 4, "hotpot_missing": 3}


def test_dolly_and_mix(spark):
    rows = [{"id": str(i), "instruction": f"ask {i}", "context": f"Context {i} holds some words. And more.", "response": f" said {i} ", "category": c} for i, c in enumerate(["closed_qa"] * 5 + ["information_extraction"] * 3 + ["summarization"] * 3 + ["brainstorming"] * 3)]
    rows += [{"id": "blank", "instruction": "x", "context": " \t", "response": "y", "category": "closed_qa"}, {"id": "null", "instruction": "x", "context": None, "response": "y", "category": "closed_qa"}]
    got = K.dolly_examples(frame(spark, rows, I.DOLLY), 4, 2, 3).collect()
    count = lambda k: sum(r.kind == k for r in got)
    assert [count(k) for k in ("dolly_grounded", "dolly_summary", "dolly_mismatch")] == [4, 2, 3]
    assert len({r.id for r in got}) == 9
    for r in got:
        _, user, target = parts(r)
        mine = f"Context {r.id} holds" in user
        if r.kind == "dolly_mismatch":
            assert not mine and user.count("[CHUNK ") == 3 and target == A.REFUSAL
        elif r.kind == "dolly_summary":
            assert mine and user.count("holds some words") == 1 and target == f"said {r.id}\n\nSources:\nreport_{r.id}.pdf"
        else:
            assert mine and user.count("holds some words") == 2 and target == f"said {r.id}\n\nSources:\ndocument_{r.id}.pdf"
    one = K.dolly_examples(frame(spark, rows, I.DOLLY), 4, 2, 3)
    both = K.mixed([one, one.withColumn("kind", one.kind)]).collect()
    assert len(both) == 18 and [r.id for r in both] == [r.id for r in K.mixed([one, one]).collect()]


def test_mixture_of_the_given_tables(spark):
    import os

    import pytest

    from passagebase.jobs import train
    from passagebase.operators import trainset as D

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("tables are not here")
    got = train.mixed_examples(spark, "/root/testdata/sf0.001").collect()
    kinds = {k: [r for r in got if r.kind == k] for k in {r.kind for r in got}}
    assert {"squad_answerable", "squad_unanswerable", "hotpot_answerable", "hotpot_missing", "dolly_grounded", "dolly_summary"} <= set(kinds)
    assert all(len(rows) <= D.MIX[k] and len({r.id for r in rows}) == len(rows) for k, rows in kinds.items())
    assert all((parts(r)[2] == A.REFUSAL) == (r.kind in D.REFUSAL_KINDS) for r in got)
