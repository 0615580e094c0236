"""Scoring answers and evidence against gold items, and metrics by group."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagebase.functions import text as T

ANSWER_RECALL, KEY_POINTS = 0.8, 0.6
HIT_KS = (1, 3, 5, 10)


def nfkc(c: Column, kind: str = "string") -> Column:
    """Unicode compatibility composition of a text or of all texts in (nested) arrays, in Arrow batches."""

    def composed(x):
        if x is None or isinstance(x, str):
            return x if x is None or x.isascii() else unicodedata.normalize("NFKC", x)
        return [composed(y) for y in x]

    def run(s: pd.Series) -> pd.Series:
        return s.map(composed)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)(c)


def gold_tokens(c: Column) -> Column:
    """Tokens of a text that is compatibility-composed (nfkc) already."""
    return F.filter(F.split(T.normalised(c), " "), lambda x: x != "")


def times(a: Column, t: Column) -> Column:
    return F.size(F.filter(a, lambda x: x == t))


def recall(gold: Column, pred: Column) -> Column:
    """Multiset share of gold tokens among pred tokens; 0 for none."""
    hit = F.aggregate(F.array_distinct(gold), F.lit(0), lambda acc, t: acc + F.least(times(gold, t), times(pred, t)))
    return F.when(F.size(gold) == 0, F.lit(0.0)).otherwise(hit / F.size(gold))


def group_matched(alternatives: Column, pred: Column) -> Column:
    """Any alternative (composed) with enough of its tokens in the answer's tokens."""
    return F.exists(alternatives, lambda a: recall(gold_tokens(a), pred) >= ANSWER_RECALL)


def score_answers(rows: DataFrame) -> DataFrame:
    """Adds correct, partial, strict_refusal, abstained to (answerable, answers, all_of, key_points, answer).

    A gold item without any kind of answer is an error.
    """
    given = {"answers": "array<string>", "all_of": "array<array<string>>", "key_points": "array<array<string>>"}
    names = rows.columns
    rows = rows.select(*(F.struct(nfkc(F.col(c), given[c]).alias("composed"), F.col(c).alias("raw")).alias(c) if c in given else F.col(c) for c in names))
    gold = {c: F.col(c)["composed"] for c in given}
    pred = gold_tokens(nfkc(F.col("answer")))
    groups = F.when(gold["answers"].isNotNull(), F.array(gold["answers"])).when(gold["all_of"].isNotNull(), gold["all_of"]).when(gold["key_points"].isNotNull(), gold["key_points"]).when(F.col("answerable"), F.raise_error(F.lit("a gold item has no answers")).cast("array<array<string>>"))
    needed = F.when(gold["answers"].isNull() & gold["all_of"].isNull(), F.lit(KEY_POINTS)).otherwise(F.lit(1.0))
    r = rows.withColumn("pred", pred).withColumn("strict_refusal", T.is_strict_refusal(F.col("answer"))).withColumn("abstained", T.is_abstention(F.col("answer")))
    share = F.size(F.filter(groups, lambda g: group_matched(g, F.col("pred")))) / F.size(groups)
    r = r.withColumn("share", F.when(F.col("answerable"), share).otherwise(F.col("abstained").cast("double")))
    right = F.when(F.col("answerable"), ~F.col("strict_refusal") & (F.col("share") >= needed)).otherwise(F.col("abstained"))
    r = r.withColumn("correct", right).withColumn("partial", F.round("share", 4)).drop("pred", "share")
    return r.withColumns({c: F.col(c)["raw"] for c in given})


def bounded(c: Column) -> Column:
    """Normalised text between blanks, so that only whole tokens match."""
    return F.concat(F.lit(" "), T.normalised(nfkc(c)), F.lit(" "))


def evidence_ranks(evidence: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(question_id, evidence_rank): smallest r whose top r passages hold every snippet; null if some is never held.

    evidence: (question_id, snippet); retrieved: (question_id, rank, text). Passages are normalised once each.
    """
    hay = retrieved.select("question_id", "rank", bounded(F.col("text")).alias("hay"))
    needles = evidence.select("question_id", "snippet", bounded(F.col("snippet")).alias("needle"))
    first = needles.join(hay, "question_id", "left").groupBy("question_id", "snippet").agg(F.min(F.when(F.contains("hay", "needle"), F.col("rank"))).alias("r"))
    return first.groupBy("question_id").agg(F.when(F.count(F.lit(1)) == F.count("r"), F.max("r")).alias("evidence_rank"))


def evidence_in_texts(evidence: DataFrame, documents: DataFrame, few: bool = False) -> DataFrame:
    """(id, held_by): how many documents of its scope hold each snippet, whole tokens only.

    evidence: (id, scope, snippet), documents: (scope, text). Texts stay where they are if the snippets are few (counted by the
    caller, so that they are broadcast). Only a text that holds all of a snippet's plain words can hold the snippet, so only
    such texts are normalised.
    """
    needles = evidence.select("id", "scope", bounded(F.col("snippet")).alias("needle")).withColumn("words", plain_words(F.col("needle")))
    hay = documents.select("scope", nfkc(F.col("text")).alias("composed")).withColumn("low", F.lower("composed"))
    near = hay.join(F.broadcast(needles) if few else needles, "scope").where(F.forall("words", lambda w: F.contains("low", w)))
    whole = F.concat(F.lit(" "), T.normalised(F.col("composed")), F.lit(" "))
    held = near.where(F.contains(whole, F.col("needle"))).groupBy("id").agg(F.count(F.lit(1)).alias("held_by"))
    asked = evidence.join(documents.select("scope").distinct(), "scope", "left_semi").select("id").distinct()
    return asked.join(held, "id", "left").select("id", F.coalesce("held_by", F.lit(0).cast("long")).alias("held_by"))


def plain_words(needle: Column) -> Column:
    """Runs of letters of a normalised text that any text must hold as they are for its normal form to hold this one.

    What the normal form spells anew (c#, c++, the sign for times) is left out.
    """
    made = lambda w: (w == "x") | F.contains(w, F.lit("csharp")) | F.contains(w, F.lit("cplusplus"))
    return F.filter(F.regexp_extract_all(needle, F.lit("[a-z]+"), F.lit(0)), lambda w: ~made(w))


def validate(items: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """Problems of gold items: `repeated` (id, repeats), `missing` (doc), `unfound` (id, doc, snippet) held by neither of two
    extractions, and `lost` (doc, snippets, lost): how many snippets of a document the first extraction loses.

    items: (id, doc, evidence array<string>); documents: (doc, text, other_text), one row a document.
    """
    repeated = items.groupBy("id").agg((F.count(F.lit(1)) - 1).alias("repeats")).where("repeats > 0")
    missing = items.select("doc").distinct().join(documents.select("doc"), "doc", "left_anti")
    snippets = items.select("id", "doc", F.explode("evidence").alias("snippet")).withColumn("needle", bounded(F.col("snippet")))
    # Only documents that snippets name are normalised.
    named = documents.join(items.select("doc").distinct(), "doc", "left_semi")
    hay = named.select("doc", bounded(F.coalesce("text", F.lit(""))).alias("hay"), bounded(F.coalesce("other_text", F.lit(""))).alias("other_hay"))
    held = lambda c: F.coalesce(F.contains(c, "needle"), F.lit(False))
    seen = snippets.join(hay, "doc", "left").select("id", "doc", "snippet", held(F.col("hay")).alias("held"), held(F.col("other_hay")).alias("other_held"))
    lost = seen.groupBy("doc").agg(F.count(F.lit(1)).alias("snippets"), F.count_if(~F.col("held")).alias("lost"))
    return {"repeated": repeated, "missing": missing, "unfound": seen.where("not held and not other_held").select("id", "doc", "snippet"), "lost": lost}


def rescored(saved: DataFrame, gold: DataFrame) -> DataFrame:
    """Saved rows with the verdicts of the present gold items, and `flipped` where the verdict changed.

    saved: (run_timestamp, pipeline, id, answer, correct), as sources.tables.saved_rows gives them; gold: one row an id. A
    saved row whose gold item is gone is left out; a saved row without a verdict counts as changed.
    """
    old = saved.select("run_timestamp", "pipeline", "id", "answer", F.col("correct").alias("was_correct"))
    new = score_answers(old.join(gold.select("id", "type", "answerable", "answers", "all_of", "key_points"), "id"))
    return new.withColumn("flipped", ~F.col("correct").eqNullSafe(F.col("was_correct")))


def grade(reply: Column) -> Column:
    """The first grade from 1 to 5 in a judge's reply; null if there is none."""
    return F.regexp_extract(reply, T.edged(r"\b([1-5])\b"), 1).try_cast("int")


def retrieval_metrics(ks: tuple = HIT_KS, rank: str = "evidence_rank", prefix: str = "evidence_") -> list[Column]:
    out = [F.round(F.avg(F.when(F.col(rank) <= k, 1).otherwise(0)), 4).alias(f"{prefix}hit_{k}") for k in ks]
    return [*out, F.round(F.avg(F.coalesce(1 / F.col(rank), F.lit(0.0))), 4).alias(f"{prefix}mrr"), F.count(F.lit(1)).alias("n")]


def answer_metrics() -> list[Column]:
    right, answerable = F.col("correct").cast("int"), F.col("answerable")
    return [
        F.round(F.avg(right), 4).alias("accuracy"),
        F.round(F.avg(F.when(answerable, right)), 4).alias("answerable_accuracy"),
        F.round(F.avg(F.when(~answerable, right)), 4).alias("abstention_recall"),
        F.round(F.avg(F.when(answerable, F.col("strict_refusal").cast("int"))), 4).alias("false_abstention_rate"),
        F.count(F.lit(1)).alias("n"),
    ]


def by_groups(rows: DataFrame, metrics: list[Column], keys: list[str]) -> DataFrame:
    """The same metrics overall and by each key, in one pass (grouping sets)."""
    sets = [[], *([F.col(k)] for k in keys)]
    return rows.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.grouping_id().alias("level"), *metrics)
