"""From retrieved passages to checked answers: gate, prompt, citations, confidence, warnings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagebase.functions import text as T
from passagebase.operators.models import first_passage, generate
from passagebase.operators.retrieval import rounded
from passagebase.operators.scoring import grade

# Thresholds and sentences of the answer protocol.
HARD_FLOOR, CONTEXT_FLOOR = 0.55, 0.60
REFUSAL = "I don't have enough information in the provided documents to answer this question."
NO_PASSAGES = "[No relevant passages were retrieved for this query.]"
NO_CHUNKS = "No chunks were retrieved for this query."
NO_SOURCES = "Model did not include a 'Sources:' section. It may have answered from training knowledge rather than the provided chunks."


def gathered(retrieved: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, chunks): each question's passages in rank order, as one array; a top-k list, so a bounded one."""
    fields = ["rank", *(c for c in ("source_file", "page", "text", "embed_score", "similarity_score") if c in retrieved.columns)]
    return retrieved.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("chunks"))


def top_scores(chunks: Column) -> tuple[Column, Column]:
    """Best and mean of the three best cosine scores; 0 without passages."""
    scores = F.sort_array(F.transform(chunks, lambda c: F.coalesce(c["embed_score"], F.lit(0.0))), asc=False)
    three = F.slice(scores, 1, 3)
    mean = F.when(F.size(three) > 0, F.aggregate(three, F.lit(0.0), lambda a, x: a + x) / F.size(three)).otherwise(F.lit(0.0))
    return F.coalesce(F.try_element_at(scores, F.lit(1)), F.lit(0.0)), mean


def gate(questions: DataFrame, use_gate: bool = True, hard: float = HARD_FLOOR, context: float = CONTEXT_FLOOR) -> DataFrame:
    """Adds status (answer, no_chunks, below_floor, weak), good (passages that stay) and dropped.

    Broad questions, and all with the gate off, keep every passage.
    """
    chunks = F.coalesce(F.col("chunks"), F.array().cast(questions.schema["chunks"].dataType))
    free = F.lit(True) if not use_gate else T.is_broad(F.col("question"))
    top1, top3 = top_scores(F.col("chunks"))
    q = questions.withColumn("chunks", chunks).withColumn("free", free).withColumn("top1", top1).withColumn("top3", top3)
    strong = F.filter("chunks", lambda c: F.coalesce(c["embed_score"], F.lit(0.0)) >= context)
    q = q.withColumn("good", F.when(F.col("free"), F.col("chunks")).otherwise(strong))
    status = F.when(F.col("free") & (F.size("chunks") == 0), "no_chunks").when(F.col("free"), "answer").when((F.col("top1") < hard) & (F.col("top3") < hard), "below_floor").when(F.size("good") == 0, "weak").otherwise("answer")
    return q.withColumn("status", status).withColumn("dropped", F.when(F.col("status") == "answer", F.size("chunks") - F.size("good")).otherwise(F.lit(0)))


def prompt(chunks: Column, question: Column) -> Column:
    """Numbered passages with their source (and page where set), then the question."""

    def block(c: Column, i: Column) -> Column:
        page = F.when(F.coalesce(c["page"], F.lit(0)) != 0, F.concat(F.lit(" | page "), c["page"].cast("string"))).otherwise("")
        return F.concat(F.lit("[CHUNK "), (i + 1).cast("string"), F.lit(" | source: "), F.coalesce(c["source_file"], F.lit("unknown")), page, F.lit("]\n"), T.strip(c["text"]))

    body = F.when(F.size(chunks) > 0, F.array_join(F.transform(chunks, block), "\n\n---\n\n")).otherwise(NO_PASSAGES)
    return F.concat(F.lit("PASSAGES:\n\n"), body, F.lit("\n\n---\n\nQUESTION: "), question, F.lit("\n\nAnswer using only the passages above. List sources at the end."))


def judge_prompt(reference: Column, answer: Column) -> Column:
    """What a judge is asked: how far an answer is borne out by a passage, from 1 to 5."""
    return F.concat(F.lit("PASSAGE:\n"), T.strip(reference), F.lit("\n\nANSWER:\n"), T.strip(answer), F.lit("\n\nHow far does the passage bear out the answer? One grade from 1 (not at all) to 5 (wholly):"))


def judged(rows: DataFrame, model: Callable[[list[str]], list[str]], parallel: int | None = None) -> DataFrame:
    """Adds `grade` (1 to 5, null if the judge's reply has none) to the labelled answers that are no abstentions.

    rows: (reference, answer, abstained); rows without a reference or an answer are not labelled.
    """
    asked = rows.where(F.col("reference").isNotNull() & F.col("answer").isNotNull() & ~F.coalesce("abstained", F.lit(False)))
    told = generate(asked.withColumn("judge_prompt", judge_prompt(F.col("reference"), F.col("answer"))), "judge_prompt", model, parallel)
    return told.withColumn("grade", grade(F.col("response"))).drop("judge_prompt", "response")


def cited(response: Column, compat: bool = False) -> Column:
    """Names listed after the first sources heading, marks of lists stripped, first mention kept."""
    block = F.try_element_at(F.split(response, T.SOURCES_HEAD, 2), F.lit(2))
    marks = "^[-*bulet ]+" if compat else r"^[-*•\s]+"
    names = F.filter(F.transform(T.lines(F.trim(block)), lambda x: F.regexp_replace(F.trim(x), marks, "")), lambda x: x != "")
    return F.coalesce(F.array_distinct(names), F.array().cast("array<string>"))


def answer_part(response: Column) -> Column:
    return T.strip(F.element_at(F.split(response, T.SOURCES_HEAD, 2), 1))


def confidence(scores: Column) -> Column:
    """Half for the first passage, half for the mean of the rest; capped at 1, rounded to 4."""
    n = F.size(scores)
    rest = F.aggregate(F.slice(scores, 2, F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, x: a + x)
    value = F.when(n == 0, F.lit(0.0)).when(n == 1, F.try_element_at(scores, F.lit(1))).otherwise(0.5 * F.try_element_at(scores, F.lit(1)) + 0.5 / (n - 1) * rest)
    return rounded(F.least(value, F.lit(1.0)), 4)


def checked(answers: DataFrame, compat: bool = False) -> DataFrame:
    """From (response, good, dropped) to answer, sources_cited, phantoms, confidence, warning."""
    a = answers.withColumn("names", cited(F.col("response"), compat)).withColumn("answer", answer_part(F.col("response")))
    real = F.transform("good", lambda c: c["source_file"])
    a = a.withColumn("phantoms", F.filter("names", lambda s: ~F.array_contains(real, s))).withColumn("abstained", T.says_abstain(F.col("answer")))
    verified = F.filter("names", lambda s: F.array_contains(real, s))
    scores = F.transform("good", lambda c: F.coalesce(c["embed_score"], c["similarity_score"], F.lit(0.0)))
    listed = F.concat(F.lit("["), F.array_join(F.transform("phantoms", lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "), F.lit("]"))
    warnings = F.array_compact(
        F.array(
            F.when(F.col("dropped") > 0, F.concat(F.col("dropped").cast("string"), F.lit(f" chunk(s) were dropped (cosine similarity < {CONTEXT_FLOOR})."))),
            F.when(F.size("names") == 0, F.lit(NO_SOURCES)),
            F.when(F.size("phantoms") > 0, F.concat(F.lit("Phantom citations detected and removed: "), listed, F.lit(". These files were not in the retrieved chunks."))),
        )
    )
    return a.select(
        "*",
        F.when(F.col("abstained"), F.array().cast("array<string>")).otherwise(verified).alias("sources_cited"),
        F.when(F.col("abstained"), F.lit(0.0)).otherwise(confidence(scores)).alias("confidence"),
        F.nullif(F.array_join(warnings, "; "), F.lit("")).alias("warning"),
    )


def answer_questions(questions: DataFrame, model: Callable[[list[str]], list[str]] = first_passage, use_gate: bool = True, parallel: int | None = None) -> DataFrame:
    """(question_id, answer, sources_cited, confidence, warning) from (question_id, question, chunks).

    Refused questions never reach the model.
    """
    gated = gate(questions, use_gate)
    asked = gated.where("status = 'answer'").withColumn("prompt", prompt(F.col("good"), F.col("question")))
    told = checked(generate(asked, "prompt", model, parallel)).select("question_id", "answer", "sources_cited", "confidence", "warning")
    weak = F.format_string("Weak match abstention: best chunk cosine similarity was %.4f, top-3 average was %.4f. The LLM was not called.", "top1", "top3")
    low = F.format_string("No relevant match found: top chunk cosine similarity was %.4f and top-3 average was %.4f. The LLM was not called.", "top1", "top3")
    why = F.when(F.col("status") == "no_chunks", NO_CHUNKS).when(F.col("status") == "weak", weak).otherwise(low)
    refused = gated.where("status <> 'answer'").select("question_id", F.lit(REFUSAL).alias("answer"), F.array().cast("array<string>").alias("sources_cited"), F.lit(0.0).alias("confidence"), why.alias("warning"))
    return told.unionByName(refused)
