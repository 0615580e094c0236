"""Chat examples from question-answer corpora in their own shapes (sources.tables: SQUAD, HOTPOT, DOLLY) with a row `id`.

Ids are unique. Every choice is an order by a seeded hash. A null or blank context, answer or response makes no example;
examples of a kind stop at its quota, and a row serves one kind only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagebase.functions import text as T
from passagebase.operators import answering as A
from passagebase.operators import chunking as C
from passagebase.operators import trainset as D

# Categories with a context, and the last page a made-up source has.
GROUNDED, SUMMARY = ("closed_qa", "information_extraction"), ("summarization",)
SQUAD_PAGES, HOTPOT_PAGES = 39, 30


def _below(n: int | Column, seed: int, *keys) -> Column:
    """A number from 0 to n - 1 by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), n if isinstance(n, Column) else F.lit(n))


def _mixed(chunks: Column, seed: int) -> Column:
    """Chunks in an order by hash of their row and text."""
    placed = F.transform(chunks, lambda c: F.struct(F.xxhash64(F.lit(seed), F.col("id"), c["text"]).alias("o"), c["text"].alias("text"), c["source_file"].alias("source_file"), c["page"].alias("page")))
    return F.transform(F.array_sort(placed), lambda c: F.struct(c["source_file"].alias("source_file"), c["page"].alias("page"), c["text"].alias("text")))


def _chunk(source: Column, page: Column, text: Column) -> Column:
    return F.struct(source.alias("source_file"), page.cast("int").alias("page"), text.alias("text"))


def _placed(ctx: DataFrame, seed: int, buckets: int = 256) -> DataFrame:
    """Contexts with their place in their title's circle, from 0, and the title's number of contexts n.

    Places are counted within hash buckets of a title, after the buckets before, so a large title is not one task.
    """
    ctx = ctx.withColumn("o", D.shuffled(seed, "title", "context")).withColumn("bucket", F.pmod("o", F.lit(buckets)))
    sizes = ctx.groupBy("title", "bucket").agg(F.count(F.lit(1)).alias("size"))
    of_title = W.partitionBy("title").orderBy("bucket")
    before = F.coalesce(F.sum("size").over(of_title.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("title", "bucket", before.alias("before"), F.sum("size").over(W.partitionBy("title")).alias("n"))
    within = F.row_number().over(W.partitionBy("title", "bucket").orderBy("o", "context")) - 1
    return ctx.withColumn("within", within).join(sizes, ["title", "bucket"]).select("title", "context", (F.col("within") + F.col("before")).alias("place"), "n")


def squad_examples(rows: DataFrame, n_answerable: int, n_unanswerable: int, seed: int = 42) -> DataFrame:
    """(id, kind, messages): the row's context among 2 to 4 others of its title, with the sentence of its answer or a refusal.

    The contexts of a title stand in a circle; a row takes those that follow its own from a place by hash, so no pair of
    contexts is ever made that isn't shown. Pages of an example are distinct.
    """
    rows = rows.where("title is not null and context is not null")
    ctx = _placed(rows.select("title", "context").distinct(), seed)
    first = lambda c: F.try_element_at(F.col("answers")[c], F.lit(1))
    q = rows.withColumn("span", first("text")).withColumn("at", first("answer_start")).withColumn("answerable", F.coalesce(F.size("answers.text"), F.lit(0)) > 0)
    q = q.withColumn("sentence", F.when(F.col("answerable"), T.sentence_around(F.col("context"), F.col("at"), F.length("span"))))
    q = q.where("sentence is not null or not answerable").withColumn("kind", F.when(F.col("answerable"), "squad_answerable").otherwise("squad_unanswerable"))
    q = D.quota(q, {"squad_answerable": n_answerable, "squad_unanswerable": n_unanswerable}, seed, "id")
    q = q.select("id", "kind", "title", "context", "question", "sentence").join(ctx, ["title", "context"])
    taken = F.least(F.col("n") - 1, _below(3, seed + 1, "id") + 2)
    steps = F.when(taken > 0, F.transform(F.sequence(F.lit(0), taken - 1), lambda j: F.pmod(F.col("place") + 1 + F.pmod(_below(F.col("n") - 1, seed + 2, "id") + j, F.col("n") - 1), F.col("n"))))
    shown = q.select("id", "title", F.explode(F.concat(F.array("place"), F.coalesce(steps, F.array().cast("array<bigint>")))).alias("place"))
    shown = shown.join(ctx.select("title", "place", F.col("context").alias("text")), ["title", "place"])
    start = _below(SQUAD_PAGES, seed + 3, "id")
    chunks = shown.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 4), "id", "text").alias("o"), "text"))).alias("c"))
    file = T.file_name(F.col("title"))
    blocks = F.transform("c", lambda c, i: _chunk(file, F.pmod(start + i * 7, F.lit(SQUAD_PAGES)) + 1, c["text"]))
    target = F.when(F.col("kind") == "squad_answerable", D.with_sources(F.col("sentence"), F.array(file))).otherwise(F.lit(A.REFUSAL))
    return q.join(chunks, "id").select("id", "kind", D.example(A.prompt(blocks, F.col("question")), target).alias("messages"))


def hotpot_examples(rows: DataFrame, n_answerable: int, n_missing: int, seed: int = 42) -> DataFrame:
    """(id, kind, messages): supporting paragraphs and 2 or 3 others, answered by the fact that states the answer; or up to 4
    others alone, refused.

    Rows whose answer is yes or no, or is stated by no supporting fact of 4 to 60 words, are never answered.
    """
    titles, sentences = F.col("context.title"), F.col("context.sentences")
    wanted = F.col("supporting_facts.title")
    paragraphs = F.transform(F.arrays_zip(titles.alias("title"), sentences.alias("sentences")), lambda p: F.struct(
        F.xxhash64(F.lit(seed + 1), F.col("id"), p["title"]).alias("o"), p["title"].alias("title"),
        T.file_name(p["title"]).alias("source_file"), (F.pmod(F.xxhash64(F.lit(seed + 2), F.col("id"), p["title"]), F.lit(HOTPOT_PAGES)) + 1).cast("int").alias("page"),
        T.strip(F.array_join(p["sentences"], " ")).alias("text")))
    facts = F.transform(F.arrays_zip(wanted.alias("title"), F.col("supporting_facts.sent_id").alias("sent_id")), lambda f: T.strip(F.get(F.get(sentences, F.array_position(titles, f["title"]).cast("int") - 1), f["sent_id"])))
    states = lambda s: F.contains(F.lower(s), F.lower("answer")) & F.size(T.words(s)).between(4, 60)
    r = rows.withColumn("paragraphs", paragraphs).withColumn("stating", F.try_element_at(F.filter(facts, states), F.lit(1)))
    r = r.withColumn("supporting", F.filter("paragraphs", lambda p: F.array_contains(wanted, p["title"])))
    r = r.withColumn("others", F.array_sort(F.filter("paragraphs", lambda p: ~F.array_contains(wanted, p["title"]))))
    stated = r.where(~F.lower("answer").isin("yes", "no") & F.col("stating").isNotNull()).withColumn("kind", F.lit("hotpot_answerable"))
    answered = D.quota(stated, {"hotpot_answerable": n_answerable}, seed, "id")
    missing = r.join(answered.select("id"), "id", "left_anti").withColumn("kind", F.lit("hotpot_missing"))
    missing = D.quota(missing, {"hotpot_missing": n_missing}, seed, "id")
    files = F.transform("supporting", lambda p: p["source_file"])
    full = F.concat("supporting", F.slice("others", F.lit(1), (_below(2, seed + 3, "id") + 2).cast("int")))
    said = answered.select("id", "kind", D.example(A.prompt(_mixed(full, seed + 4), F.col("question")), D.with_sources(F.col("stating"), files)).alias("messages"))
    return said.unionByName(missing.select("id", "kind", D.example(A.prompt(_mixed(F.slice("others", 1, 4), seed + 4), F.col("question")), F.lit(A.REFUSAL)).alias("messages")))


def dolly_examples(rows: DataFrame, n_grounded: int, n_summary: int, n_mismatch: int, seed: int = 42) -> DataFrame:
    """(id, kind, messages): answers from a row's own passages and one other context, summaries of its passages, and refusals
    where only three other contexts are shown. Rows that are refused are those no answer was made from.
    """
    usable = rows.where((T.strip(F.col("context")) != "") & (T.strip(F.col("response")) != ""))
    grounded = usable.where(F.col("category").isin(*GROUNDED))
    used = D.quota(grounded.withColumn("kind", F.lit("dolly_grounded")), {"dolly_grounded": n_grounded}, seed, "id")
    unused = grounded.join(used.select("id"), "id", "left_anti").withColumn("kind", F.lit("dolly_mismatch"))
    unused = D.quota(unused, {"dolly_mismatch": n_mismatch}, seed, "id")
    summed = D.quota(usable.where(F.col("category").isin(*SUMMARY)).withColumn("kind", F.lit("dolly_summary")), {"dolly_summary": n_summary}, seed, "id")
    picked = used.unionByName(unused).unionByName(summed)
    name = lambda kind: F.concat(F.lit(kind + "_"), F.col("id").cast("string"), F.lit(".pdf"))
    own = C.passages(picked.where("kind <> 'dolly_mismatch'"), "id", "context").groupBy(F.col("key").alias("id")).agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("own"))
    wrong = D.distractors(picked.select("id"), "id", usable.select(F.col("id").alias("other"), F.col("context").alias("text")), "other", 3)
    wrong = wrong.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pick", "other", "text"))).alias("wrong"))
    e = picked.join(own, "id", "left").join(wrong, "id", "left")
    source = F.when(F.col("kind") == "dolly_summary", name("report")).otherwise(name("document"))
    mine = F.transform("own", lambda c: _chunk(source, c["part"] + 1, c["text"]))
    bad = F.coalesce(F.transform("wrong", lambda c: _chunk(F.concat(F.lit("reference_"), c["other"].cast("string"), F.lit(".pdf")), F.lit(1), c["text"])), F.array().cast("array<struct<source_file:string,page:int,text:string>>"))
    shown = F.when(F.col("kind") == "dolly_mismatch", bad).when(F.col("kind") == "dolly_summary", mine).otherwise(_mixed(F.concat(mine, F.slice(bad, 1, 1)), seed + 1))
    target = F.when(F.col("kind") == "dolly_mismatch", F.lit(A.REFUSAL)).otherwise(D.with_sources(F.col("response"), F.array(source)))
    return e.select("id", "kind", D.example(A.prompt(shown, F.col("instruction")), target).alias("messages"))


def mixed(parts: list[DataFrame], seed: int = 42) -> DataFrame:
    """All examples (id, kind, messages) in seeded order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(D.shuffled(seed, "kind", "id"), "kind", "id")
