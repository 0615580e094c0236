"""Training sets from question-answer corpora: hard negatives, pairs, dev groups, chat examples, quotas.

Randomness is an order by a seeded hash of the row's key: reproducible, and the same whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagebase.functions import text as T
from passagebase.operators import retrieval as R

# Sample sizes and the example layout.
HARD, FROM_TOP, DEV = 3, 6, 29
MIX = {"squad_answerable": 1500, "squad_unanswerable": 600, "hotpot_answerable": 1200, "hotpot_missing": 350, "table_answerable": 750, "table_unanswerable": 450, "dolly_grounded": 1300, "dolly_summary": 500, "dolly_mismatch": 200}
REFUSAL_KINDS = ("squad_unanswerable", "hotpot_missing", "table_unanswerable", "dolly_mismatch")
SYSTEM = "Answer from the numbered passages only. Say so when they don't hold the answer. Name the sources you used."


def shuffled(seed: int, *keys: str) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def seeded(seed: int, *keys: str) -> Column:
    """An order that any engine can repeat: MD5 of the seed and the keys as text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def contexts(rows: DataFrame) -> DataFrame:
    """(title, context_id, context): distinct contexts of each title; context_id is the first position."""
    return rows.groupBy("title", "context").agg(F.min("pos").alias("context_id"))


def ranked_others(ctx: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, title, context_id, score, rank): the title's other contexts by BM25, zero scores kept.

    questions: (question_id, title, context_id of their own, question). Titles with one context drop out.
    """
    many = ctx.groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("title")
    c = ctx.join(many, "title", "left_semi").withColumnRenamed("title", "scope")
    q = questions.withColumnRenamed("title", "scope").join(many.withColumnRenamed("title", "scope"), "scope", "left_semi")
    scores = R.bm25(c.select("scope", "context_id", F.col("context").alias("text")), q.select("question_id", "scope", "question"), key="context_id")
    pairs = q.select("question_id", "scope", F.col("context_id").alias("own")).join(c.select("scope", "context_id"), "scope").where("context_id <> own")
    out = pairs.join(scores, ["question_id", "scope", "context_id"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    return R.ranked(out, "score", [F.col("context_id")], ["question_id"]).withColumnRenamed("scope", "title").drop("own")


def hard_negatives(ranks: DataFrame, seed: int = 42, k: int = HARD, top: int = FROM_TOP) -> DataFrame:
    """Up to k of each question's `top` best other contexts."""
    w = W.partitionBy("question_id").orderBy(seeded(seed, "question_id", "context_id"))
    return ranks.where(F.col("rank") <= top).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k)


def capped(questions: DataFrame, ctx: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n questions in seeded order, of titles with more than one context."""
    many = ctx.groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("title")
    return questions.join(many, "title", "left_semi").orderBy(seeded(seed, "question_id"), "question_id").limit(n)


def pairs(questions: DataFrame, ctx: DataFrame, hard: DataFrame) -> DataFrame:
    """(query, passage, label): own context positive for answerable questions, negative for others, then hard negatives."""
    text = ctx.select("context_id", F.col("context").alias("passage"))
    own = questions.join(text, "context_id").select("question_id", F.col("question").alias("query"), "passage", F.col("answerable").cast("double").alias("label"))
    q = questions.select("question_id", F.col("question").alias("query"), "answerable")
    neg = hard.join(q, "question_id").where(F.col("answerable") | (F.col("pick") <= 2)).join(text, "context_id").select("question_id", "query", "passage", F.lit(0.0).alias("label"))
    return own.unionByName(neg)


def dev_groups(questions: DataFrame, ctx: DataFrame, ranks: DataFrame, k: int = DEV) -> DataFrame:
    """(question_id, query, positive, negative): answerable questions with their k best other contexts in order."""
    text = ctx.select("context_id", F.col("context").alias("passage"))
    q = questions.where("answerable")
    neg = ranks.where(F.col("rank") <= k).join(text, "context_id").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "passage"))).alias("n"))
    return q.join(text, "context_id").join(neg, "question_id").select("question_id", F.col("question").alias("query"), F.array("passage").alias("positive"), F.transform("n", lambda x: x["passage"]).alias("negative"))


def with_sources(answer: Column, sources: Column) -> Column:
    return F.concat(T.strip(answer), F.lit("\n\nSources:\n"), F.array_join(F.array_distinct(sources), "\n"))


def example(user: Column, target: Column, system: str = SYSTEM) -> Column:
    """Three messages: system, user, assistant."""
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(say("system", F.lit(system)), say("user", user), say("assistant", target))


def quota(rows: DataFrame, limits: dict[str, int], seed: int, *keys: str) -> DataFrame:
    """At most limits[kind] rows of each kind, by seeded order; kinds without a limit go.

    Few kinds make few large groups, so most rows are dropped by a hash threshold from the kind's count beforehand.
    """
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame(list(limits.items()), "kind string, quota long"))  # one row a kind
    sizes = F.broadcast(rows.groupBy("kind").agg(F.count(F.lit(1)).alias("size")))
    h = shuffled(seed, *keys)
    share = (F.col("quota") + 100 + 10 * F.sqrt("quota")) / F.col("size")
    near = rows.withColumn("h", h).join(table, "kind").join(sizes, "kind").where(F.pmod("h", F.lit(1_000_000)) < F.greatest(share, F.lit(0.0)) * 1_000_000)
    w = W.partitionBy("kind").orderBy(F.pmod("h", F.lit(1_000_000)), "h", *keys)
    return near.withColumn("at", F.row_number().over(w)).where("at <= quota").drop("h", "quota", "size", "at")


def distractors(rows: DataFrame, key: str, others: DataFrame, other_key: str, k: int, seed: int = 42) -> DataFrame:
    """(key, pick, columns of others): k different others for each key, never the one of the same key; pick counts from 1.

    The others stand in a circle in seeded order; each key starts at a place of its own and takes those that follow. Where
    there are fewer others, all are taken. Places are joined by number: never a cross join.
    """
    n = others.count()
    # Places in two steps: rank within hash buckets, plus the rows of the buckets before.
    placed = others.withColumn("__order", shuffled(seed, other_key)).withColumn("__bucket", F.pmod("__order", F.lit(256)))
    sizes = placed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__bucket", before.alias("__before"))  # 256 rows
    within = F.row_number().over(W.partitionBy("__bucket").orderBy("__order", other_key)) - 1
    placed = placed.withColumn("__place", within).join(F.broadcast(sizes), "__bucket").withColumn("__place", F.col("__place") + F.col("__before")).drop("__order", "__bucket", "__before")
    steps = F.explode(F.sequence(F.lit(0), F.lit(min(k, max(n - 1, 0))))).alias("__step")
    wanted = rows.select(F.col(key).alias("__key")).distinct().select("__key", steps).withColumn("__place", F.pmod(F.xxhash64(F.lit(seed), "__key") + F.col("__step"), F.lit(max(n, 1))))
    met = wanted.join(placed, "__place").where(~F.col(other_key).eqNullSafe(F.col("__key")))
    picked = met.withColumn("__pick", F.row_number().over(W.partitionBy("__key").orderBy("__step"))).where(F.col("__pick") <= k)
    return picked.select(F.col("__key").alias(key), F.col("__pick").alias("pick"), *others.columns)
