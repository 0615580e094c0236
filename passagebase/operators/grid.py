"""Many settings of the retrieval pipeline in one plan: a stage runs once for each value of the knobs that it reads.

Chunks depend on max_tokens alone, so each value is chunked and its words are scored once. So are both rankings: they are read
as deep as the deepest of the fusions needs, and each rrf_k fuses the same ranks. The pool depends on max_tokens and rrf_k, and
only its depth on candidates and top_k: the deepest pool wanted is taken, with the pair scores of all its passages, and
smaller ones are its beginnings. Only the last steps (order, top_k, gate) are done for every setting, on pool rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagebase.functions import text as T
from passagebase.operators import answering as A
from passagebase.operators import retrieval as R
from passagebase.sources.shared import kept


@dataclass(frozen=True)
class Setting:
    """One run: the knobs of the pipeline, with their usual values."""

    run: str
    max_tokens: int = 300
    rrf_k: int = R.RRF_K
    candidates: int = 30
    top_k: int = 5
    use_gate: bool = False

    def depth(self) -> int:
        return max(self.candidates, self.top_k)


def pools(settings: list[Setting], questions: DataFrame, chunks_of: Callable[[int], tuple[DataFrame, DataFrame]], reranker: Callable[[Column, Column], Column]) -> DataFrame:
    """(max_tokens, rrf_k, question_id, chunk_id, text, pool_rank, cos, pair_score): one pool for each (max_tokens, rrf_k).

    chunks_of: the chunks (scope, chunk_id, text) of a size, and (scope, chunk_id, vec) of them all; called once for each size.
    """
    out = None
    asked = questions.select("question_id", "scope", "question")
    for size in sorted({s.max_tokens for s in settings}):
        chunks, embedded = chunks_of(size)
        depths = {k: max(s.depth() for s in settings if (s.max_tokens, s.rrf_k) == (size, k)) for k in sorted({s.rrf_k for s in settings if s.max_tokens == size})}
        hits = R.bm25(chunks, asked).where("score > 0").withColumn("score", F.round("score", 9))
        both = kept(R.both_ranks(embedded, hits, questions, max(R.depth(n, k) for k, n in depths.items())))
        for k, n in depths.items():
            best = R.best_fused(both, n, k).select(F.lit(size).alias("max_tokens"), F.lit(k).alias("rrf_k"), "question_id", "chunk_id", F.col("rank").alias("pool_rank"), "cos")
            found = best.join(asked, "question_id").join(chunks.select("scope", "chunk_id", "text"), ["scope", "chunk_id"]).withColumn("pair_score", reranker(F.col("question"), F.col("text"))).drop("scope")
            out = found if out is None else out.unionByName(found)
    return kept(out)


def run_all(settings: list[Setting], questions: DataFrame, chunks_of: Callable[[int], tuple[DataFrame, DataFrame]], reranker: Callable[[Column, Column], Column], hard: float = A.HARD_FLOOR, context: float = A.CONTEXT_FLOOR) -> DataFrame:
    """(run, question_id, chunk_id, rank, embed_score, rerank_score, status, used): what each setting retrieves for each question.

    status is the gate's (answer, below_floor, weak); used tells whether the passage goes into the prompt. Runs are named
    once each. questions: (question_id, scope, question, vec).
    """
    if len({s.run for s in settings}) < len(settings):
        raise ValueError("two settings have one name")
    spark = questions.sparkSession
    options = spark.createDataFrame([asdict(s) | {"depth": s.depth()} for s in settings], "run string, max_tokens int, rrf_k int, candidates int, top_k int, use_gate boolean, depth int")
    pool = pools(settings, questions, chunks_of, reranker).join(F.broadcast(options), ["max_tokens", "rrf_k"]).where(F.col("pool_rank") <= F.col("depth"))
    best = R.ranked(pool, "pair_score", [F.col("pool_rank")], ["run", "question_id"]).where(F.col("rank") <= F.col("top_k"))
    best = best.withColumn("embed_score", F.round("cos", 4)).withColumn("free", ~F.col("use_gate") | T.is_broad(F.col("question")))
    listed = F.sort_array(F.collect_list("embed_score"), asc=False)
    told = best.groupBy("run", "question_id").agg(F.first("free").alias("free"), listed.alias("scores"))
    top3 = F.aggregate(F.slice("scores", 1, 3), F.lit(0.0), lambda a, x: a + x) / F.least(F.size("scores"), F.lit(3))
    status = F.when(F.col("free"), "answer").when((F.col("scores")[0] < hard) & (top3 < hard), "below_floor").when(F.col("scores")[0] < context, "weak").otherwise("answer")
    status = told.select("run", "question_id", status.alias("status"))
    used = (F.col("status") == "answer") & (F.col("free") | (F.col("embed_score") >= context))
    return best.join(status, ["run", "question_id"]).select("run", "question_id", "chunk_id", "rank", "embed_score", F.round("pair_score", 4).alias("rerank_score"), "status", used.alias("used"))
