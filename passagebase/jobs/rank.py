"""Queries on keyword statistics, vectors, fusion and reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagebase.functions import text as T
from passagebase.jobs.base import files, query, questions, read, scratch
from passagebase.operators import retrieval as R
from passagebase.operators import vectors as V
from passagebase.sources import index as I  # noqa: E741
from passagebase.sources.shared import kept

_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_STATS = f"""tk AS (SELECT source AS scope, doc_id AS chunk_id, {_TOK} AS toks FROM documents),
tf AS (SELECT scope, chunk_id, term, count(*) AS tf FROM (SELECT scope, chunk_id, unnest(toks) AS term FROM tk) GROUP BY ALL),
st AS (SELECT scope, count(*) AS n, avg(len(toks)) AS avgdl FROM tk GROUP BY scope),
df AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT df.*, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN st USING (scope)),
fl AS (SELECT scope, 0.25 * avg(raw) AS floor FROM raw GROUP BY scope),
idf AS (SELECT raw.scope, term, df, CASE WHEN raw >= 0 THEN raw ELSE floor END AS idf FROM raw JOIN fl USING (scope))"""


def _bm25(scoped: bool) -> str:
    return f"""{_STATS},
qt AS (SELECT item_id AS question_id, 'src' || (item_id % 20) AS q_scope, term, count(*) AS times FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT question_id, tf.scope, tf.chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))) AS score
  FROM qt JOIN tf USING (term) JOIN idf ON idf.scope = tf.scope AND idf.term = tf.term JOIN tk ON tk.chunk_id = tf.chunk_id AND tk.scope = tf.scope JOIN st ON st.scope = tf.scope {"WHERE q_scope = tf.scope" if scoped else ""} GROUP BY ALL)"""


_NORM = "list_transform(embedding::DOUBLE[], lambda x: x / (CASE WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0 THEN 1 ELSE sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) END))"
_COS = f"""v AS (SELECT vec_id, {_NORM} AS vec FROM embeddings),
cs AS (SELECT item_id AS question_id, d.source AS scope, d.doc_id AS chunk_id, coalesce(list_dot_product(qv.vec, cv.vec), 0.0::DOUBLE) AS cos
  FROM benchmark b JOIN documents d ON d.source = 'src' || (b.item_id % 20) LEFT JOIN v qv ON qv.vec_id = b.item_id LEFT JOIN v cv ON cv.vec_id = d.doc_id),
er AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY cos DESC, chunk_id) AS embed_rank FROM cs)"""
_FUSED = f"""{_bm25(True)}, {_COS},
br AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS bm25_rank FROM bm WHERE score > 0),
fu AS (SELECT er.*, bm25_rank, round(coalesce(1.0::DOUBLE / (10 + bm25_rank), 0), 6) AS bm25_rrf, round(1.0::DOUBLE / (10 + embed_rank) + coalesce(1.0::DOUBLE / (10 + bm25_rank), 0), 6) AS similarity_score FROM er LEFT JOIN br USING (question_id, chunk_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity_score DESC, chunk_id) AS rank FROM fu)"""


def chunks(spark, d):
    return files(spark, d).select("scope", F.col("doc_id").alias("chunk_id"), "text")


def vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", R.unit_vector(F.col("embedding")).alias("vec"))


def embed_ranks(spark, d):
    """Cosine and full embedding rank of each question over all chunks of its scope; without a vector the cosine is 0."""
    v = vectors(spark, d)
    c = chunks(spark, d).select("scope", "chunk_id").join(v.withColumnRenamed("vec_id", "chunk_id"), "chunk_id", "left")
    q = questions(spark, d).select("question_id", "scope").join(v.withColumnRenamed("vec_id", "question_id"), "question_id", "left")
    return R.ranked(R.cosine(c, q), "cos", [F.col("chunk_id")], ["question_id"], "embed_rank")


def bm25_ranks(spark, d):
    own = chunks(spark, d)
    s = R.bm25(own, questions(spark, d)).where("score > 0").withColumn("score", F.round("score", 9))
    return R.ranked(s, "score", [F.col("chunk_id")], ["question_id"], "bm25_rank")


def fused(spark, d, k=R.RRF_K):
    return R.fuse(embed_ranks(spark, d), bm25_ranks(spark, d), k)


def pool(spark, d, k=30):
    """The k best fused chunks of each question: both rankings are read only as deep as these need."""
    v = vectors(spark, d).withColumnRenamed("vec_id", "chunk_id")
    own = chunks(spark, d)
    hits = R.bm25(own, questions(spark, d)).where("score > 0").withColumn("score", F.round("score", 9))
    return kept(R.hybrid(own.select("scope", "chunk_id").join(v, "chunk_id", "left"), hits, asked_vectors(spark, d), k))


@query(f"SELECT doc_id, {_TOK} AS tokens FROM documents")
def k1_tokens(spark, d):
    return files(spark, d).select("doc_id", T.tokens(F.col("text")).alias("tokens"))


@query(f"WITH {_STATS} SELECT scope, n, round(avgdl, 6) AS avgdl FROM st")
def k2_scope_stats(spark, d):
    return R.scope_stats(chunks(spark, d)).select("scope", "n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_STATS} SELECT scope, chunk_id, term, tf FROM tf")
def k2_postings(spark, d):
    return R.postings(chunks(spark, d))


@query(f"WITH {_STATS} SELECT scope, term, df, round(idf, 6) AS idf FROM idf")
def k3_idf(spark, d):
    c = chunks(spark, d)
    return R.idf(R.frequencies(c), R.scope_stats(c), R.few_scopes(c)).select("scope", "term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_bm25(False)} SELECT question_id, scope, chunk_id, round(score, 6) AS score FROM bm")
def k4_bm25_scores(spark, d):
    return R.bm25(chunks(spark, d), questions(spark, d, scoped=False)).withColumn("score", F.round("score", 6))


@query(f"WITH {_FUSED} SELECT question_id, chunk_id, bm25_rank FROM br")
def k5_bm25_ranks(spark, d):
    return bm25_ranks(spark, d).select("question_id", "chunk_id", "bm25_rank")


@query()
def e1_embed(spark, d):
    """Document vectors by the default hashing embedder, in Arrow batches."""
    from passagebase.operators.models import embed

    return embed(chunks(spark, d), "text").select("chunk_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


@query(f"SELECT vec_id, list_transform({_NORM}, lambda x: round(x, 6)) AS vec FROM embeddings")
def e2_unit_vectors(spark, d):
    return vectors(spark, d).select("vec_id", F.transform("vec", lambda x: R.rounded(x, 6)).alias("vec"))


@query()
def e3_question_prefix(spark, d):
    from passagebase.operators.models import embed

    q = questions(spark, d).withColumn("question", F.concat(F.lit("Represent this question for searching relevant passages: "), "question"))
    return embed(q, "question").select("question_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


@query(f"WITH {_COS} SELECT question_id, scope, chunk_id, round(cos, 4) AS embed_score FROM cs")
def e4_cosine(spark, d):
    return embed_ranks(spark, d).select("question_id", "scope", "chunk_id", R.rounded(F.col("cos"), 4).alias("embed_score"))


@query(f"WITH {_COS} SELECT question_id, chunk_id, embed_rank FROM er")
def e5_embed_ranks(spark, d):
    return embed_ranks(spark, d).select("question_id", "chunk_id", "embed_rank")


@query(f"""WITH v AS (SELECT vec_id, {_NORM} AS vec FROM embeddings),
c AS (SELECT b.item_id AS question_id, cv.vec_id AS chunk_id, list_dot_product(qv.vec, cv.vec) AS cos FROM benchmark b JOIN v qv ON qv.vec_id = b.item_id CROSS JOIN v cv)
SELECT question_id, chunk_id, rank, round(cos, 6) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY cos DESC, chunk_id) AS rank FROM c) WHERE rank <= 10""")
def e4_corpus_nearest(spark, d):
    """The ten nearest vectors of the whole table for every question, by block products: a top-k report."""
    v = vectors(spark, d).withColumn("scope", F.lit("all"))
    q = questions(spark, d, scoped=False).select("question_id").join(v.withColumnRenamed("vec_id", "question_id"), "question_id")
    return V.nearest(v.withColumnRenamed("vec_id", "chunk_id"), q, 10).select("question_id", "chunk_id", "rank", F.round("cos", 6).alias("cos"))


@query(f"WITH {_FUSED} SELECT question_id, chunk_id, bm25_rrf, similarity_score FROM fu")
def f1_fusion(spark, d):
    return fused(spark, d).select("question_id", "chunk_id", "bm25_rrf", "similarity_score")


@query(f"WITH {_FUSED} SELECT question_id, chunk_id, rank, similarity_score, round(cos, 4) AS embed_score FROM rk WHERE rank <= 5")
def f2_retrieve(spark, d):
    return pool(spark, d, 5).select("question_id", "chunk_id", "rank", "similarity_score", F.round("cos", 4).alias("embed_score"))


_RERANK = f"""{_FUSED},
sc AS (SELECT rk.question_id, rk.chunk_id, rk.rank AS pool_rank, rk.cos,
   (SELECT count(DISTINCT t) FROM unnest(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS x(t) WHERE list_contains(regexp_extract_all(lower(doc.text), '[a-z0-9]+'), t))
   / greatest(1, len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+'))))::DOUBLE AS s
  FROM rk JOIN benchmark b ON b.item_id = rk.question_id JOIN documents doc ON doc.doc_id = rk.chunk_id WHERE rank <= 30),
rr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, pool_rank) AS rank FROM sc)"""


def reranked(spark, d, k=5):
    """Pool of 30, then the share of the question's words that a passage holds, then the best k."""
    texts = chunks(spark, d).select("chunk_id", "text")
    p = pool(spark, d, 30).join(texts, "chunk_id").join(questions(spark, d).select("question_id", "question"), "question_id")
    return R.rerank(p, word_share(F.col("question"), F.col("text")), k)


def word_share(question, text):
    """Share of the question's distinct words that the text holds."""
    q = F.array_distinct(T.tokens(question))
    return F.size(F.array_intersect(q, T.tokens(text))) / F.greatest(F.lit(1), F.size(q))


def written_index(spark, d):
    """The index of all chunks, written; the folder."""
    path = scratch(spark)
    I.append(chunks(spark, d), path, vectors=vectors(spark, d).withColumnRenamed("vec_id", "chunk_id"))
    return path


def asked_vectors(spark, d):
    return questions(spark, d).join(vectors(spark, d).withColumnRenamed("vec_id", "question_id"), "question_id", "left")


@query(f"WITH {_FUSED} SELECT question_id, chunk_id, rank, similarity_score FROM rk WHERE rank <= 5")
def f2_retrieve_from_index(spark, d):
    q = asked_vectors(spark, d)
    return R.retrieve(I.read(spark, written_index(spark, d), q), q).select("question_id", "chunk_id", "rank", "similarity_score")


@query(f"WITH {_RERANK} SELECT question_id, chunk_id, rank, round(s, 4) AS rerank_score FROM rr WHERE rank <= 5")
def f3_rerank_from_index(spark, d):
    q = asked_vectors(spark, d)
    return R.retrieve(I.read(spark, written_index(spark, d), q), q, 5, word_share).select("question_id", "chunk_id", "rank", "rerank_score")


@query(f"WITH {_RERANK} SELECT question_id, chunk_id, rank FROM rr WHERE rank <= 5")
def f3_retrieve_reranked(spark, d):
    return reranked(spark, d).select("question_id", "chunk_id", "rank")


_SPLIT = r"list_filter(string_split_regex(lower({}), '\s+'), lambda x: x <> '')"


@query(f"""WITH {_FUSED}, w AS (SELECT rk.question_id, rk.chunk_id, list_distinct({_SPLIT.format("b.text")}) AS q, {_SPLIT.format("doc.text")} AS p
FROM rk JOIN benchmark b ON b.item_id = rk.question_id JOIN documents doc ON doc.doc_id = rk.chunk_id WHERE rank <= 30)
SELECT question_id, chunk_id, round(len(list_intersect(q, p)) / greatest(1, len(q))::DOUBLE, 4) AS rerank_score FROM w""")
def r1_rerank_scores(spark, d):
    """Pair scores by the default scorer hook over the pool."""
    from passagebase.operators.models import score_pairs

    p = pool(spark, d, 30).join(chunks(spark, d).select("chunk_id", "text"), "chunk_id").join(questions(spark, d).select("question_id", "question"), "question_id")
    return p.select("question_id", "chunk_id", F.round(score_pairs()("question", "text"), 4).alias("rerank_score"))


@query(f"WITH {_RERANK} SELECT question_id, chunk_id, rank, round(s, 4) AS rerank_score FROM rr WHERE rank <= 5")
def r2_rerank(spark, d):
    return reranked(spark, d).select("question_id", "chunk_id", "rank", "rerank_score")


@query(f"""WITH {_bm25(False).replace("source AS scope", "'all' AS scope")}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm WHERE score > 0),
e AS (SELECT b.item_id AS question_id, min(rank) AS evidence_rank FROM benchmark b LEFT JOIN (SELECT r.question_id, r.rank, doc.text FROM r JOIN documents doc ON doc.doc_id = r.chunk_id WHERE rank <= 10) t
  ON t.question_id = b.item_id AND contains(lower(t.text), lower(b.text)) GROUP BY ALL)
SELECT count(*) AS n, round(avg(CASE WHEN evidence_rank <= 1 THEN 1 ELSE 0 END), 4) AS hit_1, round(avg(CASE WHEN evidence_rank <= 5 THEN 1 ELSE 0 END), 4) AS hit_5, round(avg(coalesce(1.0 / evidence_rank, 0)), 4) AS mrr FROM e""")
def minimum_slice(spark, d):
    """BM25 over the whole corpus as one scope, evidence rank in the top 10, hit rates and mean reciprocal rank."""
    q, c = questions(spark, d, scoped=False), chunks(spark, d).withColumn("scope", F.lit("all"))
    s = R.bm25(c, q).where("score > 0").withColumn("score", F.round("score", 9))
    best = R.ranked(s, "score", [F.col("chunk_id")], ["question_id"]).where("rank <= 10").join(c.select("chunk_id", "text"), "chunk_id")
    hits = best.join(q.select("question_id", "question"), "question_id").where(F.contains(F.lower("text"), F.lower("question"))).groupBy("question_id").agg(F.min("rank").alias("evidence_rank"))
    e = q.select("question_id").join(hits, "question_id", "left")
    rate = lambda k: F.round(F.avg(F.when(F.col("evidence_rank") <= k, 1).otherwise(0)), 4)
    return e.agg(F.count(F.lit(1)).alias("n"), rate(1).alias("hit_1"), rate(5).alias("hit_5"), F.round(F.avg(F.coalesce(1 / F.col("evidence_rank"), F.lit(0.0))), 4).alias("mrr"))
