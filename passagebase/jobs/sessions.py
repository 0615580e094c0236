"""Queries on sources, sinks, sessions and incremental work. What they write goes to the session's shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagebase.jobs.answer import _ANSWERS
from passagebase.jobs.base import answers, files, query, questions, read, scratch
from passagebase.jobs.rank import _bm25, _FUSED, _STATS, asked_vectors, chunks, written_index
from passagebase.operators import answering as A
from passagebase.operators import chunking as C
from passagebase.operators import retrieval as R
from passagebase.operators import sessions as O
from passagebase.sources import index as X
from passagebase.sources import tables as I
from passagebase.streaming import ingest


def text_folder(spark, d) -> str:
    """Conversations as text files of about a thousand turns, written by Spark from the given table."""
    path, turns = scratch(spark), read(spark, d, "conversations")
    parts = max(8, turns.count() // 1000)
    c = turns.select(F.pmod("conv_id", F.lit(parts)).alias("part"), F.regexp_replace("text", r"\R", " ").alias("text"))
    c.repartition(parts, "part").write.partitionBy("part").text(path)
    return f"{path}/*"


@query()
def s1_scan_folder(spark, d):
    known, other = I.scan_folder(spark, text_folder(spark, d))
    return known.select("name", "length", F.lit(True).alias("supported")).unionByName(other.select("name", "length", F.lit(False).alias("supported")))


@query()
def s2_read_texts(spark, d):
    return I.read_texts(spark, text_folder(spark, d))


@query("SELECT source AS scope, doc_id::VARCHAR AS source_file, text FROM documents")
def s3_read_chunks(spark, d):
    path = scratch(spark)
    C.word_windows(files(spark, d), size=1 << 30, overlap=0).join(files(spark, d).select("source_file", F.col("text").alias("whole")), "source_file").select("scope", "source_file", "chunk_index", "chunk_id", F.col("whole").alias("text")).write.json(path)
    return I.read_json(spark, path, I.CHUNKS, array=False).select("scope", "source_file", "text")


def gold_rows(spark, d):
    q = questions(spark, d)
    return q.select(F.col("question_id").cast("string").alias("id"), F.col("scope").alias("doc"), F.lit("factoid").alias("type"), F.lit(True).alias("answerable"), "question", F.array("question").alias("evidence"), F.array("question").alias("answers"))


@query("SELECT item_id::VARCHAR AS id, 'src' || (item_id % 20) AS doc, text AS question, [text] AS answers FROM benchmark")
def s4_read_gold(spark, d):
    path = scratch(spark)
    gold_rows(spark, d).write.json(path)
    return I.read_json(spark, path, I.GOLD, array=False).select("id", "doc", "question", "answers")


@query("SELECT item_id::VARCHAR AS id, text AS query, 'paraphrased' AS type FROM benchmark")
def s5_read_cases(spark, d):
    path = scratch(spark)
    questions(spark, d).select(F.col("question_id").cast("string").alias("id"), F.col("question").alias("query"), F.lit("paraphrased").alias("type"), F.lit("ignored").alias("_comment")).write.json(path)
    return I.read_json(spark, path, I.CASES, array=False).select("id", "query", "type")


@query("SELECT source AS scope, count(*) AS n FROM documents GROUP BY source")
def s6_write_chunks(spark, d):
    path = scratch(spark)
    I.write_chunks(files(spark, d).withColumn("chunk_id", F.col("source_file")), path)
    return spark.read.parquet(path).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn FROM conversations WHERE role = 'assistant'")
def s7_write_csv(spark, d):
    path = scratch(spark)
    I.write_csv(answers(spark, d), path, ["conv_id", "turn"])
    return spark.read.csv(path, header=True)


@query("SELECT role, count(*) AS n FROM conversations GROUP BY role")
def s8_write_report(spark, d):
    path, c = scratch(spark), read(spark, d, "conversations")
    I.write_report(c.groupBy("role").agg(F.count(F.lit(1)).alias("n")), c.select("conv_id", "turn"), path)
    return spark.read.schema("role string, n long").json(f"{path}/metrics")


@query("SELECT 2 AS runs, 2 * count(*) AS rows FROM conversations")
def s9_append_history(spark, d):
    path = scratch(spark)
    for _ in range(2):
        I.append_history(read(spark, d, "conversations").agg(F.count(F.lit(1)).alias("rows")), path)
    return spark.read.schema("rows long").json(path).agg(F.count(F.lit(1)).cast("int").alias("runs"), F.sum("rows").alias("rows"))


@query("SELECT conv_id::VARCHAR AS id, text AS answer FROM conversations WHERE role = 'assistant'")
def s10_read_runs(spark, d):
    path = scratch(spark)
    row = F.struct(F.col("conv_id").cast("string").alias("id"), F.col("answer").alias("answer"), F.lit(True).alias("answerable"))
    answers(spark, d).select(F.lit("p").alias("pipeline"), F.array(row).alias("rows")).write.json(path)
    return I.saved_rows(spark, path, array=False).select("id", "answer")


@query("SELECT source AS title, text AS context, doc_id::VARCHAR AS question FROM documents")
def s11_read_corpora(spark, d):
    path = scratch(spark)
    one = F.struct(F.array(F.lit("x")).alias("text"), F.array(F.lit(0)).alias("answer_start"))
    files(spark, d).select(F.col("scope").alias("title"), F.col("text").alias("context"), F.col("source_file").alias("question"), one.alias("answers")).write.json(path)
    return spark.read.schema(I.SQUAD).json(path).select("title", "context", "question")


@query(f"WITH {_STATS} SELECT scope, n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df WHERE df.scope = st.scope) AS terms FROM st")
def s12_write_index(spark, d):
    path = scratch(spark)
    X.append(files(spark, d).withColumn("chunk_id", F.col("source_file")).select("scope", "source_file", "chunk_id", "text"), path)
    index = X.read(spark, path)
    terms = index["term_stats"].groupBy("scope").agg(F.count(F.lit(1)).alias("terms"))
    return index["scope_stats"].join(terms, "scope").select("scope", "n", F.round("avgdl", 6).alias("avgdl"), "terms")


@query("SELECT source AS scope, doc_id AS chunk_id FROM documents WHERE doc_id % 3 <> 0")
def s13_new_only(spark, d):
    c = chunks(spark, d).select("scope", "chunk_id")
    return I.new_only(c.unionAll(c), c.where("chunk_id % 3 = 0"))


@query(f"WITH {_bm25(True)} SELECT question_id, scope, count(*) AS passages FROM bm GROUP BY ALL")
def o1_isolation(spark, d):
    """Passages of each question's own scope that share a term with it."""
    return R.bm25(chunks(spark, d), questions(spark, d)).groupBy("question_id", "scope").agg(F.count(F.lit(1)).alias("passages"))


def sessions(spark, d):
    e = read(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("mtime"))
    return e.select(F.when(F.col("user_id") == 1, "demo").otherwise(F.col("user_id").cast("string")).alias("session_id"), "mtime")


@query("WITH s AS (SELECT CASE WHEN user_id = 1 THEN 'demo' ELSE user_id::VARCHAR END AS session_id, max(ts) AS mtime FROM events GROUP BY user_id) SELECT session_id FROM (SELECT session_id FROM s WHERE session_id <> 'demo' ORDER BY mtime DESC, session_id LIMIT 5) UNION ALL SELECT session_id FROM s WHERE session_id = 'demo'")
def o2_newest_sessions(spark, d):
    """The newest five (the feature is a top-n) and the demo session."""
    return O.newest(sessions(spark, d)).select("session_id")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND conv_id NOT IN (SELECT doc_id FROM labels)")
def o3_unknown_sessions(spark, d):
    q = read(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session_id"), "turn")
    return O.unknown(q, read(spark, d, "labels").select(F.col("doc_id").alias("session_id"))).select(F.col("session_id").alias("conv_id"), "turn")


@query(f"WITH {_ANSWERS}")
def o4_batch_chat(spark, d):
    from passagebase.jobs.answer import asked

    return A.answer_questions(asked(spark, d), use_gate=False, parallel=4)


@query(f"WITH {_STATS} SELECT scope, n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df WHERE df.scope = st.scope) AS terms FROM st WHERE scope IN (SELECT source FROM documents GROUP BY source ORDER BY max(doc_id) DESC LIMIT 5)")
def o2_expired_from_index(spark, d):
    """An index of all sources as sessions, then only the five with the newest document stay in every table."""
    path, own = scratch(spark), files(spark, d)
    X.append(own.withColumn("chunk_id", F.col("source_file")).select("scope", "source_file", "chunk_id", "text"), path)
    stay = O.newest(own.groupBy(F.col("scope").alias("session_id")).agg(F.max("doc_id").alias("mtime")))
    X.drop_scopes(spark, path, O.expired(spark.read.parquet(f"{path}/chunks"), stay))
    index = X.read(spark, path)
    held = index["term_stats"].groupBy("scope").agg(F.count(F.lit(1)).alias("terms"))
    return index["scope_stats"].join(held, "scope").select("scope", "n", F.round("avgdl", 6).alias("avgdl"), "terms")


def session_files(spark, d) -> str:
    """Documents as text files of about 256, in a folder a source: what uploads of several sessions look like."""
    path, docs = scratch(spark), read(spark, d, "documents")
    parts = max(1, docs.count() // (256 * 20))
    rows = docs.select(F.col("source").alias("scope"), F.pmod("doc_id", F.lit(parts)).alias("part"), "text")
    rows.repartition("scope", "part").write.partitionBy("part", "scope").text(path)
    return path


@query()
def o5_stream_ingest(spark, d):
    """Text files of several scopes ingested twice: the second run finds nothing new."""
    source, path = session_files(spark, d), scratch(spark)
    for run in range(2):
        ingest.ingest(spark, source, path, f"{path}/checkpoint{run}").awaitTermination()
    return spark.read.parquet(f"{path}/chunks").select("scope", "source_file", "chunk_index", "text")


@query("SELECT source AS scope, true AS same FROM documents GROUP BY source")
def o5_statistics_of_batches(spark, d):
    """The index appended in three batches, the first two compacted: counts by scope and term are those of one batch."""
    whole, path = scratch(spark), scratch(spark)
    c = chunks(spark, d)
    X.append(c, whole)
    for i in range(3):
        X.append(c.where(F.pmod("chunk_id", F.lit(3)) == i), path, i)
    X.compact(spark, path, 1)
    one, many = X.read(spark, whole), X.read(spark, path)
    none = F.lit(None).cast("long")  # a term that one side lacks has no sum there
    df = X.count_rows(spark, whole, "term_counts").select("scope", "term", "df", none.alias("df2"))
    df2 = X.count_rows(spark, path, "term_counts").select("scope", "term", none.alias("df"), F.col("df").alias("df2"))
    terms = df.unionByName(df2).groupBy("scope", "term").agg(F.sum("df").alias("df"), F.sum("df2").alias("df2"))
    terms = terms.groupBy("scope").agg(F.min(F.col("df").eqNullSafe(F.col("df2"))).alias("t"))
    stats = one["scope_stats"].join(many["scope_stats"].select("scope", F.col("n").alias("n2"), F.col("avgdl").alias("a2")), "scope", "full")
    return stats.join(terms, "scope").select("scope", (F.col("t") & (F.col("n") == F.col("n2")) & (F.col("avgdl") == F.col("a2"))).alias("same"))


@query(f"WITH {_bm25(True)}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm WHERE score > 0) SELECT question_id, chunk_id, rank FROM r WHERE rank <= 5")
def o6_stream_questions(spark, d):
    """Questions as a stream against the written postings of their scopes; no text is taken apart for a batch."""
    source, path = scratch(spark), scratch(spark)
    questions(spark, d).write.parquet(source)
    X.append(chunks(spark, d), f"{path}/index")
    stream = spark.readStream.schema("question_id long, question string, scope string").parquet(source)

    def best(batch):
        index = X.read(batch.sparkSession, f"{path}/index", batch)
        own = R.bm25_of(index["postings"], index["term_stats"], index["scope_stats"], batch).where("score > 0").withColumn("score", F.round("score", 9))
        return R.ranked(own, "score", [F.col("chunk_id")], ["question_id"]).where("rank <= 5").select("question_id", "chunk_id", "rank")

    ingest.answer_stream(stream, best, f"{path}/answers", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/answers").select("question_id", "chunk_id", "rank")


@query(f"WITH {_FUSED} SELECT question_id, chunk_id, rank, similarity_score FROM rk WHERE rank <= 5")
def o6_stream_retrieval(spark, d):
    """Questions as a stream, each batch answered by hybrid retrieval from the index as it was written."""
    source, path = scratch(spark), scratch(spark)
    asked_vectors(spark, d).write.parquet(source)
    index = written_index(spark, d)
    stream = spark.readStream.schema("question_id long, question string, scope string, vec array<double>").parquet(source)
    found = lambda batch: R.retrieve(X.read(batch.sparkSession, index, batch), batch).select("question_id", "chunk_id", "rank", "similarity_score")
    ingest.answer_stream(stream, found, f"{path}/answers", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/answers").select("question_id", "chunk_id", "rank", "similarity_score")
