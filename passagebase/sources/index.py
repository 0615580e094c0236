"""The index of passages as tables in bucket folders: appended batch by batch, read only in the buckets asked for.

Every table lies in folders bucket=<hash of the scope>/batch=<number>. What a batch adds to the statistics is a table of its own
(counts by scope and by term), so that appending reads nothing but its own passages, and sums of counts equal a
rebuild. A batch that is written again replaces its own folders. compact() adds up the counts of finished batches;
drop_scopes() rewrites just the folders that hold a scope, with the others' files left as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagebase.operators import retrieval as R
from passagebase.operators.models import embed
from passagebase.sources.shared import kept

BUCKETS = 64
#: Tables in bucket folders; the last two are counts that are added up over batches.
TABLES = ("chunks", "embeddings", "postings", "scope_counts", "term_counts")
COUNTS = {"scope_counts": (["scope"], ["n", "tokens"]), "term_counts": (["scope", "term"], ["df"])}


def bucket_of(scope: str = "scope", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(scope), F.lit(buckets)).cast("int")


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _path(spark, path)
    fs.delete(where, True)


def asked_buckets(rows: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the scopes of some rows: at most `buckets` numbers."""
    return sorted(r["bucket"] for r in rows.select(bucket_of(buckets=buckets).alias("bucket")).distinct().collect())


def _put(rows: DataFrame, path: str, order: list[str], batch: int, buckets: int, part: str = "batch", spread: bool = True) -> None:
    """Rows to their bucket folders; large buckets are split over tasks, small ones share one (rebalance).

    Without `spread` rows are written by the task that has them, which suits rows made of a table in such folders.
    """
    rows = rows.withColumn("bucket", bucket_of(buckets=buckets)).withColumn(part, F.lit(batch).cast("long"))
    rows = (rows.hint("rebalance", "bucket") if spread else rows).sortWithinPartitions("bucket", *order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", part).parquet(path)


def _part(spark: SparkSession, path: str, name: str, batch: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").where(F.col("batch") == batch)


def append(chunks: DataFrame, path: str, batch: int = 0, vectors: DataFrame | None = None, model: Callable[[list[str]], np.ndarray] | None = None, buckets: int = BUCKETS) -> None:
    """One batch of passages (scope, chunk_id, text, ...) with all that belongs to them.

    Texts are taken apart twice, for lengths and for postings, each time in one pass over a row; postings are written where
    their passages are read, bucket by bucket, without a shuffle. vectors: (chunk_id, vec), unit vectors; or a model, which
    is asked once for each text that the index has not seen yet.
    """
    spark = chunks.sparkSession
    _put(chunks.withColumn("dl", R.token_count(F.col("text").cast("string"))).withColumn("text_sha", F.sha2(F.col("text").cast("binary"), 256)), f"{path}/chunks", ["scope", "chunk_id"], batch, buckets)
    own = _part(spark, path, "chunks", batch)
    _put(R.postings(own, keep=("dl",)), f"{path}/postings", [], batch, buckets, spread=False)
    _put(own.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("tokens")), f"{path}/scope_counts", ["scope"], batch, buckets)
    _put(_part(spark, path, "postings", batch).groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df")), f"{path}/term_counts", ["scope", "term"], batch, buckets)
    if model is not None:
        vectors = own.select("scope", "chunk_id", "text_sha").join(text_vectors(own, path, model, batch), "text_sha")
    elif vectors is not None:
        vectors = own.select("scope", "chunk_id").join(vectors.select("chunk_id", "vec"), "chunk_id")
    if vectors is not None:
        _put(vectors.select("scope", "chunk_id", "vec"), f"{path}/embeddings", ["scope", "chunk_id"], batch, buckets)


def text_vectors(chunks: DataFrame, path: str, model: Callable[[list[str]], np.ndarray], batch: int) -> DataFrame:
    """(text_sha, vec) of texts in the index, by content: the model is asked for each new text once, whatever chunk holds it."""
    spark, place = chunks.sparkSession, f"{path}/vectors"
    texts = chunks.select("text_sha", "text").dropDuplicates(["text_sha"])
    if exists(spark, place):
        texts = texts.join(spark.read.parquet(place).where(F.col("batch") != batch).select("text_sha"), "text_sha", "left_anti")
    made = embed(texts, "text", model).select("text_sha", R.unit_vector(F.col("embedding")).alias("vec"))
    made.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(place)
    # A spare schema: a batch without new texts may be the first one.
    return spark.read.schema("text_sha string, vec array<double>, batch long").parquet(place).select("text_sha", "vec")


def _upto(spark: SparkSession, path: str, name: str) -> dict[int, int]:
    """The last batch that compact() has added up, by bucket; read from folder names."""
    if not exists(spark, f"{path}/{name}_sums"):
        return {}
    rows = spark.read.parquet(f"{path}/{name}_sums").groupBy("bucket").agg(F.max("upto").alias("upto")).collect()
    return {r["bucket"]: r["upto"] for r in rows}


def counts(spark: SparkSession, path: str, name: str, only: list[int] | None = None) -> DataFrame:
    """Counts over all batches: sums up to the last compaction and what came after it."""
    keys, sums = COUNTS[name]
    return count_rows(spark, path, name, only).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def count_rows(spark: SparkSession, path: str, name: str, only: list[int] | None = None) -> DataFrame:
    """What counts() adds up: a row a key for the sums and for each batch after them."""
    keys, sums = COUNTS[name]
    upto = _upto(spark, path, name)
    at = F.lit(-1).cast("long") if not upto else F.coalesce(F.try_element_at(F.create_map(*(F.lit(x).cast(t) for b, u in sorted(upto.items()) for x, t in ((b, "int"), (u, "long")))), F.col("bucket")), F.lit(-1).cast("long"))
    rows = _pruned(spark.read.parquet(f"{path}/{name}"), only).where(F.col("batch") > at).select(*keys, *sums)
    if upto:
        old = _pruned(spark.read.parquet(f"{path}/{name}_sums"), only).where(F.col("upto") == at)
        rows = rows.unionByName(old.select(*keys, *sums))
    return rows


def compact(spark: SparkSession, path: str, upto: int, buckets: int = BUCKETS) -> None:
    """Add up the counts of the batches up to `upto`, all of them finished; then drop what is in the sums.

    A bucket's folder of sums appears whole or not at all, and readers take the newest, so a run that is cut off harms
    nothing and the next one goes on.
    """
    for name, (keys, sums) in COUNTS.items():
        before = _upto(spark, path, name)
        rows = spark.read.parquet(f"{path}/{name}").where(F.col("batch") <= upto)
        stale = [(r["bucket"], r["batch"]) for r in rows.select("bucket", "batch").distinct().collect()]
        if not stale:
            continue
        touched = sorted({b for b, _ in stale})
        fresh = rows.select("bucket", "batch", *keys, *sums)
        if before:
            done = spark.createDataFrame(sorted(before.items()), "bucket int, upto long")
            fresh = fresh.join(F.broadcast(done), "bucket", "left").where(F.col("batch") > F.coalesce("upto", F.lit(-1))).drop("upto")
            old = spark.read.parquet(f"{path}/{name}_sums").where(F.col("bucket").isin(touched)).join(F.broadcast(done), ["bucket", "upto"], "left_semi")
            fresh = fresh.select(*keys, *sums).unionByName(old.select(*keys, *sums))
        total = fresh.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
        _put(total, f"{path}/{name}_sums", keys, upto, buckets, "upto")
        for bucket, batch in stale:
            remove(spark, f"{path}/{name}/bucket={bucket}/batch={batch}")
        for bucket, last in before.items():
            if bucket in touched and last < upto:
                remove(spark, f"{path}/{name}_sums/bucket={bucket}/upto={last}")


def _pruned(rows: DataFrame, only: list[int] | None) -> DataFrame:
    return rows if only is None else rows.where(F.col("bucket").isin(only))


def read(spark: SparkSession, path: str, asked: DataFrame | None = None, buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """The tables that retrieval takes: chunks, embeddings, postings, doc_len, term_stats, scope_stats.

    asked: rows with the scopes of interest. Only their buckets are read: the plan of every table filters the folders.
    """
    only = None if asked is None else asked_buckets(asked, buckets)
    plain = lambda name: _pruned(spark.read.parquet(f"{path}/{name}"), only).drop("bucket", "batch")
    chunks, scopes = plain("chunks"), counts(spark, path, "scope_counts", only)
    stats = scopes.select("scope", "n", (F.col("tokens") / F.col("n")).alias("avgdl"))
    out = {"chunks": chunks.drop("dl", "text_sha"), "postings": plain("postings"), "doc_len": chunks.select("scope", "chunk_id", "dl"), "scope_stats": stats}
    out["term_stats"] = R.idf(counts(spark, path, "term_counts", only), stats, R.few_scopes(stats))
    if exists(spark, f"{path}/embeddings"):
        out["embeddings"] = plain("embeddings")
    return out


def present(spark: SparkSession, path: str, asked: DataFrame, besides: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(scope, chunk_id) of what is indexed in the buckets of some rows, but for one batch's own."""
    if not exists(spark, f"{path}/chunks"):
        return asked.select("scope", "chunk_id").limit(0)
    rows = _pruned(spark.read.parquet(f"{path}/chunks"), asked_buckets(asked, buckets))
    return (rows if besides is None else rows.where(F.col("batch") != besides)).select("scope", "chunk_id")


def drop_scopes(spark: SparkSession, path: str, expired: DataFrame, buckets: int = BUCKETS) -> None:
    """Take scopes out of every table: folders that hold one are written anew without it, all others stay untouched.

    expired: (scope). A run that is cut off leaves each folder old or new; running it again finishes the work.
    """
    gone = kept(expired.select("scope").distinct())  # it may be read from the very files that go
    only = asked_buckets(gone, buckets)
    names = [*((n, "batch") for n in TABLES), *((f"{n}_sums", "upto") for n in COUNTS)]
    for name, part in names:
        if not only or not exists(spark, f"{path}/{name}"):
            continue
        rows = _pruned(spark.read.parquet(f"{path}/{name}"), only)
        held = {(r["bucket"], r[part]) for r in rows.join(gone, "scope", "left_semi").select("bucket", part).distinct().collect()}
        if not held:
            continue
        in_held = F.struct("bucket", part).isin([F.struct(F.lit(b).cast("int"), F.lit(p).cast(rows.schema[part].dataType)) for b, p in sorted(held)])
        stay = rows.where(F.col("bucket").isin(sorted({b for b, _ in held})) & in_held).join(gone, "scope", "left_anti")
        order = [c for c in ("scope", "term", "chunk_id") if c in stay.columns][:2]
        left = {(r["bucket"], r[part]) for r in stay.select("bucket", part).distinct().collect()}
        stay.hint("rebalance", "bucket", part).sortWithinPartitions("bucket", part, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", part).parquet(f"{path}/{name}")
        for bucket, number in sorted(held - left):
            remove(spark, f"{path}/{name}/bucket={bucket}/{part}={number}")
