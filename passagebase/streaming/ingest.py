"""Documents that arrive over time, chunked and indexed once; questions that arrive over time, answered once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagebase.operators import chunking as C
from passagebase.sources import index as X
from passagebase.sources.shared import kept
from passagebase.sources.tables import new_only


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, scope: str | None = None, model: Callable[[list[str]], np.ndarray] | None = None, compact_every: int = 16, buckets: int = X.BUCKETS):
    """New text files below a folder into the index at target: a file's scope is its folder's name, or the one given.

    A batch reads its own files and the keys of passages in the buckets it touches. It is written under its number, counted
    on from the batches that were there when the checkpoint was first used, so a batch that runs again after a failure
    replaces what it had written and a stream with a checkpoint of its own replaces nothing; counts are added to, never
    rebuilt. Every compact_every batches the counts of the batches before are added up. With a model, new texts get vectors.
    """
    first = first_batch(spark, target, checkpoint)
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).schema("value string").load(source)
    folder = F.url_decode(F.replace(F.element_at(F.split("_metadata.file_path", "/"), -2), F.lit("+"), F.lit("%2B")))
    named = files.select((F.lit(scope) if scope else folder).alias("scope"), F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))
    chunks = C.chunk_pages(C.unit_arrays(named))

    def put(batch: DataFrame, number: int) -> None:
        own, number = batch.sparkSession, first + number
        made = kept(batch)
        if made.isEmpty():
            return
        new = new_only(made, X.present(own, target, made, number, buckets))
        X.append(new, target, number, model=model, buckets=buckets)
        if number and number % compact_every == 0:
            X.compact(own, target, number - 1, buckets)

    return chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_batch(spark: SparkSession, target: str, checkpoint: str) -> int:
    """The number of a checkpoint's first batch: the one after all that the index has while the checkpoint is new.

    It is kept below the index under a hash of the checkpoint's path; a checkpoint in use that has none started at 0.
    """
    place = f"{target}/streams/{hashlib.sha256(checkpoint.encode()).hexdigest()}"
    if not X.exists(spark, checkpoint):
        last = spark.read.parquet(f"{target}/chunks").agg(F.max("batch")).first()[0] if X.exists(spark, f"{target}/chunks") else None
        spark.range(1).select(F.lit(0 if last is None else last + 1).cast("long").alias("first")).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place).first()["first"] if X.exists(spark, place) else 0


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "question_id"):
    """Questions against a static index: each batch goes through `answer` into a folder of its own below target.

    A batch that runs again replaces its folder, so each question of a batch has one answer; a question that is asked twice
    within a batch is answered once. Read target with `batch` as its partition column.
    """

    def put(batch: DataFrame, number: int) -> None:
        asked = kept(batch.dropDuplicates([key]))
        if not asked.isEmpty():
            answer(asked).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return questions.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
