"""Cosine rankings by blocks: both sides are dealt into blocks, a task multiplies one pair of blocks.

A block holds about BLOCK passages of a scope, or QUESTION_BLOCK questions; every pair of blocks of a scope meets in one
task, which keeps the best of each question or counts how many passages come before given ones. Nothing but these
small rows is ranked, and no side passes through the driver. Unit vectors are expected; a missing one counts as cosine 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Passages and questions of one pair of blocks, and passages multiplied at a time.
BLOCK, QUESTION_BLOCK, _STEP = 16_384, 2_048, 1_024
#: Cosines are compared after rounding, so that they do not depend on how passages fell into blocks.
DIGITS = 12


def _matrix(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column, zeros where there is none."""
    out = np.zeros((len(vectors), dim))
    column = vectors.combine_chunks()
    there = np.flatnonzero(np.asarray(column.is_valid()))
    if len(there):
        out[there] = np.asarray(column.drop_null().flatten(), dtype=np.float64).reshape(len(there), -1)
    return out


def _dim(*columns: pa.ChunkedArray) -> int:
    return max((len(v) for c in columns for v in c.drop_null().slice(0, 1).to_pylist()), default=1)


def _names(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks()) if pa.types.is_integer(column.type) else np.array(column.to_pylist(), dtype=object)


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """(scope, blocks): how many blocks of about `size` rows each scope has."""
    return rows.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))


def _pairs(chunks: DataFrame, questions: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], ddl: str, block: int, question_block: int) -> DataFrame:
    """`work` on every pair of blocks of one scope: (scope, part, question part) is the key that both sides are dealt by."""
    asked = questions.select("scope").distinct()
    c_blocks = blocks_of(chunks.join(asked, "scope", "left_semi"), block).withColumnRenamed("blocks", "parts")
    questions = questions.toDF(*questions.columns)
    sizes = c_blocks.join(blocks_of(questions, question_block).withColumnRenamed("blocks", "q_parts"), "scope")
    hashed = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    c = chunks.join(sizes, "scope").withColumn("part", hashed("chunk_id", "parts")).withColumn("q_part", spread("q_parts"))
    q = questions.join(sizes, "scope").withColumn("q_part", hashed("question_id", "q_parts")).withColumn("part", spread("parts"))
    keys = ["scope", "part", "q_part"]
    c, q = c.select(*keys, "chunk_id", "vec"), q.select(*keys, *(x for x in questions.columns if x != "scope"))
    q = q.toDF(*q.columns)  # both sides may come from one table

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, right)

    return c.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(run, ddl)


def _types(chunks: DataFrame, questions: DataFrame) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"question_id {kind(questions, 'question_id')}, chunk_id {kind(chunks, 'chunk_id')}"


def nearest(chunks: DataFrame, questions: DataFrame, k: int, block: int = BLOCK, question_block: int = QUESTION_BLOCK, name: str = "rank") -> DataFrame:
    """(question_id, chunk_id, cos, rank): the k best passages of each question's scope; ties by chunk_id.

    chunks: (scope, chunk_id, vec), questions: (question_id, scope, vec). For a search over everything give all rows one
    scope. Each pair of blocks gives k rows a question, which a window over just these merges.
    """
    ddl = f"{_types(chunks, questions)}, cos double"

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"question_id": right.column("question_id").slice(0, 0), "chunk_id": left.column("chunk_id").slice(0, 0), "cos": pa.array([], pa.float64())})
        left = left.sort_by("chunk_id")
        dim = _dim(left.column("vec"), right.column("vec"))
        matrix, asked = _matrix(left.column("vec"), dim), _matrix(right.column("vec"), dim)
        held, score = np.zeros((len(asked), 0), dtype=np.int64), np.zeros((len(asked), 0))
        for at in range(0, len(matrix), _STEP):
            new = np.round(asked @ matrix[at : at + _STEP].T, DIGITS)
            both = np.concatenate([score, new], axis=1)
            places = np.concatenate([held, np.broadcast_to(np.arange(at, at + new.shape[1]), new.shape)], axis=1)
            # Places rise from left to right, so a stable sort keeps ties by chunk_id.
            order = np.argsort(-both, axis=1, kind="stable")[:, :k]
            held, score = np.take_along_axis(places, order, axis=1), np.take_along_axis(both, order, axis=1)
        n = held.shape[1]
        return pa.table({"question_id": right.column("question_id").take(pa.array(np.repeat(np.arange(len(asked)), n))), "chunk_id": left.column("chunk_id").take(pa.array(held.ravel())), "cos": pa.array(score.ravel())})

    found = _pairs(chunks, questions.select("question_id", "scope", "vec"), best, ddl, block, question_block)
    order = W.partitionBy("question_id").orderBy(F.col("cos").desc(), "chunk_id")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def places(chunks: DataFrame, questions: DataFrame, wanted: DataFrame, block: int = BLOCK, question_block: int = QUESTION_BLOCK, name: str = "rank") -> DataFrame:
    """(question_id, chunk_id, cos, rank): where given passages stand in the whole ranking of their scope, by counting.

    wanted: (question_id, chunk_id), a bounded list for each question. A pair of blocks counts the passages before each
    wanted one, counts are added up; no ranking of the scope is made.
    """
    scoped = wanted.join(questions.select("question_id", "scope", F.col("vec").alias("q_vec")), "question_id")
    own = scoped.join(chunks.select("scope", "chunk_id", "vec"), ["scope", "chunk_id"])
    own = own.groupBy("scope", "question_id").agg(F.first("q_vec").alias("vec"), F.array_sort(F.collect_list(F.struct("chunk_id", F.col("vec").alias("of")))).alias("wanted"))
    ddl = f"{_types(chunks, questions)}, cos double, before long"

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        names, values, numbers, owners = [], [], [], []
        left = left.sort_by("chunk_id")
        ids = _names(left.column("chunk_id"))
        lists = right.column("wanted").combine_chunks()
        dim = _dim(left.column("vec"), right.column("vec"), *([pa.chunked_array([lists.flatten().field("of")])] if len(lists) else []))
        matrix, asked = _matrix(left.column("vec"), dim), _matrix(right.column("vec"), dim)
        # The same products as everywhere: rounded, so that equal vectors are equal wherever they are multiplied.
        cos = [np.round(asked @ matrix[at : at + _STEP].T, DIGITS) for at in range(0, len(matrix), _STEP)]
        for i in range(right.num_rows):
            mine = lists[i].values
            own_ids, own_vecs = _names(pa.chunked_array([mine.field("chunk_id")])), _matrix(pa.chunked_array([mine.field("of")]), dim)
            own_cos = np.round(own_vecs @ asked[i], DIGITS)
            row = np.concatenate([c[i] for c in cos]) if cos else np.empty(0)
            order = np.sort(row)
            higher = len(row) - np.searchsorted(order, own_cos, side="right")
            for j, value in enumerate(own_cos):
                equal = ids[row == value] if higher[j] < len(row) else ids[:0]
                numbers.append(int(higher[j]) + int(np.searchsorted(equal, own_ids[j], side="left")))
            names.append(mine.field("chunk_id"))
            values.append(own_cos)
            owners += [i] * len(own_cos)
        return pa.table({"question_id": right.column("question_id").take(pa.array(owners, pa.int64())), "chunk_id": pa.chunked_array(names, left.schema.field("chunk_id").type), "cos": pa.array(np.concatenate(values) if values else np.empty(0)), "before": pa.array(numbers, pa.int64())})

    counted = _pairs(chunks, own.select("question_id", "scope", "vec", "wanted"), count, ddl, block, question_block)
    return counted.groupBy("question_id", "chunk_id").agg(F.first("cos").alias("cos"), (F.sum("before") + 1).cast("int").alias(name))
