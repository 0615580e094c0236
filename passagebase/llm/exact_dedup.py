"""Exact de-duplication with counting quotient filters.

Every partition turns its documents into 64-bit fingerprints and keeps them in a counting quotient filter: the top bits
name a quotient block, the other bits are stored as sorted remainders with counts. Filters of many partitions merge
without loss, block by block, by merging sorted remainders and adding counts. Only fingerprints whose merged count is
above one can belong to copies; their documents, and no others, go on to byte verification (grouping by whole text).

Defined results: a null text counts as empty, all empty texts are equal; texts are equal if identical after lower-casing
A-Z; the row with the largest doc_id stays (a null doc_id is smaller than any other); rows repeated with the same doc_id
and text share one keep_id and all count in group_size; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagebase.llm.common import as_bytes, doc_slices, drop_rows, maybe_broadcast, stash

#: Least quotient bits, and fingerprints of a merged block beyond which there are more: blocks hold about rows / 2**bits.
QUOTIENT_BITS, BLOCK_ROWS = 12, 1 << 20
_FLUSH = 2_000_000

SLIM = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("sha", pa.binary())])


class CountingQuotientFilter:
    """Lossless multiset of 64-bit fingerprints: quotients, sorted remainders and counts, all sorted together."""

    def __init__(self, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray, q_bits: int):
        self.quotients, self.remainders, self.counts, self.q_bits = quotients, remainders, counts, q_bits

    @classmethod
    def build(cls, fingerprints: np.ndarray, q_bits: int = QUOTIENT_BITS) -> CountingQuotientFilter:
        values, counts = np.unique(np.asarray(fingerprints, dtype=np.uint64), return_counts=True)
        r_bits = np.uint64(64 - q_bits)
        return cls((values >> r_bits).astype(np.int64), values & ((np.uint64(1) << r_bits) - np.uint64(1)), counts.astype(np.int64), q_bits)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Merge by sorted (quotient, remainder); equal entries add their counts."""
        q_bits = filters[0].q_bits
        q = np.concatenate([f.quotients for f in filters])
        r = np.concatenate([f.remainders for f in filters])
        n = np.concatenate([f.counts for f in filters])
        if not len(q):
            return cls(q, r, n, q_bits)
        order = np.lexsort((r, q))
        q, r, n = q[order], r[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (r[1:] != r[:-1])]))
        return cls(q[first], r[first], np.add.reduceat(n, first), q_bits)

    def fingerprints(self) -> np.ndarray:
        return (self.quotients.astype(np.uint64) << np.uint64(64 - self.q_bits)) | self.remainders

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(quotient, remainders, counts) of each occupied quotient."""
        edges = np.flatnonzero(np.diff(self.quotients)) + 1
        for lo, hi in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(self.quotients)]]), strict=True):
            if hi > lo:
                yield int(self.quotients[lo]), self.remainders[lo:hi].tobytes(), self.counts[lo:hi].astype(np.int64).tobytes()

    @classmethod
    def from_blocks(cls, rows: list[tuple[int, bytes, bytes]], q_bits: int) -> CountingQuotientFilter:
        r = [np.frombuffer(x[1], dtype=np.uint64) for x in rows]
        q = [np.full(len(b), x[0], dtype=np.int64) for x, b in zip(rows, r, strict=True)]
        n = [np.frombuffer(x[2], dtype=np.int64) for x in rows]
        return cls.merge([cls(np.concatenate(q), np.concatenate(r), np.concatenate(n), q_bits)])


def slim_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, sha) of every row: 64-bit fingerprint and SHA-256 of the normalised text's UTF-8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in doc_slices(batches, "text"):
            texts = [x.lower() for x in as_bytes(batch.column("text"))]  # bytes.lower() lowers A-Z only
            fps = np.array([xxhash.xxh64_intdigest(x) for x in texts], dtype=np.uint64).view(np.int64)
            shas = [hashlib.sha256(x).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), pa.array(shas, pa.binary())], schema=SLIM)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long, sha binary")


def repeated_fingerprints(slim: DataFrame, q_bits: int = QUOTIENT_BITS) -> DataFrame:
    """(fp, n): fingerprints counted more than once, from filters built per partition and merged per quotient block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows = list(CountingQuotientFilter.build(np.concatenate(held), q_bits).blocks())
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary()), pa.array([x[2] for x in rows], pa.binary())], names=["quotient", "remainders", "counts"])

        for batch in batches:
            held.append(np.asarray(batch.column("fp")).view(np.uint64))
            if sum(map(len, held)) >= _FLUSH:
                yield from flush()
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by quotient; a quotient is merged once its last row has come."""
        rows: list[tuple[int, bytes, bytes]] = []

        def done(part: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            if part:
                merged = CountingQuotientFilter.from_blocks(part, q_bits)
                hit = merged.counts > 1
                yield pa.RecordBatch.from_arrays([pa.array(merged.fingerprints()[hit].view(np.int64)), pa.array(merged.counts[hit])], names=["fp", "n"])

        for batch in batches:
            rows += zip(*(batch.column(c).to_pylist() for c in ("quotient", "remainders", "counts")), strict=True)
            if rows:
                cut = next((i for i in range(len(rows), 0, -1) if rows[i - 1][0] != rows[-1][0]), 0)
                yield from done(rows[:cut])
                rows = rows[cut:]
        yield from done(rows)

    pieces = slim.select("fp").mapInArrow(build, "quotient long, remainders binary, counts binary")
    return pieces.repartition("quotient").sortWithinPartitions("quotient").mapInArrow(merge, "fp long, n long")


def quotient_bits(rows: int, least: int = QUOTIENT_BITS, block_rows: int = BLOCK_ROWS) -> int:
    """So many bits that a block of `rows` fingerprints in all holds about block_rows of them at most."""
    return max(least, (-(-rows // block_rows) - 1).bit_length())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q_bits: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (see the module for the defined cases)."""
    slim = stash(slim_rows(docs, id_col, text_col))
    repeated = stash(repeated_fingerprints(slim, q_bits or quotient_bits(slim.count())))
    n_repeated = repeated.count()
    routed = slim.join(maybe_broadcast(repeated.select("fp"), n_repeated), "fp", "left_semi")
    groups = stash(verify_bytes(docs, routed, n_repeated, id_col, text_col))
    joined = slim.join(maybe_broadcast(groups, n_repeated), "sha", "left")
    size = F.coalesce(F.col("group_size"), F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        size.alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def verify_bytes(docs: DataFrame, routed: DataFrame, n_repeated: int, id_col: str, text_col: str) -> DataFrame:
    """(sha, keep_id, group_size) of routed documents whose whole normalised texts are equal byte for byte.

    Texts are the grouping key, so map-side aggregation leaves one row per distinct text and partition, however many
    copies a group has.
    """

    def lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in doc_slices(batches, "text"):
            texts = [x.lower() for x in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()), pa.array(texts, pa.binary())], names=["doc_id", "sha", "body"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = routed.select(F.col("doc_id").alias("r_id")).distinct()
    wanted = picked.join(F.broadcast(ids) if ids.limit(BROADCAST_LIMIT + 1).count() <= BROADCAST_LIMIT else ids, picked.doc_id.eqNullSafe(ids.r_id), "left_semi")
    bodies = wanted.mapInArrow(lowered, "doc_id long, sha binary, body binary")
    return bodies.groupBy("sha", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1").select("sha", "keep_id", "group_size")


#: Routed ids are broadcast below this many, and joined by shuffle beyond.
BROADCAST_LIMIT = 500_000


def keep_one(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose decision is kept, found by doc_id and text; of rows repeated with both, one stays. Columns stay as they were."""
    body = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    marked = docs.withColumn("__sha", F.sha2(body.cast("binary"), 256))
    stay = drop_rows(marked, decisions.where(~F.col("kept")).select("doc_id", F.col("text_sha256").alias("sha")).distinct(), id_col, F.col("__sha"))
    again = decisions.where("kept and group_size > 1").groupBy(F.col("doc_id").alias("__again_id"), F.col("text_sha256").alias("__again_sha")).count().where("count > 1").drop("count")
    m = again.count()
    if not m:
        return stay.drop("__sha")
    hit = maybe_broadcast(again, m)
    on = stay[id_col].cast("long").eqNullSafe(F.col("__again_id")) & (F.col("__sha") == F.col("__again_sha"))
    return stay.join(hit, on, "left_anti").unionByName(stay.join(hit, on, "left_semi").dropDuplicates([id_col, "__sha"])).drop("__sha")
