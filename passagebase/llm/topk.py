"""Exact top-k search in Hamming space by incremental multi-index hashing.

Codes are the 64-bit SimHash fingerprints of whole texts. Every code is indexed under each of its SEGMENTS segments of
16 bits. A query looks up its own segment values, then those one bit away, two bits away and so on, segment by segment;
all codes found are verified by their full distance. After radius r in segment j (and every smaller step) each code
within SEGMENTS * r + j bits has been seen: a code not seen differs in more than r bits in the segments up to j and in
r bits or more in the others. A query is settled once its kth verified distance is within that bound, so the result is
exact, ties included. Where the probes of a step would outnumber the codes, the codes are verified one by one instead.

Work: of equal codes only the k rows with the smallest doc_ids can be in a result, so only those are indexed. The index
is dealt in blocks of about BLOCK_ROWS rows and the distinct query codes in SLICES slices; each (block, slice) is one
task's group, and the k best of each block are merged. Queries with equal codes are searched once.

Defined results: every row with a doc_id divisible by `every` is a query and is searched against all rows, itself
included; order is distance, then doc_id, a null doc_id last; null and empty texts have code zero; repeated rows count
as rows, and each is a query of its own; with fewer than k rows all are returned; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagebase.llm.common import maybe_broadcast, stash
from passagebase.llm.near_dedup import fingerprints

SEGMENTS, WIDTH = 4, 16
BLOCK_ROWS = 2_000_000
SLICES = 8
#: Queries worked off together, and candidates verified at a time.
_TOGETHER, _CANDIDATES = 256, 1 << 20
_FAR = 65


class MultiIndex:
    """Codes in the order that breaks ties, listed under the value of each segment."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes, dtype=np.uint64)
        values = [self.segment(self.codes, j) for j in range(SEGMENTS)]
        self.rows = [np.argsort(v, kind="stable").astype(np.int32) for v in values]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(v, minlength=1 << WIDTH))]) for v in values]
        weight = np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint32))
        self.masks = [np.flatnonzero(weight == r) for r in range(WIDTH + 1)]

    @staticmethod
    def segment(codes: np.ndarray, j: int) -> np.ndarray:
        return ((codes >> np.uint64(WIDTH * j)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance): the k best rows of each query, in order."""
        parts = [self._together(queries[i : i + _TOGETHER], k, i) for i in range(0, len(queries), _TOGETHER)]
        return tuple(np.concatenate(p) if parts else np.empty(0, np.int64) for p in (zip(*parts, strict=True) if parts else ((), (), ())))

    def _together(self, queries: np.ndarray, k: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best = np.empty(0, dtype=np.int64)  # query << 40 | distance << 32 | row
        bound = np.full(len(queries), _FAR)
        active = np.arange(len(queries))

        def verify(query: np.ndarray, row: np.ndarray) -> None:
            nonlocal best
            distance = np.bitwise_count(queries[query] ^ self.codes[row]).astype(np.int64)
            near = distance <= bound[query]
            best = np.union1d(best, (query[near] << 40) | (distance[near] << 32) | row[near])
            first = np.searchsorted(best >> 40, np.arange(len(queries)))
            best = best[np.arange(len(best)) - first[best >> 40] < k]
            count = np.bincount(best >> 40, minlength=len(queries))
            full = np.flatnonzero(count == k)
            bound[full] = (best[np.cumsum(count)[full] - 1] >> 32) & 255

        def expand(query: np.ndarray, lo: np.ndarray, n: np.ndarray, rows: np.ndarray | None) -> None:
            """Candidates of all probes, some at a time; a long list is cut."""
            ends = np.cumsum(n)
            for at in range(0, int(ends[-1]) if len(ends) else 0, _CANDIDATES):
                flat = np.arange(at, min(at + _CANDIDATES, int(ends[-1])))
                probe = np.searchsorted(ends, flat, side="right")
                row = lo[probe] + flat - (ends[probe] - n[probe])
                verify(query[probe], (rows[row] if rows is not None else row).astype(np.int64))

        for radius in range(WIDTH + 1):
            masks = self.masks[radius]
            for j in range(SEGMENTS):
                if len(masks) >= len(self.codes):
                    expand(active, np.zeros(len(active), np.int64), np.full(len(active), len(self.codes)), None)
                    active = active[:0]
                else:
                    value = (self.segment(queries[active], j)[:, None] ^ masks[None, :]).ravel()
                    lo = self.starts[j][value]
                    n = self.starts[j][value + 1] - lo
                    hit = n > 0
                    expand(np.repeat(active, len(masks))[hit], lo[hit], n[hit], self.rows[j])
                    active = active[bound[active] > SEGMENTS * radius + j]
                if not len(active):
                    return (best >> 40) + base, best & 0xFFFFFFFF, (best >> 32) & 255
        return (best >> 40) + base, best & 0xFFFFFFFF, (best >> 32) & 255


def nearest(index: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, slices: int = SLICES) -> DataFrame:
    """(query, doc_id, fp, distance): the k best rows (doc_id, fp) of each block for each query code, so k or more each."""
    blocks = max(1, -(-index.count() // block_rows))
    whole = index.select(F.pmod(F.xxhash64("fp", "doc_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "fp", "doc_id")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("fp"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), "fp", F.lit(None).cast("long").alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups arrive one after the other, codes before queries."""
        group, held, found, ids = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tags = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("block", "slice", "kind")], axis=1)
            cuts = np.flatnonzero(np.any(tags[1:] != tags[:-1], axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tags)], strict=True):
                piece, (block, piece_slice, kind) = batch.slice(a, b - a), tags[a].tolist()
                if (block, piece_slice) != group:
                    group, held, found = (block, piece_slice), [], None
                if not kind:
                    held.append((np.asarray(piece.column("fp")).view(np.uint64), piece.column("doc_id")))
                    continue
                if found is None and held:
                    ids = pa.chunked_array([x[1] for x in held]).combine_chunks()
                    order = np.asarray(pa.compute.array_sort_indices(ids))  # ascending, nulls last
                    found, ids = MultiIndex(np.concatenate([x[0] for x in held])[order]), ids.take(pa.array(order))
                    held = []
                if found is not None:
                    wanted = np.asarray(piece.column("fp")).view(np.uint64)
                    query, row, distance = found.search(wanted, k)
                    yield pa.RecordBatch.from_arrays([pa.array(wanted[query].view(np.int64)), ids.take(pa.array(row)), pa.array(found.codes[row].view(np.int64)), pa.array(distance, pa.int32())], names=["query", "doc_id", "fp", "distance"])

    keys = ["block", "slice"]
    dealt = whole.unionByName(asked).repartition(4 * blocks * slices, *keys).sortWithinPartitions(*keys, "kind")
    return dealt.mapInArrow(run, "query long, doc_id long, fp long, distance int")


def top_k(docs: DataFrame, k: int = 10, every: int = 50, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS, slices: int = SLICES) -> DataFrame:
    """query_id, rank (from 1), doc_id, distance, fingerprint (16 hex digits) of the k nearest rows of each query."""
    codes = stash(fingerprints(docs, id_col, text_col))
    least = Window.partitionBy("fp").orderBy(F.col("doc_id").asc_nulls_last())
    index = stash(codes.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k).select("fp", "doc_id"))
    queries = codes.where(F.col("doc_id") % every == 0)
    found = nearest(index, queries.select("fp").distinct(), k, block_rows, slices)
    order = Window.partitionBy("query").orderBy("distance", F.col("doc_id").asc_nulls_last(), "fp")
    ranked = stash(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    asked = queries.select(F.col("doc_id").alias("query_id"), F.col("fp").alias("query"))
    out = asked.join(maybe_broadcast(ranked, ranked.count()), "query")
    return out.select("query_id", "rank", "doc_id", "distance", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))
