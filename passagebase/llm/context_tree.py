"""Scoring text with context-tree weighting over bytes, beside a smoothed unigram base.

A text is coded as its words, each followed by a blank, and a line feed at the end; every byte is eight binary decisions.
The context of a decision is the bits of its byte so far and up to DEPTH bytes before it, whatever they are: contexts run
across blanks and words. Each context holds a Krichevsky-Trofimov estimate of its decisions, and the estimates of all
depths from none to DEPTH are mixed by the weights of the context tree, learned from all training text. A context never
seen in training adds nothing to its parent.

Work, tree: a gram is a byte with the DEPTH bytes before it. One narrow pass counts the grams of each partition, one
shuffle of grams adds them up: the cells of the tree, a table that grows with the corpus. Contexts that share their last
two bytes are whole subtrees, so they are worked off one after the other in numpy; only the sums of depth two (at most
65,536 contexts) go to the driver, which adds depths one and none. Each cell then has its probability. The cells are sent
to the texts, CELLS_AT_ONCE at a time: the first lot with the pass that splits words, each further lot with a pass of
its own whose parts are added up by row. Base: each chunk of documents has its own word list; lists are counted by word,
and counts go back to their chunks.

Defined results: a null text counts as empty and has the end token alone; with no training row N is 0 and every decision
has probability one half; rows with a null doc_id are neither held out nor learned from; repeated rows are scored (and
learned from) each; very long texts are worked off in parts; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagebase.llm.common import as_bytes, crc32_mod, doc_slices, stash, word_parts

DEPTH = 5
#: Last bytes of a context that name the subtree it is worked off in.
TOP = 2
END = b" "  # no word holds a blank
CHUNK_BYTES = 16 << 20
#: Cells of the tree that are sent to the workers at a time: 12 bytes each.
CELLS_AT_ONCE = 4_000_000
#: Cells worked off at a time where subtrees are smaller, and distinct grams that a task holds while it counts.
_TOGETHER, _HELD = 200_000, 2_000_000
_PIECE = 1 << 20


def buffers(text: bytes) -> Iterator[bytes]:
    """The coded text in parts, each led by the DEPTH bytes before it (line feeds before the first)."""
    before = b"\n" * DEPTH
    for part in word_parts(text):
        if words := part.lower().split():
            body = before + b" ".join(words) + b" "
            yield body
            before = body[-DEPTH:]
    yield before + b"\n"


def grams(parts: list[bytes]) -> np.ndarray:
    """Each coded byte with the DEPTH bytes before it, the latest in the lowest byte but one."""
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    out = raw.copy()
    for back in range(1, DEPTH + 1):
        out[back:] |= raw[:-back] << (8 * back)
    place = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return out[place >= DEPTH]


def in_pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, position of the text that each belongs to), about _PIECE bytes at a time."""
    held, owners, size = [], [], 0

    def out() -> tuple[np.ndarray, np.ndarray]:
        return grams(held), np.repeat(owners, [len(b) - DEPTH for b in held])

    for i, text in enumerate(texts):
        for part in buffers(text):
            held.append(part)
            owners.append(i)
            size += len(part)
            if size >= _PIECE:
                yield out()
                held, owners, size = [], [], 0
    if held:
        yield out()


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting small arguments up."""
    shift, x = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = x < 8
        shift -= np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x += low
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def summed(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of x by position; of nothing too, which bincount gives as integers."""
    return np.bincount(at, x, minlength=n).astype(float)


class Level:
    """The decisions of one depth: sorted ids (context, then bits of the byte so far), zeros and ones seen, weights."""

    def __init__(self, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        """below: log probability of what was seen, by the deeper contexts together; none at the greatest depth."""
        self.ids, self.zeros, self.ones = ids, zeros, ones
        own = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)
        self.mixed = own if below is None else np.logaddexp(own, below) - math.log(2)
        self.weight = np.ones(len(ids)) if below is None else np.exp(own - math.log(2) - self.mixed)

    def parent(self, depth: int) -> Level:
        """The level above, of contexts of `depth` bytes."""
        up = ((self.ids >> 8) & ((1 << 8 * depth) - 1)) << 8 | self.ids & 255
        ids, at = np.unique(up, return_inverse=True)
        return Level(ids, *(summed(at, x, len(ids)) for x in (self.zeros, self.ones, self.mixed)))


def decisions(cells: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bits so far with a leading one, next bit) of each of the eight decisions of the cells' bytes."""
    byte = cells & 255
    return [((1 << k) | byte >> (8 - k), byte >> (7 - k) & 1) for k in range(8)]


def subtrees(cells: np.ndarray, numbers: np.ndarray, top: int = TOP) -> list[Level]:
    """Levels from depth `top` to DEPTH of cells seen `numbers` times."""
    cells, numbers = cells[numbers > 0], numbers[numbers > 0].astype(float)
    context = cells >> 8 << 8
    steps = decisions(cells)
    ids, at = np.unique(np.concatenate([context | node for node, _ in steps]), return_inverse=True)
    one = np.concatenate([bit for _, bit in steps])
    both = np.tile(numbers, 8)
    levels = [Level(ids, summed(at, both * (1 - one), len(ids)), summed(at, both * one, len(ids)), None)]
    for depth in range(DEPTH - 1, top - 1, -1):
        levels.insert(0, levels[0].parent(depth))
    return levels


def cell_scores(cells: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of each cell's byte in its context, by levels of all depths."""
    total = np.zeros(len(cells))
    for node, bit in decisions(cells):
        p, deeper = np.full(len(cells), 0.5), np.zeros(len(cells), dtype=bool)
        for depth in range(DEPTH, -1, -1):
            level = levels[depth]
            if not len(level.ids):
                continue
            want = (cells >> 8 & ((1 << 8 * depth) - 1)) << 8 | node
            at = np.minimum(np.searchsorted(level.ids, want), len(level.ids) - 1)
            seen = level.ids[at] == want
            own = (level.ones[at] + 0.5) / (level.zeros[at] + level.ones[at] + 1)
            p = np.where(seen, np.where(deeper, level.weight[at] * own + (1 - level.weight[at]) * p, own), p)
            deeper |= seen
        total += np.log10(np.where(bit == 1, p, 1 - p))
    return total


def _texts(docs: DataFrame, id_col: str, text_col: str, folds: int) -> DataFrame:
    fold = crc32_mod(id_col, folds)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.coalesce(fold != 0, F.lit(False)).alias("train"))


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, n): every gram of all texts and how often training texts have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, number, size = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(np.concatenate(kept), return_inverse=True)
            return found, np.bincount(at, np.concatenate(number), minlength=len(found)).astype(np.int64)

        for batch in doc_slices(batches, "text", 4 << 20):
            train = np.asarray(batch.column("train").to_numpy(zero_copy_only=False), dtype=bool)
            for own, owner in in_pieces(as_bytes(batch.column("text"))):
                found, at = np.unique(own, return_inverse=True)
                kept.append(found)
                number.append(np.bincount(at, train[owner], minlength=len(found)).astype(np.int64))
                size += len(found)
            if size >= _HELD:
                kept, number = ([x] for x in merged())
                size = len(kept[0])
                if 2 * size >= _HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(number[0])], names=["gram", "n"])
                    kept, number, size = [], [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["gram", "n"])

    return texts.select("text", "train").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _by_subtree(cells: DataFrame, work, ddl: str) -> DataFrame:
    """work(grams, numbers) for whole subtrees, several small ones together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("subtree", "gram", "n")]))
            if sum(x.shape[1] for x in held) >= _TOGETHER:
                rows = np.concatenate(held, axis=1)
                cut = int(np.searchsorted(rows[0], rows[0, -1]))
                if cut:
                    yield work(rows[1, :cut], rows[2, :cut])
                held = [rows[:, cut:]]
        if held:
            rows = np.concatenate(held, axis=1)
            yield work(rows[1], rows[2])

    named = cells.withColumn("subtree", F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1)))
    return named.repartition("subtree").sortWithinPartitions("subtree").mapInArrow(run, ddl)


def top_levels(cells: DataFrame) -> list[Level]:
    """Levels of the depths below TOP, from the sums of all subtrees (at most 65,536 contexts of 255 decisions)."""
    names = ["id", "zeros", "ones", "mixed"]

    def sums(own: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        top = subtrees(own, numbers)[0]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (top.ids, top.zeros, top.ones, top.mixed)], names=names)

    got = _by_subtree(cells, sums, "id long, zeros double, ones double, mixed double").toArrow().sort_by("id")
    at = Level(*(np.asarray(got.column(c)) for c in names[:3]), None)
    at.mixed = np.asarray(got.column("mixed"))
    levels: list[Level] = []
    for depth in range(TOP - 1, -1, -1):
        at = at.parent(depth)
        levels.insert(0, at)
    return levels


def scored_cells(cells: DataFrame) -> DataFrame:
    """(gram, score): log10 probability of the gram's byte after its context."""
    above = top_levels(cells)

    def value(own: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        found = cell_scores(own, [*above, *subtrees(own, numbers)])
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(found.astype(np.float32))], names=["gram", "score"])

    return _by_subtree(cells, value, "gram long, score float")


def text_scores(texts: list[bytes], known: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sum of the values of each text's grams, those that are known."""
    total = np.zeros(len(texts))
    for own, owner in in_pieces(texts) if len(known) else ():
        found, back = np.unique(own, return_inverse=True)
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        total += np.bincount(owner, np.where(known[at] == found, value[at], 0.0).astype(float)[back], minlength=len(texts))
    return total


def _lots(cells: DataFrame, at_once: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Scored cells in sorted arrays of about at_once each, made one at a time as they are asked for."""
    scored = stash(scored_cells(cells))
    parts = max(1, -(-scored.count() // at_once))
    for i in range(parts):
        own = scored.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == i) if parts > 1 else scored
        got = own.toArrow()
        gram, value = np.asarray(got.column("gram")), np.asarray(got.column("score"))
        order = np.argsort(gram)
        yield gram[order], value[order]


def _row_numbers() -> Iterator[int]:
    return count(TaskContext.get().partitionId() << 40)


def _partial(texts: DataFrame, lot) -> DataFrame:
    """(row, part): what one lot of cells adds to each row's score; rows are numbered as in _chunked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _row_numbers()
        for batch in doc_slices(batches, "text", 4 << 20):
            part = text_scores(as_bytes(batch.column("text")), *lot.value)
            yield pa.RecordBatch.from_arrays([pa.array([next(rows) for _ in part], pa.int64()), pa.array(part)], names=["row", "part"])

    return texts.mapInArrow(run, "row long, part double")


def _packed(numbers: np.ndarray) -> bytes:
    """Four-byte numbers, byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _chunked(texts: DataFrame, lot) -> DataFrame:
    """Rows of two kinds: documents as numbers of their chunk's words, with the score by the first lot of cells, and the
    chunk's words with their training counts."""
    names = ["chunk", "row", "doc_id", "held_out", "tree", "ids", "token", "local", "n"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]

    def batch_of(size: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[n] if n in given else pa.nulls(size, k) for n, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, rows = TaskContext.get().partitionId() << 24, _row_numbers()
        known: dict[bytes, int] = defaultdict(count().__next__)
        learned: list[np.ndarray] = []
        held = 0

        def finish() -> Iterator[pa.RecordBatch]:
            if known:
                n = np.bincount(np.concatenate(learned), minlength=len(known)) if learned else np.zeros(len(known), dtype=np.int64)
                words = list(known)
                for i in range(0, len(words), 100_000):
                    part = words[i : i + 100_000]
                    yield batch_of(len(part), chunk=pa.array([chunk] * len(part), pa.int64()), token=pa.array(part, pa.binary()), local=pa.array(np.arange(i, i + len(part), dtype=np.int32)), n=pa.array(n[i : i + len(part)].astype(np.int64)))

        for batch in doc_slices(batches, "text", 4 << 20):
            texts = as_bytes(batch.column("text"))
            tree, ids = text_scores(texts, *lot.value), []
            for text, train in zip(texts, batch.column("train").to_pylist(), strict=True):
                number = known.__getitem__
                parts = [np.fromiter(map(number, words), dtype=np.int32, count=len(words)) for words in (p.lower().split() for p in word_parts(text))]
                numbers = np.concatenate([*parts, np.array([number(END)], dtype=np.int32)])
                ids.append(_packed(numbers))
                if train:
                    learned.append(numbers)
            held += sum(map(len, texts))
            yield batch_of(len(ids), chunk=pa.array([chunk] * len(ids), pa.int64()), row=pa.array([next(rows) for _ in ids], pa.int64()), doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), tree=pa.array(tree), ids=pa.array(ids, pa.binary()))
            if held >= CHUNK_BYTES:
                yield from finish()
                known, learned, held, chunk = defaultdict(count().__next__), [], 0, chunk + 1
        yield from finish()

    return texts.mapInArrow(run, "chunk long, row long, doc_id long, held_out boolean, tree double, ids binary, token binary, local int, n long")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, cells_at_once: int = CELLS_AT_ONCE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    sc = docs.sparkSession.sparkContext
    texts = _texts(docs, id_col, text_col, folds)
    cells = stash(gram_counts(texts))
    lots = _lots(cells, cells_at_once)
    first, more = sc.broadcast(next(lots)), []  # cells_at_once x 12 bytes
    if cells.count() > cells_at_once:
        texts = stash(texts)  # several passes must number the rows alike
        more = [stash(_partial(texts, sc.broadcast(lot))) for lot in lots]
    rows = stash(_chunked(texts, first))
    lists = rows.where("token is not null").select(F.col("chunk").alias("of_chunk"), "local", "token", "n")
    counts = stash(lists.groupBy("token").agg(F.sum("n").alias("c")))
    got = counts.where("c > 0").agg(F.sum("c"), F.count(F.lit(1))).first()
    total, distinct = int(got[0] or 0), int(got[1])
    denominator = total + 0.1 * (distinct + 1)
    back = lists.join(counts, "token").select("of_chunk", "local", "c")

    def add_up(documents: pa.Table, words: pa.Table) -> pa.Table:
        c = np.empty(words.num_rows, dtype=np.int64)
        c[np.asarray(words.column("local"))] = np.asarray(words.column("c"))
        base = np.log10((c + 0.1) / denominator)
        out: list[list] = [[], [], []]
        for raw in documents.column("ids").to_pylist():
            ids = _unpacked(raw)
            for column, x in zip(out, (len(ids), int((c[ids] > 0).sum()), float(base[ids].sum())), strict=True):
                column.append(x)
        n = documents.num_rows
        return pa.table({"row": documents.column("row"), "doc_id": documents.column("doc_id"), "held_out": documents.column("held_out"), "n_tokens": pa.array(out[0], pa.int64()), "n_known": pa.array(out[1], pa.int64()), "train_tokens": pa.array([total] * n, pa.int64()), "base_score": pa.array(out[2], pa.float64()), "tree": documents.column("tree")})

    documents = rows.where("token is null").select("chunk", "row", "doc_id", "held_out", "tree", "ids")
    scored = documents.groupBy("chunk").cogroup(back.groupBy("of_chunk")).applyInArrow(add_up, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, tree double")
    score = F.col("tree")
    for i, part in enumerate(more):
        scored = scored.join(part.withColumnRenamed("part", f"part{i}"), "row")
        score = score + F.col(f"part{i}")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", score.alias("score"))
