"""Packing documents into fixed-length sequences by cutting-stock column generation.

Whole blocks of a document fill sequences of their own. What is left of each document, its tail, is counted in a length
histogram. Over the histogram's bins a linear program asks for the fewest sequences: its columns are patterns (how many
tails of which bins share a sequence), found one by one by a knapsack dynamic program on the dual prices. Patterns that
fill a sequence are rounded down; documents, ranked within their bin, take the patterns' places by rank. Tails without a
place (rounding, or lengths that no pattern combines well) are laid end to end and cut freely, which needs no padding:
the last stretch is cut at powers of two.

A tokenised table in the shared folder holds ids, lengths and checksums; only tails that are cut are read again.

Defined results: null and empty texts have the end id alone; repeated rows are packed each; very long texts are cut into
blocks; an empty table gives an empty result; extra columns are ignored; a null doc_id is packed like any other.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagebase.llm.common import as_bytes, doc_slices, maybe_broadcast, release, stash

TOKENS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("block_base", pa.int64()), ("crcs", pa.list_(pa.int64())), ("tail", pa.int32()), ("tail_crc", pa.int64()), ("ids", pa.binary())])
TOKENS_DDL = "uid long, doc_id long, n long, block_base long, crcs array<long>, tail int, tail_crc long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words remembered by a task (a worker process, with keep_words) at most; beyond, those of up to SHORT bytes stay, which are the frequent ones.
CACHE_WORDS, SHORT = 250_000, 8
#: Bytes of text that are tokenised at a time.
SLICE_BYTES = 1 << 20
#: A pattern is used if at most this share of the sequence stays empty.
MAX_WASTE = 0.01
#: Tails are counted in units of so many tokens; shorter ones than LEAST_TAIL are always laid end to end.
UNIT, LEAST_TAIL = 4, 64
_RESIDUAL, _BLOCKS = 1 << 60, 1 << 61


#: Lower-case Latin letters, then marks that stand in one group; neither is changed by normalisation or split further.
SIMPLE = re.compile("([a-zà-öø-ÿ]*)([.,;:!?*#%$&]*)")


def _byte_signs() -> list[str]:
    """The printable sign of each byte in byte-level vocabularies: itself where printable, else the next from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    signs, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in signs:
            signs[b] = chr(extra)
            extra += 1
    return [signs[b] for b in range(256)]


BYTE_SIGN = _byte_signs()


# Normaliser and pre-tokenizer of a tokenizer that composes, lowers and drops white space. Its pieces never
# cross white space, so words can be encoded one by one; letters and marks reach the merge table as bytes.
WORD_SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: First bytes of the marks that compose with the letter before them, U+0300 to U+037F.
MARK_LEADS = (b"\xcc", b"\xcd")


def splits_by_words(settings: dict) -> bool:
    """Whether a tokenizer file's settings allow encoding word by word."""
    return all(settings.get(k) == v for k, v in WORD_SETTINGS.items()) and settings["model"]["type"] == "BPE" and not any(set("\t\n\x0b\x0c\r ") & set(t["content"]) for t in settings["added_tokens"])


def lowered(text: bytes) -> bytes:
    """A-Z lowered where that can't change what the tokenizer gives: not before marks that compose (some compose with
    the small letter only) nor where a special token may be spelled."""
    return text if b"<|" in text or any(m in text for m in MARK_LEADS) else text.lower()


class WordEncoder:
    """Ids of texts by a tokenizer file; words between ASCII white space are encoded once and remembered.

    That is exact for tokenizers with the settings of WORD_SETTINGS; others get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.merge = self.tokenizer.model.tokenize
        self.known: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.by_word = self.direct = splits_by_words(json.loads(self.tokenizer.to_str()))

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, word: bytes) -> bytes:
        """Ids of one word. Plain lower-case letters with closing marks go to the merge table directly."""
        text = word.decode()
        m = SIMPLE.fullmatch(text) if self.direct else None
        if not m:
            return np.array(self._plain(text), dtype=self.dtype).tobytes()
        letters, marks = m.groups()
        if not marks:
            return self._part(letters)
        ids = self.marks.get(marks) or self._marks(marks)
        if letters:
            plain = word[: len(word) - len(marks)]
            known = self.known.get(plain)
            if known is None:
                known = self.known[plain] = self._part(letters)
            ids = known + ids
        return ids

    def _part(self, part: str) -> bytes:
        signs = part if part.isascii() else "".join([BYTE_SIGN[b] for b in part.encode()])
        return array(self.code, [t.id for t in self.merge(signs)]).tobytes()

    def _marks(self, marks: str) -> bytes:
        self.marks[marks] = self._part(marks)
        return self.marks[marks]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        words = [lowered(t).split() for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {w: ids for w, ids in self.known.items() if len(w) <= SHORT}
            if len(self.known) > CACHE_WORDS // 2:
                self.known.clear()
        for w in set().union(*words).difference(self.known):
            self.known[w] = self._word(w)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, w)), dtype=self.dtype) for w in words]


def shared_encoder(path: str) -> WordEncoder:
    """One encoder a worker process: the tokenizer file is read once."""
    import sys

    kept = sys.__dict__.setdefault("_word_encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, length: int, end_id: int, keep_words: bool = False) -> DataFrame:
    """One row a document: ids (end id included), their number, checksums of whole blocks and of the tail.

    With keep_words a worker process still knows its words in the next task: some 50 MB more for a tenth less time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, task = shared_encoder(tokenizer_path), TaskContext.get().partitionId()
        row, block = task << 40, task << 40
        for batch in doc_slices(batches, "text", SLICE_BYTES):
            out: dict[str, list] = {f.name: [] for f in TOKENS}
            for ids in encoder.encode(as_bytes(batch.column("text"))):
                ids = np.append(ids, np.array([end_id], dtype=encoder.dtype))
                n, tail = len(ids), len(ids) % length
                crcs = [checksum(ids[i : i + length]) for i in range(0, n - tail, length)]
                for k, v in (("uid", row), ("n", n), ("block_base", block), ("crcs", crcs), ("tail", tail), ("tail_crc", checksum(ids[n - tail :])), ("ids", ids[n - tail :].astype("<u4").tobytes())):
                    out[k].append(v)
                row, block = row + 1, block + len(crcs)
            out["doc_id"] = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if f.name != "doc_id" else out["doc_id"] for f in TOKENS], schema=TOKENS)
        if not keep_words:
            encoder.known = {}
        release()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return picked.mapInArrow(run, TOKENS_DDL)


def bin_edges(length: int, unit: int = UNIT, least: int = LEAST_TAIL) -> np.ndarray:
    """Upper bounds of the histogram's bins, multiples of `unit`, wider for longer tails; tails below `least` have none."""
    edges, at = [], least - 1 - (least - 1) % unit
    while at < length:
        at += unit * (1 if at < length // 8 else 2 if at < length // 2 else 4)
        edges.append(min(at, length))
    return np.array(edges)


def price(values: np.ndarray, sizes: np.ndarray, length: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over capacities: the best pattern and its value. Sizes ascend."""
    best = np.zeros(length + 1)
    pick = np.full(length + 1, -1)
    fits = np.searchsorted(sizes, np.arange(length + 1), side="right").tolist()
    for c in range(1, length + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            got = best[c - sizes[:k]] + values[:k]
            i = got.argmax()
            if got[i] > best[c] + 1e-12:
                best[c], pick[c] = got[i], i
    pattern, c = np.zeros(len(sizes)), length
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[length]), pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan inverse by row operations; threads of a linear-algebra library are kept out of the driver."""
    n = len(matrix)
    work = np.concatenate([matrix, np.eye(n)], axis=1)
    for i in range(n):
        j = i + int(np.abs(work[i:, i]).argmax())
        if j != i:
            work[[i, j]] = work[[j, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0.0
        work -= factor[:, None] * work[i]
    return work[:, n:]


def column_generation(sizes: np.ndarray, demand: np.ndarray, length: int, gap: float = 1e-2, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Patterns and (fractional) counts of the cutting-stock linear program: fewest sequences that cover the demand.

    Revised simplex; the knapsack prices columns; stops when the price says the bound is within `gap`.
    """
    m = len(sizes)
    columns = np.zeros((m, m))
    columns[np.arange(m), np.arange(m)] = np.minimum(length // sizes, np.maximum(demand, 1))
    cost = np.ones(m)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand
    for step in range(rounds):
        duals = cost @ inverse
        low = int(duals.argmin())
        if duals[low] < -1e-9:
            enter, c = np.zeros(m), 0.0
            enter[low] = -1.0  # give up a surplus
        else:
            value, enter = price(np.maximum(duals, 0.0), sizes, length)
            c = 1.0
            if value <= 1.0 + gap:
                break
        change = inverse @ enter
        up = change > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / change[up]
        leave = int(ratio.argmin())
        columns[:, leave], cost[leave] = enter, c
        if step % 100 == 99:
            inverse = inverted(columns)
            x = np.maximum(inverse @ demand, 0.0)
        else:
            pivot = inverse[leave] / change[leave]
            theta = x[leave] / change[leave]
            inverse -= np.outer(change, pivot)
            inverse[leave] = pivot
            x = np.maximum(x - theta * change, 0.0)
            x[leave] = theta
    return [(columns[:, i].copy(), float(x[i])) for i in range(m) if cost[i] > 0 and x[i] > 1e-9]


def places(histogram: dict[int, int], length: int, max_waste: float = MAX_WASTE) -> tuple[np.ndarray, np.ndarray, list[tuple], int]:
    """(bin bounds, places a bin, place rows, sequences): rank intervals of each bin and the sequences they go to.

    A place row is (bin, first rank, end rank, first sequence, tails a sequence, slot of the first).
    """
    edges = bin_edges(length)
    count = np.zeros(len(edges), dtype=np.int64)
    for n, c in histogram.items():
        if n >= LEAST_TAIL:
            count[np.searchsorted(edges, n)] += c
    used = np.flatnonzero(count)
    taken, rows, sequences = np.zeros(len(edges), dtype=np.int64), [], 0
    if not len(used):
        return edges, taken, rows, sequences
    for pattern, times in column_generation(edges[used] // UNIT, count[used].astype(float), length // UNIT):
        copies = int(times + 1e-6)
        if copies and float(pattern @ edges[used]) >= (1 - max_waste) * length:
            pattern = pattern.astype(np.int64)
            free = np.where(pattern > 0, (count[used] - taken[used]) // np.maximum(pattern, 1), copies)
            copies = int(min(copies, free.min()))
            slot = 0
            for i in np.flatnonzero(pattern) if copies else ():
                b = used[i]
                rows.append((int(b), int(taken[b]), int(taken[b] + copies * pattern[i]), sequences, int(pattern[i]), slot))
                taken[b] += copies * pattern[i]
                slot += int(pattern[i])
            sequences += copies
    return edges, taken, rows, sequences


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, salts: int = 256, task_tokens: int = 1 << 22, keep_words: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = stash(tokenised(docs, tokenizer_path, id_col, text_col, length, end_id, keep_words))
    histogram = {int(r["tail"]): int(r["count"]) for r in tokens.where("tail > 0").groupBy("tail").count().collect()}  # length - 1 rows at most
    edges, taken, rows, _ = places(histogram, length)
    blocks = tokens.select("doc_id", "n", "block_base", F.posexplode("crcs").alias("i", "crc")).select(
        "doc_id", (F.col("i") * length).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.lit(_BLOCKS) + F.col("block_base") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    ranked = _ranked(tokens, edges, salts)
    placed = _placed(ranked, rows, taken)
    rest_rows = sum(histogram.values()) - int(taken.sum())
    rest = placed.where("sequence_id is null").select("uid")
    tails = tokens.where("tail > 0").select("uid", "doc_id", "n", "tail", "ids").join(maybe_broadcast(rest, rest_rows), "uid", "left_semi")
    tokens_left = sum(n * c for n, c in histogram.items()) * rest_rows // max(1, sum(histogram.values()))
    cut = _end_to_end(tails, length, max(1, -(-tokens_left // task_tokens)))
    in_order = W.partitionBy("sequence_id").orderBy("slot", "uid").rowsBetween(W.unboundedPreceding, 0)
    fitted = placed.where("sequence_id is not null").withColumn("offset", F.sum("tail").over(in_order) - F.col("tail"))
    fitted = fitted.select("doc_id", (F.col("n") - F.col("tail")).alias("start"), F.col("tail").cast("long").alias("length"), F.col("tail_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", F.col("offset").cast("long").alias("offset"))
    return blocks.unionByName(fitted).unionByName(cut)


def _ranked(tokens: DataFrame, edges: np.ndarray, salts: int) -> DataFrame:
    """Rank of each tail within its bin, in two steps: within (bin, salt), plus the rows of the salts before it."""
    ends = edges.tolist()
    widths = [b - a for a, b in zip(ends, ends[1:], strict=False)]
    steps = [0, *[i + 1 for i in range(len(widths) - 1) if widths[i] != widths[i + 1]], len(ends) - 1]

    def bin_of(tail: Column) -> Column:
        """Position of the first bin whose end is no less; -1 for tails too short to have one."""
        found = F.when(tail < LEAST_TAIL, -1).when(tail <= ends[0], 0)
        for lo, hi in zip(steps, steps[1:], strict=False):
            if hi > lo:
                found = found.when(tail <= ends[hi], lo + F.ceil((tail - ends[lo]) / (ends[lo + 1] - ends[lo])))
        return found.otherwise(len(ends) - 1).cast("int")

    small = tokens.where("tail > 0").select("uid", "doc_id", "n", "tail", "tail_crc", bin_of(F.col("tail")).alias("bin"), F.pmod(F.xxhash64("uid"), F.lit(salts)).alias("salt"))
    small = stash(small)
    before = W.partitionBy("bin").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    base = small.groupBy("bin", "salt").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).select("bin", "salt", "base")  # bins x salts at most
    own = F.row_number().over(W.partitionBy("bin", "salt").orderBy("uid")) - 1
    return small.withColumn("own", own).join(F.broadcast(base), ["bin", "salt"]).withColumn("rank", F.col("own") + F.col("base"))


def _placed(ranked: DataFrame, rows: list[tuple], taken: np.ndarray) -> DataFrame:
    """sequence_id and slot by rank; null for tails without a place. The places are a few thousand rows at most."""
    spec = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = spec[:, 0] * (1 << 44) + spec[:, 1]
        for batch in batches:
            bins, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("bin", "rank"))
            at = np.maximum(np.searchsorted(key, bins * (1 << 44) + rank, side="right") - 1, 0)
            fits = (bins >= 0) & (rank < taken[np.maximum(bins, 0)])
            p = spec[at] if len(spec) else np.zeros((len(bins), 6), dtype=np.int64)
            each = np.maximum(p[:, 4], 1)
            sequence, slot = p[:, 3] + (rank - p[:, 1]) // each, p[:, 5] + (rank - p[:, 1]) % each
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "doc_id", "n", "tail", "tail_crc")), pa.array(sequence, mask=~fits), pa.array(slot, mask=~fits)], names=["uid", "doc_id", "n", "tail", "tail_crc", "sequence_id", "slot"])

    return ranked.select("uid", "doc_id", "n", "tail", "tail_crc", "bin", "rank").mapInArrow(run, "uid long, doc_id long, n long, tail int, tail_crc long, sequence_id long, slot long")


def _end_to_end(tails: DataFrame, length: int, parts: int) -> DataFrame:
    """Lay tails end to end within each of `parts` tasks and cut at the sequence length; the last stretch at powers of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = _RESIDUAL + (TaskContext.get().partitionId() << 36)
        rows: list[tuple] = []
        open_pieces: list[tuple] = []  # (doc_id, n, start, ids) of the sequence that is being filled
        filled = 0

        def close(pieces: list[tuple], at: int) -> None:
            offset = 0
            for doc_id, n, start, ids in pieces:
                rows.append((doc_id, start, len(ids), checksum(ids), n, at, offset))
                offset += len(ids)

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return got

        for batch in batches:
            for doc_id, n, tail, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "tail", "ids")), strict=True):
                ids, start = np.frombuffer(raw, dtype="<u4"), n - tail
                while len(ids):
                    part = ids[: length - filled]
                    open_pieces.append((doc_id, n, start, part))
                    filled, start, ids = filled + len(part), start + len(part), ids[len(part) :]
                    if filled == length:
                        close(open_pieces, sequence)
                        open_pieces, filled, sequence = [], 0, sequence + 1
            if rows:
                yield out()
        while filled:
            want = 1 << (filled.bit_length() - 1)
            got, pieces = 0, []
            while got < want:
                doc_id, n, start, ids = open_pieces.pop(0)
                part = ids[: want - got]
                pieces.append((doc_id, n, start, part))
                got += len(part)
                if len(part) < len(ids):
                    open_pieces.insert(0, (doc_id, n, start + len(part), ids[len(part) :]))
            close(pieces, sequence)
            filled, sequence = filled - want, sequence + 1
        if rows:
            yield out()

    return tails.repartition(parts, "uid").sortWithinPartitions("uid").mapInArrow(run, PIECES)
