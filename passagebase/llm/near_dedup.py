"""SimHash near-duplicates with a pigeonring candidate filter.

Fingerprint: 64 bits over the XXH64 (seed 42) of all word shingles, a bit set if more than half the hashes have it set.
Two fingerprints link at `max_bits` or fewer differing bits. The 64 bits lie on a ring of max_bits + 1 segments. If two
fingerprints differ in at most max_bits bits, some chain of consecutive segments, started at the right place, has no
prefix whose differences exceed its share of the budget: prefix of length l differs in at most l * max_bits / segments
bits. Length one then means an equal segment; length two at most one differing bit in the next one, and so on. Pairs
that fail the chain never reach the full Hamming check.

Work: equal fingerprints are one node. Every node is dealt to its five segment values (five small rows); inside a
partition the next segment's value and its one-bit neighbours are looked up by binary search, chains are checked and
only a spanning forest of the links found is sent on. Crowded runs (one large group of near copies) are linked by a
breadth-first sweep that compares reached nodes with unreached ones only, so no full set of pairs is made. Segment
values with more than `block_rows` nodes are dealt as pairs of salted blocks.

Defined results: null and empty texts and texts without words have fingerprint zero and link like any other; a text with
fewer words than the shingle length is one shingle; repeated rows share fingerprint and component; a null doc_id counts
as a document that can't be a component_id unless its component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagebase.llm.common import as_bytes, doc_slices, maybe_broadcast, stash
from passagebase.llm.components import connected_components

BITS = 64
_PIECE = 1 << 16
#: Hashes whose bits are counted at a time, in bytes.
_SUMMED = 192
#: Pairs of runs with more combinations than this are swept instead of expanded.
CROWDED = 1 << 16
_PAIRS = 1 << 21


def simhash_bytes(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of one UTF-8 text; words are runs of bytes other than ASCII white space, A-Z lowered."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
        return _majority([np.array(hashes, dtype=np.uint64)], 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    ends = (starts + lengths)[shingle - 1 :].tolist()
    digest, begin = xxhash.xxh64_intdigest, starts[: len(ends)].tolist()
    pieces = [np.array([digest(joined[a:b], seed) for a, b in zip(begin[i : i + _PIECE], ends[i : i + _PIECE], strict=True)], dtype=np.uint64) for i in range(0, len(ends), _PIECE)]
    return _majority(pieces, len(ends))


def _majority(pieces: list[np.ndarray], total: int) -> int:
    counts = sum(np.unpackbits(p.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for p in pieces)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


@functools.cache
def _mixers(words: int) -> np.ndarray:
    """Two odd factors for each word; those of the first words are the same whatever their number."""
    return np.random.default_rng(42).integers(0, 1 << 63, (words, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bit_sums(hashes: np.ndarray, words: int) -> np.ndarray:
    """How many of the 64-bit hashes, mixed anew for each word, have each of words x 64 bits set."""
    one, two = _mixers(words).T
    total = np.zeros(words * BITS, dtype=np.int64)
    for at in range(0, len(hashes), _SUMMED):
        x = hashes[at : at + _SUMMED, None] * one
        x = (x ^ (x >> np.uint64(29))) * two
        x ^= x >> np.uint64(32)
        total += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return total


def majority_words(sums: np.ndarray, total: int) -> np.ndarray:
    """Words of the bits that are set in over half of `total` hashes."""
    return np.packbits(2 * sums > total, bitorder="little").view(np.uint64)


def wide_simhash(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of words x 64 bits over a set of 64-bit hashes; fewer words are the first ones of more."""
    return majority_words(bit_sums(hashes, words), len(hashes))


def ring_distances(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Differing bits of the fingerprint `one` and each row of `many`."""
    return np.bitwise_count(many ^ one).sum(axis=1, dtype=np.int64)


def ring_close(one: np.ndarray, many: np.ndarray, max_bits: int, chain: int = 4) -> np.ndarray:
    """Which rows of `many` differ from `one` in at most max_bits bits.

    The words lie on a ring of 32-bit segments. Some chain of consecutive segments must keep each of its first `chain`
    prefixes within its share of the budget; only rows that have one are counted over all segments.
    """
    parts = np.bitwise_count(np.ascontiguousarray(many ^ one).view(np.uint32)).astype(np.int64)
    m = parts.shape[1]
    spent, alive = np.zeros_like(parts), np.ones(parts.shape, dtype=bool)
    for length in range(1, min(chain, m) + 1):
        spent += np.roll(parts, 1 - length, axis=1)
        alive &= spent * m <= length * max_bits
    near = alive.any(axis=1)
    near[near] = parts[near].sum(axis=1) <= max_bits
    return near


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row, whole texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in doc_slices(batches, "text"):
            fps = np.array([simhash_bytes(x, shingle, seed) for x in as_bytes(batch.column("text"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the ring's max_bits + 1 segments, which tile the 64 bits."""
    m = max_bits + 1
    edges = [BITS * i // m for i in range(m + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


#: Reached and unreached nodes of a crowded run that are compared at a time: 8 bytes a pair.
SWEEP_NODES, SWEEP_REST = 64, 1 << 16


class Forest:
    """Union-find over positions; remembers the links that joined two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))


def sweep(fps: np.ndarray, members: np.ndarray, max_bits: int, forest: Forest) -> None:
    """Link all members of a crowded run: reached nodes are compared, in blocks, with unreached ones only."""
    rest = members
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            block, front = front[:SWEEP_NODES], front[SWEEP_NODES:]
            hit, via = np.zeros(len(rest), dtype=bool), np.empty(len(rest), dtype=np.int64)
            for at in range(0, len(rest), SWEEP_REST):
                part = slice(at, at + SWEEP_REST)
                near = np.bitwise_count(fps[block][:, None] ^ fps[rest[part]][None, :]) <= max_bits
                hit[part], via[part] = near.any(axis=0), block[near.argmax(axis=0)]
            if hit.any():
                for a, b in zip(via[hit].tolist(), rest[hit].tolist(), strict=True):
                    forest.link(a, b)
                front, rest = np.concatenate([front, rest[hit]]), rest[~hit]


def ring_links(fps: np.ndarray, group: np.ndarray, seg: int, max_bits: int) -> np.ndarray:
    """Spanning forest of the links among nodes of equal `group` (equal segment seg) that pass the chain; pairs of rows.

    fps and group are parallel; nodes of one group agree in segment `seg`.
    """
    ring = segments(max_bits)
    m = len(ring)
    shift, width = ring[(seg + 1) % m]
    after = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    _, dense = np.unique(group, return_inverse=True)
    key = (dense.astype(np.uint64) << np.uint64(width)) | after
    order = np.argsort(key, kind="stable")
    key, fps = key[order], fps[order]
    runs, first, sizes = np.unique(key, return_index=True, return_counts=True)
    forest = Forest(len(fps))
    big = sizes * sizes > CROWDED
    for r in np.flatnonzero(big):
        sweep(fps, np.arange(first[r], first[r] + sizes[r]), max_bits, forest)

    def check(a: np.ndarray, b: np.ndarray) -> None:
        """Chain of growing budgets around the ring, then a link for each pair that stays within all of them."""
        a, b = a[a < b], b[a < b]
        differ = fps[a] ^ fps[b]
        spent = np.zeros(len(a), dtype=np.int64)
        for length in range(1, m + 1):
            s, w = ring[(seg + length - 1) % m]
            spent = spent + np.bitwise_count(differ & np.uint64(((1 << w) - 1) << s))
            stay = spent <= length * max_bits // m
            a, b, differ, spent = a[stay], b[stay], differ[stay], spent[stay]
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            forest.link(x, y)

    def expand(a_lo: np.ndarray, a_n: np.ndarray, b_lo: np.ndarray, b_n: np.ndarray) -> None:
        """All pairs of two small runs each, some millions at a time."""
        ends = np.cumsum(a_n * b_n)
        at = 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS)))
            total = (a_n * b_n)[at:stop]
            which = np.repeat(np.arange(at, stop), total)
            within = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            check(a_lo[which] + within // b_n[which], b_lo[which] + within % b_n[which])
            at = stop

    expand(first[~big], sizes[~big], first[~big], sizes[~big])
    for bit in range(width):
        low = np.flatnonzero(((runs >> np.uint64(bit)) & np.uint64(1)) == 0)
        want = runs[low] | np.uint64(1 << bit)
        at = np.searchsorted(runs, want)
        ok = at < len(runs)
        ok[ok] = runs[at[ok]] == want[ok]
        a, b = low[ok], at[ok]
        crowded = sizes[a] * sizes[b] > CROWDED
        expand(first[a[~crowded]], sizes[a[~crowded]], first[b[~crowded]], sizes[b[~crowded]])
        for x, y in zip(a[crowded].tolist(), b[crowded].tolist(), strict=True):
            sweep(fps, np.concatenate([np.arange(first[x], first[x] + sizes[x]), np.arange(first[y], first[y] + sizes[y])]), max_bits, forest)
    return order[np.array(forest.links, dtype=np.int64).reshape(-1, 2)]


def links(nodes: DataFrame, max_bits: int = 4, block_rows: int = 200_000) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` that connect all pairs within max_bits bits."""
    ring = segments(max_bits)
    value = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in ring]
    dealt = nodes.select("fp", F.posexplode(F.array(*value)).alias("seg", "val"))
    sizes = dealt.groupBy("seg", "val").count().where(F.col("count") > block_rows)
    hot = stash(sizes.select("seg", "val", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")))
    if hot.count():  # at most 2**13 values a segment: a bounded side
        with_blocks = dealt.join(F.broadcast(hot), ["seg", "val"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = with_blocks.select("fp", "seg", "val", mine.alias("mine"), other.alias("other")).select("fp", "seg", "val", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    else:
        dealt = dealt.select("fp", "seg", "val", F.lit(0).alias("x"), F.lit(0).alias("y"))
    keys = ["seg", "val", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows; complete groups are worked off whenever enough rows are held."""
        held: list[np.ndarray] = []

        def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            change = np.any(rows[1:, 1:] != rows[:-1, 1:], axis=1)
            group = np.concatenate([[0], np.cumsum(change)])
            for seg in np.unique(rows[:, 1]):
                own = rows[:, 1] == seg
                fps = rows[own, 0].view(np.uint64)
                pairs = ring_links(fps, group[own], int(seg), max_bits)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(fps[pairs[:, i]].view(np.int64)) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("fp", *keys)], axis=1))
            if sum(map(len, held)) >= 100_000:
                rows = np.concatenate(held)
                cut = np.flatnonzero(np.any(rows[1:, 1:] != rows[:-1, 1:], axis=1))
                if len(cut):
                    yield from work(np.ascontiguousarray(rows[: cut[-1] + 1]))
                    rows = rows[cut[-1] + 1 :]
                held[:] = [rows]
        if held and len(rows := np.concatenate(held)):
            yield from work(rows)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its component)."""
    slim = stash(fingerprints(docs, id_col, text_col, shingle, seed))
    nodes = stash(slim.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(nodes.select("fp"), max_bits))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    top = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = stash(named.join(top, "root").select("fp", "component_id"))
    out = slim.join(maybe_broadcast(by_fp, by_fp.count()), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
