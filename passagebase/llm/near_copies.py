"""Near copies by SimHash with pigeonring filtering, at a Jaccard similarity of word shingles, every link verified.

The bits of a text's fingerprint, the SimHash of its shingle set, lie on a ring of segments of 64 bits. In each segment the
bit whose count is farthest from half is the surest: the last to differ in a near copy. Texts meet where two consecutive
segments agree in place and value of their surest bits (a key of 14 bits; three segments, 21 bits, in very large tables).
There a chain begins: its prefixes, one segment and two, must stay within CHAIN_BITS differing bits a segment, and only
texts that have such a partner go on. The first RING_WORDS segments are then compared as a whole: chains of consecutive
segments of 32 bits must stay within proportional budgets, then all their bits within RING_BITS (a pair right at 0.8
differs in 78 bits on average, deviation 8, so it passes with probability 0.997; at 0.85 with 0.99999). What passes is
verified on the whole shingle sets; nothing else links.

The surest bits of a segment agree with probability 0.43 at a similarity of 0.8 and 1 in 128 among strangers, so a pair
right at 0.8 meets nowhere with a probability of about 2 in 10,000, 3 with three segments (0.43 is simulated, the rest
calculated from it).
Sets of fewer than RING_LEAST shingles have no steady fingerprint: they, and those that may be similar to them, meet at
their least hashes, as many as leave no similar pair apart (prefix filtering, exact).

Three steps, each of which leaves less to do for the next:
1. Every text that has a partner goes with its shingle set to one group, its largest. A breadth-first sweep compares
   reached texts with unreached ones only and returns one row per text, its root in the group.
2. In each group of a key that holds several components, every text names its nearest text (by fingerprint) of another
   component; of all its groups' offers the nearest one is verified.
3. Of the pairs that still lie in different components and haven't met in step 1, all that pass the ring are verified,
   each in the group of the first key that its texts share: a pass over fingerprints finds the texts of each group that
   have such a partner (a row each), only these bring their shingle sets to the group, and the links that join components
   leave it. No list of pairs is made.
Groups larger than a bound are dealt as pairs of salted blocks, so that no task holds a group of any size.

A text is known by 64 bits of its SHA-256 while links are made; rows are decided by doc_id and the whole SHA-256.

Defined results: words are runs of bytes other than ASCII white space, A-Z lowered; a text with fewer words than the
shingle length is one shingle, so are null and empty texts; equal texts are copies; of each component the row with the
smallest doc_id stays (a null doc_id is larger than any other, ties go by SHA-256); rows repeated with doc_id and text
are decided alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagebase.llm.common import as_bytes, doc_slices, maybe_broadcast, stash, text_sha
from passagebase.llm.components import connected_components
from passagebase.llm.near_dedup import BITS, bit_sums, majority_words, ring_close, ring_distances, wide_simhash

#: (rows of the table at most, segments of the fingerprint, segments that a key spans)
KEY_PLANS = [(1 << 26, 56, 2), (None, 144, 3)]
#: Differing bits a segment that a chain may have; 9.6 are usual at a similarity of 0.8, 32 among strangers.
CHAIN_BITS = 16
RING_WORDS, RING_BITS = 8, 100
#: Sets smaller than this have no steady fingerprint and are verified at once.
RING_LEAST = 16
#: A group with more bytes of shingle sets, or more rows of fingerprints, is dealt as pairs of blocks of about this size.
BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 8192
#: Rows of whole groups that are worked off at a time.
_HELD = 1 << 17


def shingles(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct hashes of the shingles, sorted."""
    parts = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(b" ".join(parts), seed)], dtype=np.uint64)
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    ends = (starts + lengths)[words - 1 :].tolist()
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(ends)].tolist(), ends, strict=True)], dtype=np.uint64))


def segment_keys(sums: np.ndarray, total: int, span: int) -> np.ndarray:
    """A key for each segment: its place on the ring, and place and value of the surest bits of `span` segments from it on."""
    counts = sums.reshape(-1, BITS)
    surest = np.abs(2 * counts - total).argmax(axis=1)
    symbol = 2 * surest + (2 * counts[np.arange(len(counts)), surest] > total)
    keys = np.arange(len(counts))
    for i in range(span):
        keys = keys * (2 * BITS) + np.roll(symbol, -i)
    return keys.astype(np.int32)


def least_hashes(hashes: np.ndarray, least: float) -> np.ndarray:
    """The first of a set's sorted hashes, of which it shares one with every set that is similar to it."""
    return hashes[: len(hashes) - int(np.ceil(least * len(hashes) - 1e-6)) + 1]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    sha = text_sha(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), sha.alias("sha"), F.xxhash64(sha).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def key_plan(rows: int) -> tuple[int, int]:
    """(segments, segments that a key spans) for a table of so many rows."""
    return next((segments, span) for most, segments, span in KEY_PLANS if most is None or rows <= most)


def sketches(texts: DataFrame, words: int, least: float, segments: int, span: int) -> DataFrame:
    """(doc_id, sha, node, n, bits, keys, few) of every row: size of its shingle set, fingerprint, a key for each segment
    (-1: none, the set is too small) and the least hashes of sets that may have a small one beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in doc_slices(batches, "text", 2 << 20):
            n, bits, keys, few = [], [], [], []
            for s in (shingles(x, words) for x in as_bytes(batch.column("text"))):
                n.append(len(s))
                few.append(least_hashes(s, least).view(np.int64) if least * len(s) < RING_LEAST else [])
                if len(s) < RING_LEAST:
                    bits.append(bytes(8 * segments))
                    keys.append(np.full(segments, -1, dtype=np.int32))
                else:
                    sums = bit_sums(s, segments)
                    bits.append(majority_words(sums, len(s)).tobytes())
                    keys.append(segment_keys(sums, len(s), span))
            made = [pa.array(n, pa.int32()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int32())), pa.array(few, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "sha", "node")), *made], names=["doc_id", "sha", "node", "n", "bits", "keys", "few"])

    return texts.mapInArrow(run, "doc_id long, sha string, node long, n int, bits binary, keys array<int>, few array<long>")


def _dealt(bands: DataFrame, segments: int) -> DataFrame:
    """(key, node, n, one, two) of every key of every node; one and two are the segments with which its chain begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = (np.asarray(batch.column(c)).astype(np.int64) for c in ("node", "n"))
            steady = n >= RING_LEAST
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), dtype=np.int64).reshape(-1, segments)[steady]
            keys = np.asarray(batch.column("keys").flatten()).reshape(-1, segments)[steady]
            few = [np.array(x, dtype=np.int64) for x in batch.column("few").to_pylist()]
            times = np.fromiter(map(len, few), dtype=np.int64, count=len(few))
            none = np.zeros(times.sum(), dtype=np.int64)
            columns = [[keys.ravel(), *few], [np.repeat(node[steady], segments), np.repeat(node, times)], [np.repeat(n[steady], segments), np.repeat(n, times)], [bits.ravel(), none], [np.roll(bits, -1, axis=1).ravel(), none]]
            whole = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names=["key", "node", "n", "one", "two"])
            for at in range(0, whole.num_rows, 1 << 16):
                yield whole.slice(at, 1 << 16)

    return bands.select("node", "n", "bits", "keys", "few").mapInArrow(run, "key long, node long, n long, one long, two long")


def chain_partners(group: np.ndarray, n: np.ndarray, one: np.ndarray, two: np.ndarray, least: float) -> np.ndarray:
    """Which rows have a partner in their group by size and chain; rows are sorted by group and n."""
    hit, at, d = np.zeros(len(n), dtype=bool), np.arange(len(n)), 0
    while len(at):
        d += 1
        at = at[: np.searchsorted(at, len(n) - d)]
        at = at[(group[at] == group[at + d]) & (n[at] >= least * n[at + d] - 1e-6)]
        a = at[~(hit[at] & hit[at + d])]
        spent = np.bitwise_count(one[a] ^ one[a + d]).astype(np.int64)
        near = (spent <= CHAIN_BITS) & (spent + np.bitwise_count(two[a] ^ two[a + d]) <= 2 * CHAIN_BITS)
        a = a[near | (n[a] < RING_LEAST)]
        hit[a] = hit[a + d] = True
        if d % 16 == 0:  # groups whose rows all have one are done
            open_groups = np.bincount(group[~hit], minlength=group[-1] + 1) > 0
            at = at[open_groups[group[at]]]
    return hit


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows of whole groups, many at a time, with a number for each row's group."""
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        tags = np.stack([np.asarray(table.column(k)).astype(np.int64) for k in keys], axis=1)
        return np.concatenate([[False], np.any(tags[1:] != tags[:-1], axis=1)])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _HELD:
            table = pa.Table.from_batches(held).combine_chunks()
            first = starts(table)
            cuts = np.flatnonzero(first)
            if len(cuts):
                yield table.slice(0, cuts[-1]), np.cumsum(first[: cuts[-1]])
                table = table.slice(cuts[-1])
            held = table.to_batches()
    if sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held)
        yield table, np.cumsum(starts(table))


def meetings(bands: DataFrame, segments: int, least: float) -> DataFrame:
    """(key, node), a row each, where the node has a partner by the chain that begins at the key, or by size if it is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole_groups(batches, ["key", "x", "y"]):
            n, one, two = (np.asarray(table.column(c)).astype(np.int64) for c in ("n", "one", "two"))
            hit = pa.array(chain_partners(group, n, one, two, least))
            yield from table.select(["key", "node"]).filter(hit).to_batches()

    keyed = bands.where(F.col("n") >= RING_LEAST).select(F.explode(F.col("keys").cast("array<long>")).alias("key")).unionAll(bands.select(F.explode("few").alias("key")))
    rows = _blocked(_dealt(bands, segments), _many_blocks(keyed, F.count(F.lit(1)), BLOCK_ROWS))
    keys = ["key", "x", "y"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "n").mapInArrow(run, "key long, node long").distinct()


def shingle_sets(texts: DataFrame, words: int = 5) -> DataFrame:
    """(node, n, ring, hashes): size, wide fingerprint and sorted hashes of the shingle set of each row (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in doc_slices(batches, "text", 2 << 20):
            sets = [shingles(x, words) for x in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(s) for s in sets], pa.int32()), pa.array([wide_simhash(s, RING_WORDS).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "ring", "hashes"])

    return texts.mapInArrow(run, "node long, n int, ring binary, hashes binary")


def rings_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, RING_WORDS)


def similar(one: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of the sets have a Jaccard similarity of `least` or more with `one`; all sorted and distinct."""
    sizes = np.fromiter(map(len, others), dtype=np.int64, count=len(others))
    if not len(others):
        return np.zeros(0, dtype=bool)
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    common = np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return common >= least * (len(one) + sizes - common) - 1e-6


def passes_ring(i: int, others: np.ndarray, sizes: np.ndarray, rings: np.ndarray, least: float) -> np.ndarray:
    """Which of the others may be similar to i by size of set and fingerprint."""
    n, one = sizes[others], sizes[i]
    ok = np.minimum(n, one) >= least * np.maximum(n, one) - 1e-6
    ask = ok & (n >= RING_LEAST) & (one >= RING_LEAST)
    ok[ask] = ring_close(rings[i], rings[others[ask]], RING_BITS)
    return ok


def group_roots(sizes: np.ndarray, rings: np.ndarray, sets: list[np.ndarray], least: float) -> np.ndarray:
    """Position of the first member of each member's component, by a sweep of reached against unreached members."""
    root, rest = np.full(len(sizes), -1), np.arange(len(sizes))
    while len(rest):
        first, rest = rest[0], rest[1:]
        root[first], front = first, [first]
        while front and len(rest):
            x = front.pop()
            ok = passes_ring(x, rest, sizes, rings, least)
            ok[ok] = similar(sets[x], [sets[i] for i in rest[ok]], least)
            hit, rest = rest[ok], rest[~ok]
            root[hit] = first
            front += hit.tolist()
    return root


def _in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table a group of rows that follow each other and agree in the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tags = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in keys], axis=1)
        cuts = np.flatnonzero(np.any(tags[1:] != tags[:-1], axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tags)], strict=True):
            tag = tuple(tags[a].tolist())
            if held and tag != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tag
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _blocked(rows: DataFrame, sizes: DataFrame, pairs_of_blocks: bool = True) -> DataFrame:
    """Rows with the group's (x, y) blocks; sizes are (key, blocks) of the groups with several, a row each."""
    many = sizes.count()
    if not many:
        return rows.withColumn("x", F.lit(0)).withColumn("y", F.lit(0))
    dealt = rows.join(maybe_broadcast(sizes, many), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if pairs_of_blocks else F.col("mine")
    dealt = dealt.withColumn("other", other)
    return dealt.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other")).drop("blocks", "mine", "other")


def _at_home(rows: DataFrame, least: float) -> DataFrame:
    """(node, root) of rows (key, x, y, node, n, ring, hashes), roots within each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _in_groups(batches, ["key", "x", "y"]):
            nodes = np.asarray(group.column("node"))
            if len(nodes) > 1:
                sets = [np.frombuffer(s, dtype=np.uint64) for s in group.column("hashes").to_pylist()]
                root = group_roots(np.asarray(group.column("n")).astype(np.int64), rings_of(group.column("ring").combine_chunks()), sets, least)
                hit = root != np.arange(len(root))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(nodes[root[hit]])], names=["a", "b"])

    keys = ["key", "x", "y"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a long, b long")


def _offers(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, d): for each row (key, x, y, node, n, ring, component, home) its nearest of those of other component and home
    that pass the ring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _in_groups(batches, ["key", "x", "y"]):
            node, n, component, home = (np.asarray(group.column(c)).astype(np.int64) for c in ("node", "n", "component", "home"))
            rings = rings_of(group.column("ring").combine_chunks())
            found = []
            for i in range(len(node)):
                b = np.flatnonzero((component != component[i]) & (home != home[i]))
                b = b[passes_ring(i, b, n, rings, least)]
                if len(b):
                    d = ring_distances(rings[i], rings[b])
                    best = np.lexsort((node[b], d))[0]
                    found.append((node[i], node[b[best]], d[best]))
            if found:
                a, b, d = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d.astype(np.int32))], names=["a", "b", "d"])

    keys = ["key", "x", "y"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a long, b long, d int")


class Open:
    """A group's rows (key, x, y, node, n, ring, component, home, keys): which pairs are still to be verified in it."""

    def __init__(self, group: pa.Table, least: float):
        self.node, self.n, self.component, self.home = (np.asarray(group.column(c)).astype(np.int64) for c in ("node", "n", "component", "home"))
        self.rings, self.least = rings_of(group.column("ring").combine_chunks()), least
        self.keys = np.asarray(group.column("keys").combine_chunks().flatten()).astype(np.int64).reshape(len(self.node), -1)
        self.key = int(group.column("key")[0].as_py())

    def after(self, i: int) -> np.ndarray:
        """Later rows of other component and home that pass the ring and share no earlier key with row i."""
        b = i + 1 + np.flatnonzero((self.component[i + 1 :] != self.component[i]) & (self.home[i + 1 :] != self.home[i]))
        b = b[passes_ring(i, b, self.n, self.rings, self.least)]
        same = (self.keys[b] == self.keys[i]) & (self.keys[i] >= 0)
        # Pairs that share least hashes only are verified at each of them.
        return b[(self.keys[i][same.argmax(axis=1)] == self.key) | ~same.any(axis=1)]


def _with_partners(rows: DataFrame, least: float) -> DataFrame:
    """(key, node) of the rows that have a partner to be verified in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _in_groups(batches, ["key", "x", "y"]):
            own = Open(group, least)
            hit = np.zeros(len(own.node), dtype=bool)
            for i in range(len(own.node)):
                b = own.after(i)
                hit[i] |= len(b) > 0
                hit[b] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.full(hit.sum(), own.key)), pa.array(own.node[hit])], names=["key", "node"])

    keys = ["key", "x", "y"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "key long, node long").distinct()


def _links_in_groups(rows: DataFrame, least: float) -> DataFrame:
    """(a, b): links between components, verified on the rows' shingle sets (hashes); fewer than each group has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _in_groups(batches, ["key", "x", "y"]):
            own, links = Open(group, least), []
            sets = [np.frombuffer(s, dtype=np.uint64) for s in group.column("hashes").to_pylist()]
            for i in range(len(sets)):
                b = own.after(i)
                for j in b[similar(sets[i], [sets[j] for j in b], least)].tolist():
                    if own.component[j] != own.component[i]:
                        links.append((own.node[i], own.node[j]))
                        own.component[own.component == own.component[j]] = own.component[i]
            if links:
                a, b = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    keys = ["key", "x", "y"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(s, dtype=np.uint64) for s in batch.column(c).to_pylist()] for c in ("x", "y"))
            ok = [bool(similar(p, [q], least)[0]) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after links (a, b) between nodes; only the roots that they join go through the components' rounds."""
    n = roots.count()
    known = maybe_broadcast(roots, n)
    named = links.join(known.withColumnRenamed("node", "a").withColumnRenamed("root", "ra"), "a", "left").join(known.withColumnRenamed("node", "b").withColumnRenamed("root", "rb"), "b", "left")
    between = stash(named.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct())
    if between.isEmpty():
        return roots
    higher = connected_components(between).withColumnRenamed("root", "top")
    up = roots.join(higher.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = higher.select("node", F.col("top").alias("root")).join(known.select("node"), "node", "left_anti")
    return stash(up.unionByName(alone))


def _many_blocks(rows: DataFrame, measure, bound: int) -> DataFrame:
    """(key, blocks) of the groups that are dealt as several blocks."""
    return stash(rows.groupBy("key").agg(F.ceil(measure / bound).cast("int").alias("blocks")).where("blocks > 1"))


def _open_rows(shared: DataFrame, roots: DataFrame, sets: DataFrame, home: DataFrame) -> DataFrame:
    """(key, node, component, n, ring, home) of the keys that hold several components."""
    known = shared.join(maybe_broadcast(roots, roots.count()), "node", "left").select("key", "node", F.coalesce("root", "node").alias("component"))
    several = stash(known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"))
    rings = sets.select("node", "n", "ring").join(maybe_broadcast(home, home.count()), "node")
    return known.join(maybe_broadcast(several, several.count()), "key", "left_semi").join(rings, "node")


def _met(bands: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, keys): the keys of each node, -1 for those where it met no partner."""
    kept = shared.groupBy("node").agg(F.collect_set("key").alias("kept"))
    keys = F.transform("keys", lambda k: F.when(F.array_contains("kept", k.cast("long")), k).otherwise(F.lit(-1)))
    return stash(bands.select("node", "keys").join(kept, "node").select("node", keys.alias("keys")))


def components(texts: DataFrame, keyed: DataFrame, bands: DataFrame, words: int, least: float) -> DataFrame:
    """(node, root) of the nodes that have near copies; keyed has (key, node), a row each, bands the keys of each node."""
    keyed = stash(keyed)
    counted = stash(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    shared = stash(keyed.join(maybe_broadcast(counted, counted.count()), "key"))
    home = stash(shared.groupBy("node").agg(F.max(F.struct("size", "key"))["key"].alias("home")))
    n_home = home.count()
    sets = stash(shingle_sets(texts.join(maybe_broadcast(home, n_home), "node", "left_semi").select("node", "text").dropDuplicates(["node"]), words))
    at_home = sets.join(maybe_broadcast(home.withColumnRenamed("home", "key"), n_home), "node")
    heavy = _many_blocks(at_home, F.sum("n") * 8, BLOCK_BYTES)
    first = stash(_at_home(_blocked(at_home, heavy), least))
    # Groups in one block give one root a node; those in several give links.
    roots = stash(connected_components(first)) if not heavy.isEmpty() else stash(first.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(first.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
    rows = stash(_open_rows(shared, roots, sets, home))
    offers = _offers(_blocked(rows, _many_blocks(rows, F.count(F.lit(1)), BLOCK_ROWS), False), least)
    nearest = offers.groupBy("a").agg(F.min(F.struct("d", "b"))["b"].alias("b"))
    pairs = stash(nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = _merged(roots, stash(verified(pairs, sets, least)))
    rows = _open_rows(shared, roots, sets, home)
    rows = stash(rows.join(_met(bands, shared), "node"))
    if rows.isEmpty():
        return roots
    asked = stash(_with_partners(_blocked(rows, _many_blocks(rows, F.count(F.lit(1)), BLOCK_ROWS)), least))
    rows = rows.join(maybe_broadcast(asked, asked.count()), ["key", "node"], "left_semi")
    heavy = _many_blocks(rows, F.sum("n") * 8, BLOCK_BYTES)
    return _merged(roots, stash(_links_in_groups(_blocked(rows.join(sets.select("node", "hashes"), "node"), heavy), least)))


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha) of the rows that go: all of a component of near copies but its first row."""
    texts = _texts(docs, id_col, text_col)
    segments, span = key_plan(docs.count())
    rows = stash(sketches(texts, words, least, segments, span))
    bands = rows.select("node", "n", "bits", "keys", "few")
    if not rows.groupBy("node").count().where("count > 1").isEmpty():
        bands = stash(bands.dropDuplicates(["node"]))
    roots = components(texts, meetings(bands, segments, least), bands, words, least)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")
    placed = rows.select("doc_id", "sha", "node").join(maybe_broadcast(roots, roots.count()), "node", "left").select("doc_id", "sha", F.coalesce("root", "node").alias("root"))
    stay = stash(placed.groupBy("root").agg(F.min(row).alias("stay"), F.max(row).alias("last")).where(~F.col("stay").eqNullSafe(F.col("last"))).select("root", "stay"))
    return placed.join(maybe_broadcast(stay, stay.count()), "root").where(~row.eqNullSafe(F.col("stay"))).select("doc_id", "sha").distinct()
