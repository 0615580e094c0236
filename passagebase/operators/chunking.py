"""Passages from documents: fixed word windows, and sentence-complete packing with sections and overlap."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagebase.functions import text as T

CHUNK_DDL = "scope string, source_file string, chunk_index int, chunk_id string, text string, page int, pages array<int>, section string"

#: Bytes of text that a task makes Python objects of at a time.
SLICE_BYTES = 1 << 20


def word_windows(docs: DataFrame, size: int = 500, overlap: int = 50, scope: str = "scope", file: str = "source_file", text: str = "text") -> DataFrame:
    """Overlapping windows of words; a document without words has none."""
    step = size - overlap
    w = docs.select(F.col(scope).alias("scope"), F.col(file).alias("source_file"), T.words(F.col(text)).alias("w")).where(F.size("w") > 0)
    at = w.select("*", F.posexplode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).alias("chunk_index", "at"))
    return at.select("scope", "source_file", "chunk_index", chunk_id().alias("chunk_id"), F.array_join(F.slice("w", F.col("at") + 1, F.lit(size)), " ").alias("text"))


def chunk_id():
    return F.concat(F.col("source_file"), F.lit("_chunk_"), F.col("chunk_index").cast("string"))


def units(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Non-blank lines in order, without page-number lines, each with a heading flag."""
    out = docs.select(*key, F.posexplode(T.lines(F.col(text))).alias("pos", "line")).select(*key, "pos", T.strip(F.col("line")).alias("unit"))
    return out.where((F.col("unit") != "") & ~T.is_page_number(F.col("unit"))).withColumn("heading", T.is_heading(F.col("unit")))


def with_sections(unit_rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last heading at or before each unit."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return unit_rows.withColumn("section", F.last(F.when(F.col("heading"), F.col("unit")), ignorenulls=True).over(w))


def default_tokens(s: str) -> int:
    return int(len(s.split()) * 1.4) + 1


def each(count: Callable[[str], int]) -> Callable[[list[str]], list[int]]:
    """A counter of many texts from a counter of one."""
    return lambda texts: [count(t) for t in texts]


def longest_run(parts: list[str], at: int, fits: Callable[[str], bool]) -> int:
    """The end of the longest run of parts from `at` whose text fits, one part at least.

    Steps double until a run no longer fits, then the end is found by halving: a counter is asked a logarithmic number of
    times. It must not fall as words are added, as counters of tokens do.
    """
    low, step = at + 1, 1
    while low < len(parts):
        ahead = min(low + step, len(parts))
        if not fits(" ".join(parts[at:ahead])):
            break
        low, step = ahead, 2 * step
    else:
        return low
    high = ahead - 1
    while low < high:
        middle = (low + high + 1) // 2
        if fits(" ".join(parts[at:middle])):
            low = middle
        else:
            high = middle - 1
    return low


def runs(parts: list[str], fits: Callable[[str], bool]) -> list[str]:
    out, at = [], 0
    while at < len(parts):
        end = longest_run(parts, at, fits)
        out.append(" ".join(parts[at:end]))
        at = end
    return out


def split_long(text: str, many: Callable[[list[str]], list[int]], limit: int) -> list[str]:
    """Pieces within the limit: sentences, or the runs of words of over-long ones, joined while they fit."""
    fits = lambda t: many([t])[0] <= limit
    sentences = re.split(T.SENTENCE_GAP, text)
    parts = [p for s, n in zip(sentences, many(sentences), strict=True) for p in ([s] if n <= limit else runs(s.split(), fits))]
    return runs([p for p in parts if p], fits)


def segments(rows: list[tuple[int | None, str, bool]], sizes: list[int], many: Callable[[list[str]], list[int]], limit: int) -> Iterator[dict]:
    """Runs of units that end with a sentence, at a heading or at the limit; a heading is a run of its own."""
    held: list[tuple[str, int | None]] = []
    size, section, first = 0, None, None

    def run(heading: bool) -> dict:
        return {"units": [u for u, _ in held], "size": size, "heading": heading, "pages": {p for _, p in held if p is not None}, "section": first}

    for (page, unit, heading), counted in zip(rows, sizes, strict=True):
        section = unit if heading else section
        pieces = [unit] if counted <= limit else split_long(unit, many, limit)
        for piece, own in zip(pieces, [counted] if counted <= limit else many(pieces), strict=True):
            own += 1
            if held and (heading or size + own > limit):
                yield run(False)
                held, size = [], 0
            first = first if held else section
            held.append((piece, page))
            size += own
            if heading or re.search(T.SENTENCE_CLOSE, piece):
                yield run(heading)
                held, size = [], 0
    if held:
        yield run(False)


def carried_over(chunk: list[dict], coming: dict, limit: int, overlap: int) -> list[dict]:
    """Last segments of a full chunk that the next one repeats: within the overlap, none before a heading or without room."""
    if coming["heading"]:
        return []
    n, size = 0, 0
    while n < len(chunk) and size + chunk[-n - 1]["size"] <= overlap:
        size += chunk[-n - 1]["size"]
        n += 1
    return chunk[len(chunk) - n :] if size + coming["size"] <= limit else []


def pack_units(rows: list[tuple[int | None, str, bool]], count: Callable[[str], int] = default_tokens, limit: int = 300, overlap: int = 50, sizes: list[int] | None = None, many: Callable[[list[str]], list[int]] | None = None) -> list[tuple[str, list[int], str | None]]:
    """(text, pages, section) of each chunk of one document from its (page, unit, heading) rows in order.

    sizes: the units' counts where they are known; many: a counter of several texts at once, instead of `count`.
    """
    many = many or each(count)
    chunks: list[list[dict]] = [[]]
    size = 0
    for s in segments(rows, many([u for _, u, _ in rows]) if sizes is None else sizes, many, limit):
        if chunks[-1] and (size + s["size"] > limit or (s["heading"] and size >= 0.4 * limit)):
            chunks.append(carried_over(chunks[-1], s, limit, overlap))
            size = sum(x["size"] for x in chunks[-1])
        chunks[-1].append(s)
        size += s["size"]
    out = []
    for c in chunks if chunks[-1] else []:
        # Every unit is a line of its own, also within a sentence that wraps.
        body, head = "\n".join(u for s in c for u in s["units"]), c[0]["section"]
        pages = sorted(set().union(*(s["pages"] for s in c)))
        out.append((f"{head}\n{body}" if head and not body.startswith(head) else body, pages, head))
    return out


def chunk_pages(docs: DataFrame, count: Callable[[str], int] = default_tokens, limit: int = 300, overlap: int = 50, many: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """Chunks of documents given as (scope, source_file, units array<struct<page,unit,heading>>): one narrow pass, no shuffle.

    All units of a batch of documents are counted in one call of `many` (or one by one by `count`), each of them once;
    only what is over the limit is counted again, in parts.
    """
    many = many or each(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "units"):
            rows = []
            docs_ = [[(u["page"], u["unit"], u["heading"]) for u in given or ()] for given in batch.column("units").to_pylist()]
            counted, at = many([u for d in docs_ for _, u, _ in d]), 0
            for scope, file, parts in zip(batch.column("scope").to_pylist(), batch.column("source_file").to_pylist(), docs_, strict=True):
                sizes, at = counted[at : at + len(parts)], at + len(parts)
                for i, (text, pages, section) in enumerate(pack_units(parts, limit=limit, overlap=overlap, sizes=sizes, many=many)):
                    rows.append((scope, file, i, f"{file}_chunk_{i}", text, pages[0] if pages else None, pages, section))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)], names=names)

    names = [c.split()[0] for c in CHUNK_DDL.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.string()]
    return docs.select("scope", "source_file", "units").mapInArrow(run, CHUNK_DDL)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows with about `most` bytes in a column, one row at least: what a task makes objects of at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        each_row = max(1, batch.column(column).nbytes // batch.num_rows)
        at, step = 0, max(1, most // each_row)
        while at < batch.num_rows:
            part = batch.slice(at, step)
            while part.num_rows > 1 and part.column(column).nbytes > 2 * most:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows


def unit_arrays(docs: DataFrame, scope: str = "scope", file: str = "source_file", text: str = "text", page: int | None = None) -> DataFrame:
    """Documents with their units as an array, built in the row itself."""
    clean = F.filter(F.transform(T.lines(F.col(text)), T.strip), lambda x: (x != "") & ~T.is_page_number(x))
    made = F.transform(clean, lambda x: F.struct(F.lit(page).cast("int").alias("page"), x.alias("unit"), T.is_heading(x).alias("heading")))
    return docs.select(F.col(scope).alias("scope"), F.col(file).cast("string").alias("source_file"), made.alias("units"))


def without_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(scope, source_file, reason) of documents that gave no chunk: 'no text', or 'no chunks' where all lines were dropped."""
    reason = F.when(F.coalesce(T.strip(F.col("text")), F.lit("")) == "", "no text").otherwise("no chunks")
    left = docs.join(chunks.select("scope", "source_file").distinct(), ["scope", "source_file"], "left_anti")
    return left.select("scope", "source_file", reason.alias("reason"))


def split_passage(text: str, limit: int = 180) -> list[str]:
    """Whole sentences packed greedily up to a number of words."""
    out, held, size = [], [], 0
    for sentence in re.split(r"(?<=[.!?])\s+", text.strip()):
        n = len(sentence.split())
        if held and size + n > limit:
            out.append(" ".join(held))
            held, size = [], 0
        if n:
            held.append(sentence)
            size += n
    return [*out, " ".join(held)] if held else out


def passages(docs: DataFrame, key: str, text: str = "text", limit: int = 180) -> DataFrame:
    """(key, part, text): documents cut into passages of whole sentences."""

    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            parts = [split_passage(t or "", limit) for t in batch.column("text").to_pylist()]
            whose = pa.array([n for n, p in enumerate(parts) for _ in p], pa.int64())
            number = pa.array([i for p in parts for i in range(len(p))], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(whose), number, pa.array([x for p in parts for x in p], pa.string())], names=["key", "part", "text"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, part int, text string")
