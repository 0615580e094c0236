"""Chunks and passages against plain programs that follow the rules word by word; how often a counter is asked."""

import random
import re

import pytest
from pyspark.sql import functions as F

from passagebase.functions import text as T
from passagebase.jobs.queries import queries
from passagebase.operators import chunking as C

DIR = "/root/testdata/sf0.001"
GAP = re.compile('(?<=[.!?])\\s+(?=[A-Z0-9"“(])')


def plain_pieces(unit, count, limit):
    """Word by word: what fits is added, what doesn't begins anew."""
    if count(unit) <= limit:
        return [unit]
    small = []
    for sentence in GAP.split(unit):
        line = []
        for word in sentence.split() if count(sentence) > limit else [sentence]:
            if line and count(" ".join([*line, word])) > limit:
                small.append(" ".join(line))
                line = []
            line.append(word)
        small.append(" ".join(line))
    out = [small[0]]
    for part in small[1:]:
        if count(out[-1] + " " + part) <= limit:
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def plain_chunks(rows, count, limit, overlap):
    """All units with their section, cut into segments, segments dealt to chunks; sums are taken anew each time."""
    section, units = None, []
    for page, unit, heading in rows:
        section = unit if heading else section
        units += [(page, piece, heading, section, count(piece) + 1) for piece in plain_pieces(unit, count, limit)]
    weigh = lambda seg: sum(u[4] for u in seg)
    segs = [[]]
    for u in units:
        if segs[-1] and (u[2] or weigh(segs[-1]) + u[4] > limit):
            segs.append([])
        segs[-1].append(u)
        if u[2] or re.search('[.!?:;"”)]\\s*$', u[1]):
            segs.append([])
    segs = [s for s in segs if s]
    chunks, now = [], []
    for seg in segs:
        full = sum(map(weigh, now))
        if now and (full + weigh(seg) > limit or seg[0][2] and full >= 0.4 * limit):
            chunks.append(now)
            tail = []
            while not seg[0][2] and len(tail) < len(now) and weigh(now[-len(tail) - 1]) + sum(map(weigh, tail)) <= overlap:
                tail = now[-len(tail) - 1 :]
            now = tail if sum(map(weigh, tail)) + weigh(seg) <= limit else []
        now = [*now, seg]
    out = []
    for chunk in [*chunks, now] if now else chunks:
        flat = [u for seg in chunk for u in seg]
        body, head = "\n".join(u[1] for u in flat), flat[0][3]
        out.append((body if not head or body.startswith(head) else head + "\n" + body, sorted({u[0] for u in flat if u[0] is not None}), head))
    return out


COUNTERS = {"default": C.default_tokens, "letters": lambda s: len(s) // 4 + 1, "words": lambda s: len(s.split())}


@pytest.mark.parametrize("name", sorted(COUNTERS))
@pytest.mark.parametrize("seed", range(12))
def test_same_as_the_plain_program(seed, name):
    rng, count = random.Random(seed), COUNTERS[name]
    word = lambda: rng.choice(["a", "alpha", "Beta", "gamma,", "delta.", "End!", "(so)", "x" * rng.randint(1, 60)])
    rows, page = [], rng.choice([None, 1])
    for _ in range(rng.randint(0, 60)):
        page = page if page is None else page + (rng.random() < 0.2)
        heading = rng.random() < 0.1
        rows.append((page, f"{rng.randint(1, 9)}.{rng.randint(1, 9)} Heading" if heading else " ".join(word() for _ in range(rng.choice([1, 3, 8, 40, 200]))), heading))
    for limit, overlap in ((20, 5), (60, 20), (300, 50), (5, 0)):
        assert C.pack_units(rows, count, limit, overlap) == plain_chunks(rows, count, limit, overlap)


def test_wrapped_lines_stay_lines(spark):
    docs = spark.createDataFrame([("s", "f", "A sentence that wraps\nover two lines.\nAnother one.")], "scope string, source_file string, text string")
    assert [r.text for r in C.chunk_pages(C.unit_arrays(docs)).collect()] == ["A sentence that wraps\nover two lines.\nAnother one."]


@pytest.mark.parametrize(("query", "options"), [("c3_counter_in_chunks", {"count": COUNTERS["letters"], "limit": 300, "overlap": 50}), ("c4_split_long_units", {"count": C.default_tokens, "limit": 40, "overlap": 0}), ("c5_chunk_pages", {"count": C.default_tokens, "limit": 300, "overlap": 50})])
def test_queries_against_the_plain_program(spark, query, options):
    given = {r.source_file: [(None, u.unit, u.heading) for u in r.units] for r in C.unit_arrays(spark.read.parquet(f"{DIR}/documents.parquet").withColumn("scope", F.lit("s")).withColumn("source_file", F.col("doc_id").cast("string"))).collect()}
    got = {}
    for r in queries()[query](spark, DIR).collect():
        got.setdefault(r.source_file, {})[r.chunk_index] = (r.text, r.pages, r.section, r.page)
    want = {f: {i: (t, p, s, p[0] if p else None) for i, (t, p, s) in enumerate(plain_chunks(rows, **options))} for f, rows in given.items()}
    assert got == {f: c for f, c in want.items() if c}


def test_passages_query_against_a_plain_program(spark):
    """Sentences one by one: the passage is full when the next one would pass the limit."""
    got = {}
    for r in queries()["c8_passages"](spark, DIR).collect():
        got.setdefault(r.key, {})[r.part] = r.text
    for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect():
        want, n = [], 0
        for sentence in (s for s in re.split(r"(?<=[.!?])\s+", r.text.strip()) if s.split()):
            size = len(sentence.split())
            if want and n + size <= 180:
                want[-1] += " " + sentence
                n += size
            else:
                want.append(sentence)
                n = size
        assert got.get(r.doc_id, {}) == dict(enumerate(want))


def test_each_unit_is_counted_once_in_one_call_a_batch(spark):
    calls, texts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def many(batch):
        calls.add(1)
        texts.add(len(batch))
        return [len(t.split()) for t in batch]

    docs = spark.createDataFrame([("s", f"f{i}", "\n".join(f"Line {j} of file {i}." for j in range(20))) for i in range(10)], "scope string, source_file string, text string").coalesce(1)
    C.chunk_pages(C.unit_arrays(docs), many=many, limit=60).collect()
    assert (calls.value, texts.value) == (1, 200)


def test_few_counts_for_an_over_long_sentence():
    asked = []

    def many(batch):
        asked.extend(batch)
        return [len(t.split()) for t in batch]

    words = " ".join(f"w{i}" for i in range(3000))
    pieces = C.split_long(words, many, 300)
    assert [len(p.split()) for p in pieces] == [300] * 10
    assert len(asked) < 400  # word by word it would be 3,000


def test_sentence_rules_are_the_columns():
    assert T.SENTENCE_GAP == GAP.pattern


@pytest.mark.parametrize("size", [10, 3000])
def test_tasks_hold_few_documents_at_a_time(size):
    """A batch of 10,000 rows is worked off in slices of about SLICE_BYTES, whatever its rows' sizes; no row is lost."""
    import pyarrow as pa

    texts = ["x" * (size * (1 + 9 * (i % 500 == 0))) for i in range(10_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(texts)], names=["key", "text"])
    got = list(C.slices(iter([batch, batch.slice(0, 0)]), "text"))
    assert [k for b in got for k in b.column("key").to_pylist()] == list(range(10_000))
    assert max(b.column("text").nbytes for b in got) <= 2 * C.SLICE_BYTES and len(got) <= 2 + 2 * 10_000 * size * 1.1 / C.SLICE_BYTES
