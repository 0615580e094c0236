"""Exact ranked lexical search over term-partitioned postings by TPUT (three phases, uniform threshold).

One pass over the documents counts the terms that queries ask for, and all terms for the statistics. The postings lie by
term, each list cut into blocks by buckets of about DOC_BUCKET documents, so that a frequent term is many tasks' work; a
block is one row, in the order of impact. Then, for at most QUERIES queries at a time:

1. the documents in the heads of the lists (the k best of every block) are looked up and scored exactly; the kth score of
   each query among them, tau, is a lower bound of its kth score;
2. from each of a query's r lists all postings whose part is tau / r or more are fetched: a document without any such
   part scores less than tau. What was fetched is added up by query and document, before and after one shuffle by parts of buckets; the
   largest part that each unfetched list can still add makes an upper bound, and documents below tau are dropped;
3. the others are looked up in the documents' counts and scored exactly.

Weights and scores are 64-bit integers throughout. A part is times * w * impact with impact = (10**9 * tf) div
(1000 * tf + 8 * m). The vocabulary of the queries goes to the tasks if it has been counted to be at most
VOCABULARY terms; beyond that documents keep all their terms and a join picks the wanted ones. The lists of
QUERIES queries go to every task; more queries are asked in more turns over the same index.

Defined results: null and empty texts have no terms and are neither found nor counted in N; an item without terms, or whose
terms no document holds, has no rows; every row of documents is a document and every row of queries a query, also if
ids repeat or are null; equal scores go by ascending doc_id, null last; texts of any length are counted whole, in parts;
an empty table on either side gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagebase.llm.common import BROADCAST_ROWS, as_bytes, doc_slices, maybe_broadcast, release, stash, word_parts

#: Documents of a bucket, parts in which its sums are made, queries asked together, and the most terms of queries that go
#: to every task.
DOC_BUCKET, SUM_PARTS, QUERIES = 65_536, 32, 512
VOCABULARY = BROADCAST_ROWS
#: Documents scored at a time in a task; counts turned into lists and fetched postings added up at a time.
_TOGETHER, _TURNED, _FETCHED = 512, 1 << 20, 1 << 19
#: What stands between terms is ASCII without letters and digits; A-Z become a-z, all other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order: runs of letters, digits and all that is not ASCII."""
    return text.translate(_FOLD).split()


def term_counts(rows: DataFrame, id_col: str, text_col: str, known: list[str] | None = None) -> DataFrame:
    """(id, n, terms, tfs): n counts all terms of a text; with `known`, terms are the places in it of those it lists."""
    places = None if known is None else {t.encode(): i for i, t in enumerate(known)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in doc_slices(batches, "text"):
            total, names, counts, ends = [], [], [], [0]
            for text in as_bytes(batch.column("text")):
                found, n = Counter(), 0
                for part in word_parts(text):
                    words = terms_of(part)
                    n += len(words)
                    found.update(words if places is None else map(places.get, words))
                found.pop(None, None)
                total.append(n)
                names += found.keys()
                counts += found.values()
                ends.append(len(counts))
            ends = pa.array(ends, pa.int32())
            named = pa.array([t.decode() for t in names], pa.string()) if places is None else pa.array(np.array(names, dtype=np.int64))
            lists = [pa.ListArray.from_arrays(ends, v) for v in (named, pa.array(np.array(counts, dtype=np.int64)))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    kind = rows.schema[id_col].dataType.simpleString()
    given = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.mapInArrow(run, f"id {kind}, n long, terms array<{'string' if known is None else 'long'}>, tfs array<long>")


def exploded(counts: DataFrame, *keep: str) -> DataFrame:
    return counts.select(*keep, F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("x")).select(*keep, "x.term", "x.tf")


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, impact) of all counts of a batch with terms, tfs and m."""
    lists = batch.column("terms")
    row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
    tf = np.asarray(batch.column("tfs").flatten())
    return row, np.asarray(lists.flatten()), (1_000_000_000 * tf) // (1000 * tf + 8 * np.asarray(batch.column("m"))[row])


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted arrays, with the end."""
    change = np.zeros(len(keys[0]), dtype=bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    change[:1] = True
    return np.append(np.flatnonzero(change), len(change))


class Index:
    """Documents' counts, their postings by term, and the statistics of all documents, for the words of queries."""

    def __init__(self, docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = DOC_BUCKET, vocabulary: int = VOCABULARY):
        """words: (word), the distinct terms that will be asked for."""
        if words.count() <= vocabulary:
            known = sorted(r["word"] for r in words.collect())
            counts = stash(term_counts(docs, id_col, text_col, known).withColumn("doc", F.monotonically_increasing_id()))
            self.words = docs.sparkSession.createDataFrame(list(enumerate(known)), "term long, word string")
        else:
            counts, self.words = self._joined(docs, words, id_col, text_col)
        told = counts.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        self.documents, self.terms = told["docs"], told["terms"]
        m = 100 - 75 + F.expr(f"(75L * n * {self.documents}L) div {max(self.terms, 1)}L")
        buckets = max(1, -(-self.documents // bucket))
        self.counts = counts.withColumn("m", m).withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(buckets)).cast("int"))
        self.postings = stash(self._postings())
        known = self.postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max(F.get("impacts", F.lit(0))).alias("best"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * self.documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
        self.known = stash(self.words.join(known, "term").select("term", "word", "best", weight.alias("w")).where("w > 0"))

    @staticmethod
    def _joined(docs: DataFrame, words: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
        """Counts by a join with the wanted terms, for vocabularies that are not sent to the tasks."""
        numbered = stash(words.withColumn("term", F.monotonically_increasing_id()))
        every = stash(term_counts(docs, id_col, text_col).withColumn("doc", F.monotonically_increasing_id()))
        wanted = exploded(every, "doc").withColumnRenamed("term", "word").join(numbered, "word").groupBy("doc").agg(F.collect_list(F.struct("term", "tf")).alias("x"))
        empty = F.array().cast("array<long>")
        counts = every.select("id", "n", "doc").join(wanted, "doc", "left")
        return stash(counts.select("id", "n", F.coalesce(F.col("x.term"), empty).alias("terms"), F.coalesce(F.col("x.tf"), empty).alias("tfs"), "doc")), numbered

    def _postings(self) -> DataFrame:
        """(term, bucket, docs, impacts): a block of a term's list in one row, highest impact first."""
        ddl, names = "term long, bucket int, docs array<long>, impacts array<long>", ["term", "bucket", "docs", "impacts"]

        def rows(term: np.ndarray, bucket: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((doc, -impact, bucket, term))
            term, bucket, doc, impact = term[order], bucket[order], doc[order], impact[order]
            cuts = _runs(term, bucket)
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x)) for x in (doc, impact)]
            return pa.RecordBatch.from_arrays([pa.array(term[cuts[:-1]]), pa.array(bucket[cuts[:-1]], pa.int32()), *lists], names=names)

        def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                row, term, impact = _cells(batch)
                held.append((term, np.asarray(batch.column("bucket"))[row], np.asarray(batch.column("doc"))[row], impact))
                size += len(row)
                if size > _TURNED:
                    yield rows(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
            if size:
                yield rows(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            release()

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Pieces of a block follow one another; the last block of a batch may go on in the next."""
            held: list[pa.RecordBatch] = []

            def flat(held: list[pa.RecordBatch]) -> pa.RecordBatch:
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                n = np.diff(np.asarray(t.column("docs").offsets))
                key = [np.repeat(np.asarray(t.column(c)), n) for c in ("term", "bucket")]
                return rows(*key, np.asarray(t.column("docs").flatten()), np.asarray(t.column("impacts").flatten()))

            for batch in batches:
                if not batch.num_rows:
                    continue
                cuts = _runs(np.asarray(batch.column("term")), np.asarray(batch.column("bucket")))
                whole = int(cuts[-2])
                key = lambda b, i: (b.column("term")[i].as_py(), b.column("bucket")[i].as_py())
                if whole == 0 and held and key(held[-1], 0) == key(batch, 0):
                    held.append(batch)
                    continue
                if whole:
                    yield flat([*held, batch.slice(0, whole)])
                elif held:
                    yield flat(held)
                held = [batch.slice(whole)]
            if held:
                yield flat(held)
            held.clear()
            release()

        pieces = self.counts.select("terms", "tfs", "m", "bucket", "doc").mapInArrow(turned, ddl)
        return pieces.repartition("term", "bucket").sortWithinPartitions("term", "bucket").mapInArrow(joined, ddl)


class Lists:
    """The lists of some queries, ordered by term: query, factor, top (the largest part); r counts a query's lists."""

    def __init__(self, rows: list, n: int):
        rows = sorted((r["term"], r["query"], r["factor"], r["top"]) for r in rows)
        self.n = n
        self.term, self.query, self.factor, self.top = (np.array(c, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else ((), (), (), ())))
        self.r = np.bincount(self.query, minlength=n)

    def of(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, list) for every list of each cell's term."""
        lo, hi = np.searchsorted(self.term, term, "left"), np.searchsorted(self.term, term, "right")
        cell = np.repeat(np.arange(len(term)), hi - lo)
        return cell, np.arange(len(cell)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[cell]

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        """Exact scores of a batch of documents' counts for all queries."""
        out = np.zeros(batch.num_rows * self.n, dtype=np.int64)
        row, term, impact = _cells(batch)
        cell, at = self.of(term)
        np.add.at(out, row[cell] * self.n + self.query[at], impact[cell] * self.factor[at])
        return out.reshape(-1, self.n)

    def threshold(self, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(least, rest, rests): the impact from which a list is fetched, the part it may still add, a query's sum of these."""
        own, r = tau[self.query], self.r[self.query]
        least = np.maximum(1, -(-own // (self.factor * r))) if len(r) else own
        rest = np.minimum(self.top, np.maximum(own - 1, 0) // np.maximum(r, 1))
        rests = np.zeros(self.n, dtype=np.int64)
        np.add.at(rests, self.query, rest)
        return least, rest, rests


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def best_of_heads(index: Index, lists: Lists, k: int) -> np.ndarray:
    """tau of each query: its kth score among the documents at the heads of all blocks; 0 where these are fewer."""
    heads = index.postings.select(F.explode(F.slice("docs", 1, k)).alias("doc")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, _TOGETHER):
            found = lists.scores(batch)
            best = -np.sort(-found, axis=0)[:k]
            place, query = np.nonzero(best)
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(best[place, query])], names=["query", "score"])

    scores = index.counts.select("doc", "terms", "tfs", "m").join(heads, "doc", "left_semi").drop("doc").mapInArrow(run, "query long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc())
    tau = np.zeros(lists.n, dtype=np.int64)
    for r in scores.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k).where(F.col("i") == k).collect():
        tau[r["query"]] = r["score"]
    return tau


def candidates(index: Index, lists: Lists, tau: np.ndarray) -> DataFrame:
    """(doc, queries): for which queries a document may reach tau, from the postings above the threshold."""
    least, rest, rests = lists.threshold(tau)
    ddl, names = "bucket int, doc array<long>, query array<long>, sum array<long>, rest array<long>", ["bucket", "doc", "query", "sum", "rest"]

    def added(doc: np.ndarray, query: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((query, doc))
        doc, query = doc[order], query[order]
        cuts = _runs(doc, query)[:-1]
        return [doc[cuts], query[cuts], *(np.add.reduceat(v[order], cuts) for v in values)] if len(doc) else [doc, query, *values]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def given() -> Iterator[pa.RecordBatch]:
            for bucket, parts in held.items():
                sums = added(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                part = sums[0] % SUM_PARTS
                for p in range(SUM_PARTS):
                    some = [s[part == p] for s in sums]
                    if len(some[0]):
                        yield pa.RecordBatch.from_arrays([pa.array([bucket * SUM_PARTS + p], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(s)) for s in some)], names=names)

        for batch in batches:
            offsets, docs, impacts = np.asarray(batch.column("docs").offsets), np.asarray(batch.column("docs").values), np.asarray(batch.column("impacts").values)
            for i, (term, bucket) in enumerate(zip(batch.column("term").to_pylist(), batch.column("bucket").to_pylist(), strict=True)):
                a, b = offsets[i], offsets[i + 1]
                lo, hi = np.searchsorted(lists.term, [term, term + 1])
                for at in range(lo, hi):
                    n = int(np.searchsorted(-impacts[a:b], -least[at], side="right"))
                    if n:
                        held.setdefault(bucket, []).append((docs[a : a + n], np.full(n, lists.query[at]), impacts[a : a + n] * lists.factor[at], np.full(n, rest[at])))
                        size += n
                if size > _FETCHED:
                    yield from given()
                    held, size = {}, 0
        yield from given()
        held.clear()
        release()

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets follow one another."""
        held, own = [], None

        def given() -> Iterator[pa.RecordBatch]:
            if held:
                doc, query, total, seen = added(*(np.concatenate(x) for x in zip(*held, strict=True)))
                may = total + rests[query] - seen >= tau[query]
                doc, query = doc[may], query[may]
                cuts = _runs(doc)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(doc[cuts[:-1]]), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(query))], names=["doc", "queries"])

        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != own:
                    yield from given()
                    held, own = [], bucket
                held.append([np.asarray(batch.column(c)[i].values) for c in names[1:]])
        yield from given()
        held.clear()
        release()

    return index.postings.mapInArrow(fetch, ddl).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(bounded, "doc long, queries array<long>")


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, id, doc, score): documents of each query (query from 0, word, times) that reach its kth score, so k or more.

    queries: those of one turn, at most QUERIES; their lists come to the driver and go to every task.
    """
    used = queries.join(maybe_broadcast(index.known, index.known.count()), "word").withColumn("factor", F.col("times") * F.col("w"))
    rows = used.select("query", "term", "factor", (F.col("factor") * F.col("best")).alias("top")).collect()
    lists = Lists(rows, 1 + max((r["query"] for r in rows), default=0))
    tau = best_of_heads(index, lists, k)
    enough = np.maximum(tau, 1)
    kind = index.counts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, _TOGETHER):
            found, asked = lists.scores(batch), batch.column("queries")
            row, query = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(asked.offsets))), np.asarray(asked.flatten())
            score = found[row, query]
            keep = score >= enough[query]
            row = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(query[keep]), batch.column("id").take(row), batch.column("doc").take(row), pa.array(score[keep])], names=["query", "id", "doc", "score"])
        release()

    left = index.counts.select("id", "doc", "terms", "tfs", "m").join(candidates(index, lists, tau), "doc")
    return left.mapInArrow(run, f"query long, id {kind}, doc long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", bucket: int = DOC_BUCKET, vocabulary: int = VOCABULARY, together: int = QUERIES) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every item."""
    asked = stash(term_counts(items, item_col, item_text).withColumn("item", F.monotonically_increasing_id()))
    order = Window.partitionBy("turn").orderBy("item")
    n = asked.count()
    turns = max(1, -(-2 * n // together))
    # Half as many as fit a turn on average; numbers within a turn are dense.
    named = stash(asked.withColumn("turn", F.pmod(F.xxhash64("item"), F.lit(turns)).cast("int")).withColumn("query", F.row_number().over(order).cast("long") - 1))
    queries = stash(exploded(named, "turn", "query").select("turn", "query", F.col("term").alias("word"), F.col("tf").alias("times")))
    index = Index(docs, queries.select("word").distinct(), id_col, text_col, bucket, vocabulary)
    best = Window.partitionBy("turn", "query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "doc")
    found = None
    for turn in range(turns):
        some = search(index, queries.where(F.col("turn") == turn), k).withColumn("turn", F.lit(turn))
        some = stash(some.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        found = some if found is None else found.unionByName(some)
    ids = named.select("turn", "query", F.col("id").alias("item_id"))
    return found.join(maybe_broadcast(ids, n), ["turn", "query"]).select("item_id", "rank", F.col("id").alias("doc_id"), "score")
