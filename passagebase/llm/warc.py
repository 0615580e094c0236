"""WARC archives written and read back by many tasks, records found by boundary-chain verification.

Writing. Each page is one record, written by Spark's text writer, so that files come from executors and a task that is
tried again leaves nothing twice. Of records with equal payloads (SHA-256) the one with the largest id is a response and
holds the payload; the others are revisits that name it and carry its digest and length.

Reading. Archives are read in splits, and a split does not know where a record begins: a payload may hold anything, whole
WARC records included. Rows are cut at every MAGIC, so each row is one candidate record. A candidate's header gives the
offset at which its successor must begin. A task contracts the candidates of its split: by pointer jumping each gets the
offset at which its chain leaves the split, or none if the chain breaks. From these exits the starts of chains are
followed from the start of each file, again by pointer jumping, in a number of rounds that is the logarithm of the number
of splits in a file. Only candidates that the chain passes are records; a file whose chain does not end at its last byte
is an error, never a shorter result. A record whose payload holds MAGIC is put together from its rows.

Defined results: null and empty payloads are equal, so all but one of them are revisits; a null id is smaller than any
other; of rows repeated with id and payload one is the response and the others revisit it; payloads may be of any
length up to what a row holds; a null url has no target; control characters and MAGIC in a url are percent-encoded; an
empty table gives an archive without records and an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagebase.llm.common import maybe_broadcast, shared_dir, small_batches, stash

#: What every record begins with. No end of it is a beginning of it, so cutting at it is the same wherever a split begins.
MAGIC = "WARC/1."
_GAP = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_NONE = "~"


def base32(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: eight times five hex digits are four characters each.

    The digest must be a column that is there already: it is read for every character.
    """
    letters = F.array(*(F.lit(c) for c in _BASE32))

    def four(i: Column) -> Column:
        value = F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*(letters[F.shiftright(value, s).bitwiseAND(31)] for s in (15, 10, 5, 0)))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def _id_text(c: Column) -> Column:
    return F.coalesce(F.url_encode(c.cast("string")), F.lit(_NONE))


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(id, refers_to, url, html): refers_to is null for responses. Digests are grouped with map-side maxima, texts stay put."""
    p = pages.select(F.col(id_col).alias("own"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha2(F.col("html").cast("binary"), 256)).withColumn("id", _id_text(F.col("own")))
    keys = stash(p.where(F.octet_length("html") >= min_bytes).groupBy("sha", "own", "id").agg(F.count(F.lit(1)).alias("n")))
    groups = keys.groupBy("sha").agg(F.max(F.struct("own", "id"))["id"].alias("top"), F.sum("n").alias("n")).where("n > 1").select("sha", "top")
    groups = stash(groups)
    twice = stash(keys.where("n > 1").select("sha", "id", "n"))
    again = twice.count()
    few, many = maybe_broadcast(groups, groups.count()), maybe_broadcast(twice, again)
    rows = p.select("sha", "id", "url", "html")
    if again:
        # Rows alike in id and payload: one text for all of them, then as many records.
        alike = rows.join(many, ["sha", "id"]).groupBy("sha", "id", "n").agg(F.max("url").alias("url"), F.max("html").alias("html"))
        alike = alike.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
        rows = rows.join(many.select("sha", "id"), ["sha", "id"], "left_anti").withColumn("copy", F.lit(1).cast("long")).unionByName(alike)
    else:
        rows = rows.withColumn("copy", F.lit(1).cast("long"))
    rows = rows.join(few, "sha", "left")
    first = F.col("top").isNull() | ((F.col("id") == F.col("top")) & (F.col("copy") == 1)) | (F.octet_length("html") < min_bytes)
    return rows.select("id", F.when(~first, F.col("top")).alias("refers_to"), "url", "html")


def record(date: str) -> Column:
    """A planned row with its digest as the text of its record, without the gap that ends it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c, F.lit(">"))
    url = F.replace(F.col("url"), F.lit(MAGIC), F.lit(MAGIC.replace("/", "%2F")))
    for code in (*range(33), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.octet_length("html").cast("string")), F.lit("\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length("html"))
    return F.concat(
        F.lit(f"{MAGIC}1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNull(), "").otherwise(line("WARC-Target-URI", url)),
        F.when(~revisit, "").otherwise(F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit(_PROFILE)))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
        F.when(revisit, "").otherwise(F.col("html")),
    )


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Every row of pages as a record; one archive for each task that writes."""
    rows = planned(pages, id_col, url_col, html_col, min_bytes).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    rows = rows.withColumn("digest", base32(F.col("sha1")))
    rows.select(record(date).alias("value")).write.option("lineSep", _GAP).text(path)


_FIELDS = ["type", "id", "refers_to", "url", "digest", "payload_bytes", "payload_sha", "payload"]


def parsed(value: Column, payloads: bool) -> dict[str, Column]:
    """What a row (from behind MAGIC to the next one) says as a record; total is null where it can't be one.

    total: bytes of the record with MAGIC and the gap at its end. whole: the row is just that record.
    """
    head = F.substring_index(value, _GAP, 1)
    field = lambda name: F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    length = F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*$", 1)
    fits = F.contains(value, F.lit(_GAP)) & value.rlike(r"^[01]\r\n") & (length != "")
    total = F.when(fits, F.octet_length(head) + length.cast("long") + len(MAGIC) + 2 * len(_GAP))
    whole = F.coalesce(total == F.octet_length(value) + len(MAGIC), F.lit(False))
    http = F.substring_index(F.substring(value, F.length(head) + len(_GAP) + 1, F.length(value)), _GAP, 1)
    start = F.length(head) + F.length(http) + 2 * len(_GAP)
    payload = F.when(whole & (field("WARC-Type") == "response"), F.substring(value, start + 1, F.length(value) - start - len(_GAP)))
    told = F.when(whole, F.regexp_extract(http, r"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*$", 1))
    urn = lambda name: F.nullif(F.regexp_extract(field(name), "^<urn:page:(.*)>$", 1), F.lit(""))
    return {
        "total": total,
        "whole": whole,
        "type": F.when(fits, field("WARC-Type")),
        "id": F.when(fits, urn("WARC-Record-ID")),
        "refers_to": F.when(fits, urn("WARC-Refers-To")),
        "url": F.when(fits, F.nullif(field("WARC-Target-URI"), F.lit(""))),
        "digest": F.when(fits, F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1)),
        "payload_bytes": F.coalesce(F.octet_length(payload).cast("long"), F.nullif(told, F.lit("")).cast("long")),
        "payload_sha": F.sha1(payload.cast("binary")),
        "payload": payload if payloads else F.lit(None).cast("string"),
    }


def split_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_size, block, value): archives cut at MAGIC, in the order of each split."""
    t = spark.read.option("lineSep", MAGIC).text(path)
    return t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("block"), "value")


def with_places(rows: DataFrame) -> DataFrame:
    """Adds `at`, the bytes of the split's rows before this one, MAGICs counted. rows have `size`, the bytes of their value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks = batch.column("file").to_pylist(), np.asarray(batch.column("block"))
            steps = np.asarray(batch.column("size")).astype(np.int64) + len(MAGIC)
            change = [i for i in range(batch.num_rows) if (files[i], blocks[i]) != (last if i == 0 else (files[i - 1], blocks[i - 1]))]
            at = np.empty(batch.num_rows, dtype=np.int64)
            for a, b in zip(sorted({0, *change}), [*(c for c in change if c), batch.num_rows], strict=True):
                before = 0 if a in change else before
                ends = before + np.cumsum(steps[a:b])
                at[a:b], before = ends - steps[a:b], int(ends[-1])
            last = (files[-1], blocks[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "at"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{ddl}, at long")


def _jumps(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """For each candidate the place of its successor among the split's candidates, its own place where it is not there."""
    place = np.searchsorted(offset, successor)
    found = (place < len(offset)) & (offset[np.minimum(place, len(offset) - 1)] == successor)
    return np.where(found, place, np.arange(len(offset)))


def exits(offset: np.ndarray, successor: np.ndarray, limit: int) -> np.ndarray:
    """Where each candidate's chain leaves the split, which ends at limit; -1 where it breaks in it."""
    jump = _jumps(offset, successor)
    while not np.array_equal(further := jump[jump], jump):
        jump = further
    leaves = successor[jump]
    return np.where(leaves >= limit, leaves, -1)


def passed(offset: np.ndarray, successor: np.ndarray, entered: np.ndarray) -> np.ndarray:
    """Which candidates of a split the chain passes that enters it at the marked ones."""
    jump, marked = _jumps(offset, successor), entered.copy()
    while True:
        before = marked.sum()
        marked[jump[marked]] = True
        further = jump[jump]
        if marked.sum() == before and np.array_equal(further, jump):
            return marked
        jump = further


def by_split(rows: DataFrame, work: Callable[[pa.Table], pa.Table], ddl: str) -> DataFrame:
    """`work` on the candidates of each split in the order of their offsets; a split's rows come to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                yield from work(pa.Table.from_batches(held).combine_chunks()).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            files, bases = batch.column("file").to_pylist(), batch.column("base").to_pylist()
            cuts = [0, *(i for i in range(1, batch.num_rows) if (files[i], bases[i]) != (files[i - 1], bases[i - 1])), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if (files[a], bases[a]) != key:
                    yield from done()
                    held, key = [], (files[a], bases[a])
                held.append(batch.slice(a, b - a))
        yield from done()

    return rows.repartition("file", "base").sortWithinPartitions("file", "base", "offset").mapInArrow(run, ddl)


def chain_starts(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(file, offset) of the candidates at which chains from the files' starts enter splits, by pointer jumping.

    links: (file, offset, exit). Round i knows the first 2**i entries of each file and jumps twice as far as the last one.
    """
    nodes = links.where("exit >= 0").select("file", F.col("exit").alias("offset")).distinct().unionByName(links.where("offset = 0").select("file", "offset"))
    edges = stash(nodes.distinct().join(links, ["file", "offset"]).select("file", "offset", "exit"))
    reached, jump, known = stash(edges.where("offset = 0").select("file", "offset")), edges, -1
    for _ in range(rounds):
        n = reached.count()
        if n == known:
            return reached
        known = n
        ahead = reached.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset")).join(edges.select("file", "offset"), ["file", "offset"], "left_semi")
        reached = stash(reached.unionByName(ahead).distinct())
        far = jump.select("file", "offset", F.col("exit").alias("via")).join(jump.select("file", F.col("offset").alias("via"), "exit"), ["file", "via"])
        jump = stash(far.select("file", "offset", "exit"))
    raise RuntimeError("a file has more than 2**64 splits")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(file, offset, type, id, refers_to, url, digest, payload_bytes, payload_sha, payload) of every record.

    digest is the header's, payload_sha that of the payload read (null for revisits, as payload). Without payloads only
    their digests and lengths are kept.
    """
    small_batches(spark)
    cut = split_rows(spark, path)
    made = parsed(F.col("value"), payloads)
    rows = stash(with_places(cut.select("file", "file_size", "block", F.octet_length("value").alias("size"), *(c.alias(n) for n, c in made.items()))))
    splits = rows.groupBy("file", "file_size", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = stash(splits.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0)) - len(MAGIC)))
    wrong = splits.groupBy("file", "file_size").agg((F.sum("bytes") - len(MAGIC)).alias("seen")).where("seen <> file_size").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['file']}: {wrong[0]['seen']} of {wrong[0]['file_size']} bytes were read")
    # offset: where a row's MAGIC begins; a split's candidates lie in [base, base + bytes).
    placed = rows.join(maybe_broadcast(splits.select("file", "block", "base", "bytes"), splits.count()), ["file", "block"]).withColumn("offset", F.col("base") + F.col("at"))
    candidates = placed.where("total is not null and offset >= 0").withColumn("successor", F.col("offset") + F.col("total"))

    def contract(t: pa.Table) -> pa.Table:
        offset, successor = np.asarray(t["offset"]), np.asarray(t["successor"])
        out = exits(offset, successor, t["base"][0].as_py() + t["bytes"][0].as_py())
        return t.select(["file", "offset"]).append_column("exit", pa.array(out))

    links = stash(by_split(candidates.select("file", "base", "bytes", "offset", "successor"), contract, "file string, offset long, exit long"))
    starts = chain_starts(links)
    _check_ends(splits, links, starts)

    def keep(t: pa.Table) -> pa.Table:
        mark = passed(np.asarray(t["offset"]), np.asarray(t["successor"]), np.asarray(t["entered"]))
        return t.filter(pa.array(mark)).select(["file", "offset", "total", "whole", *_FIELDS])

    entered = candidates.join(maybe_broadcast(starts.withColumn("entered", F.lit(True)), starts.count()), ["file", "offset"], "left")
    entered = entered.select("file", "base", "offset", "successor", F.coalesce("entered", F.lit(False)).alias("entered"), "total", "whole", *_FIELDS)
    ddl = "file string, offset long, total long, whole boolean, " + ", ".join(f"{c} {'long' if c == 'payload_bytes' else 'string'}" for c in _FIELDS)
    records = stash(by_split(entered, keep, ddl))
    broken = records.where("not whole")
    if broken.limit(1).count():
        records = records.where("whole").unionByName(_put_together(cut, placed, splits, records, payloads))
    return records.withColumn("payload_sha", base32(F.col("payload_sha"))).select("file", "offset", *_FIELDS)


def _check_ends(splits: DataFrame, links: DataFrame, starts: DataFrame) -> None:
    """Every file's chain must end at its last byte."""
    files = splits.where("file_size > 0").select("file", "file_size").distinct()
    ends = links.join(starts, ["file", "offset"], "left_semi").select("file", F.col("exit").alias("file_size"))
    lost = files.join(ends, ["file", "file_size"], "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"{lost[0]['file']}: the chain of records breaks before its end")


def _put_together(cut: DataFrame, placed: DataFrame, splits: DataFrame, records: DataFrame, payloads: bool) -> DataFrame:
    """Records that MAGIC in their payload cuts into rows: the rows are read again and joined, one record at a time."""
    broken = stash(records.where("not whole").select("file", "offset", "total"))
    n = broken.count()
    files = broken.select("file").distinct()
    owner = F.last("start", ignorenulls=True).over(Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0))
    own = placed.select("file", "offset").join(maybe_broadcast(files, n), "file", "left_semi").join(records.select("file", "offset", F.col("offset").alias("start")), ["file", "offset"], "left")
    pieces = own.withColumn("start", owner).join(maybe_broadcast(broken.select("file", F.col("offset").alias("start"), "total"), n), ["file", "start"])
    pieces = stash(pieces)
    read = with_places(cut.select("file", "block", F.octet_length("value").alias("size"), "value")).join(maybe_broadcast(splits.select("file", "block", "base"), splits.count()), ["file", "block"])
    read = read.select("file", (F.col("base") + F.col("at")).alias("offset"), "value").join(maybe_broadcast(pieces, pieces.count()), ["file", "offset"])
    texts = read.groupBy("file", "start", "total").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    texts = stash(texts.select("file", F.col("start").alias("offset"), F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC).alias("value")))
    whole = texts.select("file", "offset", *(c.alias(k) for k, c in parsed(F.col("value"), payloads).items()))
    whole = stash(whole)
    if whole.where("whole").count() != n:
        raise ValueError("a record could not be put together from its rows")
    return whole


def round_trip(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives written and read back.

    A payload that does not have its header's digest is an error.
    """
    spark = pages.sparkSession
    path = os.path.join(shared_dir(spark), "archives", uuid.uuid4().hex)
    write_archives(pages, path, id_col, url_col, html_col, min_bytes)
    r = read_archives(spark, path, payloads=False)
    kind = pages.schema[id_col].dataType
    as_id = lambda c: F.when(F.col(c) != _NONE, F.url_decode(F.col(c))).cast(kind)
    agree = (F.col("type") == "revisit") | (F.col("payload_sha") == F.col("digest"))
    digest = F.when(agree, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload and digest differ: "), F.col("id"))).cast("string"))
    return r.select(as_id("id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), F.col("type").alias("record_type"), as_id("refers_to").alias("refers_to"))
