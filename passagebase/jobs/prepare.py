"""Queries on text preparation and chunking."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagebase.functions import text as T
from passagebase.jobs.base import files, query, read
from passagebase.operators import chunking as C

_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
_UNITS = r"""u AS (SELECT source AS scope, doc_id::VARCHAR AS source_file, pos - 1 AS pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS unit FROM
  (SELECT source, doc_id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS pos FROM documents)
  WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> '' AND NOT regexp_matches(line, '^\s*\d{1,4}\s*$'))"""


@query(f"WITH {_UNITS} SELECT scope, source_file, pos, unit FROM u")
def p1_units(spark, d):
    return C.units(files(spark, d), ["scope", "source_file"]).select("scope", "source_file", "pos", "unit")


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '\r?\n'), lambda x: NOT regexp_matches(x, '^\s*\d{1,4}\s*$'))) AS kept FROM documents")
def p2_page_number_lines(spark, d):
    return files(spark, d).select("doc_id", F.size(F.filter(T.lines(F.col("text")), lambda x: ~T.is_page_number(x))).alias("kept"))


@query(rf"WITH {_UNITS} SELECT scope, count(*) AS units, count_if(regexp_matches(unit, '^((\d+(\.\d+)*\.?|[A-Z]\.\d+(\.\d+)*\.?)\s+[A-Z][^.!?]{{1,80}}|CHAPTER\s+\d+.{{0,60}}|APPENDIX\s+[A-Z].{{0,60}})$')) AS headings FROM u GROUP BY scope")
def p3_heading_flags(spark, d):
    u = C.units(files(spark, d), ["scope", "source_file"])
    return u.groupBy("scope").agg(F.count(F.lit(1)).alias("units"), F.count_if("heading").alias("headings"))


@query("SELECT doc_id, replace(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(65534) || chr(10), ''), chr(65534), '') AS text FROM documents".replace("\\\\", "\\"))
def p4_dehyphenate(spark, d):
    return files(spark, d).select("doc_id", T.dehyphenate(F.col("text")).alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def p5_collapse(spark, d):
    return files(spark, d).select("doc_id", T.collapse(F.col("text")).alias("text"))


@query(r"""WITH c AS (SELECT doc_id, pos, trim(regexp_replace(cell, '\s+', ' ', 'g')) AS cell FROM (SELECT doc_id, unnest(string_split(text, '|')) AS cell, generate_subscripts(string_split(text, '|'), 1) AS pos FROM documents)),
k AS (SELECT *, lag(cell) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM c WHERE cell <> '')
SELECT doc_id, string_agg(cell, ' | ' ORDER BY pos) AS row_text FROM k WHERE before IS NULL OR before <> cell GROUP BY doc_id""")
def p6_row_text(spark, d):
    return files(spark, d).select("doc_id", T.row_text(F.split("text", r"\|")).alias("row_text")).where("row_text <> ''")


@query(rf"""WITH {_UNITS}, h AS (SELECT *, CASE WHEN regexp_matches(unit, '^((\d+(\.\d+)*\.?|[A-Z]\.\d+(\.\d+)*\.?)\s+[A-Z][^.!?]{{1,80}}|CHAPTER\s+\d+.{{0,60}}|APPENDIX\s+[A-Z].{{0,60}})$') THEN unit END AS head FROM u)
SELECT scope, source_file, pos, last_value(head IGNORE NULLS) OVER (PARTITION BY scope, source_file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h""")
def p7_sections(spark, d):
    u = C.units(files(spark, d), ["scope", "source_file"])
    return C.with_sections(u, ["scope", "source_file"], ["pos"]).select("scope", "source_file", "pos", "section")


@query(r"SELECT source AS scope, count(*) AS documents, count_if(regexp_replace(text, '^\s+|\s+$', '', 'g') <> '') AS with_text FROM documents GROUP BY source")
def p8_documents_without_text(spark, d):
    return files(spark, d).groupBy("scope").agg(F.count(F.lit(1)).alias("documents"), F.count_if(T.strip(F.col("text")) != "").alias("with_text"))


@query(r"""SELECT scope, source_file, CASE WHEN digits = '' THEN 'no text' ELSE 'no chunks' END AS reason FROM
  (SELECT source AS scope, doc_id || ':' || (generate_subscripts(string_split_regex(text, '\r?\n'), 1) - 1) AS source_file, regexp_replace(unnest(string_split_regex(text, '\r?\n')), '[^0-9]', '', 'g') AS digits FROM documents)
  WHERE length(digits) <= 4""")
def p8_report(spark, d):
    """The digits of every line as a document of its own: those that give no chunk, and why."""
    own = read(spark, d, "documents").select(F.col("source").alias("scope"), "doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    own = own.select("scope", F.concat_ws(":", "doc_id", "pos").alias("source_file"), F.regexp_replace("line", "[^0-9]", "").alias("text"))
    return C.without_chunks(own, C.chunk_pages(C.unit_arrays(own)))


@query(r"SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' GROUP BY conv_id")
def p9_pages_to_text(spark, d):
    c = read(spark, d, "conversations").where(T.strip(F.col("text")) != "")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE contains(lower(source), lower('SRC1'))) WHERE rn <= 5")
def p10_filter_and_first(spark, d):
    docs = read(spark, d, "documents").where(F.contains(F.lower("source"), F.lower(F.lit("SRC1"))))
    return docs.select("source", "doc_id", F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("rn")).where("rn <= 5").select("source", "doc_id")


_WINDOWS = f"""w AS (SELECT source AS scope, doc_id::VARCHAR AS source_file, {_WORDS} AS w FROM documents),
chunks AS (SELECT scope, source_file, i AS chunk_index, source_file || '_chunk_' || i AS chunk_id, array_to_string(list_slice(w, i * 450 + 1, i * 450 + 500), ' ') AS text
  FROM (SELECT *, unnest(range(0, CAST(ceil(len(w) / 450.0) AS BIGINT))) AS i FROM w WHERE len(w) > 0))"""


@query(f"WITH {_WINDOWS} SELECT scope, source_file, chunk_index, text FROM chunks")
def c1_word_windows(spark, d):
    return C.word_windows(files(spark, d)).select("scope", "source_file", "chunk_index", "text")


@query(f"SELECT doc_id, CAST(floor(len({_WORDS}) * 1.4::DOUBLE) AS INTEGER) + 1 AS tokens FROM documents")
def c2_estimated_tokens(spark, d):
    return files(spark, d).select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query()
def c3_counter_in_chunks(spark, d):
    """Chunks under another token counter: characters over four."""
    return C.chunk_pages(C.unit_arrays(files(spark, d)), count=lambda s: len(s) // 4 + 1)


@query()
def c4_split_long_units(spark, d):
    """Units far over a small limit, split into sentences and words."""
    return C.chunk_pages(C.unit_arrays(files(spark, d)), limit=40, overlap=0)


@query()
def c5_chunk_pages(spark, d):
    return C.chunk_pages(C.unit_arrays(files(spark, d)))


@query(f"WITH {_WINDOWS} SELECT chunk_id, source_file, chunk_index FROM chunks")
def c6_chunk_ids(spark, d):
    return C.word_windows(files(spark, d)).select("chunk_id", "source_file", "chunk_index")


@query(r"""SELECT doc_id, pos - 1 AS pos, sentence FROM (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM
(SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9"“(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents))""")
def c7_sentences(spark, d):
    return files(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query()
def c8_passages(spark, d):
    return C.passages(files(spark, d), "doc_id")


@query(r"""WITH s AS (SELECT doc_id, text, len(text) // 2 AS mid FROM documents),
p AS (SELECT *, regexp_extract(substr(text, 1, mid), '(?s)^(.*[.!?])(?:\s|$)', 1) AS head, substr(text, mid + 6) AS rest FROM s),
e AS (SELECT *, regexp_extract(rest, '(?s)^(.*?[.!?])(?:\s|$)', 1) AS tail FROM p),
w AS (SELECT doc_id, regexp_replace(substr(text, len(head) + 1, mid - len(head)) || substr(text, mid + 1, 5) || CASE WHEN tail = '' THEN rest ELSE tail END, '^\s+|\s+$', '', 'g') AS sentence FROM e)
SELECT doc_id, CASE WHEN len(list_filter(string_split_regex(sentence, '\s+'), lambda x: x <> '')) BETWEEN 4 AND 60 THEN sentence END AS sentence FROM w""")
def c9_sentence_around(spark, d):
    """The sentence around the middle word of each document."""
    start = F.floor(F.length("text") / 2).cast("int")
    return files(spark, d).select("doc_id", T.sentence_around(F.col("text"), start, F.lit(5)).alias("sentence"))


@query(f"WITH {_WINDOWS}, f AS (SELECT source_file, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) FILTER (chunk_index < 5) AS t FROM chunks GROUP BY source_file) SELECT source_file, t || CASE WHEN n > 5 THEN chr(10) || chr(10) || '...' ELSE '' END AS preview FROM f")
def c10_preview(spark, d):
    c = C.word_windows(files(spark, d))
    first = F.array_sort(F.collect_list(F.when(F.col("chunk_index") < 5, F.struct("chunk_index", "text"))))
    got = c.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), first.alias("f"))
    return got.select("source_file", F.concat(F.array_join(F.transform("f", lambda x: x["text"]), "\n\n"), F.when(F.col("n") > 5, "\n\n...").otherwise("")).alias("preview"))


@query(f"WITH {_WINDOWS} SELECT scope, source_file, count(*) AS chunks FROM chunks GROUP BY scope, source_file")
def c11_chunk_counts(spark, d):
    return C.word_windows(files(spark, d)).groupBy("scope", "source_file").agg(F.count(F.lit(1)).alias("chunks"))
