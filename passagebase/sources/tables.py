"""Readers and writers with explicit schemas: documents, passages, gold items, cases, runs, corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "scope string, source_file string, chunk_index int, chunk_id string, text string, page int, pages array<int>, section string"
GOLD = "id string, doc string, type string, answerable boolean, question string, evidence array<string>, answers array<string>, all_of array<array<string>>, key_points array<array<string>>"
CASES = "id string, query string, expected_source string, expected_chunk_id string, type string"
RUN = (
    "run_timestamp string, pipeline string, opts map<string,string>, retrieval_only boolean, llm_backend string, llm_model string, rows array<struct<id:string,doc:string,type:string,answerable:boolean,"
    "question:string,evidence_rank:int,has_evidence:boolean,retrieved:array<struct<chunk_id:string,embed_score:double,similarity_score:double>>,latency_s:double,answer:string,warning:string,correct:boolean,partial:double,strict_refusal:boolean,abstained:boolean>>"
)
SQUAD = "title string, context string, question string, answers struct<text:array<string>,answer_start:array<int>>"
HOTPOT = "question string, answer string, context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>,sent_id:array<int>>"
DOLLY = "instruction string, context string, response string, category string"
SUFFIXES = ("txt", "pdf", "docx")


def scan_folder(spark: SparkSession, path: str, suffixes: tuple = SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """(files of a known suffix, the others): path, name, length. Contents aren't read.

    Spark's readers pass over files without bytes, so those come from its list of files, with length 0. Names that begin
    with a dot or an underscore are hidden from Spark.
    """
    read = spark.read.format("binaryFile").load(path)
    # One spelling for a file's address: readers and lists differ in slashes and in what they encode.
    same = lambda c: F.regexp_replace(c, "^([A-Za-z0-9+.-]+):/+", "$1:/")
    decoded = F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B")))
    listed = spark.createDataFrame([(f,) for f in read.inputFiles()], "value string").select(same(decoded).alias("path"))
    found = listed.join(read.select(same(F.col("path")).alias("path"), "length"), "path", "left")
    found = found.select("path", F.coalesce("length", F.lit(0).cast("long")).alias("length"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    known = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*suffixes)
    return found.where(known).orderBy("name"), found.where(~known).orderBy("name")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text): one row a UTF-8 file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))


def read_json(spark: SparkSession, path, schema: str, array: bool = True) -> DataFrame:
    """A JSON array of objects, or one object a line; other keys are ignored, blank lines skipped."""
    return spark.read.schema(schema).json(path, multiLine=array)


def saved_rows(spark: SparkSession, paths, array: bool = True) -> DataFrame:
    """Rows of saved runs, one a question; retrieval-only runs are left out. A run is a file, or (no array) a line."""
    runs = read_json(spark, paths, RUN, array).where(~F.coalesce("retrieval_only", F.lit(False)))
    return runs.select("run_timestamp", "pipeline", F.explode("rows").alias("row")).select("run_timestamp", "pipeline", "row.*")


def bucket_of(scope: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(scope), F.lit(buckets)).cast("int")


def write_chunks(chunks: DataFrame, path: str, buckets: int = 64, mode: str = "append") -> None:
    chunks.withColumn("bucket", bucket_of(F.col("scope"), buckets)).write.mode(mode).partitionBy("bucket").parquet(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A fixed list of columns, others dropped."""
    rows.select(*columns).write.mode("overwrite").csv(path, header=True)


def write_report(metrics: DataFrame, rows: DataFrame, path: str) -> None:
    """Metrics and rows side by side as JSON; rows stay distributed."""
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    rows.write.mode("overwrite").json(f"{path}/rows")


def append_history(row: DataFrame, path: str) -> None:
    row.write.mode("append").json(path)


def new_only(incoming: DataFrame, present: DataFrame, keys: tuple = ("scope", "chunk_id")) -> DataFrame:
    """What isn't indexed yet, each key once."""
    return incoming.dropDuplicates(list(keys)).join(present.select(*keys), list(keys), "left_anti")
