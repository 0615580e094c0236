"""Reading the given tables in their roles, and the registry that queries and their SQL are kept in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagebase.sources.shared import scratch  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL it is held against."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: scope is the source, the file its id."""
    return read(spark, sf_dir, "documents").select(F.col("source").alias("scope"), F.col("doc_id").cast("string").alias("source_file"), "doc_id", "text")


def questions(spark: SparkSession, sf_dir: str, scoped: bool = True) -> DataFrame:
    """Benchmark items as questions, each in one scope."""
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return q.withColumn("scope", F.concat(F.lit("src"), (F.col("question_id") % 20).cast("string"))) if scoped else q


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with the user turn before them."""
    c = read(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")).join(user, ["conv_id", "turn"], "left")
