"""Hooks for models: an embedder, a pair scorer, a text generator. Defaults need no weights."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagebase.operators.chunking import default_tokens, each, longest_run
from passagebase.sources.shared import kept


def hashing_embedder(texts: list[str], dim: int = 384) -> np.ndarray:
    """Signed feature hashing of words, rows L2-normalised; a stand-in for a real model."""
    out = np.zeros((len(texts), dim), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % dim] += 1.0 if h & 0x80000000 else -1.0
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm == 0, 1, norm)


def embed(df: DataFrame, column: str, model: Callable[[list[str]], np.ndarray] = hashing_embedder, batch: int = 256) -> DataFrame:
    """Adds `embedding`; the model is called on bounded batches, once loaded per Python worker."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows = [r for i in range(0, len(part), batch) for r in model(part.iloc[i : i + batch].tolist())]
            yield pd.Series(rows, index=part.index, dtype=object)

    return df.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.coalesce(F.col(column), F.lit(""))))


def word_share(questions: list[str], passages: list[str]) -> list[float]:
    """Share of a question's distinct words that the passage holds."""
    out = []
    for q, p in zip(questions, passages, strict=True):
        words = set(q.lower().split())
        out.append(len(words & set(p.lower().split())) / max(1, len(words)))
    return out


def cut_pair(question: str, passage: str, size: int, many: Callable[[list[str]], list[int]], limit: int) -> str:
    """The passage, or as many of its first words as fit beside the whole question; a question over the limit leaves none."""
    room = limit - many([question])[0]
    if size <= room:
        return passage
    words = passage.split()
    fits = lambda t: many([t])[0] <= room
    if not words or not fits(words[0]):
        return ""
    return " ".join(words[: longest_run(words, 0, fits)])


def score_pairs(model: Callable[[list[str], list[str]], list[float]] = word_share, batch: int = 16, limit: int | None = None, many: Callable[[list[str]], list[int]] | None = None):
    """A column function of (question, passage) for rerankers, called in batches of pairs of like length.

    With a limit of tokens a pair is cut to it: the passage loses its last words, the question none. Lengths are counted
    by `many`, the counter of chunks, once a passage; pairs are scored from short to long, so a batch holds little padding.
    Null questions and passages count as empty.
    """
    many = many or each(default_tokens)

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, p in parts:
            asked, held = q.fillna("").tolist(), p.fillna("").tolist()
            sizes = many(held)
            if limit is not None:
                held = [cut_pair(a, b, n, many, limit) for a, b, n in zip(asked, held, sizes, strict=True)]
                sizes = [min(n, limit) for n in sizes]
            order = sorted(range(len(held)), key=sizes.__getitem__)
            out = [0.0] * len(held)
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                for at, score in zip(some, model([asked[j] for j in some], [held[j] for j in some]), strict=True):
                    out[at] = float(score)
            yield pd.Series(out, index=q.index, dtype=float)

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def first_passage(prompts: list[str]) -> list[str]:
    """An extractive stub: the first passage's first sentence, with its source named."""
    out = []
    for p in prompts:
        head, _, rest = p.partition("[CHUNK 1 | source: ")
        source, _, body = rest.partition("]\n")
        out.append((body.split(". ")[0] + ".\n\nSources:\n" + source.split(" | ")[0]) if rest else "I don't have enough information in the provided documents to answer this question.")
    return out


def generate(df: DataFrame, prompt: str, model: Callable[[list[str]], list[str]] = first_passage, parallel: int | None = None, batch: int = 16) -> DataFrame:
    """Adds `response`; `parallel` bounds how many calls run at once."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([r for i in range(0, len(part), batch) for r in model(part.iloc[i : i + batch].tolist())], index=part.index, dtype=object)

    return (df.repartition(parallel) if parallel else df).withColumn("response", F.pandas_udf(run, "string")(F.col(prompt)))


def persistent(model: Callable[[list[str]], list[str]], tries: int = 3, wait: float = 0.0) -> Callable[[list[str]], list[str]]:
    """A model that is asked again when a call fails, `tries` times in all; then the failure stands."""

    def ask(prompts: list[str]) -> list[str]:
        for left in range(tries - 1, -1, -1):
            try:
                return model(prompts)
            except Exception:
                if not left:
                    raise
                time.sleep(wait)
        raise ValueError("tries must be 1 or more")

    return ask


def generate_once(df: DataFrame, prompt: str, path: str, model: Callable[[list[str]], list[str]] = first_passage, parallel: int | None = None, batch: int = 16, tries: int = 3, portion: int = 10_000) -> DataFrame:
    """Adds `response` as generate does, with every answer kept under its prompt's hash in the table at path.

    Prompts that were answered before, in this run or another, are not asked again, and equal prompts are asked once. New ones
    are asked in portions of about `portion`, each stored when it is done: after a failure, or lost executors, a new call
    goes on with the portion that failed. Within a portion a call is tried `tries` times, a task as often as Spark's limit has it.
    """
    spark = df.sparkSession
    keyed = df.withColumn("prompt_sha", F.sha2(F.col(prompt).cast("binary"), 256))
    stored = lambda: spark.read.schema("prompt_sha string, response string").parquet(path)
    wanted = keyed.where(F.col(prompt).isNotNull()).select("prompt_sha", F.col(prompt).alias("asked")).dropDuplicates(["prompt_sha"])
    spark.createDataFrame([], "prompt_sha string, response string").write.mode("append").parquet(path)
    wanted = kept(wanted.join(stored().select("prompt_sha"), "prompt_sha", "left_anti"))
    portions = -(-wanted.count() // portion)
    for i in range(portions):
        some = wanted.where(F.pmod(F.xxhash64("prompt_sha"), F.lit(portions)) == i)
        told = generate(some, "asked", persistent(model, tries), parallel, batch)
        told.select("prompt_sha", "response").write.mode("append").parquet(path)
    return keyed.join(stored(), "prompt_sha", "left").drop("prompt_sha")
