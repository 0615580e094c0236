"""Language identification as mixture inference.

Training adds up character trigrams per language over all labelled training rows. A document is a mixture: every trigram
was drawn from one of the languages, in proportions found by expectation-maximisation. The set of languages is chosen by
penalised likelihood: the heaviest languages of the full mixture are added one by one while each addition raises the log
likelihood by more than half the log of the number of trigrams (and a noise allowance per trigram). The prediction is
the language of the largest proportion in the chosen set, the score its proportion.

Trigrams are bytes of the lower-cased text hashed into a table of fixed size, so the model is at most
languages x 65,536 numbers; it is sent to the workers as such.

Defined results: null texts and texts without a letter are `und` with score 0; with no labelled training row everything
is `und`; ties go to the language first by code point; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagebase.llm.common import crc32_mod, doc_slices, drop_rows, text_sha

TABLE_BITS = 16
UNKNOWN = "und"
#: Documents are divided by this many trigrams' worth of evidence: neighbours overlap and aren't independent.
OVERLAP = 3.0
_PIECE = 1 << 20


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, white space folded to single blanks."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").split()) + b" ", dtype=np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, dtype=np.int64)
    code = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their smoothed log-probability tables, from all given rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in doc_slices(batches, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if lang not in total:
                    total[lang] = np.zeros(1 << TABLE_BITS, dtype=np.int64)
                for i in range(0, len(text), _PIECE):
                    total[lang] += np.bincount(trigrams(text[i : i + _PIECE + 2]), minlength=1 << TABLE_BITS)
        for lang, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(t[at])], names=["lang", "gram", "n"])

    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    summed = labelled.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(summed.column("lang").to_pylist(), dtype=object)
    langs = sorted(set(names.tolist()))
    table = np.zeros((1 << TABLE_BITS, len(langs)))
    for i, lang in enumerate(langs):
        own = names == lang
        table[np.asarray(summed.column("gram"))[own], i] = np.asarray(summed.column("n"))[own]
    table += 0.5
    return langs, (table / table.sum(axis=0)).astype(np.float32)


def infer(table: np.ndarray, grams: np.ndarray, steps: int = 12) -> tuple[int, float]:
    """(language, proportion) of one document by expectation-maximisation with a penalised choice of languages."""
    at, times = np.unique(grams, return_counts=True)
    probability, total = table[at].astype(np.float64), float(times.sum())

    def fit(which: np.ndarray) -> tuple[np.ndarray, float]:
        p = probability[:, which]
        share = np.full(len(which), 1.0 / len(which))
        if len(which) > 1:
            for _ in range(steps):
                share = share * ((times / (p @ share)) @ p) / total
                share /= share.sum()
        return share, float(times @ np.log(p @ share)) / OVERLAP

    everything = np.arange(table.shape[1])
    full, _ = fit(everything)
    order = np.argsort(-full, kind="stable")
    chosen = order[:1]
    share, likelihood = fit(chosen)
    for k in range(2, len(order) + 1):
        trial = order[:k]
        more, gained = fit(trial)
        if gained - likelihood <= 0.5 * np.log(total) + 0.01 * total / OVERLAP:
            break
        chosen, share, likelihood = trial, more, gained
    best = min(range(len(chosen)), key=lambda i: (-share[i], chosen[i]))
    return int(chosen[best]), float(min(1.0, share[best]))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", with_sha: bool = False) -> DataFrame:
    """doc_id, lang_pred, score for every row; with the text's SHA-256 (sha) after doc_id if wanted."""
    langs, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)  # languages x 65,536 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in doc_slices(batches, "text"):
            names, scores = [], []
            for text, letters in zip(batch.column("text").to_pylist(), batch.column("letters").to_pylist(), strict=True):
                grams = trigrams(text) if letters and langs else ()
                if not len(grams):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    best, score = infer(table, grams)
                    names.append(langs[best])
                    scores.append(score)
            kept = [batch.column(i) for i, f in enumerate(batch.schema) if f.name not in ("text", "letters")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*(f.name for f in batch.schema if f.name not in ("text", "letters")), "lang_pred", "score"])

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    sha = [text_sha(text_col).alias("sha")] if with_sha else []
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), *sha, F.col(text_col).alias("text"), letters)
    return picked.mapInArrow(run, f"doc_id long, {'sha string, ' if with_sha else ''}lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows with a language whose crc32(doc_id) is not 0 modulo folds."""
    model = learn(docs.where(crc32_mod(id_col, folds) != 0), text_col, lang_col)
    out = identify(docs, model, id_col, text_col)
    return out.select("doc_id", F.coalesce(crc32_mod("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def drop_unknown(docs: DataFrame, predictions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose language could be told; `und` is exactly the documents without a letter, or all without a model.

    predictions are those of identify with the texts' SHA-256: rows are decided by doc_id and text.
    """
    return drop_rows(docs, predictions.where(F.col("lang_pred") == UNKNOWN).select("doc_id", "sha").distinct(), id_col, text_sha(text_col))
