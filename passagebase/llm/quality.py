"""Quality by compression: two zstandard dictionaries, one built from good and one from bad labelled text.

A text is compressed with either dictionary. What it saves under the good one, against its compressed and its raw size,
and how far it can be compressed at all, go through a logistic calibration fitted on labelled texts that the
dictionaries haven't seen. The fit uses a bounded sample of labelled rows (SAMPLE_DOCS a label, chosen by a hash of the
id); every text is scored whole.

Defined results: null and empty texts compress alike under both dictionaries and get the calibration's value for that;
without labels of both kinds the score is the share of label 1 among them, or 0.5 without any; of several labels of one
document the least counts; a null doc_id is never learned from; repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagebase.llm.common import as_bytes, crc32_mod, doc_slices

#: The fit's bounds: labelled documents a label, pieces of text a label and characters of a piece.
SAMPLE_DOCS, SAMPLE_PIECES, PIECE = 4000, 4000, 1500
DICTIONARY_BYTES, LEVEL = 112_640, 3


def compressors(dictionaries: list[bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in dictionaries:
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out


def features(text: bytes, pair: list[zstandard.ZstdCompressor]) -> tuple[float, float, float, float]:
    """Normalised size differences (against compressed and raw size), log compression ratio, log size."""
    bad, good = (len(c.compress(text)) for c in pair)
    raw = len(text)
    return ((bad - good) / max(1, min(bad, good)), (bad - good) / (raw + 16), float(np.log((raw + 16) / (min(bad, good) + 16))), float(np.log(raw + 16)))


def _terms(x: np.ndarray) -> np.ndarray:
    """Terms of the calibration: the features, their bends and the products with the first two."""
    a, b, ratio, size = x.T
    ratio_c, size_c = ratio - 1.0, size - 7.0
    return np.stack([np.ones_like(a), np.tanh(8 * a), a, np.tanh(40 * b), b, ratio_c, ratio_c**2, np.maximum(ratio_c - 1, 0), size_c, np.tanh(8 * a) * ratio_c, np.tanh(40 * b) * ratio_c, np.tanh(40 * b) * size_c], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Newton's method with a small ridge; the normal equations are solved by elimination."""
    t = _terms(x)
    w = np.zeros(t.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip((t * w).sum(axis=1), -30, 30)))
        gradient = (t * (p - y)[:, None]).sum(axis=0) + ridge * w
        hessian = np.einsum("ni,nj,n->ij", t, t, p * (1 - p), optimize=False) + ridge * np.eye(len(w))
        step = _solve(hessian, gradient)
        w -= step * min(1.0, 3.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = np.concatenate([a, b[:, None]], axis=1)
    for i in range(len(b)):
        j = i + int(np.abs(m[i:, i]).argmax())
        m[[i, j]] = m[[j, i]]
        m[i] /= m[i, i]
        factor = m[:, i].copy()
        factor[i] = 0
        m -= factor[:, None] * m[i]
    return m[:, -1]


def score_of(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip((_terms(x) * w).sum(axis=1), -30, 30)))


class QualityModel:
    """Dictionaries and calibration; `rate` alone where the labels can't give these."""

    def __init__(self, dictionaries: list[bytes] | None, weights: np.ndarray | None, rate: float):
        self.dictionaries, self.weights, self.rate = dictionaries, weights, rate

    def scores(self, texts: list[bytes], pair: list) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.rate)
        return score_of(np.array([features(t, pair) for t in texts]), self.weights)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1, seed: int = 42) -> QualityModel:
    """Fit on a bounded sample of labelled rows whose crc32(doc_id) modulo folds isn't `held`."""
    one = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("l_id")).agg(F.min(label_col).cast("int").alias("label"))
    one = one.where(crc32_mod("l_id", folds) != held).withColumn("order", F.xxhash64(F.lit(seed), "l_id"))
    picks = [one.where(F.col("label") == k).orderBy("order", "l_id").limit(SAMPLE_DOCS) for k in (0, 1)]
    sample = F.broadcast(picks[0].unionAll(picks[1]))  # 2 x SAMPLE_DOCS rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = texts.join(sample, F.col("doc_id") == F.col("l_id")).select("text", "label", "order")
    seen, unseen = joined.where(F.pmod("order", F.lit(2)) == 0), joined.where(F.pmod("order", F.lit(2)) == 1)
    pieces = seen.select("label", "order", "text", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / PIECE))).alias("i"))
    pieces = pieces.select("label", F.xxhash64("order", "i").alias("o"), F.col("text").substr((F.col("i") * PIECE + 1).cast("int"), F.lit(PIECE)).alias("piece"))
    dictionaries = []
    for k in (0, 1):
        got = [r["piece"].encode("utf-8", "replace") for r in pieces.where((F.col("label") == k) & (F.length("piece") > 0)).orderBy("o").limit(SAMPLE_PIECES).collect()]
        try:
            dictionaries.append(zstandard.train_dictionary(DICTIONARY_BYTES, got).as_bytes())
        except zstandard.ZstdError:  # too little text for a trained dictionary: its bytes are the dictionary
            dictionaries.append(b"".join(got)[-DICTIONARY_BYTES:])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(dictionaries)
        for batch in doc_slices(batches, "text"):
            x = [features(t, pair) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array([r[i] for r in x], pa.float64()) for i in range(4))], names=["label", "a", "b", "c", "d"])

    rows = np.array([tuple(r) for r in unseen.select("text", "label").mapInArrow(measure, "label int, a double, b double, c double, d double").collect()], dtype=float).reshape(-1, 5)
    rows = rows[np.lexsort(rows.T)]  # the order of tasks must not change the fit
    rate = float(rows[:, 0].mean()) if len(rows) else 0.5
    if len(np.unique(rows[:, 0])) < 2:
        return QualityModel(None, None, rate)
    return QualityModel(dictionaries, fit_logistic(rows[:, 1:], rows[:, 0]), rate)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(model.dictionaries) if model.dictionaries else []
        for batch in doc_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(as_bytes(batch.column("text")), pair), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs, fit(docs, labels, id_col, text_col, label_col, folds, held), id_col, text_col)
    return out.select("doc_id", F.coalesce(crc32_mod("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
