"""Whitening of embeddings from an exact covariance, by digit-slice matrix products.

Entries become integers, x = floor(SCALE * c) + SHIFT. One pass adds up their number n and sums S exactly, a second the
products of the centred integers y = n * x - S. There each y is cut into limbs of LIMB_BITS bits, the last one signed; the
products of the limb matrices are float64 BLAS products, and as a limb product has 2 * LIMB_BITS bits they stay exact for
FOLD_ROWS rows. After so many rows, and at a task's end, the limb products are put together as big integers. Tasks hand
these on as digits of DIGIT_BITS bits, which Spark adds up by cell and digit; what reaches the driver is one exact matrix,
whose size depends on the dimension alone. Its eigenvectors (float64; entries are rounded once, from exact fractions)
are the components. A third pass, narrow, projects each row and adds up its exact squared deviation from the same limbs.

All sums are of integers, so neither the order of rows nor their partitions change a result.

Defined results: a row whose vector is null, empty or holds a null or non-finite entry is dropped, and so is one that is
shorter or longer than the longest vector without such entries (it lacks entries, or no fit knows them); entries beyond
2**52 / SCALE are taken as that. Repeated rows and ids count as rows; a null id is an id like any other; there are as many
components as dimensions if these are fewer; a component without variance has whitened 0 and explained 0 and is left as it
is in identity_error; a deviation beyond a long is null there and whole in deviation_text; an empty table gives an empty
result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagebase.llm.common import stash

SCALE, SHIFT = 1024, 100_000
#: Bits of a limb, and rows whose limb products add up without rounding: 2 * LIMB_BITS + 29 = 53.
LIMB_BITS = 12
FOLD_ROWS = 1 << 29
#: Bits of the digits that Spark adds up: sums of 2**33 tasks fit a long.
DIGIT_BITS = 30
_SLICE_ROWS = 8192
_FARTHEST = float(1 << 52)
_LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """What a fit gives: rows n, integer sums of the entries, components (one a row) and their variances, the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def explained(self) -> list[float]:
        return [float(v) / self.trace if v > 0 else 0.0 for v in self.variances]


def clean_vectors(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(vec_id, vec array<double>) of the rows that count, and the dimension (0 without such rows)."""
    v = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = v.where(F.col("vec").isNotNull() & (F.size("vec") > 0)).where(F.forall("vec", fine))
    dim = v.agg(F.max(F.size("vec")).alias("d")).first()["d"] or 0
    return v.where(F.size("vec") == dim), dim


def integers(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The vectors of a batch as integers x, one a row."""
    flat = np.asarray(batch.column("vec").flatten(), dtype=np.float64).reshape(-1, dim)
    return np.clip(np.floor(SCALE * flat), -_FARTHEST, _FARTHEST).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in longs where they hold it, else in Python's integers."""
    most = max(abs(int(x.min())), abs(int(x.max())), 1) if x.size else 1
    if n * most + max(map(abs, sums)) <= _LONG:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y = sum of limb i * 2**(LIMB_BITS * i), as float64 matrices; all but the last limb are 0 or more, the last is signed."""
    out = []
    while True:
        most = max(int(y.max()), -1 - int(y.min())) if y.size else 0
        if most < 1 << (LIMB_BITS - 1):
            return [*out, y.astype(np.float64)]
        out.append((y & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        y = y >> LIMB_BITS


class Products:
    """Sums of products of limb matrices over rows, folded into big integers before a float64 could round."""

    def __init__(self, dim: int, fold_rows: int = FOLD_ROWS):
        self.dim, self.fold_rows, self.rows, self.parts = dim, fold_rows, 0, {}
        self.total = np.zeros((dim, dim), dtype=object)

    def add(self, y: np.ndarray) -> None:
        parts = limbs(y)
        if self.rows + len(y) > self.fold_rows:
            self.fold()
        self.rows += len(y)
        for i, a in enumerate(parts):
            for j in range(i, len(parts)):
                got = a.T @ parts[j]
                held = self.parts.get((i, j))
                self.parts[i, j] = got if held is None else held + got

    def fold(self) -> None:
        """Recombine: a limb product (i, j) stands for (j, i) as well, turned."""
        for (i, j), product in self.parts.items():
            whole = product.astype(np.int64).astype(object) << (LIMB_BITS * (i + j))
            self.total = self.total + (whole if i == j else whole + whole.T)
        self.parts, self.rows = {}, 0


def digits(values: list[int]) -> Iterator[tuple[int, int, int]]:
    """(cell, digit, part) with value = sum of part * 2**(DIGIT_BITS * digit); parts carry the value's sign."""
    for cell, value in enumerate(values):
        sign, rest, at = (-1 if value < 0 else 1), abs(value), 0
        while rest:
            if part := rest & ((1 << DIGIT_BITS) - 1):
                yield cell, at, sign * part
            rest, at = rest >> DIGIT_BITS, at + 1


_PARTS = "cell int, digit int, part long"


def _part_batch(values: list[int]) -> pa.RecordBatch:
    rows = list(digits(values)) or [(0, 0, 0)]
    cell, digit, part = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(digit, pa.int32()), pa.array(part, pa.int64())], names=["cell", "digit", "part"])


def merged(parts: DataFrame, cells: int) -> list[int]:
    """The tasks' big integers added up: partial sums per task, then one row for each cell and digit."""
    out = [0] * cells
    for r in parts.groupBy("cell", "digit").agg(F.sum("part").alias("part")).toLocalIterator():
        out[r["cell"]] += r["part"] << (DIGIT_BITS * r["digit"])
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE_ROWS):
            yield batch.slice(at, _SLICE_ROWS)


def count_and_sums(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of the integers in each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim + 1, dtype=object)
        for piece in _pieces(batches):
            x = integers(piece, dim)
            # 8,192 entries of 53 bits stay within a long.
            total = total + np.concatenate([x.sum(axis=0).astype(object), [len(x)]])
        yield _part_batch(list(total))

    got = merged(vectors.select("vec").mapInArrow(run, _PARTS), dim + 1)
    return got[-1], got[:-1]


def products(vectors: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """The exact sum over all rows of y y' for y = n * x - S, as a matrix of big integers."""
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sum_of = Products(dim)
        for piece in _pieces(batches):
            sum_of.add(centred(integers(piece, dim), n, sums))
        sum_of.fold()
        yield _part_batch(list(sum_of.total[upper]))

    half = merged(vectors.select("vec").mapInArrow(run, _PARTS), len(upper[0]))
    whole = np.zeros((dim, dim), dtype=object)
    whole[upper] = half
    whole.T[upper] = half
    return whole


def fit(vectors: DataFrame, dim: int, components: int = 8) -> Whitening:
    """Components of the covariance V (divisor n) of all given vectors, by falling variance."""
    n, sums = count_and_sums(vectors, dim)
    exact = products(vectors, dim, n, sums)
    # One rounding an entry: Python divides integers to the nearest float.
    v = np.array([[int(a) / n**3 for a in row] for row in exact])
    trace = int(sum(int(exact[i][i]) for i in range(dim))) / n**3
    values, vectors_ = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    chosen = vectors_[:, order].T
    largest = np.abs(chosen).argmax(axis=1)
    chosen = chosen * np.sign(chosen[np.arange(len(chosen)), largest])[:, None]
    noise = trace * dim * np.finfo(float).eps
    return Whitening(n, sums, chosen, np.where(values[order] > noise, values[order], 0.0), trace)


def project(vectors: DataFrame, dim: int, fitted: Whitening) -> DataFrame:
    """(vec_id, deviation, deviation_text, whitened array<double>) of every row: one narrow pass."""
    n, sums = fitted.n, fitted.sums
    scale = np.where(fitted.variances > 0, 1 / np.sqrt(np.where(fitted.variances > 0, fitted.variances, 1)), 0.0)
    turn = (fitted.components * scale[:, None]).T
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            y = centred(integers(piece, dim), n, sums)
            parts, squares = limbs(y), np.zeros(len(y), dtype=object)
            for i, a in enumerate(parts):
                for j in range(i, len(parts)):
                    dots = np.einsum("rd,rd->r", a, parts[j]).astype(np.int64).astype(object)
                    squares = squares + (dots << (LIMB_BITS * (i + j) + (i != j)))
            white = (y.astype(np.float64) / n) @ turn
            held = pa.array([int(s) if s <= _LONG else None for s in squares], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * turn.shape[1], pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column("vec_id"), held, pa.array([str(s) for s in squares]), lists], names=["vec_id", "deviation", "deviation_text", "whitened"])

    return vectors.mapInArrow(run, f"vec_id {kind}, deviation long, deviation_text string, whitened array<double>")


def identity_error(projected: DataFrame, components: int) -> float:
    """Largest absolute entry of the whitened columns' covariance (divisor n, centred) minus the identity."""
    w = [F.col("whitened")[i] for i in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = projected.agg(*(F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text: a row for each vector and component."""
    spark = rows.sparkSession
    vectors, dim = clean_vectors(rows, id_col, vec_col)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not dim:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string")
    fitted = fit(vectors, dim, components)
    projected = stash(project(vectors, dim, fitted))
    error = identity_error(projected, len(fitted.variances))
    share = F.array(*(F.lit(e) for e in fitted.explained()))
    out = projected.select("vec_id", "deviation", "deviation_text", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"), "deviation_text")
