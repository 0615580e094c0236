"""Secret scan: pattern findings, and a small character network over every candidate with its context.

Patterns give the base findings, which always stay. Candidates are runs of key characters, CANDIDATE or more long, with or
without digits, also joined by single dots. A convolutional network in numpy (character classes, one convolution, maximum
over positions, one logistic unit) reads each candidate whole, with the BEFORE characters ahead of it and the AFTER behind
it: its view is cut into windows that overlap by the width of the convolution less one, so the maximum over all windows is
the maximum over the whole view, however long. It is trained on all labelled findings: views of base findings against views of
candidates that no pattern claims and whose own characters make them unlikely keys, every distinct one of them, whole. Unlikely
are runs that change between small letters, capitals and digits in at most MIXED of their places: words, numbers, addresses.
Unclaimed runs that change more often may be keys that the patterns miss, so they are no examples of either kind. Views are
dealt by hash to parts of about PART windows; in each of ROUNDS rounds every part goes on from the mean of all parts' networks
with views of its own that it has not seen, so all are used and no task holds more than its part. Batches give findings half
the weight and each kind of other candidates (of small letters, capitals, digits) the same share. Positive views are also shown
without their context, with another candidate's, and with their value spelt anew in base 64, hex or base 32, so that the
value itself must tell, and not only in hex. Scores are calibrated on every fourth view by hash, kept out of training; their
logits are counted in steps of 1 / STEP. The threshold keeps at least RECALL of that part's findings and is as far from the
lowest finding kept as from the highest other candidate below it. Candidates above it that touch no base finding are added as kind `model`.

Defined results: null and empty texts have no spans (base_sha256 of the empty string); without findings or without
other candidates to learn from (8 each) nothing is added; repeated rows get equal results; whole texts are read, whatever their
length; an empty table gives an empty result; extra columns are ignored. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagebase.llm.common import doc_slices, stash

# The base patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")

CANDIDATE = 12
#: Share of a run's places at which letters' case or digits change, up to which an unclaimed run is no key.
MIXED = 0.25
BEFORE, AFTER, WINDOW, WIDTH = 16, 16, 56, 5
RECALL = 0.99
#: Windows that one part trains on, rounds with several parts, steps at least over all rounds; one view in HELD is kept out.
PART, ROUNDS, STEPS, HELD = 120_000, 8, 1200, 4
#: Views of a batch; the least of each kind, findings last; views of a kind that each round of a part has at least.
BATCH, LEAST, SPREAD = 96, (8, 8, 8, 24), 32
#: Steps of a logit that are counted; parameters are added up in steps of 1 / FIXED, so that sums don't depend on order.
STEP, FIXED = 256, 1 << 32
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
CLASSES = 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern findings, ordered by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters, with or without digits, also joined by single dots."""
    return [m.span() for m in _RUN.finditer(text) if m.end() - m.start() >= CANDIDATE]


def character_classes() -> np.ndarray:
    """Class of each byte: letters by case and hex range, digits, signs of keys and assignments, blanks, the rest."""
    c = np.full(256, 13, dtype=np.uint8)
    for k, chars in enumerate(("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", "/", "+", "_-", "=", ":", "\"'", " \t\r\n", ".@")):
        c[list(chars.encode())] = k
    return c


_CLASS_OF = character_classes()


def touched(base: list[tuple[int, int, int]], spans: list[tuple[int, int]]) -> list[bool]:
    """Whether each span overlaps a base finding; base is ordered by start."""
    starts, ends = [], []
    for _, a, b in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    before = [bisect_left(starts, b) for _, b in spans]
    return [i > 0 and ends[i - 1] > a for i, (a, _) in zip(before, spans, strict=True)]


def windows(characters: np.ndarray) -> np.ndarray:
    """Windows that start WINDOW - WIDTH + 1 apart, so each position of the convolution falls into one of them."""
    return np.lib.stride_tricks.sliding_window_view(characters, WINDOW)[:: WINDOW - WIDTH + 1]


def characters(windows: np.ndarray) -> np.ndarray:
    """The classes of a view, its windows laid end to end."""
    return np.concatenate([windows[0], windows[1:, WIDTH - 1 :].ravel()])


def inner_end(characters: np.ndarray) -> int:
    """Where the candidate ends in its view."""
    return int(np.flatnonzero(characters >= CLASSES)[-1]) + 1


def shape(characters: np.ndarray) -> tuple[float, int]:
    """Share of a candidate's places at which small letters, capitals and digits follow one another, and which of the three is
    the most frequent; signs are passed over.
    """
    kind = characters[characters >= CLASSES] - CLASSES
    kind = np.minimum(kind[kind < 5] // 2, 2)
    return float((kind[1:] != kind[:-1]).mean()) if len(kind) > 1 else 0.0, int(np.bincount(kind, minlength=3).argmax())


#: Share of each class of characters (letters to f and beyond in both cases, digits, '/', '+') in base 64, hex of both cases, base 32.
_ALPHABETS = np.array([[6, 20, 6, 20, 10, 1, 1], [24, 0, 0, 0, 40, 0, 0], [0, 0, 24, 0, 40, 0, 0], [0, 0, 12, 40, 12, 0, 0]]) / 64


def respelt(characters: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """The view with the candidate's letters and digits drawn anew: from base 64 every other time, else from hex or base 32."""
    out = characters.copy()
    at = np.flatnonzero((out >= CLASSES) & (out < CLASSES + 5))
    alphabet = _ALPHABETS[max(0, int(r.integers(-2, 4)))]
    out[at] = CLASSES + r.choice(len(alphabet), len(at), p=alphabet)
    return out


def view(text: str, start: int, end: int) -> bytes:
    """Windows of classes from BEFORE ahead of the candidate to AFTER behind it; 16 is added inside it, class 14 is outside."""
    lo, hi, step = start - BEFORE, end + AFTER, WINDOW - WIDTH + 1
    raw = text[max(0, lo) : hi].encode("ascii", "replace")
    got = np.full(WINDOW + step * max(0, -(-(hi - lo - WINDOW) // step)), 14, dtype=np.uint8)
    at = max(0, -lo)
    got[at : at + len(raw)] = _CLASS_OF[np.frombuffer(raw, dtype=np.uint8)]
    got[BEFORE : BEFORE + end - start] += CLASSES
    return windows(got).tobytes()


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def stacked(views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the views side by side, and how many each has."""
    return np.concatenate(views), np.array([len(v) for v in views])


class CharacterNetwork:
    """One convolution over character classes, ReLU, maximum over positions, logistic output; trained by Adam."""

    FILTERS = 16

    def __init__(self, seed: int = 42):
        r = np.random.default_rng(seed)
        self.kernel = r.normal(0, 0.3, (WIDTH, 2 * CLASSES, self.FILTERS))
        self.bias, self.out, self.shift = np.zeros(self.FILTERS), r.normal(0, 0.3, self.FILTERS), np.zeros(1)
        self.scale, self.offset, self.threshold = 1.0, 0.0, 1.0

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        n = x.shape[1] - WIDTH + 1
        out = self.kernel[0][x[:, :n]] + self.bias
        for k in range(1, WIDTH):
            out += self.kernel[k][x[:, k : k + n]]
        return out

    def _tops(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter in each window, and its position."""
        tops, places = [], []
        for i in range(0, len(x), 4096):
            hidden = self._hidden(x[i : i + 4096])
            places.append(hidden.argmax(axis=1))
            tops.append(np.take_along_axis(hidden, places[-1][:, None, :], axis=1)[:, 0, :])
        return np.concatenate(tops), np.concatenate(places)

    def logits(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """x: windows, those of a view side by side; counts: windows of each view, at least one."""
        tops = np.concatenate([self._hidden(x[i : i + 4096]).max(axis=1) for i in range(0, len(x), 4096)])
        return (np.maximum(np.maximum.reduceat(tops, _starts(counts)), 0) * self.out).sum(axis=1) + self.shift[0]

    def probabilities(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x, counts) + self.offset, -30, 30)))

    NAMES = ("kernel", "bias", "out", "shift")

    def state(self) -> np.ndarray:
        """All parameters in a row, in whole steps of 1 / FIXED."""
        return np.round(np.concatenate([getattr(self, n).ravel() for n in self.NAMES]) * FIXED).astype(np.int64)

    def take(self, state: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            shape = getattr(self, n).shape
            size = int(np.prod(shape))
            setattr(self, n, state[at : at + size].reshape(shape))
            at += size

    def train(self, batches: Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]], rate: float) -> None:
        """One step of Adam for each batch: views, whether their context is blanked, labels, weights that add up to 1."""
        first, second = ({n: np.zeros_like(getattr(self, n)) for n in self.NAMES} for _ in range(2))
        filters = np.arange(self.FILTERS)[None, :]
        for step, (views, bare, want, weight) in enumerate(batches, 1):
            own, counts = stacked(views)
            own = np.where(np.repeat(bare, counts)[:, None] & (own < CLASSES), np.uint8(14), own)
            tops, places = self._tops(own)
            # The window that holds each filter's maximum of a view.
            starts = _starts(counts)
            rows = np.repeat(starts[:, None], self.FILTERS, axis=1)
            for i in np.flatnonzero(counts > 1):
                rows[i] += tops[starts[i] : starts[i] + counts[i]].argmax(axis=0)
            top, at = tops[rows, filters], places[rows, filters]
            pooled = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip((pooled * self.out).sum(axis=1) + self.shift[0], -30, 30)))
            d = (p - want) * weight
            d_top = d[:, None] * self.out * (top > 0)
            taps = [np.bincount((own[rows, at + k].astype(np.int64) * self.FILTERS + filters).ravel(), d_top.ravel(), self.kernel[k].size).reshape(self.kernel[k].shape) for k in range(WIDTH)]
            gradient = {"out": (d[:, None] * pooled).sum(axis=0), "shift": np.array([d.sum()]), "bias": d_top.sum(axis=0), "kernel": np.stack(taps)}
            for n in self.NAMES:
                first[n] = 0.9 * first[n] + 0.1 * gradient[n]
                second[n] = 0.999 * second[n] + 0.001 * gradient[n] ** 2
                setattr(self, n, getattr(self, n) - rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8))

    def calibrate(self, views: list[np.ndarray], y: np.ndarray, recall: float = RECALL) -> None:
        """By views and their labels, each of the same weight."""
        z = self.logits(*stacked(views))
        self.settle(z, y, np.ones(len(z), dtype=np.int64), np.full(len(z), 1 / len(z)), recall)

    def settle(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, weight: np.ndarray, recall: float = RECALL) -> None:
        """Logistic calibration of logits z, each met n times and of a weight (1 in all), then the threshold: midway, in logits,
        between the lowest of the findings that must be kept for `recall` and the highest other candidate below it.
        """
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.offset, -30, 30)))
            self.scale = max(0.05, self.scale - 0.2 * float(((p - y) * z * weight).sum()) / max(1.0, float((z * z * weight).sum())) - 0.002 * (self.scale - 1))
            self.offset -= 0.5 * float(((p - y) * weight).sum())
        order = np.flatnonzero(y == 1)[np.argsort(z[y == 1], kind="stable")]
        if not len(order):
            self.threshold = 1.0
            return
        counted = np.cumsum(n[order])
        low = z[order[np.searchsorted(counted, int((1 - recall) * counted[-1]), side="right")]]
        below = z[(y == 0) & (z < low)]
        at = (low + below.max()) / 2 if len(below) else low
        self.threshold = float(1 / (1 + np.exp(-np.clip(self.scale * at + self.offset, -30, 30))))


FOUND = "doc_id long, kinds array<int>, starts array<int>, ends array<int>, views array<binary>, claimed array<boolean>"


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of each document: base findings, then candidates (kind 3), with a view for each and what patterns claim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in doc_slices(batches, "text"):
            columns: list[list] = [[] for _ in range(5)]
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                more = candidates(text)
                spans = base + [(3, a, b) for a, b in more]
                claimed = [True] * len(base) + touched(base, more)
                # A base finding is seen at its value: the run of key characters at its end.
                views = []
                for k, a, b in spans:
                    if k == 0:
                        a = b - len(ASSIGN.match(text, a)[2])
                    views.append(view(text, a, b))
                for column, x in zip(columns, ([s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans], views, claimed), strict=True):
                    column.append(x)
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "kinds", "starts", "ends", "views", "claimed"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return picked.mapInArrow(run, FOUND)


def examples(found: DataFrame, seed: int = 42) -> DataFrame:
    """(label, o, view), each distinct view that is an example: other candidates by their most frequent kind (0 to 2), findings (3)."""

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, order, seen = [], [], []
            for kinds, own, claimed in zip(*(batch.column(c).to_pylist() for c in ("kinds", "views", "claimed")), strict=True):
                for k, v, c in zip(kinds, own, claimed, strict=True):
                    if k == 3 and c:
                        continue
                    mixed, most = (0.0, 3) if k < 3 else shape(characters(np.frombuffer(v, np.uint8).reshape(-1, WINDOW)))
                    if mixed <= MIXED:
                        label.append(most)
                        order.append(xxhash.xxh64_intdigest(v, seed) >> 1)
                        seen.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(order, pa.int64()), pa.array(seen, pa.binary())], names=["label", "o", "view"])

    return found.select("kinds", "views", "claimed").mapInArrow(views, "label int, o long, view binary").distinct()


def moved(views: list[np.ndarray], others: list[np.ndarray], r: np.random.Generator) -> list[np.ndarray]:
    """Views with what stands around another candidate, as far as there are others."""
    out = []
    for v in map(characters, views):
        if others:
            other, end = characters(others[r.integers(0, len(others))]), inner_end(v)
            v[:BEFORE] = other[:BEFORE]
            v[end : end + AFTER] = other[inner_end(other) :][:AFTER]
        out.append(windows(v))
    return out


def spelt(views: list[np.ndarray], r: np.random.Generator) -> list[np.ndarray]:
    """Views spelt anew."""
    return [windows(respelt(characters(v), r)) for v in views]


def places(counts: list[int]) -> list[int]:
    """Views of each kind in a batch: the least of those there are, the rest of the batch in proportion to their numbers."""
    least = [m if n else 0 for m, n in zip(LEAST, counts, strict=True)]
    rest = BATCH - sum(LEAST)
    return [m + rest * n // sum(counts) for m, n in zip(least, counts, strict=True)]


def batches_of(kinds: list[list[np.ndarray]], steps: int, r: np.random.Generator) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """Batches that go through each kind's views again and again, in an order drawn anew, until all are used and steps are done.

    A view is shown as it is or without its context, a finding in one of four ways: also moved, and moved and spelt anew.
    """
    size = places([len(k) for k in kinds])
    steps = max([steps, *(-(-len(k) // n) for k, n in zip(kinds, size, strict=True) if n)])
    others = [v for k in kinds[:3] for v in k]
    weight = np.repeat([(0.5 if k == 3 else 0.5 / sum(map(bool, size[:3]))) / n for k, n in enumerate(size) if n], [n for n in size if n])
    want = np.repeat([0.0, 1.0], [sum(size[:3]), size[3]])
    queues: list[list[int]] = [[] for _ in kinds]
    for _ in range(steps):
        views: list[np.ndarray] = []
        for k, n in enumerate(size):
            while len(queues[k]) < n:
                queues[k] += r.permutation(len(kinds[k])).tolist()
            chosen, queues[k] = queues[k][:n], queues[k][n:]
            views += [kinds[k][i] for i in chosen]
        way = np.where(want == 1, r.integers(0, 4, len(views)), r.integers(0, 2, len(views)))
        for i in np.flatnonzero(way > 1):
            views[i] = moved([views[i]], others, r)[0]
            if way[i] == 3:
                views[i] = spelt([views[i]], r)[0]
        yield views, way == 1, want, weight / weight.sum()


def _kinds(table: pa.Table) -> list[list[np.ndarray]]:
    """A part's views by label, in the order of their hashes."""
    table = table.sort_by([("o", "ascending"), ("view", "ascending")])
    out: list[list[np.ndarray]] = [[], [], [], []]
    for k, v in zip(table.column("label").to_pylist(), table.column("view").to_pylist(), strict=True):
        out[k].append(np.frombuffer(v, dtype=np.uint8).reshape(-1, WINDOW))
    return out


def deal(rows: DataFrame, counts: dict[int, int], parts: int, rounds: int) -> DataFrame:
    """(label, o, view, part, round) of all rows; a kind with few views is dealt to several parts and rounds, so that none is without it."""
    cells = parts * rounds
    times = {k: min(cells, -(-SPREAD * cells // n)) for k, n in counts.items() if n}
    copies = F.element_at(F.create_map(*(F.lit(x) for kv in sorted(times.items()) for x in kv)), F.col("label"))
    dealt = rows.select("label", "o", "view", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    cell = F.pmod(F.floor(F.col("o") / HELD) + F.col("copy"), F.lit(cells))
    return dealt.select("label", "o", "view", F.floor(cell / rounds).alias("part"), F.pmod(cell, F.lit(rounds)).alias("round"))


def training(start: np.ndarray, rate: float, steps: int, number: int, seed: int) -> Callable[[pa.Table], pa.Table]:
    """A round of a part: the network that goes on from `start` with the part's views of the round."""

    def trained(table: pa.Table) -> pa.Table:
        own, kinds = CharacterNetwork(seed), _kinds(table)
        own.take(start)
        if any(kinds[:3]) and kinds[3]:
            r = np.random.default_rng([seed, number, table.column("part")[0].as_py()])
            own.train(batches_of(kinds, steps, r), rate)
        return pa.table({"state": pa.array([own.state()], pa.list_(pa.int64()))})

    return trained


def fit(found: DataFrame, seed: int = 42) -> CharacterNetwork | None:
    """Train on all distinct views of examples, base findings against candidates that are no keys, part by part."""
    rows = stash(examples(found, seed))
    held = F.col("o") % HELD == 0
    counted = {r["label"]: r for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(~held).alias("used"), F.sum(F.length("view")).alias("bytes")).collect()}
    if min(sum(r["n"] for k, r in counted.items() if (k == 3) == side) for side in (False, True)) < 8:
        return None
    parts = -(-sum(r["bytes"] for r in counted.values()) // (WINDOW * PART))
    rounds = ROUNDS if parts > 1 else 1
    dealt = deal(rows.where(~held), {k: r["used"] for k, r in counted.items()}, parts, rounds)
    network = CharacterNetwork(seed)
    for number in range(rounds):
        work = training(network.state() / FIXED, 0.005 * (1 - number / rounds), -(-STEPS // rounds), number, seed)
        ends = dealt.where(F.col("round") == number).groupBy("part").applyInArrow(work, "state array<long>")
        sums = ends.select(F.posexplode("state").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n")).collect()
        network.take(np.array([r["x"] / r["n"] / FIXED for r in sorted(sums)]))

    def scored(table: pa.Table) -> pa.Table:
        """Logits of a part's views as they are and bare, findings also moved and spelt anew, counted by label and step."""
        kinds, out = _kinds(table), []
        r, others = np.random.default_rng([seed, table.column("part")[0].as_py()]), [v for k in kinds[:3] for v in k]
        for label, views in enumerate(kinds):
            for at in range(0, len(views), 4096):
                own = views[at : at + 4096]
                ways = [own, [np.where(v < CLASSES, np.uint8(14), v) for v in own]]
                if label == 3:
                    ways += [moved(own, others, r), spelt(moved(own, others, r), r)]
                z = np.concatenate([network.logits(*stacked(w)) for w in ways])
                out += [(label, int(b)) for b in np.floor(z * STEP)]
        return pa.table({"label": pa.array([k for k, _ in out], pa.int32()), "bin": pa.array([b for _, b in out], pa.int64())})

    kept = rows.where(held).select("label", "o", "view", F.pmod(F.floor(F.col("o") / HELD), F.lit(parts)).alias("part"))
    bins = kept.groupBy("part").applyInArrow(scored, "label int, bin long").groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n")).orderBy("label", "bin").collect()
    label, z, n = (np.array(x) for x in ([r["label"] for r in bins], [r["bin"] / STEP for r in bins], [r["n"] for r in bins]))
    there = sorted(set(label.tolist()))
    weight = sum(np.where(label == k, n / n[label == k].sum() * (1.0 if k == 3 else 1 / max(1, sum(x < 3 for x in there))), 0.0) for k in there)
    if len(bins):
        network.settle(z, (label == 3).astype(float), n, weight / weight.sum())
    return network


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = stash(findings(docs, id_col, text_col))
    network = fit(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(spans: list[tuple]) -> str:
            return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))

        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            views = [v for own in batch.column("views").to_pylist() for v in own]
            x = np.frombuffer(b"".join(views), dtype=np.uint8).reshape(-1, WINDOW)
            p = network.probabilities(x, np.array([len(v) // WINDOW for v in views])) if network and views else np.zeros(len(views))
            limit, at = network.threshold if network else 2.0, 0
            for kinds, starts, ends, claimed in zip(*(batch.column(c).to_pylist() for c in ("kinds", "starts", "ends", "claimed")), strict=True):
                spans = [(a, k, b) for a, k, b, c, q in zip(starts, kinds, ends, claimed, p[at : at + len(kinds)], strict=True) if k < 3 or (not c and q >= limit)]
                at += len(kinds)
                base = [s for s in spans if s[1] < 3]
                for column, v in zip(out, (*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.string()) for c in out[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
