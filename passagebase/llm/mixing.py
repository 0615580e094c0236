"""Mixing sources to target weights by min-cost flow.

Documents are first added up by membership pattern (the set of sources a document belongs to): a small table, whatever
the number of documents. Token capacity then flows from patterns to source quotas. Reading a pattern once is cheap, each
further pass dearer (convex costs), so repetition spreads evenly before anything is read again. The flow of a pattern is
turned into whole passes over all its documents plus a remainder, which goes to documents in a seeded order: a threshold
on the seeded hash is found from a histogram and one bucket, and every row then decides for itself.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, ordered last; an empty table
gives an empty result; rows that agree in doc_id and text share the remainder at the threshold evenly; the one document
at the threshold may be taken in part; extra columns are ignored by `mix` and kept by `repeat_rows`.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagebase.llm.common import stash

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Patterns that the driver will route (100,000 take seconds); more than this is an error, not a silent cut.
MAX_PATTERNS = 2_000_000


def repeating_weights(sources: list, weights: tuple = WEIGHTS) -> dict:
    """Weights for sources ordered by code point, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: weights[i % len(weights)] for i, s in enumerate(ordered)}


def targets(sizes: dict, weights: dict, share: float = 1.5, cap: float = 2.0) -> dict:
    """Split share * total size by weight; what exceeds cap * size of a source is shared again among the others."""
    left, out, active = share * sum(sizes.values()), {}, sorted(sizes, key=lambda s: (s is None, s or ""))
    while active:
        total = sum(weights[s] for s in active)
        over = [s for s in active if left * weights[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / total for s in active}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        active = [s for s in active if s not in out]
    return out


def route(capacity: dict[tuple, int], quotas: dict, cap: float = 2.0) -> dict[tuple, dict]:
    """Min-cost flow of tokens: {pattern: {source: tokens}}.

    A pattern offers its size once at cost 1, a second time at cost 3, a third at cost 5 ..., up to cap passes. Costs lie on
    what patterns offer, not on where it goes, so passes are routed one after the other, each as far as it will go:
    augmenting paths from pattern to pattern, over the sources alone. Of a path's step from source s to t only some pattern
    matters that sends tokens to s and is a member of t; these are kept by pair. A pattern that no path leads from has none
    later either, so each is worked off once a pass.
    """
    left = {s: int(n) for s, n in quotas.items()}
    flow: dict[tuple, dict] = {p: dict.fromkeys(p, 0) for p in capacity}
    senders: dict[tuple, dict[tuple, None]] = {(s, t): {} for s in quotas for t in quotas if s != t}
    linked: dict = {s: set() for s in quotas}

    def send(p: tuple, s, amount: int) -> None:
        was, now = flow[p][s], flow[p][s] + amount
        flow[p][s] = now
        if (was > 0) == (now > 0):
            return
        for t in p:
            if t == s:
                continue
            if now > 0:
                senders[s, t][p] = None
                linked[s].add(t)
            else:
                del senders[s, t][p]
                if not senders[s, t]:
                    linked[s].discard(t)

    def path(p: tuple) -> list | None:
        """Sources from one of p to one with room, by breadth first."""
        come, queue = dict.fromkeys(p), deque(p)
        while queue:
            s = queue.popleft()
            if left[s] > 0:
                steps = [s]
                while come[steps[-1]] is not None:
                    steps.append(come[steps[-1]])
                return steps[::-1]
            for t in linked[s]:
                if t not in come:
                    come[t] = s
                    queue.append(t)
        return None

    for k in range(int(-(-cap // 1))):
        for p, n in capacity.items():
            room = int(n * min(1.0, cap - k))
            while room > 0 and (steps := path(p)):
                via = [next(iter(senders[s, t])) for s, t in zip(steps, steps[1:], strict=False)]
                amount = min([room, left[steps[-1]], *(flow[q][s] for q, s in zip(via, steps, strict=False))])
                for q, s, t in zip(via, steps, steps[1:], strict=False):
                    send(q, s, -amount)
                    send(q, t, amount)
                send(p, steps[0], amount)
                left[steps[-1]] -= amount
                room -= amount
    return flow


def _rows(docs: DataFrame, id_col: str, text_col: str, members: Column, seed: int) -> DataFrame:
    """doc_id, size, pattern and seeded order of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.xxhash64(F.lit(seed), F.col(id_col), text).bitwiseAND(F.lit((1 << 63) - 1))
    pattern = F.to_json(F.array_sort(F.array_distinct(members)))
    return docs.select(F.col(id_col).alias("doc_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), pattern.alias("pattern"), order.alias("order"))


def plan(rows: DataFrame, share: float, cap: float, weigh: Callable[[list], dict]) -> DataFrame:
    """One row a pattern: passes, the order at which the remainder ends, words left for that place, and source figures."""
    spark = rows.sparkSession
    found = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    sizes_of = {r["pattern"]: int(r["size"] or 0) for r in found}
    names = {p: tuple(json.loads(p)) for p in sizes_of}
    source_size: dict = {}
    for p, members in names.items():
        for s in members:
            source_size[s] = source_size.get(s, 0) + sizes_of[p]
    goal = targets(source_size, weigh(list(source_size)), share, cap)
    flow = route({names[p]: n for p, n in sizes_of.items()}, goal, cap)
    passes, rest = {}, {}
    for p, n in sizes_of.items():
        passes[p], rest[p] = divmod(sum(flow[names[p]].values()), n) if n else (0, 0)
    need = spark.createDataFrame([(p, int(r)) for p, r in rest.items() if r > 0], "pattern string, need long")
    width = F.shiftright("order", 51)
    by_bucket = rows.groupBy("pattern", width.alias("bucket")).agg(F.sum("size").alias("size"))
    upto = W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    cut = by_bucket.withColumn("upto", F.sum("size").over(upto)).join(F.broadcast(need), "pattern").where("upto >= need and upto - size < need")
    cut = cut.select("pattern", "bucket", (F.col("need") - F.col("upto") + F.col("size")).alias("need"))
    cut = spark.createDataFrame([tuple(r) for r in cut.collect()], "pattern string, bucket long, need long")  # one row a pattern
    last = rows.withColumn("bucket", width).join(F.broadcast(cut), ["pattern", "bucket"]).groupBy("pattern", "order", "need").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("alike"))
    by_order = W.partitionBy("pattern").orderBy("order").rowsBetween(W.unboundedPreceding, 0)
    last = last.withColumn("upto", F.sum("size").over(by_order)).where("upto >= need and upto - size < need")
    ends = {r["pattern"]: (r["order"], (r["need"] - r["upto"] + r["size"]) // r["alike"]) for r in last.collect()}
    single = {p: names[p][0] for p in names if len(names[p]) == 1}
    figures = [(p, int(passes[p]), *ends.get(p, (-1, 0)), source_size[single[p]] if p in single else None, float(goal[single[p]]) if p in single else None) for p in sizes_of]
    return spark.createDataFrame(figures, "pattern string, passes long, end_order long, part long, source_size long, target double")


def _taken(rows: DataFrame, planned: DataFrame) -> DataFrame:
    at = F.when(F.col("order") < F.col("end_order"), F.col("size")).when(F.col("order") == F.col("end_order"), F.col("part")).otherwise(F.lit(0))
    return rows.join(F.broadcast(planned), "pattern").withColumn("taken", F.col("passes") * F.col("size") + at)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, cap: float = 2.0, seed: int = 42, weigh: Callable[[list], dict] = repeating_weights) -> DataFrame:
    """doc_id, size, source_size, target, taken for documents with one source each or an array of overlapping sources.

    With overlapping sources, source_size and target are null for documents of several sources.
    """
    members = F.col(source_col) if docs.schema[source_col].dataType.typeName() == "array" else F.array(source_col)
    rows = stash(_rows(docs, id_col, text_col, members, seed))
    return _taken(rows, plan(rows, share, cap, weigh)).select("doc_id", "size", "source_size", "target", "taken")


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, cap: float = 2.0, seed: int = 42, weigh: Callable[[list], dict] = repeating_weights) -> DataFrame:
    """The mixture itself: each document's row as many times as it is passed over, whole documents, columns as they were.

    The document at the threshold counts if at least half of it is taken; documents without words pass once.
    """
    rows = stash(_rows(docs, id_col, text_col, F.array(source_col), seed))
    planned = plan(rows, share, cap, weigh).select("pattern", "passes", "end_order", F.col("part"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.xxhash64(F.lit(seed), F.col(id_col), text).bitwiseAND(F.lit((1 << 63) - 1))
    kept = docs.columns
    marked = docs.withColumn("__row", F.struct(*kept)).select("__row", F.to_json(F.array(source_col)).alias("pattern"), order.alias("order"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    times = F.col("passes") + F.when(F.col("order") < F.col("end_order"), 1).when((F.col("order") == F.col("end_order")) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    times = F.when(F.col("size") == 0, 1).otherwise(times).cast("int")
    out = marked.join(F.broadcast(planned), "pattern").withColumn("__times", times).where("__times > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__pass")).select("__row.*")
