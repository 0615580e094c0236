"""Sessions: which stay, which have expired, which questions are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(sessions: DataFrame, n: int = 5, demo: str = "demo") -> DataFrame:
    """The n newest sessions and the demo session; a top-n, not a window over all rows."""
    kept = sessions.where(F.col("session_id") != demo).orderBy(F.col("mtime").desc(), "session_id").limit(n)
    return kept.unionByName(sessions.where(F.col("session_id") == demo))


def expired(scopes: DataFrame, kept: DataFrame) -> DataFrame:
    """(scope) of what is indexed but no longer among the kept sessions; sources.index.drop_scopes takes these out."""
    return scopes.select("scope").distinct().join(kept.select(F.col("session_id").alias("scope")), "scope", "left_anti")


def unknown(questions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Questions whose session isn't there."""
    return questions.join(sessions.select("session_id").distinct(), "session_id", "left_anti")
