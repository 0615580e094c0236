"""All queries of the library's own jobs, and the SQL they are held against."""

from passagebase.jobs import answer, prepare, rank, sessions, train  # noqa: F401
from passagebase.jobs.base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
