"""Named queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def stamp(c: Column | str) -> Column:
    """Timestamps leave a query as text, so both engines print the same characters."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def load_all() -> None:
    from . import queries_alerts, queries_logs, queries_reports, queries_retrieval, queries_state, queries_streams, queries_tail  # noqa: F401
