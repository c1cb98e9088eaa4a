"""Named queries over the benchmark tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query function and, where SQL can express it, its counterpart."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def load_all() -> None:
    from . import (  # noqa: F401
        q_classify, q_display, q_files, q_groups, q_incidents, q_io, q_json, q_lines, q_report, q_reuse, q_review, q_search, q_stream,
    )
