"""Registered queries beside their SQL on the smallest tables.

A spread of queries runs by default; ``ALL_ORACLES=1`` runs every one. ``tools/check_oracles.py``
does the same at any scale.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, compare

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "top_important_groups", "policy_decisions", "scrubbed_lines", "framed_traces", "byte_limited_lines",
    "evidence_dossiers", "adaptive_reuse", "admitted_calls", "notification_outbox", "review_overlay",
    "relevance_page", "context_in_lines", "display_groups", "reviewed_templates", "streamed_incidents",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("ALL_ORACLES") else SAMPLE)
def test_query_matches_sql(spark, con, name):
    verdict, _ = compare(spark, con, name, SF)
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
