"""The queries beside their SQL on the smallest tables."""

import duckdb
import pytest

from logsluice.llm.queries import ORACLES
from tools.check_oracles import TABLES, compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    verdict, _ = compare(spark, con, name, sf)
    assert verdict.startswith("ok"), verdict
