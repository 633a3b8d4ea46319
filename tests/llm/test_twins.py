"""Text queries against their SQL twins."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import normal
from fellwalk.llm.queries import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert normal(entry.queries()[name](spark, SF).toPandas()) == normal(con.sql(ORACLES[name]).df())
