"""Operators 11 to 13 against their SQL."""

import duckdb
import oracle
import pytest
from conftest import SF

import tessella.llm.queries as Q


@pytest.mark.parametrize("name", ["op11_divergence", "op12_dominance", "op13_substring_dedup"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "sales"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    oracle.compare(spark, con, Q.queries()[name], Q.oracle_sql()[name], SF)
