"""The base columns of the operators against their DuckDB forms."""

import duckdb
import pytest

from inkveil.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_base_columns(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(map(str, got.select(*order).toPandas().itertuples(index=False, name=None))) == sorted(map(str, want.df()[order].itertuples(index=False, name=None)))
