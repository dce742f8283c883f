from pathlib import Path

import duckdb
import pytest

from passagelake.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, name):
    got = catalogue.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    connection = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    expected = connection.sql(catalogue.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    rows = expected.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rows))
