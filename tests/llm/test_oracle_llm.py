"""Queries with SQL give the rows that DuckDB gives; the others run and keep their schema."""

import duckdb
import pytest

from tierlabel.llm.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for name in ("documents", "pages", "conversations", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.sql(ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def normal(table):
        table = table[columns].astype(object).where(table[columns].notna(), None)
        return sorted(repr([int(v) if isinstance(v, float) and v.is_integer() else v for v in r]) for r in table.itertuples(index=False))

    assert normal(got) == normal(want)


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
