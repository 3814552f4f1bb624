"""Every registered query with SQL gives the rows that DuckDB gives for that SQL."""

import duckdb
import pytest

from tierlabel.plans.catalog import ORACLE, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


# The SQL takes the held-out classes as rightly predicted, which needs training rows of every class.
LARGER = {"v15_train_and_test"}


@pytest.fixture(scope="module")
def ducks(small):
    connections = {}
    for folder in (small, small.replace("sf0.001", "sf0.01")):
        connections[folder] = duckdb.connect()
        for name in TABLES:
            connections[folder].execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    yield connections
    for c in connections.values():
        c.close()


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, small, ducks, name):
    folder = small.replace("sf0.001", "sf0.01") if name in LARGER else small
    got = QUERIES[name](spark, folder).toArrow()
    want = ducks[folder].sql(ORACLE[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)

    def normal(table):
        return sorted(tuple(repr(v) for v in r) for r in zip(*[table[c].to_pylist() for c in columns]))

    assert normal(got) == normal(want)
