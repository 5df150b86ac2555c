import importlib

import duckdb
import pytest

import __spark_entry__ as entry

SQL = sorted(set(entry.oracle_sql()) & set(entry.queries()))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings source_files chunks parsed_chunks change_event eval_items mix_targets".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SQL)
def test_query_says_the_same_as_sql(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    expected = sorted((tuple(plain(r[order.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == expected


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_other_queries_run(spark, small, name):
    assert entry.queries()[name](spark, small).count() >= 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
    importlib.reload(entry)
