"""Each registered query outside the training-data operators against its SQL in DuckDB.

The SQL of page_text and page_scores has the container tier only; all articles of these pages are long enough for
it. test_archive.py and test_lifecycle.py hold the other tiers.
"""

import duckdb
import pytest

import __spark_entry__
from quillstack.plans.registry import ALL

SF = "/root/testdata/sf0.01"
TABLES = "documents labels pages events conversations orders".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value if value is None else str(value)


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if sql])
def test_query_equals_its_sql(spark, db, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = db.execute(ALL[name][1])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want
