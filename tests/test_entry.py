import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(v):
    return round(v, 6) if isinstance(v, float) else v


def own():
    from processgraph.plans import catalogue

    return catalogue


@pytest.mark.parametrize("name", sorted(own().SQL))
def test_query_gives_what_sql_gives(spark, con, name):
    df = own().QUERIES[name](spark, SF)
    want = con.sql(own().SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted(repr(tuple(same(r[c]) for c in cols)) for r in df.collect())
    assert got == sorted(repr(tuple(same(r[i]) for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(own().QUERIES) - set(own().SQL)))
def test_query_runs(spark, name):
    assert own().QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_works_without_the_llm_part():
    code = "import sys; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert e.llm is None and not any(k.startswith('op') for k in e.queries()) and 'pipeline' not in e.queries() and 'forward_cone' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.ROOT)
