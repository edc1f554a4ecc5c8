"""Every query against its SQL."""

import duckdb
import pytest

from turnstone.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    return repr(round(float(value), 6)) if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rel = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in rel.description]
    want = rel.fetchall()
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(canonical(r[c]) for c in sorted(columns)) for r in got.collect())
    order = [columns.index(c) for c in sorted(columns)]
    assert rows == sorted(tuple(canonical(r[i]) for i in order) for r in want)


def test_no_python_on_the_executors(spark):
    for name, q in catalog.QUERIES.items():
        plan = q(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
