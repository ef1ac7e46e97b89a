"""Every query of the catalog against the same in DuckDB."""

import os

import duckdb
import pytest

from codeloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rounded(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    rows = sorted((tuple(rounded(r[c]) for c in sorted(found.columns)) for r in found.collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(found.columns)
    at = [names.index(c) for c in sorted(names)]
    assert rows == sorted((tuple(rounded(r[i]) for i in at) for r in result.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10


def test_limits_reach_the_plan(spark):
    plan = catalog.QUERIES["search_two_column"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan or "GlobalLimit" in plan


def test_prefix_is_pushed_to_the_scan(spark):
    from codeloom.operators.store import get_by_directory

    rows = get_by_directory(spark.read.parquet(f"{SF}/documents.parquet"), "src3", "source")
    assert "StringStartsWith(source,src3/)" in rows._jdf.queryExecution().toString()


def test_symbol_rows_pass_no_table_through_the_driver(spark, monkeypatch):
    from codeloom.operators import index

    plans = []
    monkeypatch.setattr(index, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    plans.append(catalog.QUERIES["index_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
