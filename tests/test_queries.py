"""Every registered query against its SQL on the small tables."""

import math

import duckdb
import pytest

from procura.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=str)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got and len(cols) > 1  # their rows are held against brute force in test_domain.py
        return
    rel = con.sql(f"SELECT {', '.join(cols)} FROM ({sql})")
    assert got == sorted((tuple(map(plain, r)) for r in rel.fetchall()), key=str)
    wide = {str(t) for t in rel.types}
    assert "HUGEINT" not in wide


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["q_match_score", "q_dup_blocked_candidates", "q_price_statistics", "q_find_duplicates"])
def test_no_nested_loops(spark, sf_dir, name):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'O'").select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,O)" in plan and "o_totalprice" not in plan
