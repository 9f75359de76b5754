"""Every query over the driver's tables against the same in DuckDB."""

import duckdb
import pytest

from knotwork import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(tuple, df.astype(object).where(df.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, name):
    assert plain(queries.QUERIES[name](spark, FOLDER).toPandas()) == plain(duck.sql(queries.SQL[name]).df())


def test_scans_are_shared_and_pruned(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = queries.QUERIES["flagship"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2  # placement and order are one scan of orders
    assert "o_totalprice" in plan and "c_name" not in plan and "PushedFilters" in plan
    assert "GreaterThan(o_totalprice,100000.0)" in plan


def test_no_distinct_where_rows_are_unique(spark):
    plan = queries.QUERIES["has_forward"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan


def test_existence_is_a_semi_join(spark):
    from knotwork.session import query
    from knotwork.sources import tables

    df = query(spark, tables.catalog(), tables.store(spark, FOLDER), "match $c isa customer, has c_custkey $k; placement (buyer: $c); select $k;")
    assert "LeftSemi" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_custkey").distinct().count()


def test_profile_has_row_counts(spark):
    from knotwork.session import profile

    nodes = profile(queries.QUERIES["isa_scan"](spark, FOLDER))
    assert any(n["metrics"].get("numOutputRows") == 5 for n in nodes)
