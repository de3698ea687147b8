"""Every registered contract query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablepact.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def rows_of(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(str(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data, duck, name):
    got = entry.queries()[name](spark, data)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of([tuple(r) for r in got.collect()], got.columns) == rows_of(want.fetchall(), want.columns)


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "l_orderkey"


def test_filters_reach_the_scan(spark, data):
    plan = QUERIES["validate_lineitem_filter"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan.replace(" ", "") or "PushedFilters" in plan
    assert "l_comment" not in plan and "Exchange" not in plan and "Python" not in plan


def test_stream_filter_leaves_rows_in_files(spark, data):
    got = QUERIES["stream_filter"](spark, data)
    assert got.inputFiles() and "MemoryPlan" not in got._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("n", [0, 5000])
def test_stream_filter_of_a_folder_of_files(spark, data, tmp_path, n):
    events = spark.read.parquet(f"{data}/events.parquet").limit(n).withColumn("user_id", F.col("user_id") + 95)  # this small, no user_id passes
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(3).write.parquet(f"{tmp_path}/orders.parquet")
    want = spark.read.parquet(f"{tmp_path}/events.parquet").filter("value > 20 AND user_id >= 100").select("event_id", "user_id", "value")
    got = QUERIES["stream_filter"](spark, str(tmp_path))
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert bool(n) == bool(got.head(1))
