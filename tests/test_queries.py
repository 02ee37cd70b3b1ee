"""Every query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from tessera.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, duck, data):
    got, want = QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


def test_places_in_many_partitions(spark, tmp_path):
    """Of more rows than the borders of a range shuffle are sampled from."""
    n = 20_000
    rows = spark.range(n).selectExpr("id AS c_custkey", "CAST(id * 7919 % 25 AS INT) AS c_nationkey")
    rows.repartition(4).write.parquet(str(tmp_path / "customer.parquet"))
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(x) for x in names]
    try:
        for name, value in zip(names, ("false", "16")):
            spark.conf.set(name, value)
        got = [tuple(r) for r in QUERIES["sort_order_check"](spark, str(tmp_path)).select("pos", "c_custkey").collect()]
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    want = sorted(range(n), key=lambda i: (i * 7919 % 25, i))
    assert sorted(got) == list(zip(range(1, n + 1), want))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 19
    assert set(e.oracle_sql()) <= set(e.queries())
