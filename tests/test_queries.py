"""Registered queries against their SQL, and the shape of their plans."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from oddsloom.operators.asof import WINDOWS
from oddsloom.plans.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="benchmark tables not present")
SAMPLE = (
    "asof_player_form", "streak_features", "walk_forward_metrics", "poisson_totals",
    "settled_quotes", "implied_probability", "corridor_lookup", "quote_corridors", "signal_filter_reasons",
    "drawdown_streaks", "market_backtest", "event_matching", "name_resolution", "json_ingest",
    "rejection_ledger", "baseline_probabilities", "temporal_guards", "payload_dedup_stream", "alert_dedup", "live_signals", "audit_orphans", "latest_quote_stream",
)


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value + 0.0 if isinstance(value, float) else value


def shaped(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, db, name):
    frame = QUERIES[name](spark, SMALL)
    cursor = db.execute(ORACLES[name])
    columns = [item[0] for item in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert shaped(frame.columns, frame.collect()) == shaped(columns, cursor.fetchall())


@needs_data
@pytest.mark.parametrize("name", ["asof_scoped_form", "asof_team_form"])
def test_every_window_in_every_scope(spark, db, name):
    test_query_equals_its_sql(spark, db, name)
    assert {row.last_n for row in QUERIES[name](spark, SMALL).select("last_n").distinct().collect()} == {*WINDOWS, 0}


@needs_data
def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


@needs_data
def test_partitioning_does_not_change_results(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for count in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", count)
        results.append(
            [shaped(f.columns, f.collect()) for f in (QUERIES[n](spark, SMALL) for n in ("asof_h2h_form", "corridors"))]
        )
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


@needs_data
def test_scans_read_only_the_columns_they_need(spark):
    plan = QUERIES["corridors"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_extendedprice" not in plan and "o_totalprice" not in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_rounded_is_round(spark):
    from pyspark.sql import functions as F

    from oddsloom.plans.form import rounded

    odd = [float("nan"), float("inf"), None, 0.0, -0.0, -1e-9, 1e300, 0.0015625, -0.0015625, 0.0078125, 5e-7, -5e-7, 1000000.1234565]
    values = odd + [i / n for n in (3, 7, 64, 128, 640) for i in range(-40, 40)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (6, 9):
        plan = rounded(df, places)
        assert [str(r.x) for r in plan.collect()] == [str(r.x) for r in df.select(F.round("x", places).alias("x")).collect()]
        assert "FLOOR" in plan._jdf.queryExecution().optimizedPlan().toString()
