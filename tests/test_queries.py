"""Every query that has SQL gives the rows that DuckDB gives; the others run and have a stable schema."""

import math

import duckdb
import pandas as pd
import pytest
from strayframe.operators import kinematics
from strayframe.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 6) if isinstance(x, float) else x.item() if hasattr(x, "item") else x


def rows_of(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted((tuple(plain(x) for x in r) for r in pdf[columns].itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_the_oracle_s(spark, duck, name):
    assert rows_of(QUERIES[name](spark, FOLDER).toPandas()) == rows_of(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_twice_alike(spark, name):
    first, second = (QUERIES[name](spark, FOLDER) for _ in range(2))
    assert first.schema == second.schema
    assert rows_of(first.toPandas()) == rows_of(second.toPandas())


def broadcast_tables(df):
    """The broadcast exchanges of a plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.mark.parametrize("name", ["role_history", "role_vector", "physics_vector", "e04_relative_agents"])
def test_recordings_are_not_broadcast(spark, name):
    assert broadcast_tables(QUERIES[name](spark, FOLDER)) == 0


def test_boxes_are_not_broadcast(spark):
    assert broadcast_tables(QUERIES["j10_spatial_fallback"](spark, FOLDER)) <= 1  # the levels of cells


def test_points_of_one_height_stay_where_they_are(spark):
    """Nothing is shuffled by band before the edges are met, whatever the points' estimated size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.createDataFrame([(0, 0, 2.0, -1.0, 30.0, 1.0)], "polygon int, segment int, ax double, ay double, bx double, by double")
        points = spark.range(100).selectExpr("id", "cast(id as double) as x", "0.5d as y")
        plan = kinematics.inside(points, edges, "id")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_curve_s_angles_are_computed_once_a_row(spark):
    """The points come of stored controls, so no tangent is part of what is exploded."""
    plan = QUERIES["e17_turn_curve"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "TAN(" in plan.upper()
    assert not [line for line in plan.splitlines() if "Generate" in line and "TAN(" in line.upper()]


@pytest.mark.parametrize("name", ["role_history", "role_vector"])
def test_scenes_are_dealt_once(spark, name):
    """States and agents are put together where their run is: nothing is joined, or dealt again by tick."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 2  # of states, and of those that agents are made of
