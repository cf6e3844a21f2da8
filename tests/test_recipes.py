"""Recipes stay linear, report unfit steps only, and samples ignore partitioning."""

import pytest
from pyspark.sql import functions as F

from tablewright import detect_anomalies, forecast_series, operation_record, replay_recipe, search_all
from tablewright.functions.columns import plan_bytes
from tablewright.operators.sampling import sample_rows


def outlier_steps(count):
    return [operation_record("outliers", f"Step {k}", {"column": "x", "method": "Remove rows", "factor": 3.0 + k}) for k in range(count)]


def plan_length(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_plans_grow_linearly(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 17 as double) x")
    lengths = [plan_length(replay_recipe(df, outlier_steps(n))[0]) for n in (2, 4, 8)]
    assert lengths[2] - lengths[1] <= 3 * (lengths[1] - lengths[0]) + 500 and lengths[2] < 10_000


def test_a_failed_job_surfaces(spark):
    df = spark.range(10).select(F.raise_error("storage is gone").cast("double").alias("x"))
    with pytest.raises(Exception, match="storage is gone"):
        replay_recipe(df, [operation_record("missing", "Fill", {"column": "x", "method": "Median"})])


def test_a_pattern_that_spark_does_not_know_is_reported(spark):
    df = spark.createDataFrame([("a1",), ("b",)], "t string")
    table, reports = replay_recipe(df, [operation_record("filter", "Odd", {"column": "t", "operator": "contains", "value": "(?P<a>1)"})])
    assert table.count() == 2 and reports[0].startswith("Odd:")
    with pytest.raises(ValueError, match="search pattern"):
        search_all(df, "(?P<a>1)")


def test_expanding_plans_have_no_size_estimate(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert plan_bytes(df) is not None
    assert plan_bytes(df.select(F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("b"))) is None


def test_samples_and_flags_do_not_depend_on_partitions(spark):
    df = spark.range(400).selectExpr("cast(id * id % 101 as double) a", "cast(id % 7 as double) b", "cast(id as string) c").cache()
    samples = {frozenset(map(tuple, sample_rows(df.repartition(n), 40).collect())) for n in (1, 5, 13)}
    assert len(samples) == 1
    flags = [frozenset(r.c for r in detect_anomalies(df.repartition(n), ["a", "b"]).where("anomaly").collect()) for n in (1, 13)]
    assert flags[0] == flags[1]


def test_a_short_series_does_not_stop_the_others(spark):
    days = [("long", f"2024-01-{d:02}", float(d)) for d in range(1, 15)] + [("short", "2024-01-01", 1.0)]
    df = spark.createDataFrame(days, "s string, d string, v double").withColumn("d", F.to_date("d"))
    found = {r.s: r for r in forecast_series(df, "d", "v", 1, "Day", ["s"])[1].collect()}
    assert found["long"].forecast == pytest.approx(15, abs=2) and found["short"].forecast is None
