import numpy as np
import pandas as pd
import pytest
from comparing import rows
from pyspark.sql import functions as F

from tablewright import group_summary, join_tables, melt, pivot_table, resample
from tablewright.operators import grouping as G, joining
from tablewright.operators.quantiles import quantile_table
from tablewright.operators.sampling import evidence_sample, sample_rows


def test_joins(spark):
    left = spark.createDataFrame([(1, 10), (2, 20)], "id long, value long")
    right = spark.createDataFrame([(2, 200), (3, 300)], "key long, value long")
    for how, n in [("inner", 1), ("left", 2), ("right", 2), ("outer", 3)]:
        for limit in (None, 0):
            result = join_tables(left, right, "id", "key", how, limit)
            assert result.count() == n
            assert result.columns == ["id", "value", "key", "value_joined"]
    with pytest.raises(ValueError):
        join_tables(left, right, "missing", "key", "inner")
    with pytest.raises(ValueError):
        join_tables(left, right, "id", "key", "cross")
    with pytest.raises(ValueError):
        join_tables(left.withColumn("value_joined", F.lit(1)), right, "id", "key", "inner")
    with pytest.raises(ValueError):
        join_tables(left, right.withColumn("key", F.col("key").cast("string")), "id", "key", "inner")


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_joins_agree_with_pandas(spark, how, limit):
    a = pd.DataFrame({"k": [1.0, 2.0, 2.0, None, 7.0], "v": [1, 2, 3, 4, 5]})
    b = pd.DataFrame({"k": [2.0, None, None, 9.0], "v": [10, 20, 30, 40], "w": list("abcd")})
    expected = a.merge(b, how=how, on="k", suffixes=("", "_joined"))
    result = join_tables(
        spark.createDataFrame(a.replace({np.nan: None}), "k double, v long"),
        spark.createDataFrame(b.replace({np.nan: None}), "k double, v long, w string"), "k", "k", how, limit,
    )
    assert result.columns == list(expected.columns)
    clean = expected.astype(object).where(expected.notna(), None)
    assert rows(result) == sorted((tuple(r) for r in clean.itertuples(index=False)), key=repr) or {
        tuple(map(str, r)) for r in rows(result)
    } == {tuple("None" if x is None else str(int(x)) if i in (1, 2) else str(x) for i, x in enumerate(r))
          for r in clean.itertuples(index=False)}


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_hot_keys_are_joined_by_many_tasks(spark, monkeypatch, how, limit):
    monkeypatch.setattr(joining, "PIECE_ROWS", 20, raising=False)
    # Missing keys with whole copies among them, a hot key with one row opposite, zeros of both signs, single keys.
    a = [(None, i // 100) for i in range(300)] + [(5.0, i) for i in range(900)] + [(-0.0, 1), (0.0, 2), (float("nan"), 3), (8.0, 4)]
    b = [(None, i // 2) for i in range(300)] + [(5, 7), (0, 8), (9, 9)]
    left = spark.createDataFrame(a, "k double, v long").withColumn("m", F.create_map(F.lit("x"), "v"))
    result = join_tables(left, spark.createDataFrame(b, "id long, w long"), "k", "id", how, limit)
    shown = result.select("k", "v", F.col("m")["x"], "id", "w")
    expected = [(None if k != k else k, v, v, i, w) for k, v in a for i, w in b if k == i or (k is None or k != k) and i is None]
    expected += [(8.0, 4, 4, None, None)] if how in ("left", "outer") else []
    expected += [(None, None, None, 9, 9)] if how in ("right", "outer") else []
    found = [(None if r[0] is not None and r[0] != r[0] else r[0], *r[1:]) for r in shown.collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    tasks = result.filter("id IS NULL AND k IS NULL OR isnan(k)").groupBy(F.spark_partition_id()).count()
    assert tasks.agg(F.max("count")).first()[0] < 301 * 300 / 4


def test_group(frame):
    assert rows(group_summary(frame, ["group"], ["cost"], "sum")) == [("A", 200.0), ("B", 290.0)]
    by_region = dict(rows(group_summary(frame, ["region"], ["revenue"], "count")))
    assert by_region == {"West": 2, "East": 1, "North": 1, None: 1}
    with pytest.raises(ValueError):
        group_summary(frame, ["group"], ["group"], "sum")
    with pytest.raises(ValueError):
        group_summary(frame, ["group"], ["cost"], "first")


@pytest.mark.parametrize("small", [None, 0])
def test_group_without_values(spark, small):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", 3.0), (None, 5.0)], "g string, v double")
    expected = {"sum": 0.0, "mean": None, "median": None, "min": None, "max": None, "count": 0}
    for aggregation, empty in expected.items():
        result = dict(rows(group_summary(df, ["g"], ["v"], aggregation, small)))
        assert result["a"] == empty and set(result) == {"a", "b", None}


def test_pivot(frame):
    result = pivot_table(frame, ["group"], "region", "cost", "sum").orderBy("group")
    assert result.columns == ["group", "East", "North", "West"]
    assert [tuple(r) for r in result.collect()] == [("A", 80.0, 0.0, 120.0), ("B", 90.0, 130.0, 0.0)]
    assert rows(pivot_table(frame, "group", "region", "cost", "sum", pivot_values=["West"]))[0] == ("A", 120.0)
    many = pivot_table(frame, ["group"], "region", ["cost", "revenue"], "median")
    assert many.columns[1:] == ["cost_East", "cost_North", "cost_West", "revenue_East", "revenue_North", "revenue_West"]


def test_pivot_drops_empty_groups_except_for_sum_and_count(spark):
    df = spark.createDataFrame([("a", "x", None), ("b", "x", 1.0), ("b", "y", None), (None, "x", 2.0)],
                               "i string, c string, v double")
    assert rows(pivot_table(df, "i", "c", "v", "sum")) == [("a", 0.0, 0.0), ("b", 1.0, 0.0)]
    assert rows(pivot_table(df, "i", "c", "v", "mean")) == [("b", 1.0)]


def test_melt(frame):
    result = melt(frame, ["group"], ["revenue", "cost"], "metric", "amount")
    assert result.count() == 12 and result.filter("amount is null").count() == 1
    assert melt(frame, [], ["region", "cost"]).schema["value"].dataType.typeName() == "string"
    for arguments in [(["cost"], ["cost"]), (["group"], []), (["group"], ["cost"], "x", "x")]:
        with pytest.raises(ValueError):
            melt(frame, *arguments)


@pytest.mark.parametrize("keys", [[], ["g"], ["g", "h"]])
def test_quantiles_by_cell_counts_agree_with_numpy(spark, keys):
    rng = np.random.default_rng(7)
    n = 4000
    pdf = pd.DataFrame({
        "g": rng.choice(["hot", "a", "b"], n, p=[.9, .05, .05]),
        "h": rng.integers(0, 3, n),
        "x": np.exp(rng.normal(0, 8, n)) * rng.choice([-1, 1], n),
        "y": np.where(rng.random(n) < .4, 0.0, np.round(rng.normal(0, 2, n), 1)),
        "z": rng.integers(-5, 5, n) * 1e300,
    })
    df = spark.createDataFrame(pdf)
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    measures = ["x", "y", "z"]
    fast = quantile_table(df, keys, measures, probabilities)
    wide = quantile_table(df, keys, measures, probabilities, 0)
    mixed = quantile_table(df, keys, measures, probabilities, 500)
    assert keys or "percentile" not in wide._jdf.queryExecution().optimizedPlan().toString()
    grouped = pdf.groupby(keys) if keys else [((), pdf)]
    expected = {k if isinstance(k, tuple) else (k,): {m: np.quantile(p[m], probabilities) for m in measures} for k, p in grouped}
    for table in (fast, wide, mixed):
        found = {tuple(r[k] for k in keys): r for r in table.collect()}
        assert set(found) == set(expected)
        for key, r in found.items():
            for m in measures:
                assert np.allclose(r[m], expected[key][m], rtol=1e-12, atol=0), (key, m)


def test_many_groups_take_the_shuffled_plans(spark, monkeypatch):
    from tablewright.operators import charts, quantiles

    rng = np.random.default_rng(11)
    n = 3000
    pdf = pd.DataFrame({
        "g": rng.choice(["hot", "a", "b", None], n, p=[.8, .1, .05, .05]),
        "x": np.where(rng.random(n) < .4, 7.5, np.round(rng.normal(0, 50, n), 2)),
    })
    df = spark.createDataFrame([(g, x) for g, x in zip(pdf["g"], pdf["x"].tolist())], "g string, x double")
    expected = {
        "quantiles": rows(quantile_table(df, ["g"], ["x"], [.25, .5, .9])),
        "box": rows(charts.box_table(df, "x", "g")),
        "outliers": rows(charts.box_outliers(df, "x", "g")),
        "share": rows(G.share_of_total(df, "g", "x").select("g", "x", F.round("Share", 9))),
    }
    monkeypatch.setattr(quantiles, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(quantiles, "SMALL_INPUT_BYTES", 0)
    monkeypatch.setattr(quantiles, "GROUP_ROWS", 1000)
    # The one large group is broadcast.
    assert rows(quantile_table(df, ["g"], ["x"], [.25, .5, .9])) == expected["quantiles"]
    monkeypatch.setattr(quantiles, "BROADCAST_GROUPS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(quantile_table(df, ["g"], ["x"], [.25, .5, .9])) == expected["quantiles"]
        assert rows(charts.box_table(df, "x", "g")) == expected["box"]
        assert rows(charts.box_outliers(df, "x", "g")) == expected["outliers"]
        assert rows(G.share_of_total(df, "g", "x").select("g", "x", F.round("Share", 9))) == expected["share"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quantiles_edge_cases(spark):
    df = spark.createDataFrame([("a", float("inf")), ("a", 1.0), ("a", float("nan")), ("b", None), (None, 2.0), (None, -0.0)],
                               "g string, v double")
    for small in (None, 0):
        found = {r["g"]: r["v"] for r in quantile_table(df, ["g"], ["v"], [0.0, 0.5], small).collect()}
        assert found["a"][0] == 1.0 and found["a"][1] == float("inf")
        assert found["b"] is None and found[None] == [0.0, 1.0]


def test_value_counts_describe_share(frame):
    counts = rows(G.value_counts(frame, ["region", "group"]))
    assert ("group", "A", 3) in counts and ("region", "West", 2) in counts and len(counts) == 5
    described = {r["field"]: r for r in G.describe(frame).collect()}
    assert described["revenue"]["count"] == 5 and described["revenue"]["50%"] == 160.0
    shares = G.share_of_total(frame, "group", "cost").groupBy("group").agg(F.sum("Share").alias("s"))
    assert all(abs(r["s"] - 100) < 1e-9 for r in shares.collect())
    zero = G.share_of_total(frame.withColumn("cost", F.lit(0.0)), "group", "cost")
    assert zero.filter("Share is not null").count() == 0


def test_value_counts_of_long_texts(spark):
    data = ["x" * 100 + str(i % 7) for i in range(50)] + ["short"] * 9 + ["y" * 65]
    df = spark.createDataFrame([(v,) for v in data], "t string")
    found = {r["value"]: r["count"] for r in G.value_counts(df, ["t"], 3).collect()}
    assert found == {"short": 9, "x" * 100 + "0": 8, **{v: 7 for v in found if v.endswith(tuple("123456"))}}
    assert len(found) == 3


def test_value_counts_limit_rows_before_the_shuffle(frame):
    plan = G.value_counts(frame, ["region"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_top_categories(frame):
    assert rows(G.top_categories(frame, "region", "cost", 2).select("region").distinct()) == [("East",), ("North",)]


def test_sample_is_exact_and_independent_of_partitioning(spark):
    df = spark.range(20_000).withColumn("v", F.col("id") % 7)
    taken = rows(sample_rows(df, 300, "id"))
    assert len(taken) == 300
    assert rows(sample_rows(df.repartition(13), 300, "id")) == taken
    assert rows(sample_rows(df, 300, "id", seed=1)) != taken
    assert sample_rows(df, 30_000, "id").count() == 20_000
    # A key that does not identify rows: the cut-off alone would keep too few.
    assert sample_rows(df, 300, "v").count() == 300
    assert sample_rows(df, 300).count() == 300
    assert rows(sample_rows(df, 300)) == rows(sample_rows(df, 300))


def test_evidence(spark):
    df = spark.range(400)
    sample, scope = evidence_sample(df, key="id")
    assert sample.count() == 300 and scope == "300 of 400 rows, drawn reproducibly"
    assert evidence_sample(spark.range(20))[1] == "the whole table of 20 rows"


RULES = {"Day": "D", "Week": "W", "Month": "ME", "Quarter": "QE", "Year": "YE"}


@pytest.mark.parametrize(
    "frequency, aggregation",
    [(f, "sum") for f in RULES] + [("Day", "mean"), ("Week", "median"), ("Month", "min"), ("Quarter", "max"), ("Month", "count")],
)
def test_resample_agrees_with_pandas(spark, frequency, aggregation):
    rng = np.random.default_rng(3)
    stamps = pd.Timestamp("2022-11-29") + pd.to_timedelta(np.sort(rng.integers(0, 600 * 24, 40)), unit="h")
    pdf = pd.DataFrame({"t": stamps, "v": np.round(rng.normal(10, 3, 40), 2)})
    expected = pdf.set_index("t")["v"].resample(RULES[frequency]).agg(aggregation)
    data = [(t.to_pydatetime(), v) for t, v in zip(pdf["t"], pdf["v"])] + [(None, 1.0), (stamps[3].to_pydatetime(), None)]
    df = spark.createDataFrame(data, "t timestamp_ntz, v double")
    found = resample(df, "t", "v", frequency, aggregation).orderBy("t").collect()
    assert [r["t"] for r in found] == [t.date() for t in expected.index]
    for r, e in zip(found, expected):
        assert (r["v"] is None and np.isnan(e)) or r["v"] == pytest.approx(e)


def test_resample_series(spark):
    df = spark.sql(
        "select 'a' s, timestamp_ntz'2024-01-05' t, 1L v union all select 'a', timestamp_ntz'2024-03-05', 2L "
        "union all select null, timestamp_ntz'2024-02-05', 3L"
    )
    found = rows(resample(df, "t", "v", "Month", "sum", ["s"]))
    assert [(s, str(t), v) for s, t, v in found] == [
        ("a", "2024-01-31", 1), ("a", "2024-02-29", 0), ("a", "2024-03-31", 2), (None, "2024-02-29", 3),
    ]


def test_leaders_are_hinted_only_where_few(frame):
    from tablewright.operators.grouping import MAX_HINTED, top_categories

    plan = lambda n: top_categories(frame, "region", "revenue", n)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(2) and "broadcast" not in plan(MAX_HINTED + 1)
    few, many = top_categories(frame, "region", "revenue", 10), top_categories(frame, "region", "revenue", MAX_HINTED + 1)
    assert rows(few) == rows(many) and many.count() == frame.count()
