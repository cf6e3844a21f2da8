import numpy as np
import pandas as pd
import pytest
from comparing import rows
from pyspark.sql import functions as F

from tablewright import compare_quality, data_health, dataset_summary, evaluate_kpis, kpi_breakdown, kpi_definition
from tablewright.operators import charts as C, quality as Q


def test_health(plain):
    score, factors = data_health(plain)
    assert score == 91
    assert factors["Completeness"] == pytest.approx(28 / 30)
    assert factors["Row uniqueness"] == pytest.approx(5 / 6)
    assert factors["Column usefulness"] == 1.0
    constant = plain.withColumn("one", F.lit(1)).withColumn("none", F.lit(None).cast("string"))
    assert data_health(constant)[1]["Column usefulness"] == pytest.approx(5 / 7)


def test_health_of_an_empty_table(plain):
    assert data_health(plain.limit(0)) == (85, {"Completeness": 1.0, "Row uniqueness": 1.0, "Column usefulness": 0.0})


def test_row_id_is_not_data(frame, plain):
    assert data_health(frame) == data_health(plain)
    assert rows(Q.missing_by_field(frame)) == rows(Q.missing_by_field(plain))


def test_compare(plain):
    cleaned = plain.dropna().dropDuplicates()
    found = {r["Metric"]: tuple(r)[1:] for r in compare_quality(plain, cleaned).collect()}
    assert found["Rows"] == (6, 3, -3)
    assert found["Missing cells"] == (2, 0, -2)
    assert found["Duplicate rows"] == (1, 0, -1)
    assert found["Completeness %"] == pytest.approx((28 / 30 * 100, 100, 100 - 28 / 30 * 100))


def test_duplicates_tell_missing_cells_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None), (None, None)], "x string, y string")
    assert Q.duplicate_count(df).first()[0] == 1
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,)], "x double")
    assert Q.duplicate_count(zeros).first()[0] == 2


def test_unique_counts(spark):
    long = "x" * 100
    df = spark.createDataFrame([(1, long, 0.0), (1, long + "y", -0.0), (2, None, None)], "a long, b string, c double")
    assert dict(rows(Q.unique_counts(df))) == {"a": 2, "b": 2, "c": 1}
    assert dict(rows(Q.unique_counts(df, approx=True))) == {"a": 2, "b": 2, "c": 1}


def test_missing_profile_dictionary(frame, plain):
    assert rows(Q.missing_by_field(plain)) == [("region", 1, pytest.approx(100 / 6)), ("revenue", 1, pytest.approx(100 / 6))]
    profile = {r["Field"]: r for r in Q.field_profile(frame).collect()}
    assert profile["region"]["Example"] == "West" and profile["region"]["Unique"] == 3
    assert profile["revenue"]["Example"] == "100.0" and profile["revenue"]["Populated"] == 5
    empty = Q.field_profile(frame.withColumn("e", F.lit(None).cast("string"))).filter("Field = 'e'").first()
    assert (empty["Example"], empty["Missing %"], empty["Unique"]) == ("—", 100.0, 0)
    assert rows(Q.data_dictionary(plain), "field", "non_null", "unique")[0] == ("code", 6, 5)


@pytest.mark.parametrize("small", [None, 0])
def test_outlier_screen(spark, small):
    df = spark.createDataFrame([(v, 5, None) for v in (10, 11, 12, 13, 14, 1000)], "a long, b long, c double")
    assert rows(Q.outlier_screen(df, group_rows=small)) == [("a", 1, pytest.approx(100 / 6)), ("b", 0, 0.0)]


def test_correlations_agree_with_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(200, 4)), columns=list("abcd"))
    pdf["b"] += pdf["a"]
    pdf.loc[rng.random(200) < .2, "c"] = None
    pdf["k"] = 3.0
    df = spark.createDataFrame(pdf)
    expected = pdf.corr()
    for r in Q.correlation_matrix(df).collect():
        for n in pdf.columns:
            e = expected.loc[r["field"], n]
            assert (r[n] is None and np.isnan(e)) or r[n] == pytest.approx(e)
    best = Q.strongest_correlations(df).first()
    assert (best["first"], best["second"], best["correlation"]) == ("a", "b", round(expected.loc["a", "b"], 3))


def test_overview_and_eligibility(plain):
    row = Q.overview(plain).first()
    assert (row["rows"], row["columns"], row["missing_cells"], row["duplicates"]) == (6, 5, 2, 1)
    assert (row["widest_field"], row["widest_unique"]) == ("cost", 5)
    assert (row["numeric_fields"], row["categorical_fields"], row["date_fields"]) == (2, 3, 0)
    roles = {(r["field"], r["role"]): r["eligible"] for r in Q.field_eligibility(plain).collect()}
    assert roles["region", "missing treatment"] and not roles["cost", "missing treatment"]
    assert roles["region", "chart category"] and not roles["cost", "chart category"]
    assert roles["cost", "kpi split"] and roles["group", "test group"]
    assert len(Q.chart_choices(plain)) == 16


def test_high_cardinality_categories_stand_in_when_there_is_no_other(spark):
    df = spark.range(60).selectExpr("cast(id as string) s", "cast(id as string) u")
    roles = {(r["field"], r["role"]): r["eligible"] for r in Q.field_eligibility(df).collect()}
    assert roles["s", "chart category"] and not roles["s", "colour"]


def test_summary_and_report(plain):
    values = {(r["section"], r["field"], r["metric"]): r["value"] for r in dataset_summary(plain).collect()}
    assert values["quality", None, "score"] == 91 and values["numeric", "revenue", "50%"] == 160.0
    assert values["missing", "region", "count"] == 1 and values["distinct", "region", "values"] == 3
    assert {m: v for (s, f, m), v in values.items() if (s, f) == ("top value", "region")} == {"East": 2, "West": 2, "North": 1}
    assert values["correlation", "cost", "revenue"] > 0.9 if ("correlation", "cost", "revenue") in values else True


def test_a_long_text_and_its_digest_are_two_values(spark):
    import hashlib

    long = "x" * 100
    df = spark.createDataFrame([(long,), (hashlib.sha256(long.encode()).hexdigest(),), (None,)], "t string")
    assert Q.unique_counts(df).first()["unique"] == 2


def test_kpis(frame):
    board = [
        kpi_definition("Revenue", "revenue", "sum", 700.0, "$"),
        kpi_definition("Middle", "revenue", "median", 200.0, decimals=2),
        kpi_definition("Gone", "nowhere", "sum"),
        kpi_definition("Regions", "region", "count", suffix=" rows", decimals=0),
    ]
    found = {r["name"]: r for r in evaluate_kpis(frame, board).collect()}
    assert (found["Revenue"]["display"], found["Revenue"]["delta_display"]) == ("$780.0", "+80.0 vs target")
    assert (found["Middle"]["display"], found["Middle"]["delta"]) == ("160.00", -40.0)
    assert found["Gone"]["display"] == "Unavailable" and found["Gone"]["value"] is None
    assert found["Regions"]["display"] == "5 rows"
    with pytest.raises(ValueError):
        kpi_definition(" revenue ", "cost", "sum", existing=board)
    with pytest.raises(ValueError):
        kpi_definition(" ", "cost", "sum")


def test_kpi_breakdown(frame):
    definition = kpi_definition("Cost", "cost", "sum")
    assert [tuple(r) for r in kpi_breakdown(frame, definition, "region", 3).collect()] == [
        ("West", 120.0), ("North", 130.0), ("East", 170.0),
    ]


def test_chart_tables(frame):
    assert [tuple(r) for r in C.category_table(frame, "region").collect()] == [
        ("East", 2), ("West", 2), ("(Missing)", 1), ("North", 1),
    ]
    assert C.category_table(frame, "region", "cost", "Sum", 2).count() == 2
    stacked = C.stacked_table(frame, "region", "group", "cost", "sum", share=True)
    assert {(r["region"], r["group"]): r["Share"] for r in stacked.collect()}["East", "A"] == pytest.approx(80 / 170 * 100)
    negative = frame.withColumn("cost", -F.col("cost"))
    for make in (lambda: C.pie_table(negative, "region", "cost"), lambda: C.hierarchy_table(negative, ["region"], "cost")):
        with pytest.raises(ValueError):
            make()
    assert C.hierarchy_table(frame, ["group", "region"]).count() == 5
    assert C.waterfall_table(frame.withColumn("cost", F.when(F.col("region") == "West", -500.0).otherwise(F.col("cost"))),
                             "region", "cost").first()["region"] == "West"
    assert C.radar_table(frame, "group", "revenue", "mean").count() == 2


def test_points_histogram_box(spark):
    df = spark.range(8000).selectExpr("id", "cast(id as double) x", "cast(id % 7 - 3 as double) y",
                                      "case when id % 5 = 0 then null else 'a' end s")
    points = C.point_table(df, "x", "y", "s", "y", "id")
    assert points.count() == 5000 and points.filter("`Bubble size` < 0").count() == 0
    bins = C.histogram_table(df, "x", 20).orderBy("bin").collect()
    counts, edges = np.histogram(np.arange(8000.0), 20)
    assert [r["count"] for r in bins] == list(counts)
    assert [r["lower"] for r in bins] == pytest.approx(list(edges[:-1]))
    assert sum(r["density"] * (r["upper"] - r["lower"]) for r in bins) == pytest.approx(1)
    assert C.histogram_table(df, "x", 20, "s").agg(F.sum("count")).first()[0] == 8000
    assert C.histogram_table(df.withColumn("x", F.lit(2.0)), "x").collect()[0]["count"] == 8000
    for small in (None, 0):
        box = {r["s"] if "s" in r else r["segment"]: r for r in C.box_table(df, "x", "s", small).collect()}
        assert box["a"]["count"] == 6400 and box["(Missing)"]["outliers"] == 0
    spiked = df.withColumn("x", F.when(F.col("id") == 9, 1e6).otherwise(F.col("x")))
    assert C.box_table(spiked, "x").first()["outliers"] == 1
    assert rows(C.box_outliers(spiked, "x")) == [("All", 1e6)]


def _corr_rows(df, wide):
    return {(r["first"], r["second"]): r["r"] for r in Q.correlation_pairs(df, wide=wide).collect()}


def test_correlations_by_blocks_equal_the_aggregate(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(400, 5)) + 1e6, columns=list("abcde"))
    pdf["b"] += pdf["a"] - 1e6
    for name in "cde":
        pdf.loc[rng.random(400) < .3, name] = np.nan
    pdf["k"] = 0.1
    pdf["half"] = np.where(pdf["c"].isna(), rng.normal(size=400), 0.7)  # constant wherever c is held
    pdf["void"] = np.nan
    pdf["once"] = [4.0] + [np.nan] * 399
    pdf["far"] = [np.inf] + list(rng.normal(size=399))
    df = spark.createDataFrame(pdf).repartition(5)
    plain, blocks = _corr_rows(df, False), _corr_rows(df, True)
    assert plain.keys() == blocks.keys() and len(blocks) == 45
    for pair, r in plain.items():
        if r is None or np.isnan(r):
            assert repr(blocks[pair]) == repr(r), pair
        else:
            assert blocks[pair] == pytest.approx(r, abs=1e-9), pair
    assert blocks["c", "half"] is None and blocks["a", "k"] is None and blocks["a", "once"] is None
    for one, other in zip(Q.correlation_matrix(df, wide=False).collect(), Q.correlation_matrix(df, wide=True).collect()):
        assert one["field"] == other["field"]
        for n in pdf.columns:
            assert (one[n] is None and other[n] is None) or one[n] == pytest.approx(other[n], nan_ok=True), n


def test_blocks_do_not_change_correlations(spark):
    from tablewright.operators.gram import pairwise_correlations

    df = spark.range(300).select(*[F.when(F.col("id") % (k + 2) != 0, F.hash("id", F.lit(k)) % 100).alias(f"x{k}") for k in range(7)])
    whole, small = (pairwise_correlations(df, df.columns, b).orderBy("i", "j").collect() for b in (64, 3))
    assert [tuple(r)[:3] for r in whole] == [tuple(r)[:3] for r in small] and len(whole) == 28
    assert all(a["r"] == pytest.approx(b["r"]) for a, b in zip(whole, small))
    empty = pairwise_correlations(df.limit(0), df.columns).collect()
    assert len(empty) == 28 and all(r["n"] == 0 and r["r"] is None for r in empty)


def test_the_plan_of_wide_correlations_grows_with_fields(spark):
    def plan(width):
        df = spark.range(10).select(*[(F.col("id") + k).alias(f"x{k}") for k in range(width)])
        return len(Q.correlation_pairs(df)._jdf.queryExecution().optimizedPlan().toString())

    assert plan(200) < 2.5 * plan(100)
