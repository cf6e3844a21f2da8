import pytest
from comparing import rows
from pyspark.sql import functions as F

from tablewright import apply_operation, calculated, filter_rows, search_all
from tablewright.operators.cleaning import convert_type, deduplicate, treat_missing, treat_outliers


@pytest.mark.parametrize("method, expected", [("Mean", 156.0), ("Median", 160.0), ("Mode", 100.0), ("Custom value", 125.0)])
def test_fill(frame, method, expected):
    result = treat_missing(frame, "revenue", method, "125")
    assert result.filter("revenue is null").count() == 0
    assert result.filter("_row_id = 4").first()["revenue"] == expected


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    assert rows(treat_missing(df, "x", "Mean")) == [(1.0,), (2.0,), (2.0,), (3.0,)]
    assert filter_rows(df, "x", "greater than", "0").count() == 2
    assert filter_rows(df, "x", "is missing").count() == 2
    assert treat_missing(df, "x", "Drop rows").count() == 2
    assert treat_outliers(df, "x", "Remove rows").count() == 4


def test_drop(frame):
    assert treat_missing(frame, "region", "Drop rows").count() == 5
    assert "region" not in treat_missing(frame, "region", "Drop column").columns


def test_missing_errors(frame):
    with pytest.raises(ValueError):
        treat_missing(frame, "revenue", "Guess")
    with pytest.raises(ValueError):
        treat_missing(frame, "nowhere", "Mean")
    with pytest.raises(ValueError):
        treat_missing(frame, "region", "Mean")
    with pytest.raises(ValueError):
        treat_missing(frame.withColumn("empty", F.lit(None).cast("double")), "empty", "Mode")
    with pytest.raises(ValueError):
        treat_missing(frame, "revenue", "Custom value", "many")


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    assert treat_missing(df, "x", "Mode").filter("x = 'a'").count() == 3


def test_mode_of_dates_and_flags(spark):
    df = spark.sql("select * from values (timestamp_ntz'2025-01-01 10:00:00.5', true), (timestamp_ntz'2025-01-01 10:00:00.5', null), "
                   "(null, true), (timestamp_ntz'2024-01-01 00:00:00', false) as t(t, b)")
    filled = treat_missing(treat_missing(df, "t", "Mode"), "b", "Mode")
    assert filled.dtypes == df.dtypes
    assert filled.filter("t = timestamp_ntz'2025-01-01 10:00:00.5'").count() == 3 and filled.filter("b").count() == 3


def test_deduplicate(frame, plain):
    assert deduplicate(frame).count() == 5
    assert deduplicate(plain, []).count() == 5
    assert deduplicate(frame, ["region", "revenue"], False).count() == 4
    assert deduplicate(plain, keep=False).count() == 4


def test_deduplicate_keeps_first_or_last_of_the_key(frame):
    assert rows(deduplicate(frame, ["group"], "first"), "_row_id") == [(0,), (2,)]
    assert rows(deduplicate(frame, ["group"], "last"), "_row_id") == [(4,), (5,)]
    assert rows(deduplicate(frame, ["group"], "first", order_by="cost"), "group", "cost") == [("A", 60.0), ("B", 70.0)]
    assert deduplicate(frame, ["group"]).columns == frame.columns


def test_deduplicate_treats_missing_as_equal_and_ignores_partitioning(spark):
    data = [(i, None if i % 2 else "x", i % 3) for i in range(60)]
    df = spark.createDataFrame(data, "id long, k string, v long")
    expected = rows(deduplicate(df, ["k"], order_by="id"))
    assert expected == [(0, "x", 0), (1, None, 1)]
    for n in (1, 3, 7):
        assert rows(deduplicate(df.repartition(n), ["k"], order_by="id")) == expected
    survivors = rows(deduplicate(df.drop("id"), ["k"]))
    assert rows(deduplicate(df.drop("id").repartition(5), ["k"])) == survivors


@pytest.mark.parametrize(
    "target, expected",
    [
        ("Number", [1.0, 0.0, None, None]),
        ("Boolean", [True, False, True, None]),
        ("Text", ["1", "0", "yes", "2025-01-01"]),
        ("Category", ["1", "0", "yes", "2025-01-01"]),
    ],
)
def test_convert(spark, target, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["1", "0", "yes", "2025-01-01"])], "i int, value string")
    assert [r["value"] for r in convert_type(df, "value", target).orderBy("i").collect()] == expected


def test_convert_to_date(spark):
    df = spark.createDataFrame([("2025-01-31",), ("2025-02-01T10:00:00",), ("soon",), (None,)], "d string")
    result = convert_type(df, "d", "Date/time")
    assert result.schema["d"].dataType.typeName() == "timestamp_ntz"
    assert [str(r[0]) for r in result.collect()] == ["2025-01-31 00:00:00", "2025-02-01 10:00:00", "None", "None"]
    us = spark.createDataFrame([("01/31/2025",), ("12/01/2024",)], "d string")
    assert [str(r[0])[:10] for r in convert_type(us, "d", "Date/time").collect()] == ["2025-01-31", "2024-12-01"]
    eu = spark.createDataFrame([("31/01/2025",), ("1/12/2024",)], "d string")
    assert [str(r[0])[:10] for r in convert_type(eu, "d", "Date/time").collect()] == ["2025-01-31", "2024-12-01"]
    nanos = spark.createDataFrame([(1_500_000_000,)], "d long")
    assert str(convert_type(nanos, "d", "Date/time").first()[0]) == "1970-01-01 00:00:01.500000"


def test_convert_numbers_reject_java_spellings(spark):
    df = spark.createDataFrame([(v,) for v in (" 5 ", "1e3", "1,000", "5d", "0x10", "-inf", "")], "x string")
    assert [r[0] for r in convert_type(df, "x", "Number").collect()] == [
        5.0, 1000.0, None, None, None, float("-inf"), None,
    ]


def test_boolean_of_floats_is_missing(spark):
    df = spark.createDataFrame([(1.0, 1), (0.0, 0)], "f double, i long")
    assert rows(convert_type(df, "f", "Boolean"), "f") == [(None,), (None,)]
    assert rows(convert_type(df, "i", "Boolean"), "i") == [(False,), (True,)]


@pytest.mark.parametrize("small", [None, 0])
def test_outliers(spark, small):
    df = spark.createDataFrame([(v,) for v in (10, 11, 12, 13, 14, 1000)], "value long")
    capped = treat_outliers(df, "value", "Cap values", 1.5, small)
    assert capped.agg(F.max("value")).first()[0] == 17.5
    assert treat_outliers(df, "value", "Remove rows", 1.5, small).count() == 5
    assert treat_outliers(df, "value", "Replace with missing", 1.5, small).filter("value is null").count() == 1
    with pytest.raises(ValueError):
        treat_outliers(df, "value", "Ignore")


@pytest.mark.parametrize(
    "column, operator, value, expected",
    [
        ("region", "equals", "West", 2), ("region", "not equal", "West", 4), ("region", "contains", "est", 2),
        ("revenue", "greater than", "150", 3), ("revenue", "less than", "150", 2),
        ("revenue", "at least", "180", 2), ("revenue", "at most", "100", 2),
        ("region", "is missing", None, 1), ("region", "is populated", None, 5),
        ("revenue", "equals", "100.0", 2), ("revenue", "equals", "100", 0), ("revenue", "not equal", "100.0", 4),
        ("region", "contains", "^(w|n)", 3),
    ],
)
def test_filters(frame, column, operator, value, expected):
    assert filter_rows(frame, column, operator, value).count() == expected


def test_filter_errors(frame):
    for arguments in [("region", "near", "x"), ("region", "greater than", "1"), ("revenue", "at least", "x"),
                      ("region", "contains", "("), ("nowhere", "equals", "x")]:
        with pytest.raises(ValueError):
            filter_rows(frame, *arguments)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "cast(id as double) x", "cast(id as string) s").write.parquet(path)
    df = spark.read.parquet(path)
    for column, value, pushed in [("id", "5", "EqualTo(id,5)"), ("x", "5.0", "EqualTo(x,5.0)"), ("s", "5", "EqualTo(s,5)")]:
        plan = filter_rows(df, column, "equals", value)._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan
        assert filter_rows(df, column, "equals", value).count() == 1
    assert "GreaterThan(x,5.0)" in filter_rows(df, "x", "greater than", 5.0)._jdf.queryExecution().executedPlan().toString()


def test_text_of_cells_matches_python(spark):
    values = [0.0, 1.0, 1e7, 12345678.9, 1e15, 1.5e16, 1e22, 1e-3, 1.25e-4, 1e-5, 2.5e-10, -1e8, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    from tablewright.functions.columns import text

    assert [r[0] for r in df.select(text(df, "x")).collect()] == [str(v) for v in values]


def test_dates_equal_their_text(spark):
    df = spark.sql("select timestamp_ntz'2025-01-01' t union all select timestamp_ntz'2025-01-01 10:30:00.5'")
    assert filter_rows(df, "t", "equals", "2025-01-01").count() == 1
    assert filter_rows(df, "t", "equals", "2025-01-01 10:30:00.500000").count() == 1
    assert filter_rows(df, "t", "contains", "10:30:00.500000").count() == 1


def test_search_all(frame):
    assert search_all(frame, "WEST").count() == 2
    assert search_all(frame, "240.0").count() == 1
    assert search_all(frame, "").count() == 6


def test_calculated(frame):
    result = calculated(frame, "margin", "revenue - cost")
    assert [r[0] for r in result.orderBy("_row_id").select("margin").collect()] == [40, 40, 90, 110, None, 90]
    mixed = calculated(frame, "x", "-(revenue + 2) * cost % 7 / 2 ** 2")
    assert mixed.filter("x is not null").count() == 5
    for name, expression in [("cost", "revenue-cost"), ("", "cost"), ("x", "region + 1"), ("x", "__import__('os')"),
                             ("x", "cost >"), ("x", "cost > 1"), ("x", "nowhere + 1")]:
        with pytest.raises(ValueError):
            calculated(frame, name, expression)


def test_awkward_field_names(spark):
    from tablewright import group_summary, kpi_breakdown, pivot_table, resample
    from tablewright.operators import charts, grouping, quality

    df = spark.createDataFrame([("x", 1.0, 2.0), ("x", 3.0, 4.0), ("y", None, 6.0)], "`g.1` string, `a b` double, `c.d` double")
    assert rows(calculated(df, "s", "`a b` + 2 * `c.d`"), "s") == [(11.0,), (5.0,), (None,)]
    assert treat_missing(df, "a b", "Mean").filter("`a b` = 2").count() == 1
    assert deduplicate(df, ["g.1"], "last", "c.d").count() == 2
    assert filter_rows(df, "g.1", "contains", "X").count() == 2
    assert rows(group_summary(df, ["g.1"], ["c.d"], "median", 0)) == [("x", 3.0), ("y", 6.0)]
    assert pivot_table(df, "g.1", "a b", "c.d", "sum").columns == ["g.1", "1.0", "3.0"]
    assert grouping.melt(df, ["g.1"], ["a b", "c.d"]).count() == 6
    assert grouping.describe(df).count() == 2 and quality.outlier_screen(df).count() == 0
    assert quality.data_dictionary(df).count() == 3 and quality.correlation_matrix(df).count() == 2
    assert charts.category_table(df, "g.1", "c.d").count() == 2
    assert kpi_breakdown(df, {"column": "c.d", "aggregation": "sum"}, "g.1").count() == 2
    assert treat_outliers(df, "c.d", "Cap values").count() == 3
    dated = df.selectExpr("`g.1`", "`c.d`", "date'2024-01-31' as `d.t`")
    assert rows(resample(dated, "d.t", "c.d", "Month", series=["g.1"]), "`c.d`") == [(6.0,), (6.0,)]


def test_division_by_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (4.0, 2.0), (None, 0.0)], "a double, b double")
    assert [r[0] for r in calculated(df, "q", "a / b").select("q").collect()] == [
        float("inf"), float("-inf"), None, 2.0, None,
    ]


def test_unknown_operation(frame):
    with pytest.raises(ValueError):
        apply_operation(frame, {"kind": "not-real", "params": {}})


def test_date_formats_are_counted_on_every_cell_they_read(spark):
    from tablewright.functions import dates

    cells = [
        "2024-03-05", "2024-3-5", "2024/03/05", "2024/13/05", "03/25/2024", "25/03/2024", "0003/25/2024", "3/5/2024 7:08",
        "3/5/2024 7:08:09", "25/3/2024 7:08", "03-25-2024", "25-03-2024", "25.03.2024", "5.13.2024", "20240305", "+120240305",
        "5 Mar 2024", "5-mar-2024", "MAR 5, 2024", "March 5, 2024", "5 March 2024", "Mar 2024", "march 2024", "2024-03", "+12024/3/5",
        "-3/5/2024", "a/b/c", "//", "--", "", "  2024-03-05 ", " 3/5/2024 ", "99999999999/1/2020", "٣/٥/2024", "soon", "May 2024", "5 May 2024", None,
        "2024-03-05T07:08:09Z", "2024-03-05 07:08", "1/2/3", "2024-03-05-06", "3/5/2024  7:08", "12/31/99", "02/30/2024",
    ]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    forms = [dates.ISO_FORMAT, *dates.DATE_FORMATS]
    plain = df.select("c", *[dates.parse_with(F.col("c"), f).cast("string").alias(f"p{i}") for i, f in enumerate(forms)]).collect()
    trimmed = F.trim("c")
    marks = dates._marks(F.col("c"))
    bare = F.translate(marks, dates._LETTERS, "")
    gates = df.select("c", *[dates._may_fit(f, trimmed, marks, bare).alias(f"p{i + 1}") for i, f in enumerate(forms[1:])]).collect()
    for read, gate in zip(plain, gates):
        for i, form in enumerate(forms[1:], 1):
            assert gate[f"p{i}"] or read[f"p{i}"] is None, (read["c"], form)
    # The format chosen over any one cell is the first that reads it.
    for read in plain[::6]:
        first = next((f for i, f in enumerate(forms) if read[f"p{i}"] is not None), None)
        one = spark.createDataFrame([(read["c"],)], "c string")
        assert dates.best_formats(one, ["c"])["c"] == first, read["c"]
