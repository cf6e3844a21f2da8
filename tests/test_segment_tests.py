import math

import pytest
from pyspark.sql import functions as F

from tablewright.functions.distributions import r_two_sided
from tablewright.operators.hypothesis_tests import ASSOCIATION, MANY_GROUPS, RELATIONSHIP, TWO_GROUPS, statistical_test
from tablewright.operators.segment_tests import RESULT_FIELDS, segment_tests

COLUMNS = {
    TWO_GROUPS: ("x", "pair", None), MANY_GROUPS: ("x", "many", None),
    ASSOCIATION: (None, "pair", "many"), RELATIONSHIP: ("x", None, "y"),
}


@pytest.fixture(scope="module")
def plots(spark):
    """A missing segment and three others, one of which holds most rows; cells are missing here and there."""
    return spark.range(400).select(
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "b").when(F.col("id") % 20 == 9, "c").alias("plot"),
        F.when(F.col("id") % 13 != 0, F.hash("id") % 50 + F.when(F.col("id") % 2 == 0, 4).otherwise(0)).cast("double").alias("x"),
        (F.hash("id", F.lit(1)) % 50).alias("y"),
        F.when(F.hash(F.col("id"), F.lit(2)) % 3 == 0, "even").otherwise("odd").alias("pair"),
        F.when(F.col("id") % 17 != 0, F.hash(F.col("id"), F.lit(3)) % 3).alias("many"),
    )


@pytest.mark.parametrize("test_name", list(COLUMNS))
def test_each_segment_has_the_test_of_its_rows(plots, test_name):
    found = segment_tests(plots, test_name, ["plot"], *COLUMNS[test_name])
    assert found.columns == ["plot", *RESULT_FIELDS]
    told = {r["plot"]: r for r in found.collect()}
    assert set(told) == {"hot", "b", "c", None}
    whole = segment_tests(plots, test_name, None, *COLUMNS[test_name]).collect()
    assert len(whole) == 1
    for rows, row in [(plots, whole[0])] + [(plots.filter(F.col("plot").eqNullSafe(F.lit(p))), r) for p, r in told.items()]:
        one = statistical_test(rows, test_name, *COLUMNS[test_name])
        assert row["name"] == one.name and row["statistic"] == pytest.approx(one.statistic)
        assert row["pvalue"] == pytest.approx(one.pvalue, rel=1e-6) and row["significant"] == one.significant
        assert (row["effect"] is None) == (one.effect is None) and (one.effect is None or row["effect"] == pytest.approx(one.effect))


@pytest.mark.parametrize("test_name", list(COLUMNS))
def test_segments_that_cannot_be_tested_keep_a_row(plots, test_name):
    lone = plots.limit(1).withColumns({"plot": F.lit("lone")})
    void = lone.withColumns({"plot": F.lit("void"), "x": F.lit(None).cast("double"), "many": F.lit(None).cast("int")})
    told = {r["plot"]: r for r in segment_tests(plots.unionByName(lone).unionByName(void), test_name, ["plot"], *COLUMNS[test_name]).collect()}
    for plot in ("lone", "void"):
        assert told[plot]["statistic"] is None and told[plot]["pvalue"] is None and told[plot]["significant"] is False
    empty = plots.limit(0)
    assert segment_tests(empty, test_name, ["plot"], *COLUMNS[test_name]).count() == 0
    row, = segment_tests(empty, test_name, [], *COLUMNS[test_name]).collect()
    assert row["n"] == 0 and row["pvalue"] is None


def test_names_of_results_and_tests_are_checked(plots):
    with pytest.raises(ValueError):
        segment_tests(plots.withColumnRenamed("plot", "n"), RELATIONSHIP, ["n"], "x", None, "y")
    with pytest.raises(ValueError):
        segment_tests(plots, "Guess", ["plot"])


def test_tail_of_a_correlation():
    assert r_two_sided(1.0, 5) == 0.0 and r_two_sided(0.0, 5) == pytest.approx(1.0)
    # Two degrees of freedom: the density of r is constant.
    assert r_two_sided(0.25, 2) == pytest.approx(0.75) and not math.isnan(r_two_sided(-0.25, 2))
