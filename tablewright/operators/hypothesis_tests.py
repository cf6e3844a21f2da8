"""Statistical tests from sufficient statistics.

Each ``*_statistics`` function is a lazy one-row DataFrame computed by grouped
aggregation; :func:`statistical_test` reads that row and adds the p-value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tablewright.functions.columns import col, comparable, join_null_safe, number, require, require_numeric, text
from tablewright.functions.distributions import chi_square_upper, f_upper, r_two_sided, t_quantile, t_two_sided
from tablewright.operators.grouping import contingency
from tablewright.operators.quality import correlation

# The names of the tests.
TWO_GROUPS = "Two-group mean comparison"
MANY_GROUPS = "Multi-group mean comparison"
ASSOCIATION = "Category association"
RELATIONSHIP = "Numeric relationship"


@dataclass(frozen=True)
class TestResult:
    """``estimate`` is a number, or a DataFrame of group means or cell counts."""

    __test__ = False

    name: str
    statistic: float
    pvalue: float
    confidence: float
    significant: bool
    effect: float | None
    estimate: float | DataFrame = field(repr=False)


def _complete(df: DataFrame, measure: str, group: str) -> DataFrame:
    require(df, group)
    require_numeric(df, measure)
    rows = df.select(comparable(df, group).alias("g"), text(df, group).alias("label"), number(df, measure).alias("v"))
    return rows.filter(F.col("g").isNotNull() & F.col("v").isNotNull())


def group_means(df: DataFrame, measure: str, group: str) -> DataFrame:
    """``g, label, n, mean, var`` per group, over rows holding both fields."""
    return _complete(df, measure, group).groupBy("g").agg(
        F.min("label").alias("label"), F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var")
    )


def mean_interval_statistics(df: DataFrame, measure: str) -> DataFrame:
    """One row: n, mean, sem."""
    require_numeric(df, measure)
    v = number(df, measure)
    return df.agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"),
        F.try_divide(F.stddev_samp(v), F.sqrt(F.count(v))).alias("sem"),
    )


def mean_confidence_interval(df: DataFrame, measure: str, confidence: float = 0.95) -> dict[str, float]:
    row = mean_interval_statistics(df, measure).first()
    if row["n"] < 2:
        raise ValueError(f"{measure} needs two values or more for an interval.")
    margin = t_quantile((1 + confidence) / 2, row["n"] - 1) * row["sem"]
    return {"mean": row["mean"], "lower": row["mean"] - margin, "upper": row["mean"] + margin, "n": row["n"]}


def welch_statistics(df: DataFrame, measure: str, group: str) -> DataFrame:
    """One row: groups, first, second, statistic, dof, effect."""
    one = F.struct("g", "label", "n", "mean", "var")
    ends = group_means(df, measure, group).agg(
        F.count("*").alias("groups"), F.min(one).alias("a"), F.max(one).alias("b")
    )
    share_a, share_b = F.col("a.var") / F.col("a.n"), F.col("b.var") / F.col("b.n")
    effect = F.col("a.mean") - F.col("b.mean")
    spread = share_a + share_b
    parts = F.try_divide(share_a * share_a, F.col("a.n") - 1) + F.try_divide(share_b * share_b, F.col("b.n") - 1)
    return ends.select(
        "groups",
        F.col("a.label").alias("first"),
        F.col("b.label").alias("second"),
        F.try_divide(effect, F.sqrt(spread)).alias("statistic"),
        F.try_divide(spread * spread, parts).alias("dof"),
        effect.alias("effect"),
    )


def anova_statistics(df: DataFrame, measure: str, group: str) -> DataFrame:
    """One row: groups, n, statistic, dof_between, dof_within; groups of one row do not count."""
    kept = group_means(df, measure, group).filter(F.col("n") >= 2).select("n", "mean", "var")
    grand = kept.agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))).scalar()
    sums = kept.agg(
        F.count("*").alias("groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.sum(F.col("n") * F.pow(F.col("mean") - grand, 2)).alias("between"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("within"),
    )
    dof_between, dof_within = F.col("groups") - 1, F.col("n") - F.col("groups")
    return sums.select(
        "groups",
        "n",
        F.try_divide(
            F.try_divide(F.col("between"), dof_between), F.try_divide(F.col("within"), dof_within)
        ).alias("statistic"),
        dof_between.alias("dof_between"),
        dof_within.alias("dof_within"),
    )


def chi_square_statistics(df: DataFrame, first: str, second: str) -> DataFrame:
    """One row: n, rows, columns, statistic, dof, effect.

    Only the pairs of values that occur are visited.  The pairs that do not occur
    add their expected counts, which is the table total less the expected counts of
    the others; a 2 x 2 table has the same deviation in all four cells, so the
    continuity correction needs no cell that is absent either.
    """
    if first == second:
        raise ValueError("Choose two different fields.")
    joint = contingency(df, first, second).select(
        col(first).alias("a"), col(second).alias("b"), F.col("count").cast("double").alias("n")
    )
    by_a = joint.groupBy("a").agg(F.sum("n").alias("ra"))
    by_b = joint.groupBy("b").agg(F.sum("n").alias("cb"))
    total = joint.agg(F.sum("n")).scalar()
    cells = join_null_safe(join_null_safe(joint, by_a, ["a"]), by_b, ["b"])
    expected = F.col("ra") * F.col("cb") / total
    cells = cells.select("n", expected.alias("e"))
    rows = by_a.agg(F.struct(F.count("*").alias("k"), F.sum(1 / F.col("ra")).alias("inv")).alias("s")).scalar()
    columns = by_b.agg(F.struct(F.count("*").alias("k"), F.sum(1 / F.col("cb")).alias("inv")).alias("s")).scalar()
    sums = cells.agg(
        F.count("*").alias("present"),
        F.sum("n").alias("n"),
        F.sum("e").alias("e"),
        F.sum(F.pow(F.col("n") - F.col("e"), 2) / F.col("e")).alias("chi"),
        F.max(F.abs(F.col("n") - F.col("e"))).alias("deviation"),
    ).select("*", rows.alias("r"), columns.alias("c"))
    size, shift = F.col("r.k") * F.col("c.k"), F.least(F.lit(0.5), F.col("deviation"))
    plain = F.col("chi") + F.when(size > F.col("present"), F.col("n") - F.col("e")).otherwise(0.0)
    corrected = F.pow(F.col("deviation") - shift, 2) * F.col("n") * F.col("r.inv") * F.col("c.inv")
    two_by_two = (F.col("r.k") == 2) & (F.col("c.k") == 2)
    found = sums.select(
        F.col("n").cast("bigint").alias("n"),
        F.col("r.k").alias("rows"),
        F.col("c.k").alias("columns"),
        F.when(two_by_two, corrected).otherwise(plain).alias("statistic"),
        ((F.col("r.k") - 1) * (F.col("c.k") - 1)).alias("dof"),
    )
    degrees = F.greatest(F.least("rows", "columns") - 1, F.lit(1))
    return found.withColumn("effect", F.sqrt(F.try_divide(F.col("statistic"), F.col("n") * degrees)))


def pearson_statistics(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, statistic."""
    require_numeric(df, x, y)
    a, b = number(df, x), number(df, y)
    return df.agg(F.count_if(a.isNotNull() & b.isNotNull()).alias("n"), correlation(df, x, y).alias("statistic"))


def _two_groups(df: DataFrame, measure: str, group: str, _) -> tuple:
    row = welch_statistics(df, measure, group).first()
    if row["groups"] != 2:
        raise ValueError(f"{group} holds {row['groups']} groups with values; this test compares two.")
    pvalue = _tail(row["statistic"], lambda s: t_two_sided(s, row["dof"]))
    return "Welch's t-test", row["statistic"], pvalue, row["effect"], group_means(df, measure, group).select("label", "mean")


def _many_groups(df: DataFrame, measure: str, group: str, _) -> tuple:
    row = anova_statistics(df, measure, group).first()
    if row["groups"] < 2:
        raise ValueError(f"{group} needs two groups of two values or more.")
    pvalue = _tail(row["statistic"], lambda s: f_upper(s, row["dof_between"], row["dof_within"]))
    return "One-way ANOVA", row["statistic"], pvalue, None, group_means(df, measure, group).select("label", "mean")


def _association(df: DataFrame, _, first: str, second: str) -> tuple:
    row = chi_square_statistics(df, first, second).first()
    if min(row["rows"] or 0, row["columns"] or 0) < 2:
        raise ValueError(f"{first} and {second} need two values each.")
    pvalue = _tail(row["statistic"], lambda s: chi_square_upper(s, row["dof"]))
    return "Chi-square association test", row["statistic"], pvalue, row["effect"], contingency(df, first, second)


def _relationship(df: DataFrame, x: str, _, y: str) -> tuple:
    row = pearson_statistics(df, x, y).first()
    if row["n"] < 4:
        raise ValueError(f"Only {row['n']} rows hold both {x} and {y}; four are needed.")
    r = row["statistic"]
    return "Pearson correlation test", r, _tail(r, lambda s: r_two_sided(s, row["n"] - 2)), r, r


_TESTS = {
    TWO_GROUPS: _two_groups,
    MANY_GROUPS: _many_groups,
    ASSOCIATION: _association,
    RELATIONSHIP: _relationship,
}


def statistical_test(
    df: DataFrame,
    test_name: str,
    numeric_column: str | None = None,
    group_column: str | None = None,
    second_column: str | None = None,
    confidence: float = 0.95,
) -> TestResult:
    """Run a test by name; it is significant when its p-value lies under 1 - confidence."""
    if test_name not in _TESTS:
        raise ValueError(f"Unsupported statistical test: {test_name}")
    run = _TESTS[test_name]
    name, statistic, pvalue, effect, estimate = run(df, numeric_column, group_column, second_column)
    statistic = math.nan if statistic is None else statistic
    return TestResult(name, statistic, pvalue, confidence, pvalue < 1 - confidence, effect, estimate)


def _tail(statistic: float | None, probability) -> float:
    return math.nan if statistic is None or math.isnan(statistic) else probability(statistic)
