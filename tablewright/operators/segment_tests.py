"""Statistical tests as rows: one test in every segment of a table, in one job.

The sufficient statistics of all segments come from grouped aggregation, combined
map-side; a segment holding a third of the rows reaches the reducers as one row a task and
group.  P-values are computed where the rows are, in Arrow batches.

A segment for which a test is not defined (too few groups or rows, constant fields) has a
row whose statistic and p-value are missing.  Missing segment values make a segment of
their own; tables without rows have no segments, and one row without ``by``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.columns import col, comparable, join_null_safe, number, require, require_numeric
from tablewright.functions.distributions import p_value
from tablewright.operators.hypothesis_tests import ASSOCIATION, MANY_GROUPS, RELATIONSHIP, TWO_GROUPS

RESULT_FIELDS = ["name", "n", "statistic", "dof", "dof_within", "pvalue", "confidence", "significant", "effect"]


def segment_tests(
    df: DataFrame,
    test_name: str,
    by: list[str] | None = None,
    numeric_column: str | None = None,
    group_column: str | None = None,
    second_column: str | None = None,
    confidence: float = 0.95,
) -> DataFrame:
    """``by..., name, n, statistic, dof, dof_within, pvalue, confidence, significant, effect``.

    The names of tests and the meaning of the columns are those of ``statistical_test``;
    ``by`` fields may not be named like a result.
    """
    by = list(by or [])
    require(df, *by)
    if set(by) & set(RESULT_FIELDS):
        raise ValueError("Rename segment fields that are named like a result.")
    if test_name not in _TESTS:
        raise ValueError(f"Unsupported statistical test: {test_name}")
    keys = [f"k{i}" for i in range(len(by))]
    keyed = [comparable(df, name).alias(key) for key, name in zip(keys, by)]
    name, tail, build = _TESTS[test_name]
    found = build(df, keys, keyed, numeric_column, group_column, second_column)
    p = p_value(tail, F.col("statistic"), F.col("dof"), F.col("dof_within"))
    told = found.withColumn("pvalue", p)
    return told.select(
        *[F.col(key).alias(segment) for key, segment in zip(keys, by)],
        F.lit(name).alias("name"), "n", "statistic", "dof", "dof_within", "pvalue", F.lit(float(confidence)).alias("confidence"),
        F.coalesce(F.col("pvalue") < 1 - confidence, F.lit(False)).alias("significant"), "effect")


def tests_together(tables: list[DataFrame]) -> DataFrame:
    """The rows of several tests as one table."""
    return reduce(DataFrame.unionByName, tables)


def _results(table: DataFrame, keys: list[str], statistic: Column, dof: Column, within: Column, effect: Column, fit: Column) -> DataFrame:
    def where_fit(value: Column) -> Column:
        return F.when(fit, value.cast("double"))

    return table.select(
        *keys, F.col("n").cast("bigint").alias("n"), where_fit(statistic).alias("statistic"), where_fit(dof).alias("dof"),
        where_fit(within).alias("dof_within"), where_fit(effect).alias("effect"))


def _means(df: DataFrame, keys, keyed, measure: str, group: str) -> DataFrame:
    require(df, group)
    require_numeric(df, measure)
    rows = df.select(*keyed, comparable(df, group).alias("g"), number(df, measure).alias("v"))
    # Segments without a complete row keep a row of their own, with n = 0.
    held = F.when(F.col("g").isNotNull(), F.col("v"))
    return rows.groupBy(*keys, "g").agg(F.count(held).alias("n"), F.avg(held).alias("mean"), F.var_samp(held).alias("var"))


def _welch(df, keys, keyed, measure, group, _):
    one = F.when(F.col("n") > 0, F.struct("g", "n", "mean", "var"))
    ends = _means(df, keys, keyed, measure, group).groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("groups"),
        F.min(one).alias("a"), F.max(one).alias("b"))
    share_a, share_b = F.col("a.var") / F.col("a.n"), F.col("b.var") / F.col("b.n")
    spread, effect = share_a + share_b, F.col("a.mean") - F.col("b.mean")
    parts = F.try_divide(share_a * share_a, F.col("a.n") - 1) + F.try_divide(share_b * share_b, F.col("b.n") - 1)
    return _results(ends, keys, F.try_divide(effect, F.sqrt(spread)), F.try_divide(spread * spread, parts),
                    F.lit(None), effect, F.col("groups") == 2)


def _anova(df, keys, keyed, measure, group, _):
    means = _means(df, keys, keyed, measure, group)
    grands = means.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("n"))), F.lit(0)).alias("total"),
        F.sum(F.when(F.col("n") >= 2, F.col("n") * F.col("mean"))).alias("sum"))
    counted = F.col("n") >= 2
    if keys:
        joined = join_null_safe(means, grands, keys)
    else:
        whole = grands.select(F.struct("total", "sum").alias("s")).scalar()
        joined = means.withColumns({"total": whole.getField("total"), "sum": whole.getField("sum")})
    grand = F.try_divide(F.col("sum"), F.col("total"))
    sums = joined.groupBy(*keys).agg(
        F.coalesce(F.max("total"), F.lit(0)).alias("n"), F.count_if(counted).alias("groups"),
        F.sum(F.when(counted, F.col("n") * F.pow(F.col("mean") - grand, 2))).alias("between"),
        F.sum(F.when(counted, (F.col("n") - 1) * F.col("var"))).alias("within"))
    first, second = F.col("groups") - 1, F.col("n") - F.col("groups")
    ratio = F.try_divide(F.try_divide(F.col("between"), first), F.try_divide(F.col("within"), second))
    return _results(sums, keys, ratio, first, second, F.lit(None), F.col("groups") >= 2)


def _association(df, keys, keyed, _, first, second):
    """Cells that do not occur add nothing to the sum of squared shares, so only the pairs
    that occur are visited; the total of a 2 x 2 table's correction follows from its margins."""
    if first == second:
        raise ValueError("Choose two different fields.")
    require(df, first, second)
    cells = df.select(*keyed, comparable(df, first).alias("a"), comparable(df, second).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    joint = cells.groupBy(*keys, F.when(both, F.col("a")).alias("a"), F.when(both, F.col("b")).alias("b")).agg(
        F.count("*").cast("double").alias("o"))
    joint = joint.withColumn("o", F.when(F.col("a").isNotNull(), F.col("o")))
    sides = []
    for value, total in (("a", "ra"), ("b", "cb")):
        sides.append(joint.groupBy(*keys, value).agg(F.sum("o").alias(total)))
    placed = joint
    for side, value in zip(sides, ("a", "b")):
        placed = join_null_safe(placed, side, [*keys, value])
    margins = [
        side.groupBy(*keys).agg(F.count(total).alias(f"{value}s"), F.sum(1 / F.col(total)).alias(f"{value}i"), *(
            [F.coalesce(F.sum(total), F.lit(0.0)).alias("n")] if value == "a" else []))
        for side, value, total in zip(sides, ("a", "b"), ("ra", "cb"))
    ]
    if keys:
        totals = join_null_safe(margins[0], margins[1], keys)
        placed = join_null_safe(placed, totals, keys)
    else:
        packed = [m.select(F.struct("*").alias("s")).scalar() for m in margins]
        names = {n: packed[0].getField(n) for n in ("as", "ai", "n")} | {n: packed[1].getField(n) for n in ("bs", "bi")}
        placed = placed.withColumns(names)
    expected = F.col("ra") * F.col("cb") / F.col("n")
    told = placed.groupBy(*keys).agg(
        *[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in ("as", "bs", "n")], F.max("ai").alias("ai"), F.max("bi").alias("bi"),
        F.sum(F.pow(F.col("o") - expected, 2) / expected).alias("chi"), F.sum(expected).alias("e"),
        F.count("o").alias("present"), F.max(F.abs(F.col("o") - expected)).alias("deviation"))
    plain = F.col("chi") + F.when(F.col("as") * F.col("bs") > F.col("present"), F.col("n") - F.col("e")).otherwise(0.0)
    shift = F.least(F.lit(0.5), F.col("deviation"))
    corrected = F.pow(F.col("deviation") - shift, 2) * F.col("n") * F.col("ai") * F.col("bi")
    statistic = F.when((F.col("as") == 2) & (F.col("bs") == 2), corrected).otherwise(plain)
    degrees = F.greatest(F.least("as", "bs") - 1, F.lit(1))
    return _results(told, keys, statistic, (F.col("as") - 1) * (F.col("bs") - 1), F.lit(None),
                    F.sqrt(F.try_divide(statistic, F.col("n") * degrees)), (F.col("as") >= 2) & (F.col("bs") >= 2))


def _relationship(df, keys, keyed, x, _, y):
    require_numeric(df, x, y)
    pairs = df.select(*keyed, number(df, x).alias("x"), number(df, y).alias("y"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    a, b = F.when(both, F.col("x")), F.when(both, F.col("y"))
    sums = pairs.groupBy(*keys).agg(
        F.count_if(both).alias("n"), F.covar_samp(a, b).alias("c"), F.stddev_samp(a).alias("sa"), F.stddev_samp(b).alias("sb"))
    r = F.try_divide(F.col("c"), F.col("sa") * F.col("sb"))
    return _results(sums, keys, r, F.col("n") - 2, F.lit(None), r, F.col("n") >= 4)


# The names that results bear.
_TESTS = {
    TWO_GROUPS: ("Welch's t-test", "t", _welch),
    MANY_GROUPS: ("One-way ANOVA", "F", _anova),
    ASSOCIATION: ("Chi-square association test", "chi-square", _association),
    RELATIONSHIP: ("Pearson correlation test", "r", _relationship),
}
