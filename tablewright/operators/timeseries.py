"""Resampling of a measure to calendar periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions.columns import (
    col,
    comparable,
    is_date,
    populated,
    require,
    require_numeric,
)
from tablewright.operators.grouping import aggregate_column, check_aggregation
from tablewright.operators.quantiles import quantile_table

# The step between period starts.
STEPS = {
    "Day": "interval 1 day",
    "Week": "interval 7 days",
    "Month": "interval 1 month",
    "Quarter": "interval 3 months",
    "Year": "interval 1 year",
}


def check_frequency(frequency: str) -> str:
    if frequency not in STEPS:
        raise ValueError(f"Unsupported frequency: {frequency}")
    return frequency


def period_start(moment: Column, frequency: str) -> Column:
    return F.to_date(F.date_trunc(frequency.lower(), moment))


def period_end(start: Column, frequency: str) -> Column:
    """The label of a period: its last day, Sunday for weeks."""
    return {
        "Day": start,
        "Week": F.date_add(start, 6),
        "Month": F.last_day(start),
        "Quarter": F.last_day(F.add_months(start, 2)),
        "Year": F.last_day(F.add_months(start, 11)),
    }[frequency]


def resample(
    df: DataFrame,
    date: str,
    value: str,
    frequency: str,
    aggregation: str = "sum",
    series: list[str] | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """One row per calendar period, labelled by the period's last day.

    Rows missing the date or the value are left out.  Periods without rows between
    the first and the last are present: their sum is 0, other aggregates missing.
    ``series`` resamples many series at once.
    """
    series = list(series or [])
    aggregation = check_aggregation(aggregation)
    check_frequency(frequency)
    require(df, date, *series)
    if not is_date(df, date):
        raise ValueError(f"A date field is required: {date}")
    require_numeric(df, value)
    rows = df.select(
        *[comparable(df, s).alias(s) for s in series],
        period_start(col(date), frequency).alias("__start"),
        populated(df, value).alias("__value"),
    ).filter(col("__start").isNotNull() & col("__value").isNotNull())
    keys = [*series, "__start"]
    if aggregation == "median":
        periods = quantile_table(rows, keys, ["__value"], [0.5], group_rows).withColumn(
            "__value", col("__value")[0]
        )
    else:
        periods = rows.groupBy(*[col(k) for k in keys]).agg(
            aggregate_column(rows, "__value", aggregation).alias("__value")
        )
    # One row per period is left here: the gap up to the next period is filled by
    # looking one period ahead, without a second pass or a join.
    ahead = Window.partitionBy(*[col(s) for s in series]).orderBy("__start")
    step = F.expr(STEPS[frequency])
    until = F.coalesce(F.lead("__start").over(ahead), col("__start") + step) - F.expr("interval 1 day")
    filler = F.lit(0) if aggregation in ("sum", "count") else F.lit(None)
    return (
        periods.withColumn("__until", F.to_date(until))
        .withColumn("__slot", F.explode(F.sequence("__start", "__until", step)))
        .select(
            *[col(s) for s in series],
            period_end(F.to_date("__slot"), frequency).alias(date),
            F.when(col("__slot") == col("__start"), col("__value")).otherwise(filler).alias(value),
        )
    )
