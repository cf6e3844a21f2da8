"""KPI boards: many named aggregates of one table in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.columns import col, fields, is_numeric, require
from tablewright.operators.grouping import aggregate_column, check_aggregation, group_summary
from tablewright.operators.quantiles import quantile_table

BREAKDOWN_ROWS = 20
UNAVAILABLE = "Unavailable"


def kpi_definition(
    name: str, column: str, aggregation: str, target: float | None = None, prefix: str = "", suffix: str = "",
    decimals: int = 1, existing: list[dict] | None = None,
) -> dict:
    """A checked definition; names are unique without regard to case."""
    name = (name or "").strip()
    if not name:
        raise ValueError("A KPI needs a name.")
    if any(str(d["name"]).strip().lower() == name.lower() for d in existing or []):
        raise ValueError(f"A KPI named {name} already exists.")
    return {
        "name": name, "column": column, "aggregation": check_aggregation(aggregation), "target": target,
        "prefix": prefix, "suffix": suffix, "decimals": decimals,
    }


def evaluate_kpis(df: DataFrame, definitions: list[dict], group_rows: int | None = None) -> DataFrame:
    """``name, value, target, delta, display, delta_display`` of every KPI.

    All aggregates share one scan; the medians together make a second one.  A KPI
    whose field is absent, or which has no value, is shown as unavailable.
    """
    if not definitions:
        raise ValueError("Define at least one KPI.")
    known = set(fields(df))
    medians = sorted({
        d["column"] for d in definitions
        if d["column"] in known and check_aggregation(d["aggregation"]) == "median" and is_numeric(df, d["column"])
    })
    middle = None
    if medians:
        table = quantile_table(df, [], medians, [0.5], group_rows)
        middle = table.select(F.struct(*[col(m)[0].alias(f"m{i}") for i, m in enumerate(medians)])).scalar()

    def value(definition: dict) -> Column:
        column, aggregation = definition["column"], check_aggregation(definition["aggregation"])
        if column not in known:
            return F.lit(None).cast("double")
        if aggregation == "median":
            return F.max(F.lit(None).cast("double")) if column not in medians else F.max(
                middle.getField(f"m{medians.index(column)}")
            )
        return aggregate_column(df, column, aggregation).cast("double")

    values = df.agg(F.count("*").alias("__rows"), *[value(d).alias(f"k{i}") for i, d in enumerate(definitions)])
    return values.select(F.inline(F.array(*[_row(d, F.col(f"k{i}")) for i, d in enumerate(definitions)])))


def _row(definition: dict, value: Column) -> Column:
    finite = F.when(F.abs(value) < float("inf"), value)
    target = definition.get("target")
    goal = F.lit(None if target is None else float(target)).cast("double")
    delta = finite - goal
    decimals = int(definition.get("decimals", 1))
    prefix, suffix = str(definition.get("prefix") or ""), str(definition.get("suffix") or "")
    shown = F.concat(F.lit(prefix), F.format_number(finite, decimals), F.lit(suffix))
    sign = F.when(delta >= 0, "+").otherwise("")
    return F.struct(
        F.lit(definition["name"]).alias("name"),
        finite.alias("value"),
        goal.alias("target"),
        delta.alias("delta"),
        F.coalesce(shown, F.lit(UNAVAILABLE)).alias("display"),
        F.concat(sign, F.format_number(delta, 1), F.lit(" vs target")).alias("delta_display"),
    )


def kpi_breakdown(
    df: DataFrame, definition: dict, by: str, top: int = BREAKDOWN_ROWS, group_rows: int | None = None
) -> DataFrame:
    """The KPI per value of a field, missing included: the ``top`` largest, ascending."""
    column = definition["column"]
    require(df, column, by)
    table = group_summary(df, [by], [column], definition["aggregation"], group_rows)
    largest = table.filter(col(column).isNotNull()).orderBy(col(column).desc(), col(by).asc()).limit(top)
    return largest.orderBy(col(column).asc(), col(by).desc())
