"""The tables behind the chart families: small, aggregated, ready to draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.columns import (
    col,
    join_null_safe,
    number,
    require,
    require_numeric,
    text,
)
from tablewright.operators.grouping import (
    RECORDS,
    group_summary,
    record_count,
    share_of_total,
    sort_rows,
    top_categories,
)
from tablewright.operators.quantiles import look_up, quantile_table
from tablewright.operators.sampling import sample_rows

RECORD_COUNT = "Record count"
MISSING_LABEL = "(Missing)"
POINT_LIMIT = 5000
MIN_BINS, MAX_BINS = 10, 80
MAX_HIERARCHY = 3


def label(df: DataFrame, name: str) -> Column:
    return F.coalesce(text(df, name), F.lit(MISSING_LABEL))


def _labelled_summary(
    df: DataFrame, grouping: list[str], measure: str, aggregation: str, group_rows: int | None
) -> tuple[DataFrame, str]:
    require(df, *grouping)
    counted = measure == RECORD_COUNT
    if not counted:
        require_numeric(df, measure)
    if measure in grouping:
        raise ValueError("A field cannot be both a category and a measure.")
    working = df.select(
        *[label(df, g).alias(g) for g in grouping], *([] if counted else [col(measure)])
    )
    if counted:
        return record_count(working, grouping), RECORDS
    return group_summary(working, grouping, [measure], aggregation, group_rows), measure


def summarize_chart_data(
    df: DataFrame,
    category: str,
    measure: str,
    aggregation: str = "sum",
    top_n: int = 15,
    series: str | None = None,
    group_rows: int | None = None,
) -> tuple[DataFrame, str]:
    """Aggregate a measure (or count records) per category and optional series, and
    keep the ``top_n`` categories by total.  Returns the table and its value column."""
    grouping = [category] + ([series] if series else [])
    table, value = _labelled_summary(df, grouping, measure, aggregation, group_rows)
    if series is None:
        # One row per category: its value is its total.
        total = F.coalesce(col(value), F.lit(0))
        return table.orderBy(total.desc(), col(category).asc()).limit(int(top_n)), value
    return top_categories(table, category, value, top_n), value


def _require_non_negative(table: DataFrame, value: str) -> None:
    # The table holds one row per drawn shape.
    if not table.filter(col(value) < 0).isEmpty():
        raise ValueError("This chart needs non-negative values.")


def category_table(
    df: DataFrame, category: str, measure: str = RECORD_COUNT, aggregation: str = "sum", top_n: int = 12,
    ascending: bool = False, **options,
) -> DataFrame:
    """Column, bar (``ascending``) and funnel charts."""
    table, value = summarize_chart_data(df, category, measure, aggregation, top_n, **options)
    return sort_rows(table, value, ascending=ascending)


def pie_table(
    df: DataFrame, category: str, measure: str = RECORD_COUNT, aggregation: str = "sum", top_n: int = 12, **options
) -> DataFrame:
    """Pie and doughnut charts; values must not be negative."""
    table = category_table(df, category, measure, aggregation, top_n, **options)
    _require_non_negative(table, table.columns[-1])
    return table


def stacked_table(
    df: DataFrame, category: str, series: str, measure: str = RECORD_COUNT, aggregation: str = "sum",
    share: bool = False, **options,
) -> DataFrame:
    """Grouped and stacked columns; ``share`` adds the percentage of the category."""
    table, value = summarize_chart_data(df, category, measure, aggregation, 15, series, **options)
    return share_of_total(table, category, value) if share else table


def radar_table(df: DataFrame, category: str, measure: str, aggregation: str = "sum", **options) -> DataFrame:
    return category_table(df, category, measure, aggregation, 12, **options)


def waterfall_table(df: DataFrame, category: str, measure: str, aggregation: str = "sum", **options) -> DataFrame:
    """The fifteen leading categories, largest magnitude first."""
    table, value = summarize_chart_data(df, category, measure, aggregation, 15, **options)
    return sort_rows(table, value, by_magnitude=True)


def hierarchy_table(
    df: DataFrame, hierarchy: list[str], measure: str = RECORD_COUNT, aggregation: str = "sum",
    group_rows: int | None = None,
) -> DataFrame:
    """Treemap and sunburst: one row per path of up to three fields."""
    hierarchy = list(hierarchy)
    if not 1 <= len(hierarchy) <= MAX_HIERARCHY:
        raise ValueError("Choose one to three hierarchy fields.")
    table, value = _labelled_summary(df, hierarchy, measure, aggregation, group_rows)
    _require_non_negative(table, value)
    return table


def point_table(
    df: DataFrame, x: str, y: str, color: str | None = None, size: str | None = None,
    key: list[str] | str | None = None, limit: int = POINT_LIMIT,
) -> DataFrame:
    """Scatter and bubble charts: a reproducible sample of points."""
    require_numeric(df, x, y, *([size] if size else []))
    keys = [key] if isinstance(key, str) else list(key or [])
    named = list(dict.fromkeys([x, y, *([color] if color else []), *([size] if size else []), *keys]))
    require(df, *named)
    kept = named + [n for n in df.columns if n == "_row_id" and n not in named]
    points = sample_rows(df.select(*[col(n) for n in kept]), limit, keys or None).select(*[col(n) for n in named])
    if size:
        points = points.withColumn("Bubble size", F.coalesce(F.abs(number(points, size)), F.lit(0.0)))
    return points


def histogram_table(df: DataFrame, value: str, bins: int = 30, segment: str | None = None) -> DataFrame:
    """Equal-width bins: ``bin, lower, upper, (segment,) count, density``."""
    require_numeric(df, value)
    if not MIN_BINS <= bins <= MAX_BINS:
        raise ValueError(f"Choose between {MIN_BINS} and {MAX_BINS} bins.")
    rows = df.select(number(df, value).alias("__v"), *([label(df, segment).alias(segment)] if segment else []))
    rows = rows.filter((F.col("__v").isNotNull()) & (F.abs("__v") < float("inf")))
    ends = rows.agg(F.struct(F.min("__v").alias("lo"), F.max("__v").alias("hi")).alias("e")).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")
    width = (hi - lo) / bins
    slot = F.when(width > 0, F.least(F.floor((F.col("__v") - lo) / width), F.lit(bins - 1)))
    keys = ["bin"] + ([segment] if segment else [])
    counted = rows.withColumn("bin", F.coalesce(slot, F.lit(0)).cast("int")).groupBy(
        *[col(k) for k in keys]
    ).agg(F.count("*").alias("count"))
    # Density is the share of the segment's rows per unit of the measure.
    if segment:
        totals = counted.groupBy(col(segment)).agg(F.sum("count").alias("__total"))
        counted = join_null_safe(counted, totals, [segment])
        total = F.col("__total")
    else:
        total = rows.agg(F.count("*")).scalar()
    return counted.select(
        "bin",
        (lo + width * F.col("bin")).alias("lower"),
        (lo + width * (F.col("bin") + 1)).alias("upper"),
        *([col(segment)] if segment else []),
        "count",
        F.try_divide(F.col("count"), total * width).alias("density"),
    )


def box_table(
    df: DataFrame, value: str, segment: str | None = None, group_rows: int | None = None
) -> DataFrame:
    """Five-number summary, fences and outlier count per segment."""
    rows = _with_quartiles(_segmented(df, value, segment), group_rows)
    table = rows.groupBy("segment", "q1", "median", "q3").agg(
        F.count("*").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.count_if(_outside()).alias("outliers"),
    )
    return table.select(
        *(["segment"] if segment else []), "count", "min", "q1", "median", "q3", "max",
        _fence("q1", -1).alias("lower_fence"), _fence("q3", 1).alias("upper_fence"), "outliers",
    )


def box_outliers(
    df: DataFrame, value: str, segment: str | None = None, group_rows: int | None = None
) -> DataFrame:
    """The points drawn beyond the fences: ``segment, value``."""
    rows = _with_quartiles(_segmented(df, value, segment), group_rows)
    return rows.filter(_outside()).select("segment", F.col("v").alias("value"))


def _segmented(df: DataFrame, value: str, segment: str | None) -> DataFrame:
    require_numeric(df, value)
    name = label(df, segment) if segment else F.lit("All")
    rows = df.select(name.alias("segment"), number(df, value).alias("v"))
    return rows.filter(F.col("v").isNotNull())


def _with_quartiles(rows: DataFrame, group_rows: int | None) -> DataFrame:
    quartiles = quantile_table(rows, ["segment"], ["v"], [0.25, 0.5, 0.75], group_rows).select(
        "segment", F.col("v")[0].alias("q1"), F.col("v")[1].alias("median"), F.col("v")[2].alias("q3")
    )
    return look_up(rows, quartiles, ["segment"])


def _fence(quartile: str, side: int) -> Column:
    return F.col(quartile) + side * 1.5 * (F.col("q3") - F.col("q1"))


def _outside() -> Column:
    return (F.col("v") < _fence("q1", -1)) | (F.col("v") > _fence("q3", 1))
