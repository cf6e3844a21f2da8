"""Missing values, duplicates, type corrections and outlier treatment."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.columns import (
    ROW_ID,
    col,
    comparable,
    field_type,
    fields,
    is_date,
    is_missing,
    is_numeric,
    literal_number,
    number,
    parse_number,
    populated,
    require,
    require_numeric,
    text,
)
from tablewright.functions.dates import best_formats, parse_with
from tablewright.operators.quantiles import quantile_table


def treat_missing(df: DataFrame, column: str, method: str, value=None) -> DataFrame:
    """Drop the rows missing a field, drop the field, or fill its gaps."""
    require(df, column)
    if method == "Drop column":
        return drop_field(df, column)
    if method == "Drop rows":
        return df.filter(~is_missing(df, column))
    if method == "Custom value":
        return _fill(df, column, _custom(df, column, value))
    if method not in _REPLACEMENTS:
        raise ValueError(f"Unsupported missing-value treatment: {method}")
    return _fill(df, column, _REPLACEMENTS[method](df, column))


def _mean(df: DataFrame, column: str) -> Column:
    require_numeric(df, column)
    return _settled(df.agg(F.avg(number(df, column)).alias("value")))


def _median(df: DataFrame, column: str) -> Column:
    return _settled(quantile_table(df, [], [column], [0.5]).select(col(column)[0].alias("value")))


def _settled(one_row: DataFrame) -> Column:
    """The ``value`` of a one-row summary as a constant.

    Read once, it keeps a chain of steps linear: a step's plan would otherwise hold a
    copy of all steps before it for every figure that it needs.
    """
    return F.lit(one_row.first()["value"]).cast(one_row.schema["value"].dataType)


def _mode(df: DataFrame, column: str) -> Column:
    value = mode_value(df, column)
    # A date goes back as text: a Python time literal would pass through a time zone.
    return F.lit(str(value)).cast(field_type(df, column)) if is_date(df, column) else F.lit(value)


_REPLACEMENTS = {"Mean": _mean, "Median": _median, "Mode": _mode}


def _fill(df: DataFrame, column: str, replacement: Column) -> DataFrame:
    return df.withColumn(column, F.coalesce(populated(df, column), replacement))


def mode_value(df: DataFrame, column: str):
    """The most frequent value, the smallest on ties."""
    cell = comparable(df, column)
    top = (
        df.select(cell.alias("v")).filter(F.col("v").isNotNull())
        .groupBy("v").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc("v")).limit(1).collect()
    )
    if not top:
        raise ValueError(f"{column} holds no value to use as its mode.")
    return top[0]["v"]


def _custom(df: DataFrame, column: str, value) -> Column:
    kind = field_type(df, column)
    if is_numeric(df, column):
        return F.lit(literal_number(value))
    if isinstance(kind, T.BooleanType):
        flag = BOOLEAN_WORDS.get(str(value).strip().lower())
        if flag is None:
            raise ValueError(f"{value!r} is not a boolean.")
        return F.lit(flag)
    if is_date(df, column):
        moment = value if isinstance(value, datetime) else datetime.fromisoformat(str(value).strip())
        return F.lit(moment.isoformat(sep=" ")).cast(kind)
    return F.lit(str(value))


def drop_field(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.drop(column)


def deduplicate(df: DataFrame, subset: list[str] | None = None, keep="first", order_by=None) -> DataFrame:
    """Drop duplicate rows; missing values count as equal.

    ``keep`` is ``"first"``, ``"last"`` or ``False`` (drop every copy).  First and
    last follow ``order_by``, else the readers' ``_row_id``, else the remaining
    fields in schema order, so the survivor never depends on the partitioning.

    The survivor is an ordered minimum, which combines map-side: a key holding
    a third of the table reaches the reducer as one row per task.
    """
    if keep not in ("first", "last", False):
        raise ValueError(f"Unsupported choice of the record to keep: {keep}")
    data = fields(df)
    subset = list(subset or [])
    require(df, *subset)
    order = [order_by] if isinstance(order_by, str) else list(order_by or [])
    require(df, *order)
    keys = subset or data
    rest = [name for name in df.columns if name not in keys]
    if not order and ROW_ID in rest:
        order = [ROW_ID]
    lead = [name for name in order if name not in keys]
    carried = lead + [name for name in rest if name not in lead]
    row = F.struct(*[col(name) for name in carried]) if carried else F.lit(None)
    survivor = F.max(row) if keep == "last" else F.min(row)
    # Negative zero groups with zero and NaN with NULL, as in every other operator.
    grouped = df.groupBy(*[comparable(df, name).alias(name) for name in keys])
    if keep is False:
        survivors = grouped.agg(F.count("*").alias("__copies"), survivor.alias("__row")).filter(
            F.col("__copies") == 1
        )
    else:
        survivors = grouped.agg(survivor.alias("__row"))
    return survivors.select(
        *[col(name) if name in keys else F.col("__row")[name].alias(name) for name in df.columns]
    )


# The words read as booleans, in lower case.
BOOLEAN_WORDS = {
    "true": True, "1": True, "yes": True, "y": True,
    "false": False, "0": False, "no": False, "n": False,
}


def convert_type(df: DataFrame, column: str, target: str, format: str | None = None) -> DataFrame:
    """Convert a field; cells that cannot be converted become missing.

    ``format`` names the format of date text and saves the pass that finds it.
    """
    require(df, column)
    if target not in _CONVERSIONS:
        raise ValueError(f"Unsupported type: {target}")
    return df.withColumn(column, _CONVERSIONS[target](df, column, format))


def _to_boolean(df: DataFrame, column: str) -> Column:
    words = {flag: [w for w, f in BOOLEAN_WORDS.items() if f is flag] for flag in (True, False)}
    word = F.lower(text(df, column))
    return F.when(word.isin(words[True]), True).when(word.isin(words[False]), False)


def _to_number(df: DataFrame, column: str) -> Column:
    kind = field_type(df, column)
    if is_numeric(df, column):
        return populated(df, column)
    if isinstance(kind, T.StringType):
        return parse_number(col(column))
    if isinstance(kind, T.BooleanType):
        return col(column).cast("int").cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(col(column)).cast("bigint") * 86_400_000_000_000
    return F.unix_micros(col(column).cast("timestamp")) * 1000


def _to_timestamp(df: DataFrame, column: str, format: str | None) -> Column:
    kind = field_type(df, column)
    if is_date(df, column):
        return col(column) if not isinstance(kind, T.DateType) else col(column).cast("timestamp_ntz")
    if isinstance(kind, T.NumericType):
        # A plain number is a count of nanoseconds since 1970.
        micros = F.floor(number(df, column) / 1000).cast("bigint")
        return F.timestamp_micros(micros).cast("timestamp_ntz")
    if not isinstance(kind, T.StringType):
        raise ValueError(f"{column} cannot be read as a date.")
    chosen = format or best_formats(df, [column])[column]
    return F.lit(None).cast("timestamp_ntz") if chosen is None else parse_with(col(column), chosen)


_CONVERSIONS = {
    "Number": lambda df, column, format: _to_number(df, column),
    "Date/time": _to_timestamp,
    "Text": lambda df, column, format: text(df, column),
    # Parquet dictionary-encodes text; the metadata remembers the choice.
    "Category": lambda df, column, format: text(df, column).alias(column, metadata={"category": True}),
    "Boolean": lambda df, column, format: _to_boolean(df, column),
}


def treat_outliers(
    df: DataFrame, column: str, method: str, factor: float = 1.5, group_rows: int | None = None
) -> DataFrame:
    """Cap, remove or blank the values beyond ``factor`` interquartile ranges."""
    require_numeric(df, column)
    if method not in ("Cap values", "Remove rows", "Replace with missing"):
        raise ValueError(f"Unsupported outlier treatment: {method}")
    bounds = outlier_bounds(df, column, factor, group_rows).first()
    lower, upper = F.lit(bounds["lower"]).cast("double"), F.lit(bounds["upper"]).cast("double")
    value = populated(df, column)
    inside = value.between(lower, upper)
    if method == "Remove rows":
        return df.filter(value.isNull() | inside)
    if method == "Cap values":
        wide = value.cast("double")
        return df.withColumn(column, F.when(wide < lower, lower).when(wide > upper, upper).otherwise(wide))
    return df.withColumn(column, F.when(inside, value))


def outlier_bounds(
    df: DataFrame, column: str, factor: float = 1.5, group_rows: int | None = None
) -> DataFrame:
    """One row: q1, q3, lower, upper."""
    quartiles = quantile_table(df, [], [column], [0.25, 0.75], group_rows).select(
        col(column)[0].alias("q1"), col(column)[1].alias("q3")
    )
    spread = float(factor) * (F.col("q3") - F.col("q1"))
    return quartiles.select(
        "q1", "q3", (F.col("q1") - spread).alias("lower"), (F.col("q3") + spread).alias("upper")
    )
