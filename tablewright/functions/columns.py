"""Column-level vocabulary shared by every operator.

Two conventions hold throughout the package:

* *Missing* means NULL or NaN.  Spark orders NaN above every number, so each
  operator reads its inputs through :func:`populated`, which maps NaN to NULL.
* ``_row_id`` is an optional ordering column attached by the readers.  It is
  carried along but is never treated as data.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

ROW_ID = "_row_id"


class FieldGroups(NamedTuple):
    numeric: list[str]
    categorical: list[str]
    dates: list[str]


def col(name: str) -> Column:
    """Reference a column whose name may hold dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def fields(df: DataFrame) -> list[str]:
    """Names of the data columns, without the ordering column."""
    return [name for name in df.columns if name != ROW_ID]


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def require(df: DataFrame, *names: str) -> None:
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"Unknown field: {', '.join(map(str, absent))}")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(field_type(df, name), T.NumericType)


def is_date(df: DataFrame, name: str) -> bool:
    return isinstance(field_type(df, name), (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_fractional(df: DataFrame, name: str) -> bool:
    return isinstance(field_type(df, name), T.FractionalType) and not isinstance(
        field_type(df, name), T.DecimalType
    )


def require_numeric(df: DataFrame, *names: str) -> None:
    require(df, *names)
    wrong = [name for name in names if not is_numeric(df, name)]
    if wrong:
        raise ValueError(f"A numeric field is required: {', '.join(wrong)}")


def column_groups(df: DataFrame) -> FieldGroups:
    """Split the fields into numeric, date and everything else, from the schema alone."""
    names = fields(df)
    numeric = [name for name in names if is_numeric(df, name)]
    dates = [name for name in names if is_date(df, name)]
    return FieldGroups(numeric, [n for n in names if n not in numeric and n not in dates], dates)


def populated(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL."""
    column = col(name)
    return F.nanvl(column, F.lit(None)) if is_fractional(df, name) else column


def number(df: DataFrame, name: str) -> Column:
    """A numeric column as double, NaN read as NULL."""
    return populated(df, name).cast("double")


def finite(df: DataFrame, name: str) -> Column:
    """A numeric column as double with NaN and both infinities read as NULL."""
    value = number(df, name)
    return F.when(F.abs(value) < float("inf"), value)


def is_missing(df: DataFrame, name: str) -> Column:
    column = col(name)
    return column.isNull() | F.isnan(column) if is_fractional(df, name) else column.isNull()


def comparable(df: DataFrame, name: str) -> Column:
    """A grouping or join key: NaN as NULL, negative zero as zero."""
    return populated(df, name) + F.lit(0.0) if is_fractional(df, name) else col(name)


def text(df: DataFrame, name: str) -> Column:
    """Render a cell the way Python prints it; missing stays NULL."""
    kind, column = field_type(df, name), populated(df, name)
    if isinstance(kind, T.BooleanType):
        return F.initcap(column.cast("string"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _float_text(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        micros = F.date_format(column, "SSSSSS")
        return F.concat(
            F.date_format(column, "yyyy-MM-dd HH:mm:ss"),
            F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
        )
    return column.cast("string")


def _float_text(column: Column) -> Column:
    # Spark switches to scientific notation at 1e7 and below 1e-3, Python at
    # 1e16 and below 1e-4; only the cells in scientific notation are rebuilt.
    shown = column.cast("string")
    magnitude = F.abs(column)
    digits = F.regexp_replace(column.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    positional = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    exponent = F.split_part(shown, F.lit("E"), F.lit(2)).try_cast("int")
    scientific = F.concat(
        F.regexp_replace(F.split_part(shown, F.lit("E"), F.lit(1)), r"\.0$", ""),
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    return (
        F.when(magnitude == float("inf"), F.when(column > 0, "inf").otherwise("-inf"))
        .when(~shown.contains("E"), shown)
        .when((magnitude >= 1e-4) & (magnitude < 1e16), positional)
        .otherwise(scientific)
    )


# Fixed value: the spelling of a number accepted in text cells (surrounding
# blanks, sign, decimals, exponent, infinity); no thousands separators and no
# Java literal suffixes.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"


def parse_number(column: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL."""
    return F.when(column.rlike(NUMBER_PATTERN), F.trim(column).try_cast("double"))


def parse_integer(column: Column) -> Column:
    return F.when(column.rlike(INTEGER_PATTERN), F.trim(column).try_cast("bigint"))


def literal_number(value) -> int | float:
    """Parse a user-supplied number on the driver; raise ``ValueError`` when it is not one."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)):
        return value
    try:
        return int(str(value).strip())
    except ValueError:
        return float(str(value).strip())


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a DataFrame, or None where it cannot be read.

    The optimizer derives it from file sizes.  It does not know how far a generator or a
    join expands its input, so plans that hold more than scans, filters, projections and
    steps that never add rows have no estimate.
    """
    if not hasattr(df, "_jdf"):  # no JVM handle, as under Spark Connect
        return None
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes())) if _never_grows(plan) else None


_BOUNDED_NODES = {
    "LogicalRelation", "Relation", "LocalRelation", "LogicalRDD", "Range", "Project", "Filter", "Aggregate",
    "Sort", "GlobalLimit", "LocalLimit", "Distinct", "Window", "Union", "RepartitionByExpression", "Repartition",
    "InMemoryRelation",
}


def _never_grows(plan) -> bool:
    children = plan.children()
    return plan.nodeName() in _BOUNDED_NODES and all(_never_grows(children.apply(i)) for i in range(children.size()))


def is_small(df: DataFrame, limit: int) -> bool:
    size = plan_bytes(df)
    return size is not None and size <= limit


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys under which missing keys match each other.

    The right keys are renamed first, so both sides may share a lineage, and
    dropped afterwards; inner, left, left_semi and left_anti joins only.
    """
    renamed = right.withColumnsRenamed({key: f"__right_{i}" for i, key in enumerate(on)})
    condition = None
    for i, key in enumerate(on):
        term = col(key).eqNullSafe(col(f"__right_{i}"))
        condition = term if condition is None else condition & term
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__right_{i}" for i in range(len(on))])
