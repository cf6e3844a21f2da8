"""Row filters, text search and calculated fields."""

from __future__ import annotations

import ast
import operator as compare
import re
from datetime import datetime
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.columns import (
    col,
    field_type,
    fields,
    is_date,
    is_fractional,
    is_missing,
    is_numeric,
    literal_number,
    number,
    require,
    text,
)

# The conditions a filter may name.
ORDERINGS = {
    "greater than": compare.gt,
    "less than": compare.lt,
    "at least": compare.ge,
    "at most": compare.le,
}


def filter_rows(df: DataFrame, column: str, operator: str, value=None) -> DataFrame:
    """Keep the rows of one condition.  Missing cells satisfy only ``not equal``
    and ``is missing``."""
    return df.filter(condition(df, column, operator, value))


def condition(df: DataFrame, column: str, operator: str, value=None) -> Column:
    if operator not in ORDERINGS and operator not in _CONDITIONS:
        raise ValueError(f"Unsupported filter: {operator}")
    require(df, column)
    if operator in ORDERINGS:
        return _ordered(df, column, operator, value)
    return _CONDITIONS[operator](df, column, str(value))


def _equals(df: DataFrame, column: str, wanted: str) -> Column:
    """Equality with the printed form of a cell, decided on the driver so that the
    comparison itself stays typed and reaches the scan."""
    kind, cell = field_type(df, column), col(column)
    if isinstance(kind, T.StringType):
        return cell == wanted
    if isinstance(kind, T.BooleanType):
        return cell == (wanted == "True") if wanted in ("True", "False") else _never(cell)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        try:
            parsed = float(wanted)
        except ValueError:
            return _never(cell)
        if repr(parsed) != wanted or parsed != parsed:
            return _never(cell)
        return cell == F.lit(parsed).cast(kind)
    if isinstance(kind, T.IntegralType):
        exact = wanted.lstrip("-").isdigit() and str(int(wanted)) == wanted
        return cell == int(wanted) if exact and abs(int(wanted)) < 2**63 else _never(cell)
    if is_date(df, column):
        try:
            moment = datetime.fromisoformat(wanted)
        except ValueError:
            return _never(cell)
        return cell == F.lit(moment.isoformat(sep=" ")).cast(kind)
    return text(df, column) == wanted


def _never(cell: Column) -> Column:
    return cell.isNull() & cell.isNotNull()


def _ordered(df: DataFrame, column: str, operator: str, value) -> Column:
    if not is_numeric(df, column):
        raise ValueError(f"{operator} needs a numeric field: {column}")
    kept = ORDERINGS[operator](col(column), F.lit(literal_number(value)))
    # Spark orders NaN above every number; a missing cell must not match.
    above = operator in ("greater than", "at least")
    return kept & ~F.isnan(col(column)) if above and is_fractional(df, column) else kept


def _checked_pattern(df: DataFrame, pattern: str) -> str:
    """The pattern, ignoring case, once Spark has accepted it on one literal row."""
    chosen = "(?i)" + pattern
    try:
        df.sparkSession.range(1).select(F.lit("").rlike(chosen)).first()
    except PySparkException as problem:
        raise ValueError(f"Not a valid search pattern: {pattern}") from problem
    return chosen


def _matches(df: DataFrame, column: str, pattern: str) -> Column:
    return F.coalesce(text(df, column).rlike(pattern), F.lit(False))


_CONDITIONS = {
    "equals": _equals,
    "not equal": lambda df, column, value: is_missing(df, column) | ~_equals(df, column, value),
    "contains": lambda df, column, value: _matches(df, column, _checked_pattern(df, value)),
    "is missing": lambda df, column, _: is_missing(df, column),
    "is populated": lambda df, column, _: ~is_missing(df, column),
}


def search_all(df: DataFrame, query: str) -> DataFrame:
    """Keep the rows in which any field's text matches, ignoring case."""
    if not query:
        return df
    pattern = _checked_pattern(df, query)
    return df.filter(reduce(lambda a, b: a | b, [_matches(df, name, pattern) for name in fields(df)]))


def calculated(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Append an arithmetic combination of numeric fields, as double.

    Numbers, field names (in backticks if they are not plain words), ``+ - * / % **``,
    signs and parentheses are accepted.
    A nonzero number over zero is infinite and zero over zero is missing.
    """
    name = (name or "").strip()
    if not name or name in df.columns:
        raise ValueError("A calculated field needs a new, unique name.")
    quoted: dict[str, str] = {}

    def plain(match: re.Match) -> str:
        return quoted.setdefault(match.group(1), f"__field_{len(quoted)}")

    try:
        tree = ast.parse(re.sub(r"`([^`]+)`", plain, expression.strip()), mode="eval")
    except (SyntaxError, ValueError) as problem:
        raise ValueError(f"Not a valid formula: {expression}") from problem
    return df.withColumn(name, _arithmetic(df, tree.body, {word: field for field, word in quoted.items()}))


def _arithmetic(df: DataFrame, node: ast.expr, quoted: dict[str, str]) -> Column:
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return F.lit(float(node.value))
    if isinstance(node, ast.Name):
        name = quoted.get(node.id, node.id)
        require(df, name)
        if not is_numeric(df, name):
            raise ValueError(f"A formula may use numeric fields only: {name}")
        return number(df, name)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        operand = _arithmetic(df, node.operand, quoted)
        return -operand if isinstance(node.op, ast.USub) else operand
    if isinstance(node, ast.BinOp):
        left, right = _arithmetic(df, node.left, quoted), _arithmetic(df, node.right, quoted)
        if isinstance(node.op, ast.Add):
            return left + right
        if isinstance(node.op, ast.Sub):
            return left - right
        if isinstance(node.op, ast.Mult):
            return left * right
        if isinstance(node.op, ast.Div):
            return F.coalesce(F.try_divide(left, right), F.when((right == 0) & (left != 0), _infinity(left)))
        if isinstance(node.op, ast.Mod):
            return F.try_mod(left, right)
        if isinstance(node.op, ast.Pow):
            return F.pow(left, right)
    raise ValueError("A formula may use numbers, field names, + - * / % ** and parentheses only.")


def _infinity(numerator: Column) -> Column:
    return F.when(numerator > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
