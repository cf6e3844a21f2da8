"""Recognising and parsing date text.

One format is chosen per field, the one that reads most of its cells; cells in any other
format become missing, so day-first and month-first text are never mixed in a field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.columns import col

# The date formats recognised, ISO first and month before day.
ISO_FORMAT = "iso"
DATE_FORMATS = (
    "yyyy/M/d",
    "yyyy-M-d",
    "M/d/yyyy",
    "M/d/yyyy H:m",
    "M/d/yyyy H:m:s",
    "M-d-yyyy",
    "d/M/yyyy",
    "d/M/yyyy H:m",
    "d/M/yyyy H:m:s",
    "d-M-yyyy",
    "d.M.yyyy",
    "yyyyMMdd",
    "d MMM yyyy",
    "d-MMM-yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMMM yyyy",
    "MMM yyyy",
    "MMMM yyyy",
    "yyyy-MM",
)
NAME_HINTS = ("date", "time", "month", "year")

# ISO text: a date, optionally a time with fraction and zone.
_ISO_PATTERN = (
    r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?\s*$"
)


def parse_with(column: Column, format: str) -> Column:
    """Text to timestamp without zone under one format; NULL where it does not fit."""
    cell = F.trim(column)
    if format == ISO_FORMAT:
        return F.when(column.rlike(_ISO_PATTERN), cell.try_cast("timestamp").cast("timestamp_ntz"))
    if format in ("MMM yyyy", "MMMM yyyy", "yyyy-MM"):
        cell, format = F.concat(F.lit("1 "), cell), "d " + format
    return F.try_to_timestamp(cell, F.lit(format)).cast("timestamp_ntz")


_DIGITS = "0123456789"
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _marks(column: Column) -> Column:
    """What a trimmed cell keeps without its digits (a long year may have a plus sign)."""
    return F.translate(F.trim(column), _DIGITS + "+", "")


def _may_fit(format: str, cell: Column, marks: Column, bare: Column) -> Column:
    """Whether a cell's separators are those of the format: false only for cells the
    format cannot read.  ``bare`` are the marks without letters.

    Failed parses cost an exception each; this test costs a comparison of short strings.
    """
    expected = "".join(c for c in format if not c.isalpha())
    if "MMM" in format:
        return (bare == expected) & (marks != bare)
    fits = marks == expected
    if expected[:1] in ("/", "-", ".") and len(expected) > 1:
        # A year has four digits or more; a shorter number reaches that with leading zeros only.
        long_first = F.instr(cell, expected[0]) > 4
        fits = fits & (long_first if format.startswith("yyyy") else ~long_first | cell.startswith("0"))
    return fits


def best_formats(df: DataFrame, columns: list[str], least_share: float = 0.0) -> dict[str, str | None]:
    """For each text field the format that reads most of its cells, the earlier one on
    ties; None when it reads none of them or less than ``least_share``.

    One aggregate over all cells serves all fields; it does not depend on their order.
    Every cell counts, but only under the formats that share its separators.
    """
    candidates = [ISO_FORMAT, *DATE_FORMATS]
    if not columns:
        return {}
    cells = df.select(*[col(name).alias(f"v{k}") for k, name in enumerate(columns)])
    places = range(len(columns))
    cells = cells.withColumns({f"t{k}": F.trim(f"v{k}") for k in places})
    cells = cells.withColumns({f"m{k}": _marks(F.col(f"v{k}")) for k in places})
    cells = cells.withColumns({f"b{k}": F.translate(f"m{k}", _LETTERS, "") for k in places})

    def reads(k: int, form: str) -> Column:
        value = parse_with(F.col(f"v{k}"), form)
        if form == ISO_FORMAT:
            return F.count(F.when(F.startswith(F.col(f"m{k}"), F.lit("--")), value))
        return F.count(F.when(_may_fit(form, F.col(f"t{k}"), F.col(f"m{k}"), F.col(f"b{k}")), value))

    counts = [F.count(f"v{k}").alias(f"n{k}") for k in places]
    counts += [reads(k, form).alias(f"c{k}_{i}") for k in places for i, form in enumerate(candidates)]
    found = cells.agg(*counts).first()
    chosen: dict[str, str | None] = {}
    for k, name in enumerate(columns):
        reading = [found[f"c{k}_{i}"] for i in range(len(candidates))]
        most = max(reading)
        usable = most > 0 and most >= least_share * found[f"n{k}"]
        chosen[name] = candidates[reading.index(most)] if usable else None
    return chosen
