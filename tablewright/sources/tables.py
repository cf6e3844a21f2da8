"""Reading delimited and Parquet files, with names and types settled on the way in."""

from __future__ import annotations

import csv
import functools
import itertools
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablewright.functions.columns import ROW_ID, col, fields, parse_integer, parse_number
from tablewright.functions.dates import NAME_HINTS, best_formats, parse_with
from tablewright.sources import quoted_lines

# Cell texts read as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Cell texts read as booleans when a field holds nothing else.
TRUE_TEXTS = ("True", "TRUE", "true")
FALSE_TEXTS = ("False", "FALSE", "false")
DATE_SHARE = 0.8


def clean_names(names: list[str]) -> list[str]:
    """Lower-case words joined by underscores, ``column`` for a blank name.

    A name that is taken gets the first number from 2 that makes it free, so all differ.
    """
    taken: dict[str, None] = {}
    for words in (re.findall(r"[^\s-]+", str(raw).lower()) for raw in names):
        plain = "_".join(words) or "column"
        choices = itertools.chain([plain], (f"{plain}_{number}" for number in itertools.count(2)))
        taken[next(choice for choice in choices if choice not in taken)] = None
    return list(taken)


def clean_column_names(df: DataFrame) -> DataFrame:
    names = fields(df)
    renamed = dict(zip(names, clean_names(names)))
    return df.toDF(*[renamed.get(n, n) for n in df.columns])


def read_csv(
    spark: SparkSession, path: str, encoding: str | None = None, infer: bool = True, row_id: bool = False
) -> DataFrame:
    """Read delimited text with a header line.

    One pass over the raw lines settles the encoding (UTF-8, else Latin-1) and
    whether quoted cells span lines; one aggregate over the cells settles every
    field's type.  Both are skipped with ``encoding`` given and ``infer=False``.
    Files with spanning cells are split like any other (see ``quoted_lines``); a
    line end inside a cell reads as ``\\n``.
    ``row_id`` attaches the file order as ``_row_id``.
    """
    lines = spark.read.text(path)
    heads = _first_lines(lines)
    if not heads:
        raise ValueError("The table has no rows or no fields.")
    checks = _line_checks(lines).first() if encoding is None else None
    if checks is not None:
        encoding = "UTF-8" if checks["undecodable"] == 0 else "ISO-8859-1"
    spanning = checks is not None and checks["open_lines"] > 0
    if spanning:
        whole, heads = _spanning_records(lines, heads, encoding)
    else:
        heads = [{"text": head["raw"].decode(encoding), "files": head["files"]} for head in heads]
    headers = [(_header(head["text"]), head["files"]) for head in heads]
    header = headers[0][0]
    if any(sorted(other) != sorted(header) for other, _ in headers):
        raise ValueError("The files do not have the same fields.")
    width = len(header)
    if checks is not None and not spanning and checks["widest"] > width:
        raise ValueError("A line holds more cells than the header.")
    names = [f"c{i}" for i in range(width)]
    source = T.StructType([T.StructField(n, T.StringType()) for n in names])
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    if spanning:
        parsed = whole.where("not head").select(
            F.from_csv("text", ", ".join(f"{n} string" for n in names), {"quote": '"', "escape": '"'}).alias("cells"),
            F.struct("file", "block", "line").alias("order"))
    # Files whose fields come in another order are read apart and put in the first one's.
    parts = []
    for other, files in headers:
        placed = [f"c{other.index(cell)}" for cell in header]
        if spanning:
            chosen = parsed if len(headers) == 1 else parsed.where(F.col("order.file").isin(list(files)))
            parts.append(chosen.select(*[F.col("cells")[c].alias(n) for n, c in zip(names, placed)], "order"))
        else:
            reader = spark.read.schema(source).option("header", True).option("quote", '"').option("escape", '"')
            chosen = reader.option("encoding", encoding).csv(path if len(headers) == 1 else list(files))
            parts.append(chosen.select(*[F.col(c).alias(n) for n, c in zip(names, placed)], order.alias("order")))
    raw = functools.reduce(DataFrame.unionByName, parts)
    cells = [F.when(~F.col(n).isin(*MISSING_TOKENS), F.col(n)).alias(n) for n in names]
    table = raw.select(*cells, *([F.col("order").alias(ROW_ID)] if row_id else []))
    table = table.toDF(*clean_names(header), *([ROW_ID] if row_id else []))
    return infer_datetime_columns(infer_types(table)) if infer else table


def _spanning_records(lines: DataFrame, heads, encoding: str):
    """The records of files whose quoted cells span lines, and their headers as text with their files."""
    whole = quoted_lines.records(lines, encoding, quoted_lines.borders(lines, encoding))
    texts = [{"text": head["raw"].decode(encoding), "files": head["files"]} for head in heads]
    if any(quoted_lines.is_left_open(head["text"].lstrip("\ufeff")) for head in texts):  # a header over several lines
        grouped = whole.where("head").groupBy("text").agg(F.sort_array(F.collect_list("file")).alias("files"))
        texts = sorted(grouped.collect(), key=lambda row: row["files"][0])
    return whole, texts


def _first_lines(lines: DataFrame):
    """The different first lines of the files, as bytes, each with the files that begin with it.

    A file's first line is its smallest position that holds text; one row a different
    line reaches the driver, with the names of files that Spark's listing holds anyway.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    told = lines.filter(F.length(F.trim("value")) > 0).select(
        F.col("_metadata.file_path").alias("file"), place.alias("place"), F.col("value").cast("binary").alias("raw"))
    firsts = told.groupBy("file").agg(F.min_by("raw", "place").alias("raw"))
    grouped = firsts.groupBy("raw").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return sorted(grouped.collect(), key=lambda row: row["files"][0])


def _header(line: str) -> list[str]:
    """The header cells; a blank one is named by its position, a repeat numbered."""
    names: list[str] = []
    for position, cell in enumerate(next(csv.reader([line.lstrip("\ufeff")]))):
        name = cell if cell.strip() else f"Unnamed: {position}"
        repeat = 0
        while (name if not repeat else f"{name}.{repeat}") in names:
            repeat += 1
        names.append(f"{name}.{repeat}" if repeat else name)
    return names


def _line_checks(lines: DataFrame) -> DataFrame:
    # The line without its closed quoted cells is made once, in a step of its own, and only
    # for lines with quotes; inside the aggregate every use would search the line again.
    quoted = F.when(F.contains("value", F.lit('"')), quoted_lines.outside_quotes(F.col("value")))
    bare = F.coalesce("quoted", "value")
    cells = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    return lines.select("value", quoted.alias("quoted")).agg(
        F.count_if(~F.is_valid_utf8("value")).alias("undecodable"),
        F.count_if(F.col("quoted").rlike(quoted_lines.OPENING)).alias("open_lines"),
        F.coalesce(F.max(F.when(F.length(F.trim("value")) > 0, cells)), F.lit(0)).alias("widest"),
    )


def infer_types(df: DataFrame) -> DataFrame:
    """Give each text field the narrowest type all its cells fit: whole number,
    number, boolean, text.  Whole numbers with gaps become doubles."""
    names = [n for n in fields(df) if isinstance(df.schema[n].dataType, T.StringType)]
    if not names:
        return df
    figures = []
    for i, n in enumerate(names):
        cell = col(n)
        figures += [
            F.count(cell).alias(f"n{i}"),
            F.count(parse_integer(cell)).alias(f"i{i}"),
            F.count(parse_number(cell)).alias(f"d{i}"),
            F.count_if(cell.isin(*TRUE_TEXTS, *FALSE_TEXTS)).alias(f"b{i}"),
        ]
    found = df.agg(F.count("*").alias("rows"), *figures).first()

    def typed(i: int, cell: Column) -> Column:
        count = found[f"n{i}"]
        if count == found[f"i{i}"] == found["rows"]:
            return parse_integer(cell)
        if count == found[f"d{i}"]:
            return parse_number(cell)
        if count == found[f"b{i}"]:
            return F.when(cell.isin(*TRUE_TEXTS), True).when(cell.isin(*FALSE_TEXTS), False)
        return cell

    return df.withColumns({n: typed(i, col(n)) for i, n in enumerate(names)})


def infer_datetime_columns(df: DataFrame) -> DataFrame:
    """Turn text fields named like dates into timestamps when four in five of their
    cells parse; cells that do not parse become missing."""
    hinted = [
        n for n in fields(df)
        if isinstance(df.schema[n].dataType, T.StringType) and any(hint in n.lower() for hint in NAME_HINTS)
    ]
    chosen = best_formats(df, hinted, DATE_SHARE)
    return df.withColumns({n: parse_with(col(n), form) for n, form in chosen.items() if form is not None})


def read_parquet(spark: SparkSession, path: str, row_id: bool = False) -> DataFrame:
    """Read Parquet with cleaned field names; ``row_id`` attaches the file order."""
    table = spark.read.parquet(path)
    if not row_id:
        return clean_column_names(table)
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("line"))
    return clean_column_names(table.select("*", order.alias(ROW_ID)))


def require_usable(df: DataFrame) -> DataFrame:
    """Reject a table without fields or rows."""
    if not fields(df) or df.isEmpty():
        raise ValueError("The table has no rows or no fields.")
    return df
