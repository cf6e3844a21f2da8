"""Writing tables and their descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablewright.operators.quality import data_dictionary
from tablewright.operators.sampling import data_only


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One header line per part file; missing cells are empty."""
    data_only(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    data_only(df).write.mode(mode).parquet(path)


def write_data_dictionary(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(data_dictionary(df), path, mode)
