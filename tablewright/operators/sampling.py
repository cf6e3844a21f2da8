"""Exact-size reproducible samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.functions.columns import ROW_ID, col, fields, require, text

SEED = 42
# Hexadecimal digits of a digest compared with the cut-off.
_DIGITS = 12


def sample_rows(
    df: DataFrame, n: int, key: list[str] | str | None = None, seed: int = SEED, total: int | None = None
) -> DataFrame:
    """Exactly ``n`` rows, or the whole table when it has fewer.

    Rows are taken in the order of a digest of ``seed`` and ``key``, so with a key
    that identifies rows the sample does not depend on the partitioning.  Without a
    key the readers' ``_row_id`` serves, else all fields do: rows that agree in all of
    them are equal, and it does not matter which of them is taken.

    Only rows below a cut-off on the digest are sorted.  The cut-off aims at a few
    times ``n`` rows; whether enough rows lie below it is counted, and the whole
    table is sorted otherwise.  A caller that knows the ``total`` saves the count.
    """
    keys = [key] if isinstance(key, str) else list(key or ([ROW_ID] if ROW_ID in df.columns else df.columns))
    require(df, *keys)
    parts = [F.lit(str(seed))]
    for name in keys:
        plain = name != ROW_ID and isinstance(df.schema[name].dataType, T.AtomicType)
        cell = text(df, name) if plain else F.to_json(F.struct(col(name)))
        parts.append(F.coalesce(cell, F.lit("")))
    order = F.md5(F.concat_ws(":", *parts))
    ranked = df.withColumn("__order", order)
    if total is None or 4 * n + 1000 < total:
        rows = F.lit(total) if total is not None else df.select(F.lit(1)).agg(F.count("*")).scalar()
        share = F.least((F.lit(4.0) * n + 1000) / F.greatest(rows, F.lit(1)), F.lit(1.0))
        # The share as a digest prefix; "g" follows every hexadecimal digit.
        prefix = F.lpad(F.lower(F.hex((share * 16**_DIGITS).cast("bigint"))), _DIGITS, "0")
        aim, everything = F.when(share < 1, prefix).otherwise("g"), F.lit("g")
        below = df.select(order.alias("__order")).agg(F.count_if(F.col("__order") < aim)).scalar()
        enough = below >= F.least(rows, F.lit(n))
        ranked = ranked.filter(F.col("__order") < F.when(enough, aim).otherwise(everything))
    return (
        ranked
        .orderBy("__order", *[col(name) for name in keys])
        .limit(int(n))
        .drop("__order")
    )


def evidence_sample(df: DataFrame, limit: int = 300, key: list[str] | str | None = None) -> tuple[DataFrame, str]:
    """All rows of a small table, else a reproducible sample, and a sentence saying which."""
    total = df.count()
    if total <= limit:
        return df, f"the whole table of {total:,} rows"
    return sample_rows(df, limit, key), f"{limit:,} of {total:,} rows, drawn reproducibly"


def data_only(df: DataFrame) -> DataFrame:
    return df.select(*[col(name) for name in fields(df)])
