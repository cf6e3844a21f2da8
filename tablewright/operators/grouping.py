"""Group-by summaries, pivots, reshaping, shares and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablewright.functions.columns import (
    col,
    column_groups,
    comparable,
    field_type,
    fields,
    is_numeric,
    join_null_safe,
    number,
    populated,
    require,
    require_numeric,
    text,
)
from tablewright.operators.quantiles import describe_quantiles, look_up, quantile_table

AGGREGATIONS = ("sum", "mean", "median", "min", "max", "count")
RECORDS = "Records"
# A pivot column is a column of the result; Spark's own limit on them.
MAX_PIVOT_KEYS = 10_000
# Texts beyond this many characters are compared by digest.
LONG_TEXT = 64
#: Lists of leaders up to this many rows carry a broadcast hint.
MAX_HINTED = 10_000


def check_aggregation(aggregation: str) -> str:
    name = str(aggregation).lower()
    if name not in AGGREGATIONS:
        raise ValueError(f"Unsupported calculation: {aggregation}")
    return name


def aggregate_column(df: DataFrame, measure: str, aggregation: str) -> Column:
    """One aggregate expression; every one but the median, which has its own plan."""
    if aggregation == "count":
        return F.count(populated(df, measure))
    if aggregation in ("min", "max"):
        return (F.min if aggregation == "min" else F.max)(populated(df, measure))
    if not is_numeric(df, measure):
        raise ValueError(f"A numeric field is required: {measure}")
    if aggregation == "sum":
        return F.coalesce(F.sum(populated(df, measure)), F.lit(0))
    if isinstance(field_type(df, measure), T.DecimalType):
        return F.try_divide(F.sum(col(measure)).cast("double"), F.count(col(measure)))
    return F.avg(number(df, measure))


def group_summary(
    df: DataFrame,
    groups: list[str],
    values: list[str],
    aggregation: str,
    group_rows: int | None = None,
) -> DataFrame:
    """One row per group, missing groups included; each measure keeps its name.

    The sum of no value is 0, the other aggregates of no value are missing.
    """
    groups, values = list(groups), list(values)
    aggregation = check_aggregation(aggregation)
    if not groups or not values:
        raise ValueError("Choose at least one grouping field and one measure.")
    require(df, *groups, *values)
    repeated = [name for name in values if name in groups]
    if repeated or len(set(groups)) < len(groups) or len(set(values)) < len(values):
        raise ValueError("A field cannot be used twice in a summary.")
    if aggregation == "median":
        table = quantile_table(df, groups, values, [0.5], group_rows)
        return table.select(*[col(g) for g in groups], *[col(v)[0].alias(v) for v in values])
    return df.groupBy(*[comparable(df, g).alias(g) for g in groups]).agg(
        *[aggregate_column(df, v, aggregation).alias(v) for v in values]
    )


def record_count(df: DataFrame, groups: list[str], name: str = RECORDS) -> DataFrame:
    require(df, *groups)
    return df.groupBy(*[comparable(df, g).alias(g) for g in groups]).agg(F.count("*").alias(name))


def pivot_table(
    df: DataFrame,
    index: list[str] | str,
    columns: str,
    values: list[str] | str,
    aggregation: str,
    fill_value=0,
    pivot_values: list | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """Spread the values of one field into columns.

    Rows with a missing index or column key are left out; cells without a value
    hold ``fill_value``.  Columns are named after the key, or ``value_key`` when
    ``values`` is a list.  ``pivot_values`` names the keys and saves their look-up.
    """
    index = [index] if isinstance(index, str) else list(index)
    many = not isinstance(values, str)
    measures = list(values) if many else [values]
    aggregation = check_aggregation(aggregation)
    if not index or not measures:
        raise ValueError("A pivot table needs at least one row field and one value field.")
    require(df, *index, columns, *measures)
    if len({*index, columns, *measures}) < len(index) + 1 + len(measures):
        raise ValueError("A field cannot be used twice in a pivot table.")

    present = col("__key").isNotNull()
    for name in index:
        present = present & populated(df, name).isNotNull()
    if aggregation in ("mean", "median", "min", "max"):
        # Groups without any value are dropped, not filled.
        some = F.coalesce(*[populated(df, m).cast("string") for m in measures]).isNotNull()
        present = present & some
    rows = df.withColumn("__key", comparable(df, columns)).filter(present)
    labels = text(df, columns).alias("__label")
    if pivot_values is None:
        keyed = rows.select("__key", labels).distinct().orderBy("__key").limit(MAX_PIVOT_KEYS + 1).collect()
        if len(keyed) > MAX_PIVOT_KEYS:
            raise ValueError(f"A pivot table holds at most {MAX_PIVOT_KEYS:,} columns.")
        pairs = [(r["__key"], r["__label"]) for r in keyed]
    else:
        listed = df.sparkSession.createDataFrame([(v,) for v in pivot_values], T.StructType(
            [T.StructField(columns, field_type(df, columns))]
        ))
        pairs = [(v, r[0]) for v, r in zip(pivot_values, listed.select(text(listed, columns)).collect())]
    if not pairs:
        raise ValueError("The pivot table would hold no column.")

    if aggregation == "median":
        cells = quantile_table(rows, [*index, "__key"], measures, [0.5], group_rows)
        cells = cells.withColumns({m: col(m)[0] for m in measures})
    else:
        cells = rows.groupBy(*[comparable(df, n).alias(n) for n in index], "__key").agg(
            *[aggregate_column(df, m, aggregation).alias(m) for m in measures]
        )
    wide = cells.groupBy(*[col(n) for n in index]).pivot("__key", [k for k, _ in pairs]).agg(
        *[F.first(col(m)).alias(m) for m in measures]
    )
    names = [f"{m}_{label}".strip("_") if many else label for _, label in pairs for m in measures]
    if len({*index, *names}) < len(index) + len(names):
        raise ValueError("The pivot table would repeat a field name.")
    result = wide.toDF(*index, *names)
    if many:
        names = [f"{m}_{label}".strip("_") for m in measures for _, label in pairs]
    if fill_value is None:
        return result.select(*[col(n) for n in [*index, *names]])
    return result.select(*[col(n) for n in index], *[F.coalesce(col(n), F.lit(fill_value)).alias(n) for n in names])


def melt(
    df: DataFrame,
    id_vars: list[str],
    value_vars: list[str],
    var_name: str = "measure",
    value_name: str = "value",
) -> DataFrame:
    """Wide to long: one row per row and stacked field, missing values kept."""
    id_vars, value_vars = list(id_vars), list(value_vars)
    require(df, *id_vars, *value_vars)
    if not value_vars:
        raise ValueError("Choose at least one field to stack.")
    if set(id_vars) & set(value_vars):
        raise ValueError("A field cannot be both an identifier and a stacked field.")
    if not var_name.strip() or not value_name.strip() or var_name == value_name:
        raise ValueError("The two new fields need different names.")
    if {var_name, value_name} & set(id_vars):
        raise ValueError("A new field has the name of an identifier.")
    if all(is_numeric(df, v) for v in value_vars) or len({field_type(df, v).simpleString() for v in value_vars}) == 1:
        stacked = [col(v) for v in value_vars]
    else:
        stacked = [text(df, v).alias(v) for v in value_vars]
    return df.select(*[col(i) for i in id_vars], *stacked).unpivot(
        [col(i) for i in id_vars], [col(v) for v in value_vars], var_name, value_name
    )


def distinct_count(df: DataFrame, groups: list[str], column: str, name: str = "unique") -> DataFrame:
    """Distinct populated values of a field per group."""
    require(df, *groups, column)
    return df.groupBy(*[comparable(df, g).alias(g) for g in groups]).agg(
        F.count_distinct(comparable(df, column)).alias(name)
    )


def _hinted(leaders: DataFrame, most: int) -> DataFrame:
    """Broadcast a list of at most ``most`` rows where that is few; else the sizes decide."""
    return F.broadcast(leaders) if most <= MAX_HINTED else leaders


def value_counts(df: DataFrame, columns: list[str] | None = None, top: int = 5) -> DataFrame:
    """The most frequent populated values of each field: ``field, value, count``.

    Equally frequent values rank in ascending order.  A text over 64 characters is
    counted, and ranked, by its SHA-256 digest, and only the texts that made the
    list are read back.
    """
    columns = list(columns or column_groups(df).categorical)
    require(df, *columns)
    cells = df.select(*[text(df, c).alias(c) for c in columns]).unpivot(
        [], [col(c) for c in columns], "field", "value"
    ).filter(F.col("value").isNotNull())
    long = F.length("value") > LONG_TEXT
    keyed = cells.select(
        "field", "value", F.when(long, F.sha2("value", 256)).otherwise(F.col("value")).alias("key"), long.alias("long")
    )
    counts = keyed.groupBy("field", "key", "long").agg(F.count("*").alias("count"))
    # The rank filter is applied before the shuffle too, so each task sends at
    # most ``top`` rows per field.
    ranked = Window.partitionBy("field").orderBy(F.desc("count"), F.asc("key"))
    leaders = counts.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    short = leaders.filter(~F.col("long")).select("field", F.col("key").alias("value"), "count")
    # At most ``top`` rows per field; when no long text made the list, adaptive
    # execution leaves the second reading out.
    listed = _hinted(leaders.filter("long").select("field", "key", "long", "count"), top * len(columns))
    texts = keyed.filter("long").join(listed, ["field", "key", "long"]).groupBy("field", "key", "count")
    return short.unionByName(texts.agg(F.first("value").alias("value")).select("field", "value", "count"))


def contingency(df: DataFrame, first: str, second: str) -> DataFrame:
    """Counts per pair of values; rows missing either are left out."""
    require(df, first, second)
    a, b = comparable(df, first), comparable(df, second)
    return (
        df.select(a.alias(first), b.alias(second))
        .filter(col(first).isNotNull() & col(second).isNotNull())
        .groupBy(col(first), col(second)).agg(F.count("*").alias("count"))
    )


def describe(
    df: DataFrame, columns: list[str] | None = None, digits: int = 3, group_rows: int | None = None
) -> DataFrame:
    """One row per numeric field: count, mean, std, min, quartiles and max."""
    columns = list(columns or column_groups(df).numeric)
    if not columns:
        raise ValueError("A numeric field is required.")
    require_numeric(df, *columns)

    def moments(name: str) -> Column:
        v = number(df, name)
        return F.struct(
            F.lit(name).alias("field"), F.count(v).alias("count"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        )

    basic = df.agg(F.array(*[moments(c) for c in columns]).alias("r")).select(F.inline("r"))
    quartiles = describe_quantiles(df, columns, group_rows)
    joined = join_null_safe(basic, quartiles.withColumnsRenamed({"median": "q2"}), ["field"])
    shown = {"mean": "mean", "std": "std", "min": "min", "25%": "q1", "50%": "q2", "75%": "q3", "max": "max"}
    return joined.select(
        "field", "count", *[F.round(col(source), digits).alias(name) for name, source in shown.items()]
    )


def share_of_total(df: DataFrame, category: str, value: str, name: str = "Share") -> DataFrame:
    """Append ``value`` as a percentage of its category's total; missing when that is 0."""
    require(df, category)
    require_numeric(df, value)
    totals = df.groupBy(comparable(df, category).alias("__category")).agg(F.sum(number(df, value)).alias("__total"))
    keyed = df.withColumn("__category", comparable(df, category))
    # The per-category totals are joined back rather than taken by a window: a
    # window would gather a hot category in one task.
    joined = look_up(keyed, totals, ["__category"], "left")
    return joined.withColumn(name, F.try_divide(number(df, value), F.nullif(F.col("__total"), F.lit(0.0))) * 100).drop(
        "__category", "__total"
    )


def top_categories(df: DataFrame, category: str, value: str, n: int) -> DataFrame:
    """Keep all rows of the ``n`` categories with the largest summed value."""
    require(df, category)
    require_numeric(df, value)
    key = comparable(df, category)
    leaders = (
        df.groupBy(key.alias("__category")).agg(F.coalesce(F.sum(populated(df, value)), F.lit(0)).alias("__total"))
        .orderBy(F.desc("__total"), F.asc("__category")).limit(int(n)).select("__category")
    )
    keyed = df.withColumn("__category", key)
    return join_null_safe(keyed, _hinted(leaders, int(n)), ["__category"], "left_semi").drop("__category")


def sort_rows(df: DataFrame, value: str, ascending: bool = False, by_magnitude: bool = False) -> DataFrame:
    """Sort by a value or its magnitude, the remaining fields breaking ties."""
    require(df, value)
    key = F.abs(number(df, value)) if by_magnitude else populated(df, value)
    lead = key.asc_nulls_last() if ascending else key.desc_nulls_last()
    return df.orderBy(lead, *[col(n) for n in fields(df) if n != value])
