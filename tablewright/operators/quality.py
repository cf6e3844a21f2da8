"""Profiling: health score, missing values, duplicates, field profiles, correlations.

Every per-field figure of a table comes from one aggregate over one scan.  The two
figures that need a shuffle, distinct values and distinct rows, have their own
plans, which shuffle narrow rows only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablewright.functions.columns import (
    ROW_ID,
    col,
    column_groups,
    comparable,
    field_type,
    fields,
    is_missing,
    join_null_safe,
    number,
    populated,
    require,
    require_numeric,
    text,
)
from tablewright.operators.gram import pairwise_correlations
from tablewright.operators.grouping import LONG_TEXT, describe, value_counts
from tablewright.operators.quantiles import quantile_table
from tablewright.operators.sampling import data_only

# Weights of the health score.
COMPLETENESS_WEIGHT, UNIQUENESS_WEIGHT, USEFULNESS_WEIGHT = 0.55, 0.30, 0.15
# Most distinct values a field may hold for each use.
COLOUR_LIMIT, KPI_SPLIT_LIMIT, CHART_CATEGORY_LIMIT, TEST_GROUP_LIMIT = 20, 30, 40, 20
# Most fields whose pairs are written out in one aggregate.
NARROW_FIELDS = 32
# The chart families, and the numeric, categorical and date fields each needs.
CHART_NEEDS = {
    "Column chart": (0, 1, 0),
    "Bar chart": (0, 1, 0),
    "Pie chart": (0, 1, 0),
    "Doughnut chart": (0, 1, 0),
    "Funnel chart": (0, 1, 0),
    "Grouped / stacked columns": (1, 1, 0),
    "Treemap": (1, 1, 0),
    "Sunburst": (1, 1, 0),
    "Radar chart": (1, 1, 0),
    "Waterfall chart": (1, 1, 0),
    "Line chart": (1, 0, 1),
    "Area chart": (1, 0, 1),
    "Scatter plot": (2, 0, 0),
    "Bubble chart": (2, 0, 0),
    "Correlation heatmap": (2, 0, 0),
    "Histogram": (1, 0, 0),
    "Box plot": (1, 0, 0),
    "Violin plot": (1, 0, 0),
}
EXAMPLE_LENGTH = 60
NO_EXAMPLE = "—"


def _per_field(df: DataFrame, names: list[str], **figures) -> DataFrame:
    """One row per field from a single aggregate: ``field``, ``rows`` and the figures."""

    def entry(name: str) -> Column:
        return F.struct(
            F.lit(name).alias("field"),
            F.count("*").alias("rows"),
            *[make(name).alias(alias) for alias, make in figures.items()],
        )

    return df.agg(F.array(*[entry(n) for n in names]).alias("f")).select(F.inline("f"))


def distinct_rows(df: DataFrame) -> DataFrame:
    """One row ``distinct_rows``; missing cells are equal to each other.

    Rows are compared by a 128-bit fingerprint of all fields, so the shuffle carries
    16 bytes a row, not the table, and copies combine before it.  Two different
    rows among 10^12 share a fingerprint with a probability near 10^-15.
    """
    cells = [c for name in fields(df) for c in (comparable(df, name), is_missing(df, name))]
    prints = df.select(F.xxhash64(F.lit(1), *cells).alias("a"), F.xxhash64(F.lit(2), *cells).alias("b"))
    return prints.distinct().agg(F.count("*").alias("distinct_rows"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row ``duplicates``: rows beyond the first of each identical group."""
    return df.agg((F.count("*") - distinct_rows(df).scalar()).alias("duplicates"))


def unique_counts(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct populated values per field: ``field, unique``.

    Fields are stacked into narrow rows of field and value, which combine map-side and
    spread over the cluster by value; a text over 64 characters travels as its SHA-256
    digest.  ``approx`` replaces the shuffle by a sketch.
    """
    names = list(columns or fields(df))
    if approx:
        return _per_field(df, names, unique=lambda n: F.approx_count_distinct(comparable(df, n))).drop("rows")
    stacked = df.select(*[_stackable(df, n).alias(str(i)) for i, n in enumerate(names)]).unpivot(
        [], [str(i) for i in range(len(names))], "i", "value"
    )
    distinct = stacked.select("i", "value.*").filter(~(F.col("whole").isNull() & F.col("real").isNull() & F.col("text").isNull() & F.col("digest").isNull())).distinct()
    counted = distinct.groupBy("i").agg(F.count("*").alias("unique"))
    listed = df.sparkSession.createDataFrame([(str(i), n) for i, n in enumerate(names)], "i string, field string")
    named = listed.join(counted, "i", "left")
    return named.select("field", F.coalesce("unique", F.lit(0)).alias("unique"))


def _stackable(df: DataFrame, name: str) -> Column:
    """A cell in one of four slots, so that fields of different types can be stacked and a
    long text's digest is no text."""
    kind, cell = field_type(df, name), comparable(df, name)
    whole, real = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    words = digest = F.lit(None).cast("string")
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        whole = cell.cast("bigint")
    elif isinstance(kind, T.DateType):
        whole = F.unix_date(cell).cast("bigint")
    elif isinstance(kind, T.TimestampType):
        whole = F.unix_micros(cell)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        real = cell.cast("double")
    else:
        short = F.length(cell.cast("string")) <= LONG_TEXT
        words, digest = F.when(short, cell.cast("string")), F.when(~short, F.sha2(cell.cast("string"), 256))
    return F.struct(whole.alias("whole"), real.alias("real"), words.alias("text"), digest.alias("digest"))


def _measures(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing, duplicates, completeness, constant fields."""
    names = fields(df)
    missing = sum((F.count_if(is_missing(df, n)) for n in names), F.lit(0))
    # A field is constant when its smallest and largest value agree: no distinct count.
    constant = sum(
        (F.min(populated(df, n)).eqNullSafe(F.max(populated(df, n))).cast("bigint") for n in names), F.lit(0)
    )
    counted = data_only(df).agg(
        F.count("*").alias("rows"), missing.cast("bigint").alias("missing"), constant.alias("constant")
    )
    width = F.lit(len(names)).cast("bigint")
    cells = F.greatest(F.col("rows") * width, F.lit(1))
    return counted.select(
        "rows",
        width.alias("columns"),
        "missing",
        (F.col("rows") - distinct_rows(df).scalar()).alias("duplicates"),
        (1 - F.col("missing") / cells).alias("completeness"),
        "constant",
    )


def health(df: DataFrame) -> DataFrame:
    """One row: score (0-100), completeness, row_uniqueness, column_usefulness."""
    return _scored(_measures(df)).select("score", "completeness", "row_uniqueness", "column_usefulness")


def _scored(measures: DataFrame) -> DataFrame:
    factors = measures.select(
        "*",
        (1 - F.col("duplicates") / F.greatest("rows", F.lit(1))).alias("row_uniqueness"),
        (1 - F.col("constant") / F.greatest("columns", F.lit(1))).alias("column_usefulness"),
    )
    weighted = (
        COMPLETENESS_WEIGHT * F.col("completeness")
        + UNIQUENESS_WEIGHT * F.col("row_uniqueness")
        + USEFULNESS_WEIGHT * F.col("column_usefulness")
    )
    score = F.least(F.greatest(F.bround(100 * weighted).cast("int"), F.lit(0)), F.lit(100))
    return factors.withColumn("score", score)


def data_health(df: DataFrame) -> tuple[int, dict[str, float]]:
    row = health(df).first()
    return row["score"], {
        "Completeness": row["completeness"],
        "Row uniqueness": row["row_uniqueness"],
        "Column usefulness": row["column_usefulness"],
    }


def compare_quality(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows ``Metric, Before, After, Change`` for two versions of a table."""
    metrics = {
        "Rows": "rows",
        "Columns": "columns",
        "Missing cells": "missing",
        "Duplicate rows": "duplicates",
        "Completeness %": "completeness",
    }

    def pick(prefix: str, name: str) -> Column:
        value = F.col(f"{prefix}.{name}").cast("double")
        return value * 100 if name == "completeness" else value

    both = _measures(before).select(
        F.struct("*").alias("old"), _measures(after).select(F.struct("*")).scalar().alias("new")
    )
    rows = [
        F.struct(
            F.lit(label).alias("Metric"),
            pick("old", name).alias("Before"),
            pick("new", name).alias("After"),
            (pick("new", name) - pick("old", name)).alias("Change"),
        )
        for label, name in metrics.items()
    ]
    return both.select(F.inline(F.array(*rows)))


def missing_by_field(df: DataFrame, top: int | None = None) -> DataFrame:
    """``field, missing, percent`` of the fields with missing cells, most first."""
    rows = _per_field(df, fields(df), missing=lambda n: F.count_if(is_missing(df, n)))
    found = rows.filter(F.col("missing") > 0).select(
        "field", "missing", (F.col("missing") / F.col("rows") * 100).alias("percent")
    ).orderBy(F.desc("missing"), "field")
    return found.limit(top) if top else found


def field_profile(df: DataFrame, order_by: str | None = None, approx: bool = False) -> DataFrame:
    """``Field, Type, Populated, Missing %, Unique, Example`` of every field.

    The example is the first populated value by ``order_by`` or ``_row_id``, else
    the smallest.
    """
    order = order_by or (ROW_ID if ROW_ID in df.columns else None)
    if order:
        require(df, order)

    def example(name: str) -> Column:
        cell = text(df, name)
        if order is None:
            return F.min(cell)
        return F.min_by(cell, F.when(~is_missing(df, name), col(order)))

    figures = _per_field(
        df,
        fields(df),
        populated=lambda n: F.count_if(~is_missing(df, n)),
        example=example,
    )
    types = F.create_map(*[F.lit(x) for n in fields(df) for x in (n, field_type(df, n).simpleString())])
    joined = join_null_safe(figures, unique_counts(df, approx=approx), ["field"], "left")
    missing = F.coalesce(F.try_divide(F.col("rows") - F.col("populated"), F.col("rows")) * 100, F.lit(0.0))
    return joined.select(
        F.col("field").alias("Field"),
        types[F.col("field")].alias("Type"),
        F.col("populated").alias("Populated"),
        missing.alias("Missing %"),
        F.col("unique").alias("Unique"),
        F.coalesce(F.substring("example", 1, EXAMPLE_LENGTH), F.lit(NO_EXAMPLE)).alias("Example"),
    )


def data_dictionary(df: DataFrame, approx: bool = False) -> DataFrame:
    """``field, dtype, non_null, unique`` of every field."""
    types = F.create_map(*[F.lit(x) for n in fields(df) for x in (n, field_type(df, n).simpleString())])
    counts = _per_field(df, fields(df), non_null=lambda n: F.count_if(~is_missing(df, n)))
    joined = join_null_safe(counts, unique_counts(df, approx=approx), ["field"], "left")
    return joined.select("field", types[F.col("field")].alias("dtype"), "non_null", "unique")


def outlier_screen(
    df: DataFrame, top: int | None = None, factor: float = 1.5, group_rows: int | None = None
) -> DataFrame:
    """``field, outliers, rate`` per numeric field with at least four values."""
    numeric = column_groups(df).numeric
    if not numeric:
        raise ValueError("A numeric field is required.")
    quartiles = quantile_table(df, [], numeric, [0.25, 0.75], group_rows)
    by_position = quartiles.select(F.struct(*[col(n).alias(f"q{i}") for i, n in enumerate(numeric)])).scalar()

    def outside(name: str) -> Column:
        q = by_position.getField(f"q{numeric.index(name)}")
        spread = q[1] - q[0]
        value = number(df, name)
        beyond = (value < q[0] - factor * spread) | (value > q[1] + factor * spread)
        return F.count_if((spread != 0) & beyond)

    rows = _per_field(df, numeric, outliers=outside, populated=lambda n: F.count(number(df, n)))
    found = rows.filter(F.col("populated") >= 4).select(
        "field", "outliers", (F.col("outliers") / F.col("populated") * 100).alias("rate")
    )
    return found.orderBy(F.desc("rate"), "field").limit(top) if top else found


def correlation(df: DataFrame, x: str, y: str) -> Column:
    """Pearson r over the rows holding both; missing when either is constant."""
    a, b = number(df, x), number(df, y)
    deviations = F.stddev_samp(F.when(b.isNotNull(), a)) * F.stddev_samp(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_samp(a, b), deviations)


def correlation_pairs(df: DataFrame, columns: list[str] | None = None, wide: bool | None = None) -> DataFrame:
    """``first, second, r`` of every unordered pair, from one pass.

    Up to ``NARROW_FIELDS`` fields each pair is an expression of one aggregate; more
    fields (or ``wide``) take blocks of pairwise moments, whose plan grows with the
    fields, not with the pairs.  Both give the same figures.
    """
    columns = _correlated(df, columns)
    if wide if wide is not None else len(columns) > NARROW_FIELDS:
        names = F.array(*[F.lit(n) for n in columns])
        pairs = pairwise_correlations(df, columns).filter("i < j")
        return pairs.select(F.get(names, F.col("i")).alias("first"), F.get(names, F.col("j")).alias("second"), "r")
    pairs = [
        F.struct(F.lit(x).alias("first"), F.lit(y).alias("second"), correlation(df, x, y).alias("r"))
        for x, y in combinations(columns, 2)
    ]
    return df.agg(F.array(*pairs).alias("p")).select(F.inline("p"))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, wide: bool | None = None) -> DataFrame:
    """The square matrix: ``field`` and one column per field; ``wide`` as for the pairs."""
    columns = _correlated(df, columns)
    if wide if wide is not None else len(columns) > NARROW_FIELDS:
        return _matrix_by_blocks(df, columns)
    cells = {frozenset(pair): correlation(df, *pair) for pair in combinations(columns, 2)}
    own = {x: F.when(F.stddev_samp(number(df, x)) > 0, 1.0) for x in columns}
    flat = {f"c{i}_{j}": (own[x] if x == y else cells[frozenset((x, y))])
            for i, x in enumerate(columns) for j, y in enumerate(columns) if i <= j}
    matrix = df.agg(*[e.alias(n) for n, e in flat.items()])
    rows = [
        F.struct(
            F.lit(x).alias("field"),
            *[F.col(f"c{min(i, j)}_{max(i, j)}").alias(y) for j, y in enumerate(columns)],
        )
        for i, x in enumerate(columns)
    ]
    return matrix.select(F.inline(F.array(*rows)))


def _correlated(df: DataFrame, columns: list[str] | None) -> list[str]:
    columns = list(columns or column_groups(df).numeric)
    require_numeric(df, *columns)
    if len(columns) < 2:
        raise ValueError("At least two numeric fields are needed.")
    return columns


def _matrix_by_blocks(df: DataFrame, columns: list[str]) -> DataFrame:
    half = pairwise_correlations(df, columns).select("i", "j", "r")
    # Each pair stands in the rows of both its fields.
    cells = half.select(F.inline(F.array(
        F.struct(F.col("i").alias("row"), F.col("j").alias("at"), "r"),
        F.struct(F.col("j").alias("row"), F.col("i").alias("at"), "r"))))
    across = cells.groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("at", "r"))).alias("r"))
    names = F.array(*[F.lit(n) for n in columns])
    return across.orderBy("row").select(
        F.get(names, F.col("row")).alias("field"), *[F.col("r")[k].alias(n) for k, n in enumerate(columns)])


def strongest_correlations(df: DataFrame, top: int = 4, wide: bool | None = None) -> DataFrame:
    """The pairs with the largest |r|, rounded to three places."""
    pairs = correlation_pairs(df, wide=wide).filter(F.col("r").isNotNull())
    strongest = pairs.orderBy(F.desc(F.abs("r")), "first", "second").limit(top)
    return strongest.select("first", "second", F.round("r", 3).alias("correlation"))


def overview(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row of headline figures."""
    groups = column_groups(df)
    widest = unique_counts(df, approx=approx).agg(F.max(F.struct("unique", "field")).alias("w"))
    widest = widest.select("w").scalar()
    return _measures(df).select(
        "rows",
        "columns",
        (100 * (1 - F.col("completeness"))).alias("missing_percent"),
        F.col("missing").alias("missing_cells"),
        "duplicates",
        (100 * F.col("duplicates") / F.greatest("rows", F.lit(1))).alias("duplicate_percent"),
        widest.getField("field").alias("widest_field"),
        widest.getField("unique").alias("widest_unique"),
        *[F.lit(len(g)).alias(f"{n}_fields") for n, g in zip(("numeric", "categorical", "date"), groups)],
    )


def chart_choices(df: DataFrame) -> list[str]:
    """The chart families whose tables can be built from the fields at hand."""
    available = [len(group) for group in column_groups(df)]
    return [
        family for family, needed in CHART_NEEDS.items()
        if all(have >= need for have, need in zip(available, needed))
    ]


def field_eligibility(df: DataFrame, approx: bool = False) -> DataFrame:
    """``field, role, eligible``: which field suits which analysis."""
    categorical = column_groups(df).categorical
    missing = _per_field(df, fields(df), missing=lambda n: F.count_if(is_missing(df, n)))
    known = join_null_safe(missing, unique_counts(df, approx=approx), ["field"], "left").withColumn(
        "categorical", F.col("field").isin(categorical) if categorical else F.lit(False)
    )
    low = F.col("categorical") & (F.col("unique") <= CHART_CATEGORY_LIMIT)
    # Without any low-cardinality field every categorical one may label a chart.
    # The window holds one row per field of the table.
    none_low = F.max(low.cast("int")).over(Window.partitionBy(F.lit(0))) == 0
    known = known.withColumn("low", low | (F.col("categorical") & none_low))
    roles = {
        "missing treatment": F.col("missing") > 0,
        "colour": F.col("categorical") & (F.col("unique") <= COLOUR_LIMIT),
        "kpi split": F.col("unique") <= KPI_SPLIT_LIMIT,
        "chart category": F.col("low"),
        "test group": F.col("unique").between(2, TEST_GROUP_LIMIT),
    }
    entries = [F.struct(F.lit(r).alias("role"), e.alias("eligible")) for r, e in roles.items()]
    return known.select("field", F.inline(F.array(*entries)))


def dataset_summary(df: DataFrame, digits: int = 2, top: int = 5, categories: list[str] | None = None) -> DataFrame:
    """The profile of a table as rows ``section, field, metric, value``.

    The rows of :func:`report_tables`; the strongest correlations, with the other field as
    metric; of each text field (or those in ``categories``) the number of distinct values
    and its ``top`` values with their counts.
    """
    groups = column_groups(df)
    summary = report_tables(df, digits)
    if len(groups.numeric) > 1:
        summary = summary.unionByName(strongest_correlations(df).select(
            F.lit("correlation").alias("section"), F.col("first").alias("field"),
            F.col("second").alias("metric"), F.col("correlation").cast("double").alias("value"),
        ))
    named = groups.categorical if categories is None else list(categories)
    if not named:
        return summary
    distinct = unique_counts(df, named).select(
        F.lit("distinct").alias("section"), "field", F.lit("values").alias("metric"), F.col("unique").cast("double").alias("value"))
    common = value_counts(df, named, top).select(
        F.lit("top value").alias("section"), "field", F.col("value").alias("metric"), F.col("count").cast("double").alias("value"))
    return summary.unionByName(distinct).unionByName(common)


def report_tables(df: DataFrame, digits: int = 2, group_rows: int | None = None) -> DataFrame:
    """The report as rows ``section, field, metric, value``."""
    groups = column_groups(df)

    def entry(section: str, metric: str, value: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), F.lit(None).cast("string").alias("field"),
            F.lit(metric).alias("metric"), value.cast("double").alias("value"),
        )

    head = {
        "rows": F.col("rows"),
        "columns": F.col("columns"),
        "duplicates": F.col("duplicates"),
        "numeric fields": F.lit(len(groups.numeric)),
        "categorical fields": F.lit(len(groups.categorical)),
        "date fields": F.lit(len(groups.dates)),
    }
    factors = {n.replace("_", " "): F.col(n) for n in ("score", "completeness", "row_uniqueness", "column_usefulness")}
    entries = [entry("overview", m, v) for m, v in head.items()] + [entry("quality", m, v) for m, v in factors.items()]
    report = _scored(_measures(df)).select(F.inline(F.array(*entries)))
    gaps = missing_by_field(df).select(
        F.lit("missing").alias("section"), "field",
        F.inline(F.array(
            F.struct(F.lit("count").alias("metric"), F.col("missing").cast("double").alias("value")),
            F.struct(F.lit("percent").alias("metric"), F.col("percent").alias("value")),
        )),
    )
    report = report.unionByName(gaps)
    if groups.numeric:
        table = describe(df, groups.numeric, digits, group_rows)
        statistics = [n for n in table.columns if n != "field"]
        cells = [F.struct(F.lit(n).alias("metric"), col(n).cast("double").alias("value")) for n in statistics]
        report = report.unionByName(
            table.select(F.lit("numeric").alias("section"), "field", F.inline(F.array(*cells)))
        )
    return report
