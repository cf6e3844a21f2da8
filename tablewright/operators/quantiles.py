"""Exact, linearly interpolated quantiles.

Spark's ``percentile`` keeps a value-to-count map per group and merges it in one
task.  That is the best plan for groups of bounded size, and a failure for a group
holding billions of distinct values.  :func:`quantile_table` therefore treats the two
kinds apart, with the same answer:

* groups up to a row limit, and all of an input known to be small: ``percentile``;
* larger groups, and the whole of a larger table without keys: counts per coarse cell
  of the value axis, then counts per fine cell inside the cells that hold a wanted
  rank, then counts per value inside the fine cells that do.  Each step is a map-side
  combined aggregation over the scan; no step gathers the rows of a group.

The larger groups are usually few.  They are counted, and if they are, their keys and
wanted cells are broadcast and their rows never move; otherwise both are joined by
shuffling, after salting the rows and combining equal values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions.columns import col, comparable, is_small, join_null_safe, number, require, require_numeric

# Inputs up to this estimated size are small: any of their groups may be merged in a task.
SMALL_INPUT_BYTES = 32 * 1024 * 1024
# Of larger inputs, groups up to this many rows may be.
GROUP_ROWS = 100_000
# Per-group look-up rows are broadcast when the keys of all rows together are
# estimated below this size, or when there are no more groups than this.
BROADCAST_BYTES = 8 * 1024 * 1024
BROADCAST_GROUPS = 5_000
# Parts a group is split into when its look-up row cannot be broadcast.
SALTS = 64
FINE_CELLS = 2**20
CELLS_PER_OCTAVE = 64


def quantile_table(
    df: DataFrame,
    keys: list[str],
    measures: list[str],
    probabilities: list[float],
    group_rows: int | None = None,
) -> DataFrame:
    """One row per group (one row in all without keys): the keys, then for every
    measure an array with one quantile per probability; NULL without values.

    ``group_rows`` sets the largest group that may be merged in one task; given, it
    applies to inputs of any size.
    """
    require(df, *keys)
    require_numeric(df, *measures)
    names = [f"k{i}" for i in range(len(keys))]
    values = [f"v{i}" for i in range(len(measures))]
    rows = df.select(
        *[comparable(df, k).alias(n) for k, n in zip(keys, names)],
        *[number(df, m).alias(v) for m, v in zip(measures, values)],
    )
    if group_rows is None and is_small(rows, SMALL_INPUT_BYTES):
        found = _merged(rows, names, values, probabilities)
    elif not keys:
        found = _by_cell_counts(rows, names, values, probabilities)
    else:
        limit = GROUP_ROWS if group_rows is None else group_rows
        large = rows.groupBy(*names).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
        large = large.select(*names, F.lit(True).alias("large"))
        few = large.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
        marked = look_up(rows, large, names, "left", few)
        # Without any large group adaptive execution leaves the second part out.
        found = _merged(marked.filter(F.col("large").isNull()), names, values, probabilities).unionByName(
            _by_cell_counts(marked.filter("large").drop("large"), names, values, probabilities, few)
        )
    return found.toDF(*keys, *measures)


def _merged(rows: DataFrame, names: list[str], values: list[str], probabilities: list[float]) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    return rows.groupBy(*names).agg(*[F.percentile(v, wanted).alias(v) for v in values])


def _by_cell_counts(
    rows: DataFrame, names: list[str], measures: list[str], probabilities: list[float], few: bool = True
) -> DataFrame:
    ids = [*names, "m"]
    values = rows.unpivot(names, measures, "m", "v").filter(F.col("v").isNotNull())
    if few:
        values = values.withColumn("w", F.lit(1).cast("bigint"))
    else:
        # However often a value occurs, it travels to the join as one row.
        values = values.groupBy(*ids, "v").agg(F.count("*").alias("w"))
    values = values.withColumn("cell", _coarse_cell(F.col("v")))

    # 1. Coarse cells.  The ranks wanted follow from the group's own count.
    coarse = values.groupBy(*ids, "cell").agg(
        F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    coarse = coarse.withColumns(
        {"total": F.sum("n").over(Window.partitionBy(*ids)), "before": _rows_before(ids, "cell")}
    )
    coarse = _holding_a_rank(coarse, probabilities).select(*ids, "cell", "lo", "hi", "total", "before")

    # 2. Fine cells: equal steps between the exact ends of each wanted coarse cell.
    span = F.col("hi") - F.col("lo")
    step = F.when(span > 0, F.least(F.floor((F.col("v") - F.col("lo")) / span * FINE_CELLS), F.lit(FINE_CELLS - 1)))
    cell_ids = [*ids, "cell"]
    fine = (
        _join_cells(values, coarse, cell_ids, few)
        .withColumn("fine", F.coalesce(step, F.lit(0)))
        .groupBy(*cell_ids, "fine")
        .agg(
            F.sum("w").alias("n"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
            F.min("total").alias("total"),
            F.min("before").alias("before"),
        )
    )
    fine = fine.withColumn("before", F.col("before") + _rows_before(cell_ids, "fine"))
    fine = _holding_a_rank(fine, probabilities).select(*cell_ids, "fine", "lo", "hi", "total", "before")

    # 3. Single values inside the wanted fine cells.
    inside = _join_cells(values, fine, cell_ids, few).filter(F.col("v").between(F.col("lo"), F.col("hi")))
    single = inside.groupBy(*cell_ids, "fine", "v").agg(
        F.sum("w").alias("n"), F.min("total").alias("total"), F.min("before").alias("before")
    )
    single = single.withColumn("before", F.col("before") + _rows_before([*cell_ids, "fine"], "v"))
    single = _holding_a_rank(single, probabilities)
    by_rank = (
        single.select(*ids, "total", "v", F.explode("ranks").alias("rank"))
        .groupBy(*ids)
        .agg(
            F.first("total").alias("total"),
            F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"),
        )
    )
    found = by_rank.select(*ids, _interpolate(probabilities).alias("q"))
    per_group = found.groupBy(*names).agg(
        *[F.max(F.when(F.col("m") == m, F.col("q"))).alias(m) for m in measures]
    )
    if not names:
        return per_group
    # Groups without any value keep their row.
    return _join_cells(rows.select(*names).distinct(), per_group, names, few, "left")


def _join_cells(rows: DataFrame, side: DataFrame, on: list[str], few: bool, how: str = "inner") -> DataFrame:
    return join_null_safe(rows, F.broadcast(side) if few else side, on, how)


def _coarse_cell(value: Column) -> Column:
    # A non-decreasing function of the value: sign, then 64 cells per power of two.
    octave = F.floor(F.log2(F.abs(value)) * CELLS_PER_OCTAVE).cast("bigint") + 100_000
    return (
        F.when(value == 0, F.lit(0).cast("bigint"))
        .when(F.abs(value) == float("inf"), F.signum(value).cast("bigint") * 1_000_000)
        .otherwise(F.signum(value).cast("bigint") * octave)
    )


def _position(probability: float) -> Column:
    return F.lit(float(probability)) * (F.col("total") - 1)


def _wanted_ranks(probabilities: list[float]) -> Column:
    ranks = [f(_position(p)).cast("bigint") for p in probabilities for f in (F.floor, F.ceil)]
    return F.array_distinct(F.array(*ranks))


def _rows_before(group: list[str], order: str) -> Column:
    running = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum("n").over(running) - F.col("n")


def _holding_a_rank(cells: DataFrame, probabilities: list[float]) -> DataFrame:
    first, end = F.col("before"), F.col("before") + F.col("n")
    held = F.filter(_wanted_ranks(probabilities), lambda r: (r >= first) & (r < end))
    return cells.withColumn("ranks", held).filter(F.size("ranks") > 0)


def _interpolate(probabilities: list[float]) -> Column:
    def one(p: float) -> Column:
        position = _position(p)
        low, high = F.floor(position), F.ceil(position)
        below, above = F.col("at")[low.cast("bigint")], F.col("at")[high.cast("bigint")]
        return F.when(low == high, below).otherwise((high - position) * below + (position - low) * above)

    return F.array(*[one(p) for p in probabilities])


def few_groups(df: DataFrame, keys: list[str]) -> bool:
    """Whether one short row per group is certain to be small enough to broadcast.

    A small key projection settles it without a job; otherwise the groups are
    counted, up to the limit.
    """
    groups = df.select(*[col(k) for k in keys])
    return is_small(groups, BROADCAST_BYTES) or groups.distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS


def look_up(
    rows: DataFrame, per_group: DataFrame, keys: list[str], how: str = "inner", few: bool | None = None
) -> DataFrame:
    """Join one look-up row per group to the rows of the groups, inner or left.

    With few groups the look-up is broadcast.  With many, every group is split into
    salted parts and its look-up row copied to each, so that a group holding a large
    share of the rows is joined by many tasks.  ``few`` tells when the caller knows.
    """
    if few_groups(rows, keys) if few is None else few:
        return join_null_safe(rows, F.broadcast(per_group), keys, how)
    salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    copies = per_group.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return join_null_safe(salted, copies, [*keys, "__salt"], how).drop("__salt")


def describe_quantiles(df: DataFrame, measures: list[str], group_rows: int | None = None) -> DataFrame:
    """Quartiles of many fields as rows ``field, q1, median, q3``."""
    table = quantile_table(df, [], measures, [0.25, 0.5, 0.75], group_rows)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("field"), col(m).alias("q")) for m in measures]))
    return table.select(rows.alias("r")).select(
        "r.field", F.col("r.q")[0].alias("q1"), F.col("r.q")[1].alias("median"), F.col("r.q")[2].alias("q3")
    )
