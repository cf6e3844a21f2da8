"""Single-key joins of two tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.columns import ROW_ID, col, comparable, field_type, is_small, require

JOIN_METHODS = ("inner", "left", "right", "outer")
JOINED_SUFFIX = "_joined"
# The optional side of an outer join is joined in one pass up to this estimated
# size; beyond it a hot key there could not be split between tasks.
ONE_PASS_BYTES = 1024**3
# The rows of a key that has more pairs than the square of this are dealt out, on both
# sides, in pieces of about so many rows; every two pieces meet in a task of their own.
PIECE_ROWS = 2000

_LEFT_KEY, _RIGHT_KEY = "__left_key", "__right_key"
_HOT_KEY, _PLACE = "__hot_key", "__place"
_PIECES, _LEFT_PIECES, _RIGHT_PIECES = "__pieces", "__left_pieces", "__right_pieces"


def join_tables(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    how: str,
    one_pass_bytes: int | None = None,
    piece_rows: int | None = None,
) -> DataFrame:
    """Join on one key; missing keys match missing keys.

    Right fields whose name exists on the left get the ``_joined`` suffix.  Keys of
    the same name become one field; keys of different names are both kept.

    Adaptive execution splits a hot key's partition on both sides of an inner join
    but only on the preserved side of an outer one, and on neither side of a full
    one.  An outer join with a large optional side is therefore put together from
    an inner join and the unmatched rows, found against distinct keys.

    A key with many rows on both sides, such as the missing one, has few bytes but the
    product of its rows as output, which adaptive execution leaves to one task.  Such
    keys are counted first and joined apart, piece by piece.
    """
    if how not in JOIN_METHODS:
        raise ValueError(f"{how!r} is no way to join; choose one of {', '.join(JOIN_METHODS)}.")
    require(left, left_on)
    require(right, right_on)
    _check_key_types(field_type(left, left_on), field_type(right, right_on))

    right = right.drop(ROW_ID) if ROW_ID in right.columns else right
    shared_key = left_on == right_on
    renames = {
        name: name + JOINED_SUFFIX
        for name in right.columns
        if name in left.columns and not (shared_key and name == right_on)
    }
    right_names = [renames.get(n, n) for n in right.columns if not (shared_key and n == right_on)]
    clash = (set(right_names) & set(left.columns)) | {n for n in right_names if right_names.count(n) > 1}
    if clash:
        raise ValueError(f"The joined table would repeat a field: {', '.join(sorted(clash))}")

    left_side = left.withColumn(_LEFT_KEY, comparable(left, left_on))
    right_side = right.withColumn(_RIGHT_KEY, comparable(right, right_on)).withColumnsRenamed(renames)
    if shared_key:
        right_side = right_side.drop(right_on)
    matching = col(_LEFT_KEY).eqNullSafe(col(_RIGHT_KEY))

    limit = ONE_PASS_BYTES if one_pass_bytes is None else one_pass_bytes
    hot = _hot_keys(left_side, right_side, PIECE_ROWS if piece_rows is None else piece_rows)
    # Hot keys have rows on both sides: none of theirs is unmatched.
    left_rest, right_rest = _without(left_side, _LEFT_KEY, hot), _without(right_side, _RIGHT_KEY, hot)
    if how == "inner":
        rows = left_rest.join(right_rest, matching, "inner")
    elif how == "left":
        rows = _keep_left(left_rest, right_rest, matching, is_small(right_side, limit))
    elif how == "right":
        if is_small(left, limit):
            rows = left_rest.join(right_rest, matching, "right")
        else:
            rows = left_rest.join(right_rest, matching, "inner").unionByName(
                _unmatched(right_rest, left_rest, _LEFT_KEY, matching), allowMissingColumns=True
            )
    else:
        rows = _keep_left(left_rest, right_rest, matching, is_small(right_side, limit)).unionByName(
            _unmatched(right_rest, left_rest, _LEFT_KEY, matching), allowMissingColumns=True
        )
    rows = rows.unionByName(_join_pieces(left_side, right_side, hot), allowMissingColumns=True)

    def output(name: str) -> Column:
        if shared_key and name == left_on:
            return F.coalesce(col(name), col(_RIGHT_KEY)).alias(name)
        return col(name)

    return rows.select(*[output(n) for n in left.columns], *[col(n) for n in right_names])


def _keep_left(left: DataFrame, right: DataFrame, matching: Column, right_small: bool) -> DataFrame:
    if right_small:
        return left.join(right, matching, "left")
    return left.join(right, matching, "inner").unionByName(
        _unmatched(left, right, _RIGHT_KEY, matching), allowMissingColumns=True
    )


def _unmatched(kept: DataFrame, other: DataFrame, other_key: str, matching: Column) -> DataFrame:
    # Distinct keys combine map-side, so the other side brings one row per key.
    return kept.join(other.select(other_key).distinct(), matching, "left_anti")


def _hot_keys(left: DataFrame, right: DataFrame, piece_rows: int) -> DataFrame:
    """The keys with more than ``piece_rows`` squared pairs, and each side's number of pieces.

    Each has that many rows of output, so there are few of them for the size of the result.
    """
    counted = left.select(col(_LEFT_KEY).alias(_HOT_KEY), F.lit(1).alias("left_rows"), F.lit(0).alias("right_rows")).unionAll(
        right.select(col(_RIGHT_KEY), F.lit(0), F.lit(1)))
    totals = counted.groupBy(_HOT_KEY).agg(F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows"))
    # As doubles, since the product may be beyond a long.
    pairs = F.col("left_rows").cast("double") * F.col("right_rows")
    return totals.filter(pairs > float(piece_rows) ** 2).select(
        _HOT_KEY, *[F.ceil(F.col(f"{side}_rows") / piece_rows).alias(f"__{side}_count") for side in ("left", "right")])


def _without(side: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    return side.join(F.broadcast(hot), col(key).eqNullSafe(col(_HOT_KEY)), "left_anti")


def _join_pieces(left: DataFrame, right: DataFrame, hot: DataFrame) -> DataFrame:
    """The inner join on hot keys: a row is in one piece of its side and meets every piece of the other."""
    left = _dealt(left, _LEFT_KEY, hot, "left").withColumnRenamed(_PIECES, _LEFT_PIECES)
    right = _dealt(right, _RIGHT_KEY, hot, "right").withColumnRenamed(_PIECES, _RIGHT_PIECES)
    # Structs are equal where both hold a missing key.
    return left.join(right, col(_LEFT_PIECES) == col(_RIGHT_PIECES)).drop(_LEFT_PIECES, _RIGHT_PIECES)


def _dealt(side: DataFrame, key: str, hot: DataFrame, name: str) -> DataFrame:
    other = {"left": "right", "right": "left"}[name]
    hot_rows = side.join(F.broadcast(hot), col(key).eqNullSafe(col(_HOT_KEY)))
    # Rows are numbered in an order of their own: a task that runs again deals them to
    # the same pieces, in whatever order it reads them, and copies to different ones.
    hashed = [col(f.name) for f in side.schema if not re.search(r"\b(map<|variant\b)", f.dataType.simpleString())]
    numbered = hot_rows.sortWithinPartitions(F.xxhash64(*hashed)).withColumn(_PLACE, F.monotonically_increasing_id())
    # Never null, like the other number: the two sides' pieces must be of one type.
    numbers = {
        name: F.coalesce(F.pmod(F.xxhash64(_PLACE), col(f"__{name}_count")), F.lit(0).cast("long")),
        other: F.explode(F.sequence(F.lit(0).cast("long"), col(f"__{other}_count") - 1)),
    }
    pieces = numbered.withColumns({f"__{n}_piece": number for n, number in numbers.items()})
    # A number of partitions that is given is kept; merged by their few bytes, pieces would
    # end up in one task again.
    session = side.sparkSession
    partitions = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    return pieces.select(
        *[col(n) for n in side.columns], F.struct(col(_HOT_KEY).alias("key"), "__left_piece", "__right_piece").alias(_PIECES)
    ).repartition(partitions, _PIECES)


def _check_key_types(left: T.DataType, right: T.DataType) -> None:
    def family(kind: T.DataType) -> str:
        if isinstance(kind, T.NumericType):
            return "number"
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "date"
        return kind.typeName()

    if family(left) != family(right):
        raise ValueError(f"Join keys of different types: {left.simpleString()} and {right.simpleString()}")
