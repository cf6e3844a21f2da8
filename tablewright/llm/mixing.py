"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue up in a shuffled order (a digest of their id); a document
repeats in further rounds up to three times.  Its virtual finish time is the number of
words its source has queued up to its end, divided by the source's target.  All queues
are served at once, each at the rate of its target, so the mix is the schedule sorted by
finish time, cut where the budget is used up.  Served words at virtual time v are v times
the sum of the targets, hence the budget ends at v = 1; a document in service at that
moment counts with the words served so far.

A running sum over a source that holds a third of all rows is not left to one task: the
digest cuts every queue into buckets, bucket sums give each bucket its start, and windows
run inside the buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import settle

WEIGHTS = (1, 2, 3)
MAX_ROUNDS = 3
#: Buckets a source's queue is cut into, at least; and rows of all sources to one more.
LEAST_BUCKETS = 256
BUCKET_ROWS = 4000


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, rounds: int = MAX_ROUNDS) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares by weight, at most rounds * source_size.

    Sources take the weights in turn by code point, null last.  What a full source cannot
    take is shared again by weight among the others.  In the order of size per weight the
    full sources come first, so the level at which the rest meet is the largest of
    (words left) / (weight left).  One row a source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    totals = totals.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place % len(weights)).cast("long"))
    limit = rounds * F.col("source_size")
    order = Window.orderBy((limit / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    totals = totals.withColumn("level", left.cast("double") / weight_left)
    level = F.max("level").over(everything)
    return totals.withColumn(
        "target", F.least(limit.cast("double"), level * F.col("weight"))
    ).select("source", "source_size", "target")


def _queued(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, buckets: int) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    turn = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(seed))))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source_col).cast("string").alias("source"), words.cast("long").alias("size"), turn.alias("turn"),
    )
    bucket = F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32))
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    return rows.withColumns({"bucket": bucket, "queue": name})


def schedule(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    rounds: int = MAX_ROUNDS,
    seed: int = 0,
) -> DataFrame:
    """Every turn of every document, in the order of finish times over all sources.

    Columns: row (all columns of ``docs``), queue, bucket, place (together the identity of
    a row), size, source_size, target, round (0 up), finish and taken: the words served
    before the budget ends, ``size`` for all turns that finish by 1, 0 for those that begin
    later.

    * A null text has size 0 and is never served; a null source is a source of its own.
    * Equal ids queue next to each other, by size; repeated rows are served one by one.
    * On an empty table the result is empty.  Sizes are words, cut at white space.
    """
    count = docs.count()
    buckets = max(LEAST_BUCKETS, count // BUCKET_ROWS)
    narrow = docs.select(*dict.fromkeys((id_col, text_col, source_col)))
    sums = settle(
        _queued(narrow, id_col, text_col, source_col, seed, buckets)
        .groupBy("queue", "source", "bucket").agg(F.sum("size").alias("size")),
        "queues",
    )
    shares = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, rounds)
    shares = shares.withColumn("queue", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    behind = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "queue", "bucket", F.coalesce(F.sum("size").over(behind), F.lit(0)).alias("start")
    ).join(shares, "queue")
    starts = settle(starts, "starts")

    line = Window.partitionBy("queue", "bucket").orderBy("turn", F.col(f"row.`{id_col}`"), "size")
    rows = _queued(docs, id_col, text_col, source_col, seed, buckets).drop("source").withColumns({
        "place": F.row_number().over(line),
        "until": F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    }).join(starts, ["queue", "bucket"])
    turns = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    begin = F.col("round") * F.col("source_size") + F.col("start") + F.col("until") - F.col("size")
    served: Column = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.round("target").cast("long") - begin))
    finish = F.when(F.col("target") > 0, (begin + F.col("size")) / F.col("target")).otherwise(0.0)
    return turns.select(
        "row", "queue", "bucket", "place", "size", "source_size", "target", "round",
        finish.alias("finish"), served.alias("taken"),
    )


def in_order(turns: DataFrame) -> DataFrame:
    """Turns sorted over all partitions by finish time; equal ones by their place in the queues."""
    order = ["finish", "queue", "bucket", "place"]
    return turns.repartitionByRange(*order).sortWithinPartitions(*order)


def taken_words(turns: DataFrame) -> DataFrame:
    """Per document row: size, source_size, target and the words of all its turns."""
    same = ["row", "queue", "bucket", "place", "size", "source_size", "target"]
    return in_order(turns).groupBy(*same).agg(F.sum("taken").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix in their order, repeated as often as they are served.

    Rows are whole: a turn in service when the budget ends counts when half its words are
    served.  A text without words is never served.  The columns are those of ``docs``.
    """
    turns = schedule(docs, id_col, text_col, source_col).where((F.col("size") > 0) & (2 * F.col("taken") >= F.col("size")))
    return in_order(turns).select("row.*")
