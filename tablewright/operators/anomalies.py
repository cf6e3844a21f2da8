"""Isolation-forest anomaly detection (Liu, Ting and Zhou, 2008).

Every tree sees a uniform sample, without replacement, of all complete rows: those with
the smallest digests of row and tree.  Smallest-k sets merge, so one pass keeps k rows a
tree in every task and two small merges finish them; the forest is the same however the
table is split, and growing it costs the same for any table.  Trees grow in parallel
tasks, scoring is one pass of an Arrow-batched function with the forest attached.  Splits
are uniform between a node's extremes, so rescaling a field would change nothing and no
standardising pass is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions.columns import ROW_ID, col, finite, is_small, require, require_numeric
from tablewright.functions.storage import materialize
from tablewright.operators.quantiles import SMALL_INPUT_BYTES, quantile_table
from tablewright.operators.sampling import SEED

TREES = 100
ROWS_PER_TREE = 256
#: Parts that the rows kept by tasks are merged in before they meet, one group a tree and part.
MERGE_PARTS = 1024
LEAST_ROWS = 10
REVIEW_ROWS = 100
_EULER = 0.5772156649015329


class Forest(NamedTuple):
    """Complete binary trees as arrays: per tree 2^depth - 1 splits and 2^depth leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    depth: int
    normal_path: float


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points: 2 H(n-1) - 2 (n-1)/n."""
    n = np.asarray(n, dtype=float)
    larger = np.maximum(n, 3)
    general = 2 * (np.log(larger - 1) + _EULER) - 2 * (larger - 1) / larger
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, general))


def complete_rows(df: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [finite(df, c).isNotNull() for c in columns])


def _digests(seeds: np.ndarray, salt: int) -> np.ndarray:
    """Exponential variates of mean 1, one a 64-bit seed (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = seeds.astype(np.uint64) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return -np.log(((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54)


def _smallest(seeds: np.ndarray, copies: np.ndarray, tree: int, trees: int, count: int, bound: float):
    """(row, digest) of the ``count`` smallest digests of one tree below ``bound``, a row standing for all its copies.

    The digests of m equal rows are the order statistics of m variates; the next one
    lies a variate over (m - copies so far) beyond the last, so none but small ones are made.
    """
    digests = _digests(seeds, tree + 1) / copies
    rows = np.flatnonzero(digests < bound)
    digests, step = digests[rows], 1
    kept_rows, kept = np.empty(0, dtype=np.intp), np.empty(0)
    while len(rows):
        kept_rows, kept = np.concatenate([kept_rows, rows]), np.concatenate([kept, digests])
        if len(kept) > count:
            best = np.argpartition(kept, count - 1)[:count]
            kept_rows, kept = kept_rows[best], kept[best]
            bound = kept.max()
        more = (copies[rows] > step) & (digests < bound)
        rows, digests = rows[more], digests[more]
        digests = digests + _digests(seeds[rows], tree + 1 + step * trees) / (copies[rows] - step)
        step += 1
    return kept_rows, kept


def _keep_smallest(batches: Iterator[pd.DataFrame], trees: int, rows_per_tree: int, width: int) -> Iterator[pd.DataFrame]:
    """The rows with the smallest digests of each tree among a task's batches."""
    best = [(np.empty(0), np.empty(0, dtype=np.int64), np.empty((0, width)))] * trees
    part = 0
    for batch in batches:
        if batch.empty:
            continue
        # A cell of the batch is a view that would keep the whole batch in memory; rows of a
        # matrix are copied when they are chosen.
        part, points = int(batch["part"].iloc[0]), np.stack(batch["x"].to_numpy())
        numbers, copies = batch["seed"].to_numpy(), batch["copies"].to_numpy()
        for tree, held in enumerate(best):
            bound = held[0].max() if len(held[0]) == rows_per_tree else np.inf
            chosen, digests = _smallest(numbers, copies, tree, trees, rows_per_tree, bound)
            if len(chosen):
                merged = [np.concatenate(pair) for pair in zip(held, (digests, numbers[chosen], points[chosen]))]
                order = np.lexsort((merged[1], merged[0]))[:rows_per_tree]
                best[tree] = tuple(values[order] for values in merged)
    for tree, (digests, numbers, points) in enumerate(best):
        if len(digests):
            yield pd.DataFrame({"tree": tree, "part": part, "digest": digests, "seed": numbers, "x": list(points)})


def draw_rows(
    df: DataFrame, columns: list[str], trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE,
    seed: int = SEED, key: list[str] | None = None,
) -> DataFrame:
    """(tree, rank, x): for each tree a uniform sample of the complete rows, without replacement.

    ``key`` tells rows apart; without one equal rows are counted first, so that each copy
    has its own chance.  A table with fewer rows gives each tree all of them.
    """
    keys = list(key or [])
    values = F.array(*[finite(df, c) for c in columns])
    rows = df.filter(complete_rows(df, columns)).select(values.alias("x"), *[col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    # -0.0 and 0.0 are one value.
    rows = rows.withColumn("x", F.transform("x", lambda v: v + F.lit(0.0)))
    seeds = F.xxhash64(F.lit(seed), "x", *[f"k{i}" for i in range(len(keys))])
    counted = rows.withColumn("copies", F.lit(1).cast("long")) if keys else rows.groupBy("x").agg(F.count("*").alias("copies"))
    seeded = counted.select("x", seeds.alias("seed"), "copies", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)).alias("part"))

    width = len(columns)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _keep_smallest(batches, trees, rows_per_tree, width)

    kept = seeded.mapInPandas(keep, "tree int, part int, digest double, seed long, x array<double>")
    for group in (["tree", "part"], ["tree"]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("digest", "seed", "x"))
        kept = kept.withColumn("rank", rank).filter(F.col("rank") <= rows_per_tree)
    return kept.select("tree", "rank", "x")


def fit_forest(
    df: DataFrame, columns: list[str], seed: int = SEED, key: list[str] | str | None = None,
    trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE,
) -> Forest:
    """A forest of ``trees`` trees, each on ``rows_per_tree`` rows drawn from all complete rows."""
    columns = list(columns)
    require_numeric(df, *columns)
    if not columns:
        raise ValueError("Choose at least one numeric field.")
    if trees < 1 or rows_per_tree < LEAST_ROWS:
        raise ValueError(f"A forest needs a tree, and a tree at least {LEAST_ROWS} rows.")
    keys = [key] if isinstance(key, str) else list(key or ([ROW_ID] if ROW_ID in df.columns else []))
    require(df, *keys)
    # trees x rows_per_tree rows, read by the count and by the growing tasks.
    dealt = materialize(draw_rows(df, columns, trees, rows_per_tree, seed, keys))
    per_tree = dealt.filter(F.col("tree") == 0).count()
    if per_tree < LEAST_ROWS:
        raise ValueError(f"Only {per_tree} rows hold all fields; {LEAST_ROWS} are needed.")
    depth = max(1, math.ceil(math.log2(per_tree)))
    # A fixed number of tasks: the rows are few, but growing takes its time.
    dealt = dealt.repartition(min(trees, df.sparkSession.sparkContext.defaultParallelism), "tree")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        points = np.stack(pdf.sort_values("rank")["x"].to_numpy())
        feature, threshold, path = _grow(points, depth, np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], "feature": [feature], "threshold": [threshold], "path": [path]})

    grown = (
        dealt.groupBy("tree")
        .applyInPandas(grow, "tree int, feature array<int>, threshold array<double>, path array<double>")
        .orderBy("tree")
        .collect()
    )
    return Forest(
        np.array([t["feature"] for t in grown], dtype=np.int32),
        np.array([t["threshold"] for t in grown], dtype=float),
        np.array([t["path"] for t in grown], dtype=float),
        depth,
        float(average_path(per_tree)),
    )


def _grow(points: np.ndarray, depth: int, rng: np.random.Generator):
    splits = 2**depth - 1
    feature, threshold = np.zeros(splits, dtype=np.int32), np.full(splits, np.inf)
    path = np.zeros(splits + 1)

    def finish(node: int, level: int, length: float) -> None:
        # An early leaf: its splits send everything left, to one deepest leaf.
        while level < depth:
            node, level = 2 * node + 1, level + 1
        path[node - splits] = length

    waiting = [(0, 0, points)]
    while waiting:
        node, level, rows = waiting.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        varying = np.flatnonzero(high > low)
        if level == depth or len(rows) <= 1 or not len(varying):
            finish(node, level, level + float(average_path(len(rows))))
            continue
        chosen = int(varying[rng.integers(len(varying))])
        cut = float(rng.uniform(low[chosen], high[chosen]))
        cut = min(cut, float(np.nextafter(high[chosen], low[chosen])))
        feature[node], threshold[node] = chosen, cut
        left = rows[:, chosen] <= cut
        waiting.append((2 * node + 1, level + 1, rows[left]))
        waiting.append((2 * node + 2, level + 1, rows[~left]))
    return feature, threshold, path


def forest_score(forest: Forest, values: list[Column]) -> Column:
    """The anomaly score 2^(-mean path / normal path) of a row."""
    feature, threshold, path, depth, normal = forest
    splits = threshold.shape[1]

    @F.pandas_udf("double")
    def score(*series: pd.Series) -> pd.Series:
        points = np.stack([s.to_numpy(dtype=float, na_value=np.nan) for s in series])
        width = points.shape[1]
        cells, row, total = points.ravel(), np.arange(width), np.zeros(width)
        for start, cut, length in zip(feature.astype(np.intp) * width, threshold, path):
            node = np.zeros(width, dtype=np.intp)
            for _ in range(depth):
                right = cells.take(start.take(node) + row) > cut.take(node)
                node += node + 1 + right
            total += length.take(node - splits)
        return pd.Series(np.exp2(-total / len(path) / normal))

    return score(*values)


def detect_anomalies(
    df: DataFrame,
    columns: list[str],
    contamination: float = 0.05,
    seed: int = SEED,
    key: list[str] | str | None = None,
    trees: int = TREES,
    rows_per_tree: int = ROWS_PER_TREE,
) -> DataFrame:
    """Append ``anomaly`` and ``anomaly_score``.

    A row is flagged when its score exceeds the (1 - contamination) quantile of all
    scores.  Rows missing a field, or infinite in one, are not scored nor flagged.
    Rows are scored once: the threshold and the flags read the kept scores.
    """
    contamination = float(contamination)
    if not 0.0 < contamination <= 0.5:
        raise ValueError("The expected share must lie above 0 and at most at 0.5.")
    forest = fit_forest(df, columns, seed, key, trees, rows_per_tree)
    complete = complete_rows(df, columns)
    score = forest_score(forest, [finite(df, c) for c in columns])
    names = [n for n in df.columns if n not in ("anomaly", "anomaly_score")]
    # Scoring is the costly part: a table that may lie in fewer partitions than there are
    # cores is spread first.
    spread = df.repartition(df.sparkSession.sparkContext.defaultParallelism) if is_small(df, SMALL_INPUT_BYTES) else df
    scored = materialize(spread.select(*[col(n) for n in names], F.when(complete, score).alias("anomaly_score")))
    scores = scored.select("anomaly_score")
    threshold = quantile_table(scores, [], ["anomaly_score"], [1 - contamination]).select(F.col("anomaly_score")[0])
    flag = F.coalesce(F.col("anomaly_score") > threshold.scalar(), F.lit(False))
    return scored.select(*[col(n) for n in names], flag.alias("anomaly"), "anomaly_score")


def top_anomalies(flagged: DataFrame, limit: int = REVIEW_ROWS) -> DataFrame:
    """The flagged rows with the highest scores."""
    rest = [col(n) for n in flagged.columns if n not in ("anomaly", "anomaly_score", ROW_ID)]
    return flagged.filter(F.col("anomaly")).orderBy(F.desc("anomaly_score"), *rest).limit(limit)
