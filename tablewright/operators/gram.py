"""Pairwise moments of many numeric fields in one pass, by blocks of fields.

Every task folds its Arrow batches into square blocks of pairwise-complete moments
(count, both means, both sums of squares, cross product), computed by matrix products
over the values and their masks.  Blocks of different tasks are merged pair by pair by
the update formulas for two samples, in two levels, so that neither a task nor a group
holds more than one block beside the one it is reading.  The plan names each field
once, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.functions.columns import number

BLOCK_FIELDS = 64
MERGE_BUCKETS = 64
# A sum of squares this small against its raw form has lost digits and is taken again.
_CANCELLED = 1e-8

_PART = "low int, high int, bucket int, moments binary"
_PARTS = ("n", "x", "y", "xx", "yy", "xy")  # planes of a block


def pairwise_correlations(df: DataFrame, columns: list[str], block_fields: int = BLOCK_FIELDS) -> DataFrame:
    """``i, j, n, r`` for positions i <= j of ``columns``: the rows holding both and Pearson's r.

    r is missing when either field is constant over those rows (or they are fewer than
    two) and NaN when one of them is infinite there.  NULL and NaN are missing.  Tables
    without rows yield every pair with n = 0; repeated rows count as often as they occur.
    """
    width = len(columns)
    blocks = [(low, min(low + block_fields, width)) for low in range(0, width, block_fields)]
    values = df.select(*[number(df, name).alias(f"v{k}") for k, name in enumerate(columns)])
    parts = values.mapInArrow(_block_parts(blocks), _PART)
    for keys in (["low", "high", "bucket"], ["low", "high"]):
        parts = parts.groupBy(*keys).applyInArrow(_merged, _PART)
    found = parts.mapInArrow(_block_pairs(blocks), "i int, j int, n bigint, r double")
    every = df.sparkSession.range(width).select(
        F.col("id").cast("int").alias("i"),
        F.explode(F.sequence(F.col("id").cast("int"), F.lit(width - 1))).alias("j"))
    joined = every.join(found, ["i", "j"], "left")
    return joined.select("i", "j", F.coalesce("n", F.lit(0)).alias("n"), "r")


def _block_parts(blocks: list[tuple[int, int]]):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            # A missing cell is NaN from here on.
            table = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            sides = [_Side(table[:, low:high]) for low, high in blocks]
            for a in range(len(blocks)):
                for b in range(a, len(blocks)):
                    new = _moments(sides[a], sides[b])
                    held[a, b] = _combined(held[a, b], new) if (a, b) in held else new
        bucket = TaskContext.get().partitionId() % MERGE_BUCKETS
        for (a, b), moments in held.items():
            yield _row(a, b, bucket, moments)

    return parts


class _Side:
    """A block of fields of one batch: values about each field's first one, and masks."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.held = cells, ~np.isnan(cells)
        self.mask = self.held.astype(float)
        self.infinite = np.isinf(cells)
        usable = self.held & ~self.infinite
        first = usable.argmax(axis=0)
        picked = cells[first, np.arange(cells.shape[1])]
        self.origin = np.where(usable.any(axis=0), picked, 0.0)
        # About a value of its own a constant field is exactly zero.
        self.shifted = np.where(usable, np.where(usable, cells, 0.0) - self.origin, 0.0)
        self.squares = self.shifted**2


def _moments(a: _Side, b: _Side) -> np.ndarray:
    n = a.mask.T @ b.mask
    x, y = a.shifted.T @ b.mask, a.mask.T @ b.shifted
    raw_xx, raw_yy = a.squares.T @ b.mask, a.mask.T @ b.squares
    many = np.maximum(n, 1.0)
    x, y = x / many, y / many
    xx, yy = raw_xx - n * x * x, raw_yy - n * y * y
    xy = a.shifted.T @ b.shifted - n * x * y
    moments = np.stack([n, a.origin[:, None] + x, b.origin[None, :] + y, xx, yy, xy])
    doubtful = ((xx <= _CANCELLED * raw_xx) & (raw_xx > 0)) | ((yy <= _CANCELLED * raw_yy) & (raw_yy > 0))
    for i, j in zip(*np.nonzero(doubtful)):
        both = a.held[:, i] & b.held[:, j]
        moments[1:, i, j] = _plain(a.cells[both, i], b.cells[both, j])
    if a.infinite.any() or b.infinite.any():
        tainted = (a.infinite.T.astype(float) @ b.mask + a.mask.T @ b.infinite.astype(float)) > 0
        moments[1:, tainted] = np.nan
    return moments


def _plain(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """The moments of two short columns about their own means, exact for constants."""
    with np.errstate(invalid="ignore"):
        dx, dy = x - x[0], y - y[0]
        mx, my = dx.mean(), dy.mean()
        ex = np.zeros_like(dx) if not dx.any() else dx - mx
        ey = np.zeros_like(dy) if not dy.any() else dy - my
        return x[0] + mx, y[0] + my, ex @ ex, ey @ ey, ex @ ey


def _combined(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The moments of two disjoint samples together."""
    n = p[0] + q[0]
    share = q[0] / np.maximum(n, 1.0)
    # A side without rows has no means to differ by.
    both = (p[0] > 0) & (q[0] > 0)
    with np.errstate(invalid="ignore"):
        dx, dy = np.where(both, q[1] - p[1], 0.0), np.where(both, q[2] - p[2], 0.0)
        empty = p[0] == 0
        weight = p[0] * share
        return np.stack([
            n,
            np.where(empty, q[1], p[1] + dx * share),
            np.where(empty, q[2], p[2] + dy * share),
            p[3] + q[3] + dx * dx * weight,
            p[4] + q[4] + dy * dy * weight,
            p[5] + q[5] + dx * dy * weight,
        ])


def _row(low: int, high: int, bucket: int, moments: np.ndarray) -> pa.RecordBatch:
    # The shape travels in front of the planes.
    head = np.array(moments.shape[1:], dtype=float)
    packed = np.concatenate([head, moments.ravel()]).tobytes()
    return pa.record_batch({
        "low": pa.array([low], pa.int32()), "high": pa.array([high], pa.int32()),
        "bucket": pa.array([bucket], pa.int32()), "moments": pa.array([packed], pa.binary())})


def _unpacked(cell: pa.Scalar) -> np.ndarray:
    flat = np.frombuffer(cell.as_buffer(), dtype=float)
    return flat[2:].reshape(len(_PARTS), int(flat[0]), int(flat[1]))


def _merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for cell in batch.column("moments"):
            moments = _unpacked(cell)
            total = moments if total is None else _combined(total, moments)
    if total is not None:
        yield _row(key[0].as_py(), key[1].as_py(), 0, total)


def _block_pairs(blocks: list[tuple[int, int]]):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, cell in zip(batch.column("low"), batch.column("high"), batch.column("moments")):
                n, _, _, xx, yy, xy = _unpacked(cell)
                i = blocks[low.as_py()][0] + np.arange(n.shape[0])[:, None] + 0 * n.astype(int)
                j = blocks[high.as_py()][0] + np.arange(n.shape[1])[None, :] + 0 * n.astype(int)
                with np.errstate(invalid="ignore", divide="ignore"):
                    r = xy / (np.sqrt(xx) * np.sqrt(yy))
                flat = (n < 2) | (xx == 0) | (yy == 0)
                r = np.where(i == j, 1.0, r)
                kept = i <= j
                yield pa.record_batch({
                    "i": pa.array(i[kept], pa.int32()), "j": pa.array(j[kept], pa.int32()),
                    "n": pa.array(n[kept].astype(np.int64)),
                    "r": pa.array(r[kept], pa.float64(), mask=flat[kept])})

    return pairs
