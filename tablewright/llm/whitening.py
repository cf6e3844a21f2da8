"""Embedding whitening by a block Jacobi-Davidson method.

The leading eigenvectors of the covariance are found without forming it.  The vectors
are settled once as packed integer blocks; a Spark job multiplies the centred rows Y by a
narrow matrix W and sums Y'(YW) task by task, so that only dimension x components numbers
a task are shuffled and dimension x components numbers reach the driver.  The driver
holds a small search space:

* Rayleigh-Ritz on the space gives approximate pairs and residuals;
* each open pair has a correction equation, projected off all locked and current
  vectors, solved by MINRES; all equations advance together, one job a step;
* the corrections widen the space; pairs whose residual has reached double precision
  are locked, in falling order, until all are.

Rows and covariance stay in tasks whatever their number.  What the driver holds grows with the
dimension of a vector (at most ``MAX_DIMENSION``) alone: some 120 vectors and their images.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import settle

COMPONENTS = 8
#: x = floor(SCALE * entry) + OFFSET, a long.
SCALE, OFFSET = 1024, 100_000
#: Entries from here on have no x that sums stay exact for; such a vector counts as not finite.
LARGEST_ENTRY = float(1 << 30)
MAX_DIMENSION = 16_384
BLOCK_BYTES = 2 << 20

#: Residuals, as a share of the largest eigenvalue: aimed at, and accepted when rounding allows no less.
RESIDUAL = 2.0**-46
ROUNDING = 2.0**-40
INNER_STEPS = 4
INNER_SHARE = 1e-2
MAX_ROUNDS = 100
#: Directions of the search space for each wanted pair: at most, and after a restart.
MOST_DIRECTIONS, KEPT_DIRECTIONS = 12, 4
SEED = 20_240_613


def _entries(vector_col: str) -> Column:
    return F.col(f"`{vector_col}`").cast("array<double>")


def _usable(vector_col: str) -> Column:
    """No null, no entry that is null, not finite or too large."""
    fine = F.forall(_entries(vector_col), lambda c: F.coalesce(F.abs(c) < LARGEST_ENTRY, F.lit(False)))
    return F.coalesce(fine & (F.size(_entries(vector_col)) > 0), F.lit(False))


def _whole(column: pa.Array, dim: int) -> np.ndarray:
    """x of each row of a list column whose rows all have ``dim`` entries."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.floor(values * SCALE).astype(np.int64) + OFFSET


def _packed(df: DataFrame, vector_col: str, dim: int) -> DataFrame:
    """One row a block: its x, row by row, as 64-bit integers."""
    step = max(1, BLOCK_BYTES // (8 * dim))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _whole(batch.column(0), dim)
            for at in range(0, len(whole), step):
                part = whole[at : at + step]
                yield pa.record_batch({"data": pa.array([part.tobytes()], pa.binary())})

    return settle(df.select(_entries(vector_col)).mapInArrow(pack, "data binary"), "vectors")


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for data in batch.column(0):
            yield np.frombuffer(data.as_buffer(), np.int64).reshape(-1, dim)


def _sums(blocks: DataFrame, dim: int) -> tuple[int, list[int], int]:
    """Rows, sum of each dimension and the largest absolute x; all exact."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, largest = [0] * dim, 0, 0
        for whole in _matrices(batches, dim):
            rows += len(whole)
            total = [a + int(b) for a, b in zip(total, whole.sum(axis=0), strict=True)]
            largest = max(largest, int(np.abs(whole).max()))
        if rows:
            yield pa.record_batch({
                "dim": pa.array(range(dim), pa.int32()), "rows": pa.array([rows] * dim, pa.int64()),
                "total": pa.array(map(str, total)), "largest": pa.array([largest] * dim, pa.int64()),
            })

    added = blocks.mapInArrow(add, "dim int, rows long, total string, largest long")
    found = added.groupBy("dim").agg(
        F.sum("rows").alias("rows"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
        F.max("largest").alias("largest"),
    ).orderBy("dim").collect()
    return (found[0]["rows"], [int(r["total"]) for r in found], found[0]["largest"]) if found else (0, [], 0)


class _Centred:
    """Products with the covariance of the packed rows, divisor n, centred before multiplying."""

    def __init__(self, blocks: DataFrame, dim: int, n: int, sums: list[int]):
        self.blocks, self.dim, self.n, self.sums = blocks, dim, n, np.array(sums, np.int64)

    def _summed(self, part: Callable[[np.ndarray], np.ndarray], height: int, width: int) -> np.ndarray:
        """Sum over all blocks of part(centred rows), a height x width matrix."""
        dim, n, sums = self.dim, self.n, self.sums

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((height, width))
            for whole in _matrices(batches, dim):
                total += part((n * whole - sums) / n)
            yield pa.record_batch({"at": pa.array(range(height), pa.int32())} | {
                f"c{k}": pa.array(total[:, k]) for k in range(width)})

        names = [f"c{k}" for k in range(width)]
        added = self.blocks.mapInArrow(add, ", ".join(["at int", *[f"{c} double" for c in names]]))
        found = added.groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).orderBy("at").collect()
        return np.array([[r[c] for c in names] for r in found]).reshape(height, width)

    def product(self, wide: np.ndarray) -> np.ndarray:
        return self._summed(lambda rows: rows.T @ (rows @ wide), self.dim, wide.shape[1]) / self.n

    def projected_mean(self, wide: np.ndarray) -> np.ndarray:
        return self._summed(lambda rows: (rows @ wide).sum(axis=0)[None, :], 1, wide.shape[1])[0] / self.n

    def projected_covariance(self, wide: np.ndarray, mean: np.ndarray) -> np.ndarray:
        def part(rows: np.ndarray) -> np.ndarray:
            spread = rows @ wide - mean
            return spread.T @ spread

        return self._summed(part, wide.shape[1], wide.shape[1]) / self.n

    def variances(self) -> np.ndarray:
        return self._summed(lambda rows: (rows * rows).sum(axis=0)[None, :], 1, self.dim)[0] / self.n


def _off(space: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """``wide`` without its part in the orthonormal ``space``; twice, so that rounding is projected too."""
    for _ in range(2):
        wide = wide - space @ (space.T @ wide)
    return wide


def _widened(space: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Orthonormal directions of ``more`` outside ``space``."""
    kept = np.empty((len(space), 0))
    for vector in more.T:
        size = np.linalg.norm(vector)
        if size == 0 or not np.isfinite(size):
            continue
        both = np.hstack([space, kept])
        left = _off(both, (vector / size)[:, None])
        if (length := np.linalg.norm(left)) > 1e-10:
            kept = np.hstack([kept, _off(both, left / length)])
            kept[:, -1] /= np.linalg.norm(kept[:, -1])
    return kept


def _corrections(product, space: np.ndarray, values: np.ndarray, residuals: np.ndarray) -> np.ndarray:
    """MINRES on (I - QQ')(V - value I)(I - QQ') t = -residual for all columns, one product a step."""

    def apply(wide: np.ndarray) -> np.ndarray:
        wide = _off(space, wide)
        return _off(space, product(wide) - wide * values)

    begin = _off(space, -residuals)
    beta = np.linalg.norm(begin, axis=0)
    aimed = np.maximum(beta, 1e-300) * INNER_SHARE
    found = np.zeros_like(begin)
    older, now = np.zeros_like(begin), begin / np.where(beta > 0, beta, 1)
    ways = [np.zeros_like(begin), np.zeros_like(begin)]
    cos, sin = [np.ones_like(beta), np.ones_like(beta)], [np.zeros_like(beta), np.zeros_like(beta)]
    left, coupling = beta.copy(), np.zeros_like(beta)
    for _ in range(min(INNER_STEPS, len(space) - space.shape[1])):
        image = apply(now)
        alpha = (now * image).sum(axis=0)
        ahead = image - alpha * now - coupling * older
        following = np.linalg.norm(ahead, axis=0)
        # Two earlier rotations on the new column of the tridiagonal matrix, then a new one.
        third = sin[0] * coupling
        second = cos[1] * cos[0] * coupling + sin[1] * alpha
        first = cos[1] * alpha - sin[1] * cos[0] * coupling
        size = np.hypot(first, following)
        size = np.where(size > 0, size, 1)
        cosine, sine = first / size, following / size
        way = (now - second * ways[1] - third * ways[0]) / size
        live = np.abs(left) > aimed
        found = found + np.where(live, cosine * left, 0) * way
        left = np.where(live, -sine * left, left)
        ways, cos, sin = [ways[1], way], [cos[1], cosine], [sin[1], sine]
        older, now = now, ahead / np.where(following > 0, following, 1)
        coupling = following
        if not (np.abs(left) > aimed).any():
            break
    return _off(space, found)


def leading_eigenpairs(
    product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int = COMPONENTS, seed: int = SEED,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Falling eigenvalues, unit eigenvectors (columns) and residual norms of a symmetric operator.

    ``product`` multiplies the operator by a narrow matrix.  Every residual is at most
    2**-46 of the largest eigenvalue, or has stopped falling below 2**-40 of it, where
    rounding of the products themselves ends.
    """
    wanted = min(wanted, dim)
    start = np.random.default_rng(seed).standard_normal((dim, min(dim, wanted + 2)))
    basis = np.linalg.qr(start)[0]
    images = product(basis)
    locked, locked_images = np.empty((dim, 0)), np.empty((dim, 0))
    largest, before = 0.0, np.inf
    for _ in range(MAX_ROUNDS):
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, images = basis @ turn, images @ turn
        largest = max(largest, abs(values[0]))
        missing = min(wanted - locked.shape[1], basis.shape[1])
        residuals = images[:, :missing] - basis[:, :missing] * values[:missing]
        residuals = residuals - locked @ (locked.T @ residuals)
        norms = np.linalg.norm(residuals, axis=0)
        full = basis.shape[1] + locked.shape[1] >= dim
        stalled = norms.max() > before / 2 and norms.max() <= ROUNDING * largest
        before = norms.max()
        done = norms <= RESIDUAL * largest
        count = missing if full or stalled else int(np.argmin(done)) if not done.all() else missing
        locked = np.hstack([locked, basis[:, :count]])
        locked_images = np.hstack([locked_images, images[:, :count]])
        if locked.shape[1] == wanted:
            break
        if count:
            before = np.inf
        missing -= count
        keep = basis.shape[1] if basis.shape[1] <= MOST_DIRECTIONS * wanted else KEPT_DIRECTIONS * wanted
        basis, images = basis[:, count : count + keep], images[:, count : count + keep]
        still = norms[count:] > RESIDUAL * largest
        space = np.hstack([locked, basis[:, :missing]])
        steps = _corrections(product, space, values[count : count + missing][still], residuals[:, count:][:, still])
        fresh = _widened(np.hstack([locked, basis]), np.hstack([steps, residuals[:, count:][:, still]]))
        if not fresh.shape[1]:
            fresh = _widened(np.hstack([locked, basis]), np.random.default_rng(seed + 1).standard_normal((dim, wanted)))
        basis, images = np.hstack([basis, fresh]), np.hstack([images, product(fresh)])
    else:
        raise ArithmeticError(f"residuals stay at {before / largest:.1e} of the largest eigenvalue")
    small = locked.T @ locked_images
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors, images = locked @ turn, locked_images @ turn
    size = np.linalg.norm(vectors, axis=0)
    return values, vectors / size, np.linalg.norm(images - vectors * values, axis=0) / size


def whitened(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every usable row as struct ``row`` with its whitened vector.

    Columns: n (rows of the fit list), deviation (decimal(38,0), the sum over dimensions of
    (n * x - S) ** 2, exact), whitened (array<double>, one entry a component, falling
    eigenvalue), explained (array<double>, shares of the trace), identity_error (largest absolute
    entry of the whitened covariance minus the identity).

    * Rows whose vector is null or empty, or has an entry that is null, not finite or of
      2**30 or more, are left out, of the fit list too; the row's other columns may be null.
    * Vectors of another length than the most frequent one (of equally frequent ones the longest)
      share no covariance with the others and are left out alike.
    * Repeated rows count as often as they are there and are all returned.
    * A component without variance (fewer differing rows than components, or all rows equal) has
      no whitened entry (null), explains 0 and is left out of identity_error.
    * An empty table, or one without usable rows, gives an empty result.
    * Tied eigenvalues leave the choice of their vectors open; it is the same for all rows.
    """
    lengths = df.where(_usable(vector_col)).groupBy(F.size(_entries(vector_col)).alias("dim")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), _entries(vector_col).alias("vector"))
    columns = "row, n, deviation, whitened, explained, identity_error".split(", ")
    if not most:
        empty = [F.lit(None).cast(t).alias(c) for c, t in zip(
            columns[1:], ("long", "decimal(38,0)", "array<double>", "array<double>", "double"), strict=True)]
        return rows.where("false").select("row", *empty)
    dim = most[0]["dim"]
    if dim > MAX_DIMENSION:
        raise ValueError(f"vectors have {dim} entries; {MAX_DIMENSION} is the most")
    same = _usable(vector_col) & (F.size(_entries(vector_col)) == dim)
    blocks = _packed(df.where(same), vector_col, dim)
    n, sums, largest = _sums(blocks, dim)
    if 2 * n * largest >= 1 << 62:
        raise ArithmeticError(f"{n} rows with entries up to {largest} exceed exact 64-bit deviations")
    centred = _Centred(blocks, dim, n, sums)
    values, vectors, _ = leading_eigenpairs(centred.product, dim, components)
    trace = float(centred.variances().sum())
    live = values > max(trace, 0.0) * 1e-12
    wide = vectors[:, live] / np.sqrt(values[live])
    error = 0.0
    if live.any():
        mean = centred.projected_mean(wide)
        error = float(np.abs(centred.projected_covariance(wide, mean) - np.eye(live.sum())).max())
    explained = [float(v / trace) if ok else 0.0 for v, ok in zip(values, live, strict=True)]

    total, kind = np.array(sums, np.int64), pa.struct([("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])
    fits = dim * (2 * n * largest) ** 2 < 1 << 63

    @F.arrow_udf("struct<deviation: decimal(38,0), whitened: array<double>>")
    def project(vector: pa.Array) -> pa.Array:
        apart = n * _whole(vector, dim) - total
        if fits or (apart.astype(float) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
            deviation = pa.array((apart * apart).sum(axis=1)).cast(pa.decimal128(38, 0))
        else:
            deviation = pa.array((apart.astype(object) ** 2).sum(axis=1), pa.decimal128(38, 0))
        scores = np.full((len(apart), len(live)), np.nan)
        scores[:, live] = apart / n @ wide
        flat = pa.array(scores.ravel(), mask=np.tile(~live, len(apart)))
        offsets = pa.array(np.arange(len(apart) + 1) * len(live), pa.int32())
        return pa.StructArray.from_arrays([deviation, pa.ListArray.from_arrays(offsets, flat)], fields=list(kind))

    alike = _usable("vector") & (F.size("vector") == dim)
    return rows.where(alike).withColumn("found", project("vector")).select(
        "row", F.lit(n).cast("long").alias("n"), "found.deviation", "found.whitened",
        F.array(*map(F.lit, explained)).alias("explained"), F.lit(error).alias("identity_error"),
    )
