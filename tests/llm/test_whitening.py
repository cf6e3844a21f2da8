import math

import numpy as np
import pytest

from tablewright.llm import queries, whitening
from tablewright.llm.whitening import leading_eigenpairs, whitened


def longs(vectors):
    return [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]


def brute(vectors, components=8):
    """Exact deviations; whitened entries by a dense eigenvalue solver."""
    x = longs(vectors)
    n, sums = len(x), [sum(column) for column in zip(*x, strict=True)]
    apart = [[n * c - s for c, s in zip(row, sums, strict=True)] for row in x]
    centred = np.array(apart, float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return [sum(c * c for c in row) for row in apart], centred @ axes / np.sqrt(values), values / (centred**2).mean(axis=0).sum()


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, row string, n int, whitened double")


def vectors(count, dim, seed=0):
    spread = np.linspace(1, 0.2, dim)
    return [[float(np.float32(c)) for c in v] for v in np.random.default_rng(seed).standard_normal((count, dim)) * spread]


@pytest.mark.parametrize(("count", "dim"), [(300, 24), (40, 5), (12, 70)])
def test_equals_a_dense_solver(spark, count, dim):
    given = vectors(count, dim)
    found = {r.row.vec_id: r for r in whitened(frame(spark, [(k, v, "x", 1, 2.0) for k, v in enumerate(given)])).collect()}
    deviations, scores, shares = brute(given)
    assert [int(found[k].deviation) for k in range(count)] == deviations
    mine = np.array([found[k].whitened for k in range(count)])
    signs = np.sign((mine * scores).sum(axis=0))
    assert np.abs(mine * signs - scores).max() < 1e-9
    assert np.allclose(found[0].explained, shares, rtol=1e-12)
    assert {r.n for r in found.values()} == {count} and found[0].identity_error < 1e-9


def test_eigenpairs_of_close_and_repeated_values():
    rng = np.random.default_rng(5)
    axes = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    values = np.sort(np.concatenate([[9, 9, 5, 5 - 1e-6, 4, 3.9, 3.8], np.linspace(3.7999, 0, 83)]))[::-1]
    calls = []
    matrix = axes * values @ axes.T

    def product(wide):
        calls.append(wide.shape[1])
        return matrix @ wide

    found, columns, residuals = leading_eigenpairs(product, 90)
    assert np.abs(found - values[:8]).max() < 1e-11 and residuals.max() <= 2.0**-40 * 9
    assert np.abs(columns.T @ columns - np.eye(8)).max() < 1e-12
    assert len(calls) < 60


def test_rows_left_out(spark):
    given = vectors(20, 3)
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]),
           (104, []), (105, [1.0, 2.0]), (106, [2.0**31, 0.0, 0.0]), (None, given[0]), (0, given[0])]
    rows = [(k, v, None, None, None) for k, v in [*enumerate(given), *odd]]
    found = whitened(frame(spark, rows)).collect()
    assert sorted(r.row.vec_id for r in found if r.row.vec_id is not None) == sorted([*range(20), 0])
    assert {r.n for r in found} == {22}
    first = [r for r in found if r.row.vec_id in (0, None)]
    assert len(first) == 3 and len({tuple(r.whitened) for r in first}) == 1 and len(first[0].whitened) == 3


def test_no_variance_and_empty_tables(spark):
    same = whitened(frame(spark, [(k, [1.0, 2.0], "", 0, 0.0) for k in range(4)])).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(0, [None, None], [0.0, 0.0], 0.0)] * 4
    line = whitened(frame(spark, [(k, [float(k), 0.0, 1.0], "", 0, 0.0) for k in range(5)])).collect()
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in line)
    assert whitened(frame(spark, [])).collect() == [] and whitened(frame(spark, [(1, None, "", 0, 0.0)])).collect() == []


def test_deviations_beyond_64_bits(spark):
    given = [[2.0**29, 1.0], [-(2.0**29), 0.5], [0.25, 3.0]]
    found = {r.row.vec_id: int(r.deviation) for r in whitened(frame(spark, [(k, v, "", 0, 0.0) for k, v in enumerate(given)])).collect()}
    assert [found[k] for k in range(3)] == brute(given, 1)[0] and max(found.values()) > 2**63


def test_blocks_and_partitions_do_not_matter(spark, monkeypatch):
    given = frame(spark, [(k, v, "", 0, 0.0) for k, v in enumerate(vectors(60, 10))])
    before = {r.row.vec_id: r.whitened for r in whitened(given).collect()}
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 1)
    after = {r.row.vec_id: r.whitened for r in whitened(given.repartition(7)).collect()}
    assert np.abs(np.abs(np.array([before[k] for k in range(60)])) - np.abs(np.array([after[k] for k in range(60)]))).max() < 1e-9


def test_query_over_the_table(spark, tables):
    found = queries.QUERIES["op11_jacobi_davidson_whitening"](spark, tables)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = spark.read.parquet(f"{tables}/embeddings.parquet").orderBy("vec_id").collect()
    deviations, scores, shares = brute([r.embedding for r in rows])
    at = {r.vec_id: k for k, r in enumerate(rows)}
    got = found.collect()
    assert len(got) == 8 * len(rows)
    mine = np.zeros((len(rows), 8))
    for r in got:
        mine[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviations[at[r.vec_id]] and abs(r.explained / shares[r.component - 1] - 1) < 1e-9
    assert np.abs(mine * np.sign((mine * scores).sum(axis=0)) - scores).max() < 1e-8
    assert got[0].identity_error < 1e-9
