"""Whitened embeddings against exact sums and numpy's own eigenvectors."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from sweepframe.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def plain(rows):
    """Ids, whole numbers, n, sums, eigenvalues and vectors, all computed at once."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in rows], x, n, sums, values[::-1], vectors.T[::-1], centred


def check(rows, out, most=8):
    ids, x, n, sums, values, vectors, centred = plain(rows)
    k = min(most, len(values))
    got = sorted((r.vec_id, r.component) for r in out)
    assert got == sorted((i, c) for i in ids for c in range(1, k + 1))
    by_id = {i: j for j, i in enumerate(ids)}
    trace = values.sum()
    signs = {}
    for r in out:
        j, c = by_id[r.vec_id], r.component - 1
        assert r.n == n
        assert r.deviation == int(((n * x[j] - sums) ** 2).sum())
        assert r.explained == pytest.approx(values[c] / trace, rel=1e-9)
        assert r.identity_error <= 1e-9
        want = centred[j] @ vectors[c] / math.sqrt(values[c])
        if abs(want) > 1e-3:
            signs.setdefault(c, np.sign(r.whitened / want))
        assert r.whitened * signs.get(c, 1) == pytest.approx(want, rel=1e-6, abs=2e-3 if c not in signs else 1e-7)


def test_query_against_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    out = queries.op13_embedding_whitening(spark, SF).collect()
    check(rows, out)


def table(spark, rows):
    names = "id component n deviation whitened k vec i s dims sums explained identity_error".split()
    schema = "vec_id long, embedding array<float>" + "".join(f", {n} string" for n in names)
    return spark.createDataFrame([(*r, *(None for _ in names)) for r in rows], schema)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(c) for c in rng.standard_normal(3)]) for k in range(40)]
    odd = [
        (100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]),
        (104, [1.0, float("inf"), 2.0]), (105, [1.0, 2.0]), (None, None), (106, [1e30, 0.0, 0.0]),
    ]
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in rows]
    out = whitening.whitened(table(spark, rows + odd).repartition(3)).collect()
    check(rows, out)
    # repeated rows and ids count as often as they come
    twice = whitening.whitened(table(spark, rows + rows)).collect()
    assert len(twice) == 2 * len(out) and {r.n for r in twice} == {80}
    for nothing in ([], odd[:5], [(1, [1.0, 2.0])] * 4):
        got = whitening.whitened(table(spark, nothing))
        assert got.columns == whitening.whitened(table(spark, rows)).columns and got.collect() == []


def test_exact_beyond_53_bits(spark):
    rows = [(k, [float(np.float32(3e3 * k)), float(np.float32(0.5 * k * k))]) for k in range(30)]
    out = whitening.whitened(table(spark, rows)).collect()
    ids, x, n, sums, *_ = plain(rows)
    want = {i: int(((n * r - sums) ** 2).sum()) for i, r in zip(ids, x)}
    assert 1 << 53 < max(want.values()) < 1 << 63 and {r.vec_id: r.deviation for r in out} == want
    far = [(k, [1e9 * k, 0.0]) for k in range(30)]
    assert {r.deviation for r in whitening.whitened(table(spark, far)).collect() if r.vec_id == 0} == {None}


@pytest.mark.parametrize("seed", range(6))
def test_eigenvectors(seed):
    rng = np.random.default_rng(seed)
    d = [1, 2, 3, 20, 64, 64][seed]
    values = rng.exponential(1.0, d) ** 3
    if seed >= 3:
        # equal and nearly equal ones, among them the eighth and ninth
        values = np.sort(values)[::-1]
        values[1] = values[2] = values[0] * (1 - 1e-13)
        values[6:10] = values[6]
        values[12:] = 0 if seed == 5 else values[12:]
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    got, vectors = whitening.eigen(matrix, 8)
    k = min(8, d)
    scale = values.max()
    assert np.allclose(got, np.sort(values)[::-1][:k], rtol=0, atol=1e-13 * scale * d)
    assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-12)
    assert np.abs(matrix @ vectors.T - vectors.T * got).max() < 1e-13 * scale * d


def test_sturm_counts():
    rng = np.random.default_rng(3)
    diagonal, off = rng.standard_normal(12), rng.standard_normal(11)
    off[4] = 0
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = np.linspace(-4, 4, 33)
    assert whitening.above(diagonal, off, at).tolist() == [(values > a).sum() for a in at]
