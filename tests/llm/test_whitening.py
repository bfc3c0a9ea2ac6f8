"""Exact whitening against plain exact sums, an exact recurrence and numpy's eigenvectors."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from ravelin.llm import named, whitening


def leverrier(matrix):
    """Coefficients of det(x - matrix), constant first, by exact traces."""
    size, out, part = len(matrix), [1], np.zeros_like(matrix)
    for k in range(1, size + 1):
        part = matrix @ part + out[-1] * np.eye(size, dtype=int).astype(object)
        out.append(-sum((matrix @ part).diagonal()) // k)
    return [int(v) for v in out[::-1]]


def gram(rows):
    y = np.array(rows, object)
    return y.T @ y


def random_rows(seed, n, d, top=9):
    return np.random.default_rng(seed).integers(-top, top + 1, (n, d)).tolist()


MATRICES = {
    "full": gram(random_rows(1, 30, 9)),
    "short of rank": gram(random_rows(2, 3, 7)),
    "sparse": gram([[1, 0, 0, 0], [0, 0, 2, 0], [0, 0, 0, 0]]),
    "repeated": np.diag([5, 2, 5, 5, 2, 0]).astype(object),
    "all equal": np.diag([7] * 5).astype(object),
    "near": np.array([[10**30, 0, 0], [0, 10**30 + 1, 0], [0, 0, 3]], object),
    "one": np.array([[4]], object),
    "blocks": np.kron(np.eye(3, dtype=int), np.array([[2, 1], [1, 2]])).astype(object),
}


@pytest.mark.parametrize("name", MATRICES)
def test_polynomial_roots_and_null_spaces(name):
    matrix = MATRICES[name]
    residues = [(p, whitening.polynomial_modulo(matrix, p).tolist()) for p in whitening.primes(2 * whitening.bound_of(matrix))]
    whole = whitening.remaindered(residues)
    assert whole == leverrier(matrix)
    while whole[0] == 0:
        whole = whole[1:]
    factors = whitening.square_free(whole, whitening.bound_of(matrix))
    back = [1]
    for power, factor in factors:
        for _ in range(power):
            back = [int(v) for v in np.convolve(np.array(back, object), np.array(factor, object))]
    assert back == whole
    found, basis = [], []
    for power, factor in factors:
        for k in range(1, len(factor)):
            root, gap, bits = whitening.isolated(factor, k)
            assert whitening.above(factor, root - 2, bits) == k and whitening.above(factor, root + 2, bits) == k - 1
            found += [Fraction(root, 1 << bits)] * power
            basis += whitening.null_space(matrix, root, gap, bits, power)
    real = matrix.astype(float)
    want = sorted(np.linalg.eigvalsh(real))[-len(found) :]
    assert np.allclose([float(v) for v in sorted(found)], want, rtol=1e-9)
    basis = np.array(basis)
    assert np.abs(basis @ basis.T - np.eye(len(basis))).max() < 1e-12
    for value, vector in zip(found, basis, strict=True):
        assert np.abs(real @ vector - float(value) * vector).max() <= 1e-12 * real.max()


def test_tied_to_the_last_double_but_not_equal():
    roots = sorted(whitening.isolated(leverrier(MATRICES["near"]), k)[0::2] for k in (1, 2))
    bits = max(b for _, b in roots)
    assert abs(sum((r << bits - b) * s for (r, b), s in zip(roots, (-1, 1), strict=True))) == 1 << bits


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) and abs(x) < 2.0**56 for x in v)


def check(rows, out, components=32):
    """Deviations exactly, whitened values against an independent projection of the same space."""
    sizes = {len(v) for _, v in rows if sound(v)}
    seen = 0
    for size in sizes:
        mine = [(k, [floor(64 * Fraction(float(c))) + 1_000_000 for c in v]) for k, v in rows if sound(v) and len(v) == size]
        x = np.array([v for _, v in mine], object).reshape(len(mine), size)
        n, sums = len(mine), x.sum(axis=0)
        exact = ((n * x - sums) ** 2).sum(axis=1)
        matrix = n * (x.T @ x) - np.outer(sums, sums)
        centred = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(r, sums, strict=True)] for r in x])
        values, vectors = np.linalg.eigh(matrix.astype(float) / n**2)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        rank = int((values > values.sum() * 1e-12).sum()) if n > 1 else 0
        want = centred @ vectors[:, :rank] / np.sqrt(values[:rank])
        got = {}
        for r in out:
            if r["n"] == n and r["key"] in {k for k, _ in mine}:
                got.setdefault(r["key"], {})[r["component"]] = r
                seen += 1
        for (key, _), line, deviation in zip(mine, want, exact, strict=True):
            if rank:
                assert sorted(got[key]) == list(range(1, rank + 1))
            for i in range(rank):
                r = got[key][i + 1]
                assert int(r["deviation"]) == deviation and r["identity_error"] < 1e-9
                assert abs(abs(r["whitened"]) - abs(line[i])) < 1e-6
                assert abs(r["explained"] - values[i] / float(sum(matrix.diagonal()) / n**2)) < 1e-9
    assert seen == len(out)


def whiten(spark, rows, components=32):
    df = spark.createDataFrame(rows, "key long, emb array<double>, w int, size string, e string")
    return whitening.whitened(df, "key", "emb", components).collect()


def extra(rows):
    return [(*r, 1, "s", "e") for r in rows]


def test_same_as_numpy(spark):
    draw = np.random.default_rng(4)
    stretch = np.diag([3.0, 2.0, 1.5, 1.0, 0.5, 0.2])
    rows = [(i, (draw.normal(size=6) @ stretch + 5).tolist()) for i in range(300)]
    rows += [(1000 + i, draw.normal(size=3).tolist()) for i in range(40)] + [(5000, [1.0] * 4)]
    rows += [(-1, None), (-2, []), (-3, [None] * 6), (-4, [float("nan")] * 6), (-5, [1.0, float("inf")]), (-6, [2.0**56] * 6)]
    check(rows, whiten(spark, extra(rows)))
    check(rows, whiten(spark, extra(rows), 2), 2)


def test_short_of_rank_equal_and_empty(spark):
    draw = np.random.default_rng(6)
    rows = [(i, (draw.normal(size=2) @ np.array([[1, 2, 0, 1], [0, 1, 3, 1.0]])).round(0).tolist()) for i in range(50)]
    check(rows, whiten(spark, extra(rows)))
    assert whiten(spark, extra([(1, [1.0, 2.0]), (2, [1.0, 2.0])])) == []
    assert whiten(spark, []) == []


def test_repeated_rows_null_keys_and_wide_integers(spark):
    rows = [(None, [float(i % 3), 2.0**50 * (i % 2), 0.25 * i]) for i in range(6)] + [(7, [1.0, 0.0, 3.0])] * 3
    out = whiten(spark, extra(rows))
    assert len(out) == 27 and all(r["n"] == 9 and r["identity_error"] < 1e-4 for r in out)
    total = {}
    for r in out:
        total[r["component"]] = total.get(r["component"], 0) + r["whitened"] ** 2 / 9
    assert all(abs(v - 1) < 1e-6 for v in total.values())
    x = np.array([[floor(64 * Fraction(c)) for c in v] for _, v in rows], object)
    want = sorted(int(v) for v in ((9 * x - x.sum(axis=0)) ** 2).sum(axis=1))
    assert sorted(int(r["deviation"]) for r in out if r["component"] == 1) == want


def test_query(spark):
    out = named.QUERIES["op12_whitening"](spark, "/root/testdata/sf0.01").toPandas()
    data = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(data["embedding"]).astype(float)) + 1_000_000
    v, u = np.linalg.eigh(np.cov(x.T, bias=True))
    assert len(out) == 32 * len(data) and (out["identity_error"] < 1e-9).all()
    want = np.abs((x - x.mean(axis=0)) @ u[:, ::-1][:, :32] / np.sqrt(v[::-1][:32]))
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[data["vec_id"]].to_numpy()
    assert np.abs(np.abs(got) - want).max() < 1e-6
    share = out.drop_duplicates("component").sort_values("component")["explained"].to_numpy()
    assert np.allclose(share, v[::-1][:32] / v.sum())
    n = len(data)
    exact = dict(zip(data["vec_id"], (((n * x - x.sum(axis=0)).astype(int)) ** 2).sum(axis=1), strict=True))
    assert all(exact[k] == d for k, d in zip(out["vec_id"], out["deviation"], strict=True))
