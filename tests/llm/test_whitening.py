"""op13_whitening against dense linear algebra, the eigensolver on hard spectra, odd input."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from millrace.llm import whitening
from millrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def dense(x):
    """Whole-number rows to (n, deviations, values, vectors, trace), by numpy and Python integers."""
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    deviations = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    y = np.array(x, np.float64) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return n, deviations, values[::-1], vectors[:, ::-1], y, (y * y).sum() / n


def test_query(spark):
    source = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    x = [[math.floor(1024 * float(c)) + 100_000 for c in r["embedding"]] for r in source]
    n, deviations, values, vectors, y, trace = dense(x)
    df = QUERIES["op13_whitening"](spark, SF)
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = df.toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 8 * n and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-11
    order = np.argsort([r["vec_id"] for r in source])
    assert got.deviation.tolist() == [deviations[i] for i in order for _ in range(8)]
    found = got.whitened.to_numpy().reshape(-1, 8)
    want = (y @ vectors[:, :8] / np.sqrt(values[:8]))[order]
    assert np.abs(found * np.sign((found * want).sum(axis=0)) - want).max() < 1e-9
    assert np.allclose(got.explained.to_numpy().reshape(-1, 8), values[:8] / trace, rtol=1e-12)


def spectra():
    rng = np.random.default_rng(3)
    yield "falling", rng.standard_normal((400, 120)) * np.linspace(1, 30, 120) + 1e5
    yield "flat", rng.standard_normal((900, 300))
    yield "same rows", np.repeat(rng.standard_normal((1, 20)), 50, 0)
    yield "rank 3", rng.standard_normal((50, 3)) @ rng.standard_normal((3, 20))
    yield "fewer dimensions than components", rng.standard_normal((6, 4))
    yield "equal eigenvalues", np.kron(np.eye(16), np.ones((4, 1)))
    q, _ = np.linalg.qr(rng.standard_normal((200, 40)))
    yield "close pairs", (q * np.sqrt(np.array([10, 10 - 1e-9, 9, 9 - 1e-7, *np.linspace(8.9, 1, 36)]))) * 20
    yield "one huge", np.column_stack([rng.standard_normal(100) * 1e6, rng.standard_normal((100, 30))])


@pytest.mark.parametrize("name, x", list(spectra()), ids=lambda v: v if isinstance(v, str) else "")
def test_eigenpairs(name, x):
    y = x - x.mean(axis=0)
    v = y.T @ y / len(y)
    found = whitening.eigenpairs(lambda w: v @ w, len(v), 8)
    k = min(8, len(v))
    want = np.linalg.eigvalsh(v)[::-1][:k]
    top = max(want[0], 1e-30)
    assert len(found.values) == k and np.abs(found.values - want).max() <= 1e-13 * top
    assert np.abs(found.vectors.T @ found.vectors - np.eye(k)).max() < 1e-13
    assert np.linalg.norm(v @ found.vectors - found.vectors * found.values, axis=0).max() <= 1e-13 * top


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    a = a @ a.T
    known, _ = np.linalg.qr(rng.standard_normal((30, 2)))
    keep = np.eye(30) - known @ known.T
    rhs, shifts = keep @ rng.standard_normal((30, 3)), np.array([3.0, 20.0, 200.0])
    t = whitening.minres(lambda w: a @ w, rhs, shifts, known, 200)
    for i, s in enumerate(shifts):
        assert np.linalg.norm(keep @ (a - s * np.eye(30)) @ keep @ t[:, i] - rhs[:, i]) < 1e-6


SCHEMA = "vec_id long, embedding array<double>, vec string, x array<int>, component string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "v", [1], "c", "n") for i, v in rows], SCHEMA)


def test_odd_input(spark):
    big = 2**60
    good = [(big + 1, [0.5, -0.25, 3.0]), (None, [1.0, 2.0, -1.0]), (big + 5, [0.0, 0.0, 0.001]), (big + 5, [0.0, 0.0, 0.001]), (7, [-4.0, 1.5, 2.5])]
    bad = [(8, None), (9, []), (10, [1.0, None, 2.0]), (11, [1.0, float("nan"), 2.0]), (12, [1.0, float("inf"), 2.0]), (13, [1.0, 2.0]), (14, [1e300, 0.0, 0.0])]
    got = whitening.whiten(frame(spark, good + bad)).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in good]
    n, deviations, values, vectors, y, trace = dense(x)
    assert len(got) == 3 * n and {r.n for r in got} == {n} and {r.component for r in got} == {1, 2, 3}
    assert sorted((str(r.vec), int(r.deviation)) for r in got) == sorted((str(i), d) for (i, _), d in zip(good, deviations, strict=True) for _ in range(3))
    first = {str(r.vec): r.whitened for r in got if r.component == 1}
    want = {str(i): w for (i, _), w in zip(good, y @ vectors[:, 0] / math.sqrt(values[0]), strict=True)}
    assert all(abs(abs(first[k]) - abs(want[k])) < 1e-10 for k in want)
    assert whitening.whiten(frame(spark, bad[:1])).count() == 0 and whitening.whiten(frame(spark, [])).count() == 0


def test_no_variance_and_large_numbers(spark):
    same = whitening.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(4)])).collect()
    assert len(same) == 8 and all(r.whitened == 0 and r.deviation == 0 and r.explained == 0 and r.identity_error == 0 for r in same)
    huge = [(i, [2.0**41 * (1 if i % 2 else -1), float(i)]) for i in range(50)]
    got = whitening.whiten(frame(spark, huge)).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in huge]
    assert {(r.vec, int(r.deviation)) for r in got} == {(i, d) for (i, _), d in zip(huge, dense(x)[1], strict=True)}
