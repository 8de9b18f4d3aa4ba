"""Whitening against numpy's eigenvectors and whole-number arithmetic."""

import math

import numpy as np
import pytest

from quarrystone.llm import whiten


def expected(vectors):
    """(x, deviation of each row, eigenvalues, eigenvectors as columns) by falling eigenvalue."""
    x = [[math.floor(1024 * float(np.float64(c))) + 100000 for c in v] for v in vectors]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, total, strict=True)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, total, strict=True)] for row in x])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    return centred, deviation, values[::-1], directions[:, ::-1]


def compare(rows, vectors):
    """rows: by vec_id, the place in vectors."""
    centred, deviation, values, directions = expected(vectors)
    n, k = len(vectors), min(8, len(values))
    assert len(rows) == n * k
    for c in range(1, k + 1):
        z = np.zeros(n)
        for r in rows:
            if r["component"] == c:
                assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]]
                assert r["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-6)
                assert abs(r["identity_error"]) < 1e-8
                z[r["vec_id"]] = r["whitened"]
        wanted = centred @ directions[:, c - 1] / math.sqrt(values[c - 1])
        assert min(abs(z - wanted).max(), abs(z + wanted).max()) < 1e-7


@pytest.mark.parametrize("dim", [1, 5, 12])
def test_against_numpy(spark, dim):
    rng = np.random.default_rng(dim)
    vectors = (rng.normal(size=(60, dim)) * (1 + np.arange(dim)) + 3).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, n string").repartition(4)
    compare(whiten.whiten(rows).collect(), vectors)


def test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    held = table.orderBy("vec_id").collect()
    ids = [r["vec_id"] for r in held]
    assert ids == list(range(len(ids)))
    compare(whiten.whiten(table).collect(), [r["embedding"] for r in held])


def test_rows_that_are_dropped_and_repeated(spark):
    good = [[1.0, 2.0, 5.0], [2.0, 1.0, 4.0], [0.5, -3.0, 1.0], [4.0, 0.0, 0.0], [4.0, 0.0, 0.0]]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0], [None, None, None]]
    rows = [(i, v) for i, v in enumerate(good)] + [(100 + i, v) for i, v in enumerate(bad)]
    compare(whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), good)


def test_no_variance_and_other_lengths(spark):
    """A row alone, equal rows and an empty table have no component; a length of its own is a fit of its own; a null id stays."""
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whiten.whiten(empty).collect() == [] and len(whiten.whiten(empty).columns) == 7
    rows = [(1, [1.0, 2.0])] * 3 + [(2, [1.0]), (3, [2.0]), (None, [4.0]), (5, [1.0, 1.0, 1.0])]
    got = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got) == [(0, 1, 3), (2, 1, 3), (3, 1, 3)]


def test_large_entries(spark):
    """Deviations that no long can hold are null; the others are exact beyond 2**53."""
    vectors = [[1e9, 0.0], [-1e9, 1.0], [3.0, 2.0], [5e8, -1.0]]
    got = whiten.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    _, deviation, values, _ = expected(vectors)
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: d if d < 2**63 else None for i, d in enumerate(deviation)}
    assert max(r["explained"] for r in got) == pytest.approx(values[0] / values.sum(), rel=1e-6)
    with pytest.raises(Exception, match="outside the grid|too large"):
        whiten.whiten(spark.createDataFrame([(1, [1e200]), (2, [1.0])], "vec_id long, embedding array<double>")).collect()


def test_squares_are_exact():
    d = np.array([[2**60, -(2**59) + 12345], [3, -4], [2**21, 2**42 + 1]], dtype=np.int64)
    assert whiten.squared(d) == [sum(int(x) ** 2 for x in row) for row in d]
