import math
from fractions import Fraction

import numpy as np
import pytest

from llm import whitening
from llm.whitening import Spectrum, eigenpairs, fit, identity_error, whiten

SCHEMA = "vec_id long, embedding array<float>, whitened string, `a.b` string"


def matrices():
    rng = np.random.default_rng(0)
    for dim in (1, 2, 3, 10, 40):
        a = rng.normal(size=(dim, dim))
        q, _ = np.linalg.qr(a)
        yield a @ a.T
        yield np.diag(np.arange(1.0, dim + 1))
        for values in (np.repeat([5.0, 3.0, 1.0], dim)[:dim], np.resize([4.0, 4.0 + 1e-9, 1.0], dim), 10.0 ** -np.arange(dim)):
            m = q @ np.diag(values) @ q.T
            yield (m + m.T) / 2


def test_inertia_counts():
    for matrix in matrices():
        values = np.linalg.eigvalsh(matrix)
        for shift in np.linspace(values[0] - 1, values[-1] + 1, 29):
            if np.abs(values - shift).min() > 1e-9:
                assert Spectrum(matrix).above(shift) == (values > shift).sum()


def test_contour_integrals_find_every_eigenpair():
    for matrix in matrices():
        values = np.linalg.eigvalsh(matrix)[::-1]
        wanted = min(8, int((values > 1e-12 * values.sum()).sum()))
        intervals = Spectrum(matrix).intervals(wanted)
        assert sum(c for _, _, c in intervals) >= wanted
        done = 0
        for low, high, count in intervals:
            found, vectors = eigenpairs(matrix, low, high, count)
            assert np.allclose(found, values[done : done + count], atol=1e-12 * values[0])
            assert np.abs(matrix @ vectors - vectors * found).max() < 1e-11 * values[0]
            assert np.allclose(vectors.T @ vectors, np.eye(count), atol=1e-11)
            done += count


def test_a_wrong_count_is_noticed():
    with pytest.raises(ArithmeticError):
        eigenpairs(np.diag([3.0, 2.0, 1.0]), 0.5, 3.5, 2)


def by_hand(vectors, components=8):
    """Exact covariance by fractions, then a dense eigensolver."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(column) for column in zip(*x)]
    centred = [[Fraction(a * n - s, n) for a, s in zip(row, sums)] for row in x]
    covariance = [[float(sum(r[i] * r[j] for r in centred) / n) for j in range(len(sums))] for i in range(len(sums))]
    values, found = np.linalg.eigh(np.array(covariance))
    values, found = values[::-1][:components], found[:, ::-1][:, :components]
    white = np.array([[float(c) for c in row] for row in centred]) @ found / np.sqrt(values)
    return n, [sum((a * n - s) ** 2 for a, s in zip(row, sums)) for row in x], white, values / np.trace(covariance)


def compared(rows, vectors):
    n, deviations, white, explained = by_hand(list(vectors.values()))
    got = {(r["vec_id"], r["component"]): r for r in rows}
    places = {v: i for i, v in enumerate(vectors)}
    assert set(got) == {(v, c + 1) for v in vectors for c in range(white.shape[1])}
    for c in range(white.shape[1]):
        signs = {np.sign(got[v, c + 1]["whitened"] * white[i, c]) for v, i in places.items() if abs(white[i, c]) > 1e-6}
        assert len(signs) == 1
        sign = signs.pop()
        for v, i in places.items():
            row = got[v, c + 1]
            assert row["whitened"] == pytest.approx(sign * white[i, c], abs=1e-8)
            assert (row["n"], row["deviation"]) == (n, deviations[i])
            assert row["explained"] == pytest.approx(explained[c], rel=1e-9)
            assert row["identity_error"] < 1e-9


def test_query_as_by_hand(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    compared(whitening.query(spark, "/root/testdata/sf0.001").collect(), {r["vec_id"]: r["embedding"] for r in rows})


def test_query_with_awkward_vectors(kept, tmp_path_factory, spark):
    rng = np.random.default_rng(3)
    good = {i: [float(np.float32(x)) for x in rng.normal(size=3) * [3, 2, 1]] for i in range(40)}
    good[40] = good[39]  # ties
    bad = [None, [], [None, 1.0, 1.0], [math.nan, 1.0, 1.0], [1.0, math.inf, 1.0], [1.0, -math.inf, 1.0], [1.0], [1.0] * 4]
    rows = [*good.items(), *((100 + i, v) for i, v in enumerate(bad))]
    path = str(tmp_path_factory.mktemp("vectors"))
    kept([(i, v, "x", "y") for i, v in rows], SCHEMA).write.parquet(f"{path}/embeddings.parquet")
    compared(whitening.query(spark, path).collect(), good)


def test_repeated_rows_null_ids_and_clashing_columns(kept):
    rows = [(1, [1.0, 2.0], "x", "y")] * 3 + [(None, [2.0, 5.0], "x", "y"), (2, [0.0, 0.5], "x", "y")]
    frame = kept(rows, SCHEMA)
    model = fit(frame)
    out = whiten(frame, model)
    assert model.n == 5 and out.columns == ["vec_id", "a.b", "deviation", "whitened"]
    got = out.collect()
    assert len(got) == 5 and len({tuple(r["whitened"]) for r in got if r["vec_id"] == 1}) == 1
    assert identity_error(out, 2) < 1e-12


def test_no_vectors_and_no_variance(kept, spark, tmp_path_factory):
    assert fit(kept([], SCHEMA, parts=1)) is None
    equal = kept([(i, [1.5, 2.5], "x", "y") for i in range(4)], SCHEMA)
    model = fit(equal)
    assert len(model.eigenvalues) == 0
    assert {(r["deviation"], len(r["whitened"])) for r in whiten(equal, model).collect()} == {(0, 0)}
    path = str(tmp_path_factory.mktemp("equal"))
    equal.write.parquet(f"{path}/embeddings.parquet")
    assert whitening.query(spark, path).collect() == []


def test_numbers_too_large_for_doubles_stay_exact(kept):
    """Sums and deviations beyond 64 bits."""
    rows = [(i, [float(i) * 2.0**40, 1.0], "x", "y") for i in range(5)]
    model = fit(kept(rows, SCHEMA))
    x = [math.floor(1024 * r[1][0]) + 100_000 for r in rows]
    assert model.sums[0] == sum(x)
    out = {r["vec_id"]: int(r["deviation"]) for r in whiten(kept(rows, SCHEMA), model).collect()}
    assert out == {i: (5 * a - sum(x)) ** 2 for i, a in enumerate(x)}
