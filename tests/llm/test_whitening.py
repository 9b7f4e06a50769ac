"""Exact sums and whitened components against plain integers and numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest

from skyfacts.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, id string, x double, component int"


def framed(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1.0, 3) for i, v in rows], SCHEMA)


def integers(rows):
    """(id, x) of the vectors that take part, as Python integers."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in kept]


def check(got, rows, components=8):
    """Everything that the contract fixes, from plain integers; signs are free."""
    own = integers(rows)
    n, dims = len(own), len(own[0][1])
    sums = [sum(x[d] for _, x in own) for d in range(dims)]
    centred = np.array([[(n * v - s) / n for v, s in zip(x, sums)] for _, x in own])
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1][: min(components, dims)]
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert len(got) == n * len(values)
    made = np.zeros((n, len(values)))
    taken = {}
    for row, (i, x) in enumerate(own):
        nth = taken[i] = taken.get(i, -1) + 1
        assert sorted(by_id[i]) == list(range(1, len(values) + 1))
        for k in range(len(values)):
            same = [r for r in by_id[i][k + 1] if r["deviation"] == sum((n * v - s) ** 2 for v, s in zip(x, sums))]
            assert same and {r["n"] for r in same} == {n}
            made[row, k] = same[min(nth, len(same) - 1)]["whitened"]
            assert same[0]["explained"] == pytest.approx(values[k] / np.trace(cov), rel=1e-9)
    error = np.abs(made.T @ made / n - np.eye(len(values))).max()
    assert error < 1e-9 and {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    vectors = np.linalg.lstsq(centred, made * np.sqrt(values), rcond=None)[0]
    assert np.allclose(cov @ vectors, vectors * values, rtol=1e-7, atol=1e-7 * values[0])


def test_query(query, table):
    check(query("op12_whitening"), [(r["vec_id"], r["embedding"]) for r in table("embeddings").collect()])


def test_exact_sums(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 64)
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(333, 5)) * [1, 100, 1e-4, 1e6, 0]).tolist())]
    n, sums, both = whitening.scatter(whitening.whole(framed(spark, rows).repartition(3), "vec_id", "embedding"))
    x = [x for _, x in integers(rows)]
    assert n == 333 and sums == [sum(r[d] for r in x) for d in range(5)]
    assert both == [[sum(r[d] * r[e] for r in x) for e in range(5)] for d in range(5)]


def test_very_large_entries(spark):
    rows = [(i, [v, 1.0]) for i, v in enumerate([1e30, -1e30, 1e15, 0.5, 0.25])]
    whole = whitening.whole(framed(spark, rows), "vec_id", "embedding")
    x = [r["x"] for r in whole.collect()]
    n, sums, both = whitening.scatter(whole)
    assert both[0][0] == sum(r[0] ** 2 for r in x) and sums[0] == sum(r[0] for r in x)
    got = whitening.whiten(framed(spark, rows)).collect()
    assert {r["deviation"] for r in got} == {None} and got[0]["n"] == 5


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(70, 3)).tolist())]
    rows += [(100, [9.0, -3.0, 0.5])] * 3 + [(100, [1.0, 1.0, 1.0]), (None, [2.0, 0.0, 0.0])]
    bad = [(200, None), (201, [1.0, None, 0.0]), (202, [float("nan"), 1.0, 1.0]), (203, [float("inf"), 1.0, 1.0]), (204, [1.0]), (205, [])]
    check(whitening.whiten(framed(spark, rows + bad)).collect(), rows)
    empty = whitening.whiten(framed(spark, rows).limit(0))
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(framed(spark, bad[:1])).collect() == []


def test_no_variance(spark):
    got = whitening.whiten(framed(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(got) == 6 and {(r["whitened"], r["explained"], r["deviation"]) for r in got} == {(None, None, 0)}
    flat = whitening.whiten(framed(spark, [(i, [float(i), float(i)]) for i in range(5)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and {r["identity_error"] < 1e-9 for r in flat} == {True}
