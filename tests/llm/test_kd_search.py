"""Top-k search against all inner products."""

from __future__ import annotations

import math

import numpy as np
import pytest

from skyfacts.llm import kd_search


def exact(rows, top=10, every=100):
    """Every answer by plain integers; of equal rows one counts."""
    whole = {
        (i, tuple(math.floor(1024 * c) for c in v))
        for i, v in rows
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)
    }
    out = []
    for own in whole:
        if own[0] % every == 0:
            scores = [(-max(-kd_search.LONG, min(kd_search.LONG, sum(a * b for a, b in zip(own[1], x)))), i) for i, x in whole if (i, x) != own]
            out += [(own[0], rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "s", 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, shard string, x int, query double")
    return sorted(map(tuple, kd_search.top_k(frame, **options).collect()))


def test_query(query, table):
    got = sorted(map(tuple, query("op11_kd_search")))
    assert got == exact([(r["vec_id"], r["embedding"]) for r in table("embeddings").collect()])


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_many_shards(spark, monkeypatch, spread):
    monkeypatch.setattr(kd_search, "SHARD_BYTES", 8 * 6 * 300)
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(3000, 6)) * np.exp(spread * rng.normal(size=(3000, 1)))
    matrix[:1000] = matrix[0]  # a third of all rows is one vector
    rows = list(enumerate(np.round(matrix, 2).tolist()))
    assert found(spark, rows, every=50) == exact(rows, every=50)


def test_tree_skips_what_cannot_reach():
    rng = np.random.default_rng(2)
    rows = rng.integers(-1000, 1000, size=(5000, 3))
    tree = kd_search.Tree(np.arange(5000), rows)
    opened = []
    spans, tree.spans = tree.spans, type("Seen", (list,), {"__getitem__": lambda self, i: opened.append(i) or list.__getitem__(self, i)})(tree.spans)
    query = np.array([[700, -300, 200]])
    ((_, ids, scores),) = tree.search(query, 5, [None])
    all_scores = rows @ query[0]
    assert ids.tolist() == sorted(range(5000), key=lambda i: (-all_scores[i], i))[:5] and scores.tolist() == sorted(all_scores.tolist())[::-1][:5]
    assert len(opened) < len(spans) / 4
    ((_, ids, _),) = tree.search(query, 5, [int(all_scores.max()) + 1])
    assert not len(ids)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(60, 4)).tolist())]
    rows += [(100 * i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)] + [(100, [1.0, 2.0, 3.0, 4.0])] * 3 + [(5000, [0.0] * 4)]
    rows += [(300, [5.0, 5.0, 5.0, 5.0]), (300, [5.0, 5.0, 5.0, 6.0]), (-200, [-1.0, 0.5, 0.0, 0.0])]
    bad = [(6000, None), (6100, [1.0, None, 0.0, 0.0]), (6200, [float("nan"), 1.0, 1.0, 1.0]), (6300, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (6400, [1.0])]
    assert found(spark, rows + bad) == exact(rows)
    assert found(spark, rows[:3]) == exact(rows[:3]) and found(spark, rows[:1]) == []
    assert found(spark, bad[:4]) == [] and found(spark, [(0, []), (1, [])]) == [(0, 1, 1, 0)]


def test_large_components(spark):
    values = [1e9, -1e9, 3e8, 2.5e13, -2.5e13, 1e4]
    rows = [(100 * i, [v, 1.0, -v / 3]) for i, v in enumerate(values)]
    assert found(spark, rows, top=3) == exact(rows, top=3)
