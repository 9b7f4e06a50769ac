"""Exact order statistics against brute force, with skew, ties and nulls."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from skyfacts.functions import ranks

RULES = {"low": ranks.nearest(0.1), "mid_lo": ranks.below(0.5), "mid_hi": ranks.above(0.5), "high": ranks.nearest(0.9)}


def brute(values):
    ordered = sorted(values)
    last = len(ordered) - 1
    places = (math.floor(0.1 * last + 0.5), math.floor(0.5 * last), math.ceil(0.5 * last), math.floor(0.9 * last + 0.5))
    return tuple(ordered[k] for k in places)


def sample():
    rnd = random.Random(7)
    groups = {
        "hot": [rnd.lognormvariate(3, 2) for _ in range(6000)],
        "negative": [rnd.uniform(-5, 5) for _ in range(700)],
        "tiny": [1e-9 * rnd.random() for _ in range(300)],
        "constant": [2.5] * 50,
        "ties": [float(rnd.randrange(4)) for _ in range(500)],
        "single": [3.0],
        None: [1.0, 2.0],
    }
    return groups, [(k, v) for k, values in groups.items() for v in values]


@pytest.mark.parametrize("refinements", [0, 1, 2])
def test_groups(spark, refinements):
    groups, data = sample()
    df = spark.createDataFrame(data + [("hot", None), ("empty", None)], "k string, v double").repartition(5)
    found = ranks.values_at_ranks(df, ["k"], "v", RULES, refinements=refinements)
    assert {r.k: tuple(r)[1:] for r in found.collect()} == {k: brute(v) for k, v in groups.items()}


def test_groups_by_type(spark):
    groups, data = sample()
    df = spark.createDataFrame(data, "k string, v double")
    found = ranks.values_at_ranks(df, ["k"], "v", RULES)
    assert {r.k: tuple(r)[1:] for r in found.collect()} == {k: brute(v) for k, v in groups.items()}


def test_narrow_band_is_split_to_single_values(spark, monkeypatch):
    """All values in one first bucket: what is ranked in the end is a few values per rank, not the group."""
    rnd = random.Random(3)
    values = [1e9 + rnd.random() for _ in range(20_000)] + [1e9 + 0.25] * 10_000
    df = spark.createDataFrame([(v,) for v in values], "v double")
    seen = []
    kept = ranks._running
    monkeypatch.setattr(ranks, "_running", lambda rows, group, order: seen.append(rows) or kept(rows, group, order))
    (row,) = ranks.values_at_ranks(df, [], "v", RULES).collect()
    assert tuple(row) == brute(values)
    assert seen[-1].count() <= 3 * len(RULES)


def test_nothing_runs_before_an_action(spark):
    df = spark.createDataFrame([(1.0,)], "v double").select(F.assert_true(F.lit(False) & (F.col("v") > 0)), "v")
    ranks.values_at_ranks(df, [], "v", RULES)


@pytest.mark.parametrize("n", [1, 2, 5, 6, 10, 11, 100, 1500])
def test_whole_frame(spark, n):
    values = [(i * 7919) % 1009 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    (row,) = ranks.values_at_ranks(df, [], "v", RULES).collect()
    assert tuple(row) == brute(values)


def test_nothing_to_rank(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert [tuple(r) for r in ranks.values_at_ranks(df, [], "v", {"m": ranks.nearest(0.5)}).collect()] == [(None,)]


def test_not_a_number_and_infinity_come_last(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (0.0,)], "v double")
    rules = {f"r{k}": (lambda n, k=k: F.lit(k).cast("bigint")) for k in range(5)}
    (row,) = ranks.values_at_ranks(df, [], "v", rules).collect()
    assert list(row)[:4] == [float("-inf"), 0.0, 1.0, float("inf")] and math.isnan(row.r4)


def test_decimals_keep_their_type(spark):
    df = spark.range(1001).select(F.lit("x").alias("k"), (F.col("id") / 100).cast("decimal(12,2)").alias("v"))
    (row,) = ranks.values_at_ranks(df, ["k"], "v", {"m": ranks.below(0.5)}).collect()
    assert str(row.m) == "5.00"
