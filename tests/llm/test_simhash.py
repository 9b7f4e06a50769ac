"""SimHash groups against a comparison of all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skyfacts.llm import simhash


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (id, fingerprint); the smallest id reachable over links of up to two bits, for each row."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for name, f in rows:
        if name is not None:
            low[find(f)] = min(name, low.get(find(f), name))
    return sorted(((name, f, low.get(find(f))) for name, f in rows), key=repr)


def test_query(query, table):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in table("documents").collect()]
    got = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in query("op2_simhash")]
    assert sorted(got, key=repr) == plain_components(rows)


def test_awkward_documents(awkward, nothing):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in awkward.collect()]
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(awkward).collect()]
    assert sorted(got, key=repr) == plain_components(rows)
    assert simhash.near_duplicates(nothing).collect() == []


@pytest.mark.parametrize("key_rows", [50_000, 5])
def test_links_of_close_fingerprints(spark, key_rows):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**64, 30, np.uint64, endpoint=False).tolist() + [0, 2**64 - 1]
    values = set()
    for s in seeds:  # long chains, dense balls and strangers
        for _ in range(int(rng.integers(1, 60))):
            values.add(s)
            for _ in range(int(rng.integers(1, 4))):
                s ^= 1 << int(rng.integers(0, 64))
    values |= {1 << i | 1 << j for i in range(0, 64, 3) for j in range(i)}
    rows = [(i, f) for i, f in enumerate(sorted(values))]
    frame = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for _, f in rows], "fp long")
    links = simhash.near_links(frame, key_rows=key_rows)
    assert all((r["a"] ^ r["b"]) % 2**64 and ((r["a"] ^ r["b"]) % 2**64).bit_count() <= 2 for r in links.collect())
    roots = {r["node"] % 2**64: r["root"] for r in simhash.components(links).collect()}
    groups = {}
    for name, f in rows:
        groups.setdefault(roots.get(f, f"own {f}"), []).append(name)
    low = {name: min(g) for g in groups.values() for name in g}
    assert [(i, f, low[i]) for i, f in rows] == sorted(plain_components(rows))


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000, 2001), (2000, 2001)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 if n <= 300 else 1000 if n < 2000 else 2000 for e in edges for n in e}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_spark_hash_is_the_same(spark):
    texts = ["", "a", "é b c", "x" * 100]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()
    assert [r[0] % 2**64 for r in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]
