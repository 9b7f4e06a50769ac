"""The manifest against plain hashing."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from skyfacts.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(digests, arity):
    """The root, and each leaf's list of (before, after) from the leaf's run up."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for leaf_no, place in enumerate(at):
            run, slot = runs[place // arity], place % arity
            paths[leaf_no].append((run[:slot], run[slot + 1 :]))
            at[leaf_no] = place // arity
        level = [h("".join(run)) for run in runs]
    return level[0], paths


def expected(rows, arity=8):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for group in order:
        own = sorted(groups[group], key=lambda x: x[:3])
        made[group] = own, *climb([x[2] for x in own], arity)
    root, above = climb([made[g][1] for g in order], arity)
    out = []
    for group, path_above in zip(order, above):
        own, subroot, paths = made[group]
        for (_, _, digest, r), path in zip(own, paths):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for before, after in path + path_above:
                node = h("".join([*before, node, *after]))
            proof = h("".join(d for before, after in path + path_above for d in [*before, *after]))
            out.append((r["doc_id"], digest, subroot, root, proof, node, node == root))
    return out


def audited(frame, arity=8):
    found = merkle.audit(frame, tampered=merkle.lower_cased_in_thirds(), arity=arity)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=repr)


def test_query(query, documents):
    want = expected(documents.collect())
    assert sorted(map(tuple, query("op13_merkle")), key=repr) == sorted(want, key=repr)
    assert {row[-1] for row in want} == {True, False}


@pytest.mark.parametrize("arity", [2, 8])
def test_awkward_rows(awkward, arity):
    rows = awkward.collect()
    assert audited(awkward, arity) == sorted(expected(rows, arity), key=repr)


def test_lone_rows_and_groups(awkward, documents, nothing):
    assert audited(nothing) == [] and merkle.manifest(nothing).root is None
    one = awkward.where("doc_id = 5")
    row = one.first()
    digest = leaf(row, row["text"])
    assert [r[1:5] for r in audited(one)] == [(digest, digest, digest, h(""))]
    group = documents.where("lang = 'fr'")
    assert audited(group) == sorted(expected(group.collect()), key=repr)
    each = documents.limit(80).withColumn("lang", F.col("doc_id").cast("string"))  # more groups than a run holds
    assert audited(each) == sorted(expected(each.collect()), key=repr)


def test_sizes_around_a_run(spark):
    for count in (8, 9, 65):
        frame = spark.range(count).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("lang"), F.lit(1).alias("n_chars"), F.lit("Text").alias("text"))
        assert audited(frame) == sorted(expected(frame.collect()), key=repr)


def test_any_change_is_found(documents):
    made = merkle.manifest(documents)
    assert made.root == merkle.manifest(documents.orderBy(F.desc("doc_id"))).root
    for changed in (documents.where("doc_id <> 7"), documents.withColumn("source", F.when(F.col("doc_id") == 7, "other").otherwise(F.col("source")))):
        assert merkle.manifest(changed).root != made.root


def test_one_node_is_no_run(documents):
    with pytest.raises(ValueError):
        merkle.manifest(documents, arity=1)
