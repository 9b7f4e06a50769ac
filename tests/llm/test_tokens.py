"""Subword ids, token files and packing against the tokenizers library and plain counting."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skyfacts.llm import packing, shared, subwords, token_blocks

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_every_plain_character_matches_the_library():
    made = subwords.encoder("word_bpe_49k.json")
    for code in range(0x180):
        c = chr(code)
        for text in (c, f"a{c}b", f"1{c}{c}A!", f"{c}'s{c} 'LL"):
            assert np.frombuffer(made.encode(text), "<u4").tolist() == ids_of(text)[:-1], (hex(code), text)


def test_memory_may_be_emptied(monkeypatch):
    monkeypatch.setattr(subwords, "MEMORY_WORDS", 3)
    made = subwords.Encoder("word_bpe_49k.json")
    text = "these are more words than it may keep, these are"
    assert np.frombuffer(made.encode(text), "<u4").tolist() == ids_of(text)[:-1]


@pytest.mark.parametrize("high", [1, 2, 300, 2**16, 2**32])
def test_file_round_trip(high):
    rng = np.random.default_rng(high)
    documents = [rng.integers(0, high, n, np.uint64).astype("<u4") for n in (0, 1, 5000, 1024, 1023, 3)]
    documents[2][::100] = 2**32 - 1  # outliers beyond the packed width
    made = token_blocks.TokenFile.parse(token_blocks.encode_file([d.tobytes() for d in documents]))
    every = np.concatenate(documents)
    assert (made.ids() == every).all() and made.ends.tolist() == np.cumsum([len(d) for d in documents]).tolist()
    for i in range(len(made.low)):
        assert (made.block(i) == every[i * 1024 : (i + 1) * 1024]).all()
    if high <= 2**16:
        assert len(token_blocks.encode_file([d.tobytes() for d in documents])) < 4 * len(every)


def expected_digests(rows):
    start, out = 0, []
    for name, text in rows:
        ids = ids_of(text)
        out.append((name, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_token_query(query, table):
    rows = sorted((r["doc_id"], r["text"]) for r in table("documents").collect())
    assert sorted(map(tuple, query("op3_token_blocks"))) == expected_digests(rows)


def test_tokens_of_awkward_documents(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(token_blocks, "FILE_IDS", 50)
    files = token_blocks.write_tokens(awkward, shared.new_folder(spark, "t"))
    got = sorted(map(tuple, token_blocks.read_digests(files).collect()), key=lambda r: r[1])
    want = sorted(((r["doc_id"], r["text"]) for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [(g[0], g[2], g[3]) for g in got] == [(w[0], w[2], w[3]) for w in expected_digests(want)]
    assert [g[1] for g in got] == [w[1] for w in expected_digests(want)]
    assert token_blocks.token_digests(spark, nothing).collect() == []


def check_packed(rows, capacity):
    """Every sequence is gapless from 0 and no longer than the capacity; returns the number of sequences."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return len(gaps)


def test_packing_query(query, table):
    rows = query("op4_packing")
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for name, text in ((r["doc_id"], r["text"]) for r in table("documents").collect()):
        ids = ids_of(text)
        cut = [(i, a, len(ids[a : a + 4096]), crc(ids[a : a + 4096])) for i, a in enumerate(range(0, len(ids), 4096))]
        assert sorted(got.pop(name)) == cut
    assert not got
    assert check_packed(rows, 4096) == best_fit([r["length"] for r in rows], 4096)


@pytest.mark.parametrize("seed", range(4))
def test_packing_equals_best_fit_decreasing(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 3, 7, 33, 50, rng.randint(1, 100)]) for _ in range(1500)] + [60] * 700
    pieces = spark.createDataFrame([(n, 0, 0) for n in lengths], "length long, rank int, offset int")
    rows = packing.pack_pieces(pieces, capacity=100).collect()
    assert sorted(r["length"] for r in rows) == sorted(lengths)
    assert check_packed(rows, 100) == best_fit(lengths, 100)


def test_plan_is_bounded_by_the_capacity(spark):
    rng = random.Random(1)
    runs = [(n, rng.randint(1, 10**9)) for n in range(1, 4097)]
    plan = packing.plan_packing(spark.createDataFrame(runs, "length long, n long"), 4096)
    assert len(plan) < 150_000
    # Entries of a length cover its ranks without a hole.
    assert set(plan["length"].tolist()) == set(range(1, 4097))
    assert all(plan["first"][i] == 0 for i in np.flatnonzero(np.diff(plan["length"], prepend=0)))


def round_by_round(runs, capacity):
    """Entries of the plan from the two sweeps in plain Python, and the number of rounds."""
    state, entries, rounds = [packing._documents(n, 0, many) for n, many in runs] + [packing._gap(capacity, 0, packing.SUPPLY)], [], 0
    while any(r[0] == packing.DOCUMENT for r in state):
        ranges = defaultdict(list)
        for r in state:
            ranges[r[1].bit_length()].append(r)
        out = packing.hand_over([r for group in ranges.values() for r in packing.sweep_range(group, capacity)], capacity)
        entries += [r for r in out if r[0] == packing.ENTRY]
        state, rounds = [r for r in out if r[0] != packing.ENTRY], rounds + 1
    return entries, rounds


@pytest.mark.parametrize("seed", range(60))
def test_rounds_equal_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 64, 100, 127, 128, 1000, 4096])
    top = rng.choice([capacity, max(1, capacity // 3), max(1, capacity // 10)])
    runs = [(n, rng.choice([1, 2, 3, rng.randint(1, 30)])) for n in rng.sample(range(1, top + 1), rng.randint(1, min(top, 90)))]
    entries, rounds = round_by_round(runs, capacity)
    held, ranks = defaultdict(list), defaultdict(list)
    for _, length, rank, n, gap, sequence, per in entries:
        ranks[length] += range(rank, rank + n)
        for i in range(n):
            held[sequence + i // per].append((capacity - gap + i % per * length, length))
    assert {n: sorted(found) for n, found in ranks.items()} == {n: list(range(many)) for n, many in runs}
    rows = [{"sequence_id": s, "offset": o, "length": n} for s, parts in held.items() for o, n in parts]
    assert check_packed(rows, capacity) == best_fit([n for n, many in runs for _ in range(many)], capacity)
    assert rounds <= len(runs)


def test_packing_of_awkward_documents(awkward, nothing):
    rows = packing.pack_documents(awkward, capacity=64).collect()
    assert sum(r["length"] for r in rows) == sum(len(ids_of(r["text"])) for r in awkward.collect())
    check_packed(rows, 64)
    assert packing.pack_documents(nothing).collect() == []
