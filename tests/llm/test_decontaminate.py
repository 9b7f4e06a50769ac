"""Decontamination against windows looked up one by one."""

from __future__ import annotations

import hashlib
import random
import re
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from skyfacts.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, width=10):
    found, hit, names = words(text), set(), set()
    places = {}
    for n in range(1, width + 1):
        for i in range(len(found) - n + 1):
            places.setdefault(tuple(found[i : i + n]), []).append(i)
    for name, item in items:
        own = words(item)
        for i in range(max(1, len(own) - width + 1) if own else 0):
            window = tuple(own[i : i + width])
            for at in places.get(window, []):
                hit.update(range(at, at + len(window)))
                names.add(name)
    return len(found), len(hit), sorted(names)


def test_query(query, table):
    items = [(str(r["item_id"]), r["text"]) for r in table("benchmark").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in query("op8_decontaminate")}
    for r in table("documents").collect():
        n, hit, names = brute(r["text"], items)
        assert got[r["doc_id"]] == (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0)
    assert any(g[-1] for g in got.values()) and not all(g[-1] for g in got.values())


def test_awkward_documents_and_several_automata(spark, awkward, monkeypatch):
    items = [(1, "Un deux, TROIS quatre-cinq six sept huit neuf dix onze"), (2, "one"), (3, None), (4, "!!"), (5, "dix onze douze fin"), (None, "two"), (2, "nobody")]
    bench = spark.createDataFrame(items, "item_id int, text string").withColumn("items", F.lit("clash"))
    named = [("" if i is None else str(i), t) for i, t in items]
    texts = [r["text"] for r in awkward.collect()]
    want = sorted((t is not None, t or "", brute(t, named)) for t in texts)
    clashing = awkward.withColumns({"found": F.lit(1), "row": F.lit(2), "items": F.lit(3), "a.b": F.lit(4), "ranges": F.lit(5)})
    for limit in (100_000, 2):
        rows = decontaminate.contaminated(clashing, bench, F.col("text"), most_windows=limit)
        assert rows.select("row.*").columns == clashing.columns
        rows = rows.select("row.text", "row.`a.b`", "found").collect()
        assert sorted((r.text is not None, r.text or "", (r.found.n_words, r.found.n_hit, r.found["items"])) for r in rows) == want
        for r in rows:  # spans point at the hit words of the original
            assert r["a.b"] == 4 and sum(len(words(r.text[s.start : s.end])) for s in r.found.spans) == r.found.n_hit
    none = decontaminate.contaminated(awkward, bench.limit(0), F.col("text")).collect()
    assert len(none) == len(texts) and all(r.found.n_hit == 0 and r.found["items"] == [] for r in none)


def test_one_scanner_at_a_time_within_its_memory():
    """10 MB of items in parts of the default size; an automaton has at most two nodes a word of its windows."""
    rng = random.Random(3)
    vocabulary = [f"w{i:x}" for i in range(60_000)]
    every = set()
    while len(every) < decontaminate.MOST_WINDOWS:
        every |= decontaminate.windows(" ".join(rng.choices(vocabulary, k=20_000)))
    chosen = sorted(every)[: decontaminate.MOST_WINDOWS]
    made = decontaminate.Scanner(decontaminate.Patterns((w, ["1"]) for w in chosen))
    stats = made.made.get_stats()
    assert stats["nodes_count"] <= 20 * len(chosen) + 1 and stats["total_size"] < 200_000_000
    part = pa.array([chosen[0].decode() + " x"])
    for names in (["a"], ["b"]):
        patterns = SimpleNamespace(value=decontaminate.Patterns([(chosen[0], names)]))
        assert decontaminate._hits(patterns).func(part).to_pylist()[0]["items"] == names
        assert len(decontaminate._built) == 1


def test_a_text_passes_one_worker_in_few_rows(spark, documents):
    """With one automaton a text is sent to Python once, and few texts are decoded and sent at a time."""
    bench = spark.createDataFrame([(1, "one two"), (2, "three")], "item_id int, text string")
    rows = decontaminate.contaminated(documents.select("doc_id", "text"), bench, F.col("text"))
    for found in (rows.select("row.doc_id", "found.n_words", "found.n_hit"), rows.where("found.n_hit = 0").select("row.*")):
        assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 256
