"""The pipeline against its stages in plain Python, and on awkward documents."""

from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from skyfacts.llm import langid, quality_fm
from skyfacts.llm.shared import fold, settle
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import plain_components, plain_fingerprint


def test_whole_run(spark, query, table):
    docs = table("documents")
    own = docs.collect()
    names, scores = langid.train(docs.where(fold(docs["doc_id"], 4) != 2)).predict([r["text"] for r in own])
    own = [r for r, n, s in zip(own, names, scores, strict=True) if n != "und" and s >= 0.3]
    seen = spark.createDataFrame(own, docs.schema)
    machine = quality_fm.train(seen.where(fold(seen["doc_id"], 3) != 1), table("labels"), id_col="doc_id", text_col="text", label_col="quality")
    odds = machine.margins([quality_fm.features(r["text"]) for r in own])
    own = [r for r, o in zip(own, odds, strict=True) if o >= 0]
    groups = plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in own])
    first = {name for name, _, low in groups if name == low}
    items = [(str(r["item_id"]), r["text"]) for r in table("benchmark").collect()]
    own = [r for r in own if r["doc_id"] in first and brute(r["text"], items)[1] == 0]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in own}
    got: dict[int, int] = {}
    for r in query("pipeline"):
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want and 0 < len(want) < docs.count()


def test_stages_on_awkward_documents(spark, awkward, nothing):
    from tests.llm.conftest import SF_DIR

    for docs in (settle(awkward), settle(nothing)):
        for name, stage in pipeline.STAGES:
            out = settle(stage(spark, docs, SF_DIR))
            if name != "pack":
                assert out.columns == awkward.columns
                docs = out
    rows = settle(awkward)
    kept = pipeline.near_duplicates(spark, rows, SF_DIR).collect()
    assert len(kept) == len({plain_fingerprint(r["text"]) for r in rows.collect()}) and kept[0].asDict().keys() == set(awkward.columns)
    assert pipeline.language(spark, rows, SF_DIR).where("text is null or text = ''").count() == 0


def test_columns_of_any_name_keep_their_values(spark, awkward):
    from tests.llm.conftest import SF_DIR

    names = ["id_", "mark_", "a.b", "skyfacts_id", "skyfacts_mark", "row", "own", "id", "mark", "found", "x`y"]
    rows = [(*r, *[f"{name} {r['doc_id']}" for name in names]) for r in awkward.collect()]
    extra = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    docs = settle(spark.createDataFrame(rows, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in awkward.schema)}, {extra}"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        kept = out.collect()
        assert {tuple(r) for r in kept} <= set(rows) and (kept or name != "near_duplicates")
    assert pipeline.pack(spark, docs, SF_DIR).count() >= len(rows)
