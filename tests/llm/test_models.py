"""Language and quality models: held-out accuracy, exact kernels and interactions, awkward texts."""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pytest

import __spark_entry__ as contract
from skyfacts.llm import langid, quality_fm
from skyfacts.llm.shared import draw


def plain_grams(text):
    line = (" " + " ".join("".join(c.lower() if "A" <= c <= "Z" else c if c.isalpha() or ord(c) > 127 else " " for c in text).split()) + " ").encode()
    return {line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1)}


def test_kernel_is_the_blended_spectrum_kernel(monkeypatch):
    texts = ["the cat sat on the mat", "THE CAT!", "el gato come", "ñandú été", "x", "el el el " * 50]
    for chunk in (1 << 20, 7):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        model = langid.fit(texts, ["en", "en", "es", "es", "en", "es"], landmarks=3)
        sets = [plain_grams(t) for t in texts]
        for i, row in enumerate(model.kernel(texts)):
            want = [len(sets[i] & sets[j]) / np.sqrt(len(sets[i]) * len(sets[j])) for j in (0, 1, 4, 2, 3, 5)]
            assert np.allclose(row, want, atol=1e-5)


def test_languages_of_held_out_documents(query, table):
    truth = {r["doc_id"]: r["lang"] for r in table("documents").collect()}
    rows = query("op1_langid")
    assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in truth}
    own = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in own]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_awkward_documents(awkward, nothing):
    rows = langid.predict_languages(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by[i]["lang_pred"] for i in (0, 1, 2, 10, 13, 14)] == ["und"] * 6 and by[0]["score"] == 0
    assert by[5]["lang_pred"] == "fr"
    assert langid.predict_languages(nothing).collect() == []
    unlabelled = awkward.withColumn("lang", awkward["source"].substr(5, 1)).replace("", None, "lang")
    assert {r["lang_pred"] for r in langid.predict_languages(unlabelled).collect()} == {"und"}


ENGLISH, SPANISH = "the house of the people and their long story was there ", "la casa de los hombres y su larga historia estaba "


def test_long_texts_of_a_language_are_learned(spark, tmp_path):
    """All texts of one language over 50 KB, all of the other short; through the registered query."""
    rows = [(i, f"{i} " + ENGLISH * 3, "en") for i in range(40)] + [(100 + i, f"{i} " + SPANISH * 1100, "es") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = contract.queries()["op1_langid"](spark, str(tmp_path)).collect()
    assert len(found) == 80 and all(r["lang_pred"] == ("en" if r["doc_id"] < 100 else "es") for r in found)


def test_long_texts_of_a_label_are_learned(spark, tmp_path):
    """All texts of label 0 over 50 KB, all of label 1 short; through the registered query."""
    rows = [(i, f"{i} " + ENGLISH * 3) for i in range(40)] + [(100 + i, f"{i} " + "buy now !!! $$$ " * 3500) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 100), None) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = contract.queries()["op9_quality_fm"](spark, str(tmp_path)).collect()
    assert len(found) == 80 and all(r["predicted"] == int(r["doc_id"] < 100) for r in found)


def test_draw_is_bounded(spark):
    rows = [(k, "a", 10) for k in range(300)] + [(k, "b", 500 + k) for k in range(20)] + [(1, "c", 10_000)]
    frame = spark.createDataFrame(rows, "key long, kind string, size int")
    drawn = draw(frame, "kind", 50, 1200, 100)
    assert drawn == [(k, "a") for k in range(50)] + [(0, "b"), (1, "b")] + [(1, "c")]


def plain_ridge(texts, languages, landmarks, ridge):
    """The same fit written out with sets, a kernel matrix and its pseudo-inverse."""
    names = sorted(set(languages))
    chosen = [i for name in names for i in [j for j, own in enumerate(languages) if own == name][:landmarks]]
    known = set().union(*[plain_grams(texts[i]) for i in chosen])

    def kernel(a, b):
        x, y = plain_grams(a), plain_grams(b)
        return len(x & y & known) / np.sqrt(len(x) * len(y))

    inner = np.array([[kernel(texts[a], texts[b]) for b in chosen] for a in chosen])
    values, vectors = np.linalg.eigh(inner)
    root = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    features = np.array([[kernel(t, texts[b]) for b in chosen] for t in texts]) @ root
    weights = np.diag([1 / languages.count(own) for own in languages])
    targets = np.array([[1.0 if own == name else -1.0 for name in names] for own in languages])
    solved = np.linalg.inv(features.T @ weights @ features + ridge * len(names) * np.eye(root.shape[1])) @ features.T @ weights @ targets
    return lambda text: np.array([kernel(text, texts[b]) for b in chosen]) @ root @ solved


def test_ridge_on_landmarks_against_plain_algebra():
    texts = ["the cat sat on the mat", "a dog and the bone", "el gato come pan", "la casa del perro", "le chat est noir", "une maison et un chien", "the end of it", "pan y agua"]
    languages = ["en", "en", "es", "es", "fr", "fr", "en", "es"]
    model, plain = langid.fit(texts, languages, landmarks=2, ridge=0.05), plain_ridge(texts, languages, 2, 0.05)
    for text in [*texts, "el perro y the cat", "zzz"]:
        assert np.allclose(model.outputs([text])[0], plain(text), atol=2e-3)


def test_letters():
    assert [langid.has_letter(t) for t in ("", "²½ Ⅷ 12_", "² é", "ª", "日", "1a")] == [False, False, True, True, True, True]


def test_pairs_in_linear_time():
    rng = np.random.default_rng(2)
    machine = quality_fm.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    rows = [(rng.choice(20, n, False), rng.normal(size=n)) for n in (1, 2, 7)]
    for (index, value), got in zip(rows, machine.margins(rows), strict=True):
        pairs = sum(machine.vectors[index[a]] @ machine.vectors[index[b]] * value[a] * value[b] for a, b in combinations(range(len(index)), 2))
        assert got == pytest.approx(0.3 + machine.weights[index] @ value + pairs)


def test_quality_of_held_out_documents(query, table):
    truth = {r["doc_id"]: r["quality"] for r in table("labels").collect()}
    rows = query("op9_quality_fm")
    assert len(rows) == table("documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    own = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in own]) > 0.85


def test_quality_of_awkward_documents(spark, awkward, nothing):
    labels = spark.createDataFrame([(0, 0), (3, 1), (4, 1), (5, None), (99, 1), (6, 1), (6, 0)], "doc_id long, quality int")
    rows = quality_fm.score_quality(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows if r["doc_id"] is not None}
    assert by[0] == by[1]
    assert quality_fm.score_quality(nothing, labels).collect() == []
    assert {r["score"] for r in quality_fm.score_quality(awkward, labels.limit(0)).collect()} == {0.5}


def test_few_files_of_labelled_keys(spark, monkeypatch):
    """Many shuffle partitions do not make as many files of a few keys each."""
    files, settle = [], quality_fm.settle

    def counted(df, name):
        made = settle(df, name)
        files.append(len(made.inputFiles()))
        return made

    monkeypatch.setattr(quality_fm, "settle", counted)
    docs = spark.createDataFrame([(i, f"{i} words") for i in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, quality int")
    settings = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        quality_fm.train(docs, labels, id_col="doc_id", text_col="text", label_col="quality", sample=50)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert files == [32]
