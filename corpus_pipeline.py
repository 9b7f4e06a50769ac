"""Corpus preparation in five stages: language, quality, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of `documents`, whatever others they
are called, and leave them as they are. An empty table stays empty. The tables
`labels` and `benchmark` come from `sf_dir`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfacts.llm import decontaminate, langid, packing, quality_fm, simhash
from skyfacts.llm.shared import fold, settle

#: A text in whose language the model puts less than this is in none of the languages.
MIN_LANGUAGE = 0.3
#: A text that is more likely of label 0 than of label 1 goes.
MIN_QUALITY = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a learned language; null texts and texts without letters go. Fold 2 of 4 is not learned from."""
    model = langid.train(docs.where(fold(F.col("doc_id"), 4) != 2))
    found = langid.language(docs, model, F.col("text"))
    return docs.where((found["lang"] != langid.UNKNOWN) & (found["score"] >= MIN_LANGUAGE))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts whose quality score is high enough. Labels of fold 1 of 3 are not learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = docs.where(fold(F.col("doc_id"), 3) != 1)
    machine = quality_fm.train(seen, labels, id_col="doc_id", text_col="text", label_col="quality")
    return docs.where(quality_fm.quality(docs, machine, F.col("text")) >= MIN_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of SimHash near duplicates, that of smallest id."""
    return simhash.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that hold no window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(docs, benchmark, F.col("text")).where("found.n_hit = 0").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of the documents with its place in a training sequence."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("leaks", leaks),
    ("pack", pack),
]

#: No SQL: a classifier, XXH64 and a tokenizer are beyond it. tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
