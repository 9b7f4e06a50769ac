"""Small documents with every awkward case, and the small test tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as contract  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Extra columns carry names that operators use for their own results.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, length int, host string, fp long, key string"


@pytest.fixture(scope="session", autouse=True)
def workers(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(contract.__file__))


@pytest.fixture(scope="session")
def awkward(spark):
    words = "un deux trois quatre cinq six sept huit neuf dix onze douze"
    texts = [
        None, "", "   \n\t", "one", "One TWO", words, words, words + " fin", "Ünï €12 ½ don't " * 30, "a " * 60_000,
        "1234 !!", "x\x00y \x1c z \x85 q", "日本語 テスト e\u0301 İ Σας", "12", "|||",
    ]
    rows = [(i, t, "fr" if i % 2 else None, "s", len(t or ""), 0.5, 1, "h", 7, "k") for i, t in enumerate(texts)]
    rows += [(6, words, None, None, None, None, None, None, None, None)] * 3 + [(None, "nobody", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def query(spark):
    """Runs a registered query and returns its rows."""
    return lambda name: contract.queries()[name](spark, SF_DIR).collect()


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")
