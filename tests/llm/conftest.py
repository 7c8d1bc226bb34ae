import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from conftest_llm import CLASH, DIR


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


@pytest.fixture(scope="session")
def make(spark):
    """documents of (doc_id, text) pairs, with further columns of clashing names."""

    def build(rows, clash=True):
        extra = CLASH if clash else {}
        schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` int" for c in extra)
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *extra.values()) for i, t in rows], schema)

    return build
