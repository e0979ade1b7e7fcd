import os
import sys

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]

import pytest  # noqa: E402
from llm_models import EDGE  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def rows(documents):
    return sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())


@pytest.fixture(scope="session")
def edge(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, part int, h string, prefix string, w string, score double, _spans string, _id long, rep long, bucket int"
    return spark.createDataFrame([(i, t, None if i == 4 else "en", "s", None if t is None else len(t), 1, "h", "p", "w", 0.5, "z", 3, 4, 5) for i, t in EDGE], schema).cache()


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
