import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpusmill.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests")


@pytest.fixture
def texts(spark):
    """Texts as a frame (doc_id, text)."""
    def build(*items):
        return spark.createDataFrame(list(enumerate(items)), "doc_id bigint, text string")

    return build


@pytest.fixture
def mapped(texts):
    """Apply a column function to texts; results in input order."""
    from pyspark.sql import functions as F

    def run(fn, *items):
        rows = texts(*items).select("doc_id", fn(F.col("text")).alias("out")).collect()
        return [r.out for r in sorted(rows, key=lambda r: r.doc_id)]

    return run
