import pytest
from llm_rows import SHAPE, prose, row


@pytest.fixture
def frame(spark):
    """Documents with extra columns whose names the operators use themselves."""

    def build(rows):
        return spark.createDataFrame(rows, SHAPE)

    return build


@pytest.fixture
def odd():
    """Nulls, empty and long texts, ties, equal and repeated rows."""
    long = " ".join(prose(k) for k in range(300))
    return [
        row(1, prose(1)),
        row(2, prose(1)),
        row(2, prose(1)),
        row(3, None),
        row(4, ""),
        row(5, None, None, None),
        row(None, prose(2)),
        row(None, prose(3)),
        row(6, prose(3), None, "b"),
        row(7, long, "de", "b"),
        row(8, long + " end", "de", None),
        row(9, "  \t\n ", "fr", "c"),
        row(9, "éü ß", "fr", "c", None),
        row(10, "1234 !!", "fr", "c"),
    ]
