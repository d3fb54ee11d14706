"""The stages that turn `documents` into packed training sequences.

Every stage reads all that its predecessor kept, written as Parquet. All but the
last return the columns of documents; the last one returns the places of the
documents' pieces in the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.common import read, written
from corpusmill.llm.exact import drop_copies
from corpusmill.llm.language import accepted
from corpusmill.llm.mixture import mixed_documents
from corpusmill.llm.near import drop_near
from corpusmill.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Null, empty and letterless texts go, as do ambiguous ones. Repeated rows are judged
    alike, long texts whole. An empty table stays one. Further columns stay as they are,
    whatever their names; so they do in all stages.
    """
    return accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the largest identifier.

    A null text is an empty one. Identifiers that are null lose; of rows equal in
    identifier and text one stays. An empty table stays one.
    """
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest identifier.

    Texts without words are one class. Rows of one identifier are one class, too, and
    rows without one belong to that of their words. An empty table stays one.
    """
    return drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is one of its own; documents without words come as often as others
    of their rank. Rows that share an identifier are decided each on its own. An empty
    table stays one.
    """
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence; the columns are those of `pack`.

    Texts without words have a piece without a bin; copies lie in different bins.
    An empty table gives an empty result.
    """
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Learned, near and greedy decisions can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
