"""Tables as corpora: one shape for documents, pages, turns and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import is_blank, text_of


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, if the scan has fewer partitions than there are cores.

    A large table keeps its scan partitions and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def as_corpus(
    df: DataFrame,
    key: str,
    text: str,
    name: str | None = None,
    source: str | None = None,
) -> DataFrame:
    """doc_id, name, text, source; rows without text are dropped."""
    none = F.lit(None).cast("string")
    return df.where(~is_blank(text_of(text))).select(
        F.col(key).alias("doc_id"),
        (F.col(name) if name else none).alias("name"),
        F.col(text).alias("text"),
        (F.col(source) if source else none).alias("source"),
    )


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
