"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import checkpoint_dir, prepare_checkpoints

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Parts of a group whose rows look up something of the group.
PARTS = 4096


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_total(name: str) -> Column:
    """Words of the whole text; 0 for null."""
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def word_list(name: str) -> Column:
    """The words of the whole text in order; empty for null."""
    bare = F.btrim(text_or_empty(name), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare != "", F.split(bare, GAP)).otherwise(F.array().cast("array<string>"))


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores appended until no column of df has it."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def settled(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared checkpoint folder and read from there.

    Unlike localCheckpoint, the rows outlive the executors that made them.
    """
    prepare_checkpoints(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """df as a compressed table in the shared checkpoint folder.

    All tables of an application lie in one folder named after it, which can be
    deleted when the application has ended. file_rows: rows of a file at most, for
    rows so large that a task should read few; 0 for no limit.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int) -> bool:
    """Whether df, a settled frame, has at most `limit` rows."""
    return df.limit(limit + 1).count() <= limit


def spread(rows: DataFrame, per_group: DataFrame, at: list[str], own: str, how: str = "inner") -> DataFrame:
    """rows with the columns of their group in per_group (one row a group).

    A group's rows are dealt over PARTS parts by the column `own`. Only one row a
    part meets the group's row, and the rows of a part meet that one, so a group of
    any size is no task of its own.
    """
    part = F.pmod(F.xxhash64(own), F.lit(PARTS)).cast("int").alias("part")
    met = rows.select(*at, part).distinct().join(per_group, at)
    return rows.select("*", part).join(met, [*at, "part"], how).drop("part")


def utf8(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], pa.large_string())
    values = values.fill_null("").cast(pa.large_binary())
    n = len(values)
    _, spots, data = values.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(spots, np.int64, n + 1, values.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[ends[0] : ends[-1]], ends - ends[0]


def row_blocks(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes; a longer row stands alone."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = int(np.searchsorted(ends, ends[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text, last column, compressed: it crosses the network and waits on disks."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        n = batch.num_columns - 1
        small = [press.compress(t.as_buffer()) for t in batch.column(n).cast(pa.large_binary())]
        cols = [*(batch.column(k) for k in range(n)), pa.array(small, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:n], "packed"])


def unpacked(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body)
