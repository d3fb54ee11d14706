"""Text files in, compressed corpora out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import tables as T
from corpusmill.functions.text import is_blank


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def read_corpus(
    spark: SparkSession,
    path: str,
    extensions: list[str] | None = None,
    max_bytes: int | None = None,
    max_files: int | None = None,
    report_large: bool = False,
) -> DataFrame:
    """path, name, text of the text files below a folder, without blank ones.

    The path is looked at before any content is read. `max_files` takes the first
    files by path: the choice is made on narrow rows, then joined. With
    `max_bytes`, which the caller has to ask for, larger files are not read; with
    `report_large` they come with a NULL text and the reason in a column `error`.
    """
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    place = root.replace("\\", "/").split("://")[-1]
    begin = F.locate(place, F.col("path")) + F.lit(len(place))
    inner = F.substring(F.col("path"), begin, F.length("path"))
    skipped = F.exists(F.split(inner, "/"), lambda p: p.isin(T.SKIPPED_FOLDERS))
    listed = files.where(extension(F.col("path")).isin(extensions or T.TEXT_EXTENSIONS)).where(~skipped)
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("name")
    fits = F.col("length") <= max_bytes if max_bytes is not None else F.lit(True)
    texts = listed.where(fits).select("path", name, decode_text(F.col("content")).alias("text"))
    texts = texts.where(~is_blank(F.col("text")))
    if max_bytes is not None and report_large:
        reason = F.concat(F.lit(f"more than {max_bytes} bytes: "), F.col("length").cast("string"))
        large = listed.where(~fits).select("path", name, F.lit(None).cast("string").alias("text"), reason.alias("error"))
        texts = texts.withColumn("error", F.lit(None).cast("string")).unionByName(large)
    if max_files is None:
        return texts
    chosen = texts.select("path").orderBy("path").limit(max_files)
    return texts.join(chosen, "path", "left_semi")


def decode_text(content: Column) -> Column:
    """UTF-8 with replacement characters where bytes do not decode."""
    return F.make_valid_utf8(content.cast("string"))


def write_compressed(df: DataFrame, path: str, out: str = "compressed", mode: str = "errorifexists") -> None:
    """Rows with their compressed struct as parquet, one folder per content type.

    Rows of a type are brought together before the writing, so that a type has no
    small file of every task; a frequent type is dealt over several tasks. The size
    they aim at is `spark.sql.adaptive.advisoryPartitionSizeInBytes`.
    """
    typed = df.withColumn("content_type", F.col(f"{out}.content_type"))
    typed.hint("rebalance", "content_type").write.mode(mode).partitionBy("content_type").parquet(path)
