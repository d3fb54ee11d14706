"""Token counts as rollups that signed changes keep up to date.

A state folder holds, for every committed batch, the images of the documents it
changed (`ledger`) and its signed sums by source, language and tokenizer version
(`rollup`). A batch is written whole and then marked as committed by one small
file; readers see marked batches only. So a batch that died half-way is simply
written again, and one that is delivered twice changes nothing. Totals add up the
sums of all committed batches; documents are never counted again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import text_or_empty

GROUP = ["source", "lang", "tokenizer_version"]
#: Fixed value: the pre-tokenizer pattern that belongs to the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters handed to the tokenizer at once, cut only where a piece must end.
SPAN = 1 << 19
CUT = re.compile(r"(?<=[^\W_])(?= [^\W\d_])")
_ENCODERS: dict = {}


def vocabulary(path: str) -> bytes:
    """The vocabulary file: lines of base64 token and rank; it is bounded and sent to the workers."""
    with open(path, "rb") as f:
        return f.read()


def encoder(vocab: bytes):
    key = blake2b(vocab, digest_size=16).digest()
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocab.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def spans(text: str, most: int = SPAN) -> Iterator[str]:
    """The text in parts of about `most` characters that tokenize as the whole does."""
    at = 0
    while len(text) - at > most:
        cut = CUT.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def with_tokens(docs: DataFrame, text: str, vocab: bytes, columns: list) -> DataFrame:
    """columns, then n_tokens, the byte-pair tokens of the whole text; null has 0."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    rows = docs.select(*columns, text_or_empty(text).alias("of_text"))
    keep = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for batch in batches:
            n = [sum(len(enc.encode_ordinary(p)) for p in spans(t.as_py())) for t in batch.column(keep)]
            own = [batch.column(k) for k in range(keep)]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(n, pa.int64())], [*batch.schema.names[:keep], "n_tokens"]
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:keep]]
    return rows.mapInArrow(run, ", ".join([*fields, "n_tokens bigint"]))


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def committed(spark: SparkSession, state: str) -> list[int]:
    """Numbers of the committed batches, in order."""
    fs, at = _fs(spark, f"{state}/commits")
    if not fs.exists(at):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at))


def removed(spark: SparkSession, state: str) -> None:
    """Delete a state folder."""
    fs, at = _fs(spark, state)
    fs.delete(at, True)


def commit(spark: SparkSession, state: str, batch: int, changes: DataFrame) -> bool:
    """Apply a batch of changes once; False if it is committed already.

    changes: doc_id, op (`insert`, `revise`, `delete`), source, lang,
    tokenizer_version, n_tokens, seq. An insert or revision sets a document's
    counts, whatever they were; deleting an unknown document changes nothing. Of
    several changes of a document in a batch the one with the highest seq counts
    (null lowest; of equal ones the greatest row). Rows without a doc_id can't be
    addressed again: their inserts count, one each, their other changes do not. A
    null n_tokens is 0. Batches are numbered upwards; a number below the last one
    that was never committed is an error.
    """
    done = committed(spark, state)
    if batch in done:
        return False
    if done and batch < done[-1]:
        raise ValueError(f"batch {batch} comes after {done[-1]}")
    facts = ["op", *GROUP, "n_tokens"]
    rows = changes.select(
        "doc_id", "seq", "op", *[F.col(c).cast("string").alias(c) for c in GROUP],
        F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"),
    )
    latest = F.max(F.struct("seq", *facts)).alias("x")
    images = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(latest)
    images = images.select("doc_id", *[F.col(f"x.{c}").alias(c) for c in facts])
    images = images.withColumn("live", F.col("op") != "delete").drop("op")
    images.write.mode("overwrite").parquet(f"{state}/ledger/{batch}")
    images = spark.read.parquet(f"{state}/ledger/{batch}")
    new = images.where("live").select(*GROUP, "n_tokens", F.lit(1).alias("sign"))
    alone = rows.where("doc_id IS NULL AND op = 'insert'").select(*GROUP, "n_tokens", F.lit(1).alias("sign"))
    signed = new.unionByName(alone)
    if done:
        old = known(spark, state, done).join(images.select("doc_id"), "doc_id", "left_semi")
        signed = signed.unionByName(old.where("live").select(*GROUP, "n_tokens", F.lit(-1).alias("sign")))
    sums = signed.groupBy(GROUP).agg(
        F.sum("sign").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("sign")).alias("n_tokens")
    )
    sums.coalesce(1).write.mode("overwrite").parquet(f"{state}/rollup/{batch}")
    fs, at = _fs(spark, f"{state}/commits/{batch}")
    fs.create(at, True).close()
    return True


def known(spark: SparkSession, state: str, batches: list[int]) -> DataFrame:
    """The latest image of every document in the given batches."""
    image = F.struct(*GROUP, "n_tokens", "live")
    parts = [
        spark.read.parquet(f"{state}/ledger/{b}").select("doc_id", F.lit(b).alias("batch"), image.alias("x"))
        for b in batches
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("doc_id").agg(F.max_by("x", "batch").alias("x")).select("doc_id", "x.*")


def totals(spark: SparkSession, state: str) -> DataFrame:
    """source, lang, tokenizer_version, n_docs, n_tokens over all committed batches.

    Groups without documents are left out; null sources and languages are groups.
    """
    shape = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint"
    paths = [f"{state}/rollup/{b}" for b in committed(spark, state)]
    rows = spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)
    sums = rows.groupBy(GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where("n_docs <> 0")
