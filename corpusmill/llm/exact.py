"""Exact dedup: a tree of merges over sorted runs of digests.

Rows fall into `runs` runs by identifier and place, so that no identifier, missing
ones too, fills a run. A run is sorted by digest and reduced to one entry per digest:
the identifier that stays, where it lies and a count. In every round `fan_in`
neighbouring runs are exchanged, merged in order of digest and again reduced to one
entry per digest, until one run is left; its entries are dealt over all tasks by
digest. The answer then goes back down the same tree to the documents. However many
copies a text has, no merge sees more than `fan_in` entries of it, and a leaf only
those of its run.

An entry is known by SHA-256, byte length and a second, independent 64-bit hash
together; entries meet only where all three agree, at every level. Texts
themselves are read once and are never shuffled to decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh, settled, text_or_empty

RUNS = 1 << 15
FAN_IN = 1 << 8
DIGEST = ["sha", "second", "n_bytes"]


def digest(text: str, normalise: Callable[[Column], Column] | None = None) -> list[Column]:
    """SHA-256, second hash and byte length of the (normalised) text; null is empty."""
    t = text_or_empty(text)
    t = normalise(t) if normalise else t
    return [
        F.unhex(F.sha2(t, 256)).alias("sha"),
        F.xxhash64(t).alias("second"),
        F.octet_length(t).cast("long").alias("n_bytes"),
    ]


def exact_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: str = "largest",
    normalise: Callable[[Column], Column] | None = None,
    runs: int = RUNS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    keep: the `largest` or `smallest` identifier of equal texts stays.
    Null text counts as empty. Documents without an identifier lose against any
    with one; in a group of such only, keep_id is null and one row is kept. Of
    rows with equal identifier and equal text exactly one is kept. An empty table
    gives an empty result. Other columns of docs are not looked at. Long texts are
    hashed whole.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep: largest or smallest")
    if runs < 1 or fan_in < 2:
        raise ValueError("runs must be 1 or more, fan_in 2 or more")
    ident = F.col(doc_id)
    leaf = settled(
        docs.select(
            ident.alias("doc_id"),
            F.pmod(F.xxhash64(ident, F.spark_partition_id()), F.lit(runs)).cast("long").alias("run"),
            *digest(text, normalise),
        )
    )
    # A missing identifier loses against any; of equal ones that of one run is it.
    # Sums over structs are sort-based: every level sorts its entries and merges them.
    best, known = (F.max, F.col("doc_id").isNotNull()) if keep == "largest" else (F.min, F.col("doc_id").isNull())
    one = F.struct(known.alias("known"), "doc_id", F.col("run").alias("own_run"))
    at = ["run", *DIGEST]
    merged = leaf.groupBy(at).agg(best(one).alias("best"), F.count("*").alias("group_size"))
    levels, width = [merged], runs
    while width > 1:
        width = -(-width // fan_in)
        merged = (
            merged.withColumn("run", F.floor(F.col("run") / fan_in))
            .groupBy(at)
            .agg(best("best").alias("best"), F.sum("group_size").alias("group_size"))
        )
        levels.append(merged)
    answer = levels.pop()
    for lower in reversed(levels):
        up = lower.select("run", *DIGEST).withColumn("above", F.floor(F.col("run") / fan_in))
        answer = up.join(answer.withColumnRenamed("run", "above"), ["above", *DIGEST]).select(*at, "best", "group_size")
    here = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("run") == F.col("best.own_run"))
    nth = F.row_number().over(Window.partitionBy(*at, "doc_id").orderBy("doc_id"))
    return leaf.join(answer, at).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (here & (nth == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "n_bytes",
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs, in their own columns, without the copies that exact_dedup drops.

    Rows equal in identifier and text come out once: the one whose other columns
    hash lowest.
    """
    normalise = how.get("normalise")
    kept = exact_dedup(docs, doc_id, text, **how).where("kept")
    key, tie, nth = (fresh(docs, x) for x in ("copy_key", "copy_tie", "copy_nth"))
    named = lambda ident, sha: F.concat_ws(":", F.coalesce(ident.cast("string"), F.lit("none")), sha)
    t = text_or_empty(text)
    sha = F.sha2(normalise(t) if normalise else t, 256)
    rest = [F.xxhash64(*[F.col(f"`{x}`") for x in docs.columns if x != text])]
    first = Window.partitionBy(key).orderBy(tie)
    return (
        docs.withColumns({key: named(F.col(doc_id), sha), tie: rest[0]})
        .join(kept.select(named(F.col("doc_id"), F.col("text_sha256")).alias(key)), key, "left_semi")
        .withColumn(nth, F.row_number().over(first))
        .where(F.col(nth) == 1)
        .select(*[F.col(f"`{x}`") for x in docs.columns])
    )
