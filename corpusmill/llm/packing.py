"""Best-fit packing of documents into training sequences, with conflicts.

A text longer than a sequence is cut into full pieces, each a bin of its own, and
a tail. Tails are dealt at random into shards of a bounded number of rows; each
shard is packed by itself, largest first. Bins are kept in order of the room left
and carry two bitmaps, of the sources and of the duplicate clusters they hold. A
tail goes to the tightest bin that has room and shares neither with it: the search
starts at the first bin with enough room and moves on to the next until one is
compatible. Only numbers move; texts stay where they are.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import settled, text_or_empty, word_total

CAPACITY = 1024
SHARD_ROWS = 4096


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item, items in the given order.

    sources, clusters: small numbers, -1 where an item has none; two items of one
    source or of one cluster never share a bin.
    """
    room: list[tuple[int, int]] = []
    held: list[list[int]] = []
    out = np.empty(len(sizes), np.int64)
    for k, (size, source, cluster) in enumerate(zip(sizes.tolist(), sources.tolist(), clusters.tolist(), strict=True)):
        s = 1 << source if source >= 0 else 0
        c = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(room, (size, -1))
        while at < len(room):
            maps = held[room[at][1]]
            if not (maps[0] & s or maps[1] & c):
                break
            at += 1
        if at < len(room):
            left, b = room.pop(at)
            held[b][0] |= s
            held[b][1] |= c
        else:
            left, b = capacity, len(held)
            held.append([s, c])
        insort(room, (left - size, b))
        out[k] = b
    return out


def _numbered(values: pd.Series) -> np.ndarray:
    return pd.factorize(values)[0]


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cluster: str | None = None,
    capacity: int = CAPACITY,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start_word, n_words, bin_id, bin_words, bin_docs.

    Sizes are words of the whole text. cluster: a column that names a document's
    duplicate cluster; without one, equal texts form a cluster. A null source or
    cluster conflicts with nothing. A document without words (null, empty, blank)
    has one piece of 0 words and no bin. Repeated rows are packed as often as they
    come, in different bins. An empty table gives an empty result; other columns
    are not looked at. A text longer than a bin fills bins of its own; the rest of it
    is packed as a piece like others. Pieces of equal size go in the order of rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    alike = F.xxhash64(F.col(cluster)) if cluster else F.xxhash64(text_or_empty(text))
    alike = F.when(F.col(cluster).isNotNull(), alike) if cluster else alike
    rows = settled(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            alike.alias("cluster"),
            word_total(text).alias("words"),
        )
    ).withColumn("row", F.monotonically_increasing_id())
    last = F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = pieces.withColumn("start_word", F.col("piece") * capacity)
    pieces = pieces.withColumn("n_words", F.least(F.col("words") - F.col("start_word"), F.lit(capacity)).cast("long"))
    whole = pieces.where((F.col("n_words") == capacity) | (F.col("n_words") == 0)).select(
        "doc_id",
        "piece",
        "start_word",
        "n_words",
        F.when(F.col("n_words") > 0, F.concat_ws("-", F.lit("full"), "row", "piece")).alias("bin_id"),
        F.when(F.col("n_words") > 0, F.col("n_words")).alias("bin_words"),
        F.when(F.col("n_words") > 0, F.lit(1).cast("long")).alias("bin_docs"),
    )
    tails = pieces.where((F.col("n_words") < capacity) & (F.col("n_words") > 0))
    shards = max(1, -(-rows.count() // shard_rows))
    by = F.when(F.col("doc_id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("doc_id"))
    tails = tails.withColumn("shard", F.pmod(by, F.lit(shards)))

    def fill(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["n_words", "row"], ascending=[False, True], kind="stable", ignore_index=True)
        bins = best_fit(own["n_words"].to_numpy(), _numbered(own["source"]), _numbered(own["cluster"]), capacity)
        own["bin_id"] = [f"{key[0]}-{b}" for b in bins]
        own["bin_words"] = np.bincount(bins, own["n_words"])[bins].astype(np.int64)
        own["bin_docs"] = np.bincount(bins)[bins]
        return own[["doc_id", "piece", "start_word", "n_words", "bin_id", "bin_words", "bin_docs"]]

    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = (
        f"doc_id {kind}, piece bigint, start_word bigint, n_words bigint, "
        "bin_id string, bin_words bigint, bin_docs bigint"
    )
    return tails.groupBy("shard").applyInPandas(fill, shape).unionByName(whole)
