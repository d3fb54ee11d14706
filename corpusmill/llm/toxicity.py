"""Toxicity by a linear classifier over character n-grams with naive Bayes scaling.

A document has a feature for every hashed n-gram of four to six characters that
occurs in it. Each feature is scaled by its naive Bayes log-count ratio: the log of
how much likelier a document of label 1 holds it than one of label 0. A logistic
regression over the scaled features gives the score.

Counts of the ratios are taken partition by partition over the learning rows; the
regression runs over the features that tell the labels apart best, on fewer rows.
Both are bounded by parameters, so the model's size and what reaches the driver
don't grow with the corpus. Scoring is one pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import text_or_empty, written
from corpusmill.llm.language import held_out

SIZES = (4, 5, 6)
BUCKETS = 1 << 18
#: Features of the regression.
FEATURES = 2048
#: Learning rows of each label: for the ratios, and for the regression.
MOST_COUNTED, MOST_FITTED = 50_000, 4_096
#: Documents that must hold a feature.
LEAST = 3
DECAY, RATE, STEPS = 1e-3, 0.05, 300
THRESHOLD = 0.3
SPAN = 1 << 18


def _hashes(text: str) -> np.ndarray:
    """Hashes of all n-grams of the text; ASCII white space is all alike."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    c = np.where((c >= 9) & (c <= 13), np.uint64(32), c)
    out, key = [], np.zeros(len(c), np.uint64)
    for n in range(1, max(SIZES) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        key = key[:m] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(1)
        if n in SIZES:
            out.append((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parts(text: str, buckets: int, span: int = SPAN) -> Iterator[np.ndarray]:
    """Features of the whole text in lower case; a long one in spans that share n-grams' ends."""
    text = f" {text.lower()} "
    share = max(SIZES) - 1
    for at in range(0, len(text), span):
        yield (_hashes(text[max(at - share, 0) : at + span]) % np.uint64(buckets)).astype(np.int64)


def buckets_of(text: str, buckets: int = BUCKETS, span: int = SPAN) -> np.ndarray:
    """The distinct features of the whole text."""
    found = [np.unique(p) for p in parts(text, buckets, span)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, buckets), np.int64)
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            total[label][buckets_of(text.as_py(), buckets)] += 1
    for label in (0, 1):
        at = np.flatnonzero(total[label])
        cols = [pa.array(np.full(len(at), label), pa.int32()), pa.array(at), pa.array(total[label][at])]
        yield pa.RecordBatch.from_arrays(cols, ["label", "bucket", "n"])


def _known(batches: Iterator[pa.RecordBatch], slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [slots[buckets_of(t.as_py(), len(slots))] for t in batch.column(2)]
        held = pa.array([np.sort(x[x >= 0]) for x in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), held], ["label", "at", "held"])


def learning_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int) -> DataFrame:
    """label, at, text of the documents that labels name; `at` orders them at random.

    An identifier labelled more than once has its highest label. Of each label the
    `most` identifiers of lowest hash teach, so the table that is broadcast is bounded.
    All rows of such an identifier teach; the regression takes equal ones once.
    """
    given = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(doc_id))
    given = given.groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    given = given.withColumn("nth", F.xxhash64(F.col("id").cast("string")))
    some = [given.where(F.col("label") == x).orderBy("nth", "id").limit(most) for x in (0, 1)]
    own = docs.select(F.col(doc_id).alias("own_id"), text_or_empty(text).alias("own_text"))
    both = F.broadcast(some[0].unionByName(some[1]).select("id", "label"))
    at = F.xxhash64(F.col("id").cast("string"), "own_text").alias("at")
    return own.join(both, F.col("own_id") == F.col("id")).select("label", at, F.col("own_text").alias("text"))


def fit(labels: np.ndarray, weights: np.ndarray, held: list[np.ndarray], ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of every feature, scaling included, and the bias: logistic loss, L2 decay."""
    cols = np.concatenate(held).astype(np.int64) if held else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(held)), [len(x) for x in held])
    share = weights / weights.sum()
    w, grown = np.zeros(len(ratio)), np.full(len(ratio), 1e-12)
    prior = float((share * labels).sum())
    bias, bias_grown = float(np.log(prior / (1 - prior))), 1e-12
    for _ in range(STEPS):
        margin = np.bincount(rows, (w * ratio)[cols], len(held)) + bias
        off = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels) * share
        step = np.bincount(cols, off[rows], len(ratio)) * ratio + DECAY * w
        grown += step * step
        w -= RATE * step / np.sqrt(grown)
        bias_grown += off.sum() ** 2
        bias -= RATE * off.sum() / np.sqrt(bias_grown)
    return w * ratio, bias


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    buckets: int = BUCKETS,
    features: int = FEATURES,
    most_counted: int = MOST_COUNTED,
    most_fitted: int = MOST_FITTED,
) -> dict:
    """The model: weight of every bucket (0 for most) and the bias.

    Where no row, or none of one label, was learned from, every document scores the
    share of label 1 among the rows, 0 without rows.
    """
    rows = written(learning_rows(docs, labels, doc_id, text, label, most_counted))
    seen = dict.fromkeys((0, 1), 0) | {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not seen[0] or not seen[1]:
        return {"weights": np.zeros(buckets), "bias": None, "prior": float(seen[1] > 0)}
    counts = rows.select("label", "text").mapInArrow(lambda it: _counted(it, buckets), "label int, bucket bigint, n bigint")
    got = counts.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros((2, buckets))
    held[got.column("label").to_numpy(), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    ratio = np.log((held[1] + 1) / (seen[1] + 2)) - np.log((held[0] + 1) / (seen[0] + 2))
    # How far the shares of the two labels lie apart, in standard errors.
    both = held.sum(0) / (seen[0] + seen[1])
    error = np.sqrt(both * (1 - both) * (1 / seen[0] + 1 / seen[1])) + 1e-9
    apart = np.where(held.sum(0) >= LEAST, np.abs(held[1] / seen[1] - held[0] / seen[0]) / error, 0)
    best = np.sort(np.argsort(-apart, kind="stable")[:features])
    best = best[apart[best] > 0]
    slots = np.full(buckets, -1, np.int32)
    slots[best] = np.arange(len(best))
    # The cut is told by hashes alone, so that no task reads all texts of the sample.
    ats = rows.select("label", "at").distinct()
    lowest = [ats.where(F.col("label") == x).orderBy("at").limit(most_fitted) for x in (0, 1)]
    cut = {r.label: r.at for r in lowest[0].unionByName(lowest[1]).groupBy("label").agg(F.max("at").alias("at")).collect()}
    within = F.when(F.col("label") == 1, F.col("at") <= cut[1]).otherwise(F.col("at") <= cut[0])
    sample = rows.where(within).dropDuplicates(["label", "at"]).select("label", "at", "text")
    hits = sample.mapInArrow(lambda it: _known(it, slots), "label int, at bigint, held array<int>").toArrow()
    taught = sorted(zip(hits["at"].to_pylist(), hits["label"].to_pylist(), hits["held"].to_pylist()))
    y = np.array([t[1] for t in taught], float)
    each = np.array([seen[0] / (y == 0).sum(), seen[1] / (y == 1).sum()])
    own, bias = fit(y, each[y.astype(int)], [np.array(t[2], np.int64) for t in taught], ratio[best])
    weights = np.zeros(buckets)
    weights[best] = own
    return {"weights": weights, "bias": bias, "prior": None}


def _scored(batches: Iterator[pa.RecordBatch], model: dict, keep: int) -> Iterator[pa.RecordBatch]:
    weights = model["weights"]
    some = np.flatnonzero(weights)
    slots = np.full(len(weights), -1, np.int32)
    slots[some] = np.arange(len(some))
    value = weights[some]
    for batch in batches:
        score = np.full(batch.num_rows, model["prior"] or 0.0)
        if model["bias"] is not None:
            for k, text in enumerate(batch.column(keep)):
                has = np.zeros(len(some), bool)
                for part in parts(text.as_py(), len(weights)):
                    hit = slots[part]
                    has[hit[hit >= 0]] = True
                score[k] = 1 / (1 + np.exp(-np.clip(value[has].sum() + model["bias"], -50, 50)))
        own = [batch.column(k) for k in range(keep)]
        yield pa.RecordBatch.from_arrays([*own, pa.array(score)], [*batch.schema.names[:keep], "score"])


def scores(docs: DataFrame, columns: list, text: str, model: dict) -> DataFrame:
    """columns, then score, from the whole text alone; null counts as empty."""
    rows = docs.select(*columns, text_or_empty(text).alias("of_text"))
    keep = len(columns)
    schema = rows.select(*rows.columns[:keep]).schema
    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in schema], "score double"])
    return rows.mapInArrow(lambda it: _scored(it, model, keep), shape)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    threshold: float = THRESHOLD,
    **how,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from labelled documents that are not held out; a null identifier counts as
    the empty text in the split and has no label. Null and empty texts score by the
    bias alone. Repeated rows are judged each on its own. Labels other than 0 and 1
    are not looked at, nor are further columns. An empty table gives an empty result.
    """
    model = train(docs, labels, doc_id, text, label, **how)
    columns = [F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out")]
    found = scores(docs, columns, text, model)
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
