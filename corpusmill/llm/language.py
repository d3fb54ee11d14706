"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1; each bit of the code is a binary
classifier over hashed byte n-grams: a multinomial log-likelihood ratio between
the languages on its two sides, each side a mixture that gives every language the
same weight. A document's bits are its mean log ratios; decoding adds up, over the
bits, a logistic loss weighted by how well the bit tells its sides apart, and takes
the codeword with the least loss. A narrow lead over the second is flagged.

Training counts n-grams of all training documents by language, partition by
partition; the model is languages x BUCKETS counts, however large the corpus.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import row_blocks, text_or_empty, utf8

BUCKETS = 1 << 12
#: Languages a model has at most: those with the most learning documents.
MOST_LANGUAGES = 512
BLOCK = 1 << 19
UNKNOWN = "und"
#: A lead in loss below this share of the best possible lead is ambiguous.
LEAD = 0.05


def codewords(n: int) -> np.ndarray:
    """n distinct rows of +1 / -1, far apart.

    Up to seven languages get the exhaustive code (every split of the languages
    in two once). More get columns drawn from a fixed seed: balanced splits, as
    many as give a distance of about a third of the length.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        rows = [[1] + [1 if (c >> k) & 1 else -1 for k in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.array(rows, float).T
    rng = np.random.default_rng(20)
    columns: list[np.ndarray] = []
    while len(columns) < 10 * int(np.ceil(np.log2(n))) or len({tuple(r) for r in np.array(columns).T}) < n:
        side = np.where(np.arange(n) % 2 == 0, 1.0, -1.0)
        columns.append(rng.permutation(side))
    return np.array(columns).T


def _letters() -> np.ndarray:
    table = np.full(256, 32, np.uint32)
    table[128:] = np.arange(128, 256)
    for lo, hi in ((65, 90), (97, 122)):
        table[lo : hi + 1] = np.arange(97, 123)
    return table


LETTERS = _letters()


def grams(data: np.ndarray, ends: np.ndarray, buckets: int, starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram of one, two, three and four bytes.

    ASCII letters lose their case; all else below 128 is a space. No n-gram
    crosses rows, and none made of spaces only counts. starts: only n-grams that
    begin among so many first bytes.
    """
    b = LETTERS[data]
    row = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
    found, rows = [], []
    key = np.zeros(len(b), np.uint32)
    for n in range(1, 5):
        m = len(b) - n + 1
        if m <= 0:
            break
        key = key[:m] * np.uint32(0x01000193) ^ b[n - 1 :]
        h = (key * np.uint32(0x9E3779B1)) >> np.uint32(7)
        ok = (row[:m] == row[n - 1 :]) & ((b[:m] != 32) | (b[n - 1 :] != 32))
        if starts is not None:
            ok[starts:] = False
        found.append((h[ok] % np.uint32(buckets)).astype(np.int64))
        rows.append(row[:m][ok])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(found), np.concatenate(rows)


def pieces(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int | None]]:
    """Rows i to j with their bytes and offsets, some BLOCK bytes at a time.

    A longer row comes in several pieces, three bytes shared; the last item tells how
    many first bytes n-grams of the piece begin in, so that each is seen once.
    """
    for i, j in row_blocks(ends, BLOCK):
        lo, hi = int(ends[i]), int(ends[j])
        if j == i + 1 and hi - lo > BLOCK:
            for at in range(lo, hi, BLOCK):
                to = min(at + BLOCK + 3, hi)
                yield i, j, data[at:to], np.array([0, to - at]), BLOCK
        else:
            yield i, j, data[lo:hi], ends[i : j + 1] - lo, None


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, ends = utf8(batch.column(1))
        for i, j, part, cuts, starts in pieces(data, ends):
            names = sorted(set(langs[i:j]))
            own = np.searchsorted(names, langs[i:j])
            gram, row = grams(part, cuts, buckets, starts)
            got = np.bincount(own[row] * buckets + gram, minlength=len(names) * buckets)
            for k, name in enumerate(names):
                total[name] = total.get(name, 0) + got[k * buckets : (k + 1) * buckets]
    for name, n in total.items():
        at = np.flatnonzero(n)
        cols = [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["lang", "bucket", "n"])


def train(labelled: DataFrame, lang: str, text: str, buckets: int = BUCKETS) -> dict:
    """The model: names, code and per-bucket weights of every bit.

    Rows with a null language or text teach nothing, nor do those of languages beyond
    the MOST_LANGUAGES with the most rows. That bounds what comes to the driver.
    """
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    per = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1)
    found = per.collect()
    names = sorted(r.lang for r in found[:MOST_LANGUAGES])
    if len(found) > MOST_LANGUAGES:
        rows = rows.where(F.col("lang").isin(names))
    counts = rows.mapInArrow(lambda it: _counted(it, buckets), "lang string, bucket bigint, n bigint")
    seen = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(names), buckets))
    if seen.num_rows:
        spots = pa.compute.index_in(seen["lang"], pa.array(names, pa.string())).to_numpy()
        table[spots, seen["bucket"].to_numpy()] = seen["n"].to_numpy()
    share = (table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * buckets)
    code = codewords(len(names))
    weights = np.zeros((code.shape[1], buckets))
    trust = np.ones(code.shape[1])
    if len(names) > 1:
        for k, side in enumerate(code.T):
            weights[k] = np.log(share[side > 0].mean(0)) - np.log(share[side < 0].mean(0))
            # How far the nearest language lies from the bit's boundary.
            trust[k] = max((share @ weights[k] * side).min(), 1e-3)
    return {"names": names, "code": code, "weights": weights, "trust": trust / trust.max(), "buckets": buckets}


def decode(bits: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best codeword, its probability and whether the lead is narrow, for each row."""
    code, trust = model["code"], model["trust"]
    margin = bits[:, None, :] * code[None]
    loss = (np.logaddexp(0, -8 * margin) * trust).sum(2) / trust.sum()
    best = loss.argmin(1)
    p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    score = 1 / p.sum(1)
    two = np.sort(loss, 1)[:, :2]
    lead = two[:, 1] - two[:, 0] if loss.shape[1] > 1 else np.full(len(bits), np.inf)
    return best, score, lead < LEAD * np.abs(np.log(2))


def _predicted(batches: Iterator[pa.RecordBatch], model: dict, keep: int) -> Iterator[pa.RecordBatch]:
    buckets, names = model["buckets"], np.array([*model["names"], UNKNOWN], object)
    weights = model["weights"].T.astype(np.float32)
    for batch in batches:
        n = batch.num_rows
        data, ends = utf8(batch.column(keep))
        sums, grams_of = np.zeros((n, weights.shape[1])), np.zeros(n)
        for i, j, part, cuts, starts in pieces(data, ends):
            gram, row = grams(part, cuts, buckets, starts)
            grams_of[i:j] += np.bincount(row, minlength=j - i)
            for k in range(weights.shape[1]):
                sums[i:j, k] += np.bincount(row, weights[:, k][gram], j - i)
        known = np.array(batch.column(keep + 1).to_pylist(), bool) & (grams_of > 0) & (len(names) > 1)
        best, score, unsure = np.full(n, len(names) - 1), np.zeros(n), np.ones(n, bool)
        if len(names) > 1 and known.any():
            best[known], score[known], unsure[known] = decode(sums[known] / grams_of[known, None], model)
        own = [batch.column(k) for k in range(keep)]
        yield pa.RecordBatch.from_arrays(
            [*own, pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(unsure)],
            [*batch.schema.names[:keep], "lang_pred", "score", "ambiguous"],
        )


def predict(docs: DataFrame, columns: list, text: str, model: dict) -> DataFrame:
    """columns, then lang_pred, score and ambiguous, from the whole text alone.

    lang_pred is `und`, with score 0 and ambiguous, where the text is null or has
    no letter, or where nothing was learned. Long texts are read in pieces.
    """
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*columns, text_or_empty(text).alias("of_text"), letter.alias("of_letter"))
    keep = len(columns)
    schema = rows.select(*rows.columns[:keep]).schema
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
    shape = ", ".join([*fields, "lang_pred string, score double, ambiguous boolean"])
    return rows.mapInArrow(lambda it: _predicted(it, model, keep), shape)


def held_out(doc_id: str = "doc_id"):
    """Whether the CRC-32 of the identifier as text leaves 2 when divided by 4."""
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(crc, F.lit(4)) == 2


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous.

    Learns from the documents that are not held out and have a language. A null
    identifier counts as the empty text in the split. Repeated rows are judged
    each on its own; an empty table gives an empty result. Of languages with equal loss
    the first by name is predicted, and the decision is ambiguous.
    """
    model = train(docs.where(~held_out(doc_id)), lang, text)
    columns = [F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out")]
    return predict(docs, columns, text, model)


def accepted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs, in their own columns, without those whose language can't be told.

    A document is rejected if its text has no letter or its decision is flagged as
    ambiguous. Where no language was learned at all, only texts without a letter go.
    """
    model = train(docs.where(~held_out(doc_id)), lang, text)
    if not model["names"]:
        return docs.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    own = [F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("own")]
    found = predict(docs, own, text, model)
    return found.where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select("own.*")
