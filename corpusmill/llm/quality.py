"""Quality rules: base counts of a text and a hashed n-gram likelihood ratio.

Two multinomials over hashed words and word pairs are fitted, one to trusted
documents, one to the whole corpus. The weight of a bucket is the logarithm of
the ratio of its two (smoothed) shares, in whole millionths, so that the score of
a document is an integer sum that no order of addition changes. The mean weight
of its n-grams against a fixed threshold decides. All of it is column expressions;
the fitted weights are one array of `buckets` numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import GAP, WORD, settled, text_or_empty, word_list

BUCKETS = 1 << 16
#: Lowest mean log-likelihood ratio of a kept document, in millionths of a nat.
THRESHOLD = -250_000
SCALE = 1_000_000
#: Fixed odd factor of the first word's bucket in a pair's.
PAIR = 31421
#: Trusted documents that the target is fitted to, at most: those whose identifiers
#: have the lowest MD5. It bounds the table that is broadcast (8 bytes a document).
MOST_TRUSTED = 100_000
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MOST_REPEATED = 50, 50


def bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(word.cast("binary")), F.lit(buckets)).cast("int")


def bound(value: Column, zero: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once; zero gives the type of the result."""
    return F.aggregate(F.array(value), zero, lambda _, x: body(x))


def grams(words: Column, buckets: int) -> Column:
    """Buckets of the words, then of each word with the next one.

    The bucket of a pair is worked out from those of its two words.
    """

    def both(b: Column) -> Column:
        less = F.greatest(F.size(b) - 1, F.lit(0))
        pair = lambda x, y: F.pmod(x.cast("long") * PAIR + y + 1, F.lit(buckets)).cast("int")
        return F.concat(b, F.zip_with(F.slice(b, F.lit(1), less), F.slice(b, F.lit(2), less), pair))

    none = F.array().cast("array<int>")
    return bound(F.transform(words, lambda w: bucket(w, buckets)), none, both)


def repeated_words(words: Column) -> Column:
    """Words in three-word windows found twice or more in the list, the first included."""
    none = F.lit(0).cast("long")
    n = F.size(words)

    def windows(h: Column) -> Column:
        at = lambda i: F.element_at(h, i)
        spots = F.sequence(F.lit(1), F.size(h) - 2)
        return F.transform(spots, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))

    def counted(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(none)

    def covered(w: Column) -> Column:
        # In hash order a window is repeated if a neighbour has its hash.
        keyed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda k, x, j: ((j > 0) & (F.get(k, j - 1)["h"] == x["h"])) | F.coalesce(
            F.get(k, j + 1)["h"] == x["h"], F.lit(False)
        )
        spots = lambda k: F.array_sort(F.transform(F.filter(k, lambda x, j: again(k, x, j)), lambda x: x["i"]))
        return bound(keyed, none, lambda k: bound(spots(k), none, total))

    def total(at: Column) -> Column:
        start = F.struct(none.alias("n"), F.lit(-3).alias("last"))
        step = lambda s, i: F.struct(
            (s["n"] + F.least(i - s["last"], F.lit(3)).cast("long")).alias("n"), i.alias("last")
        )
        return F.aggregate(at, start, step, lambda s: s["n"])

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    found = lambda h: bound(windows(h), none, counted)
    return F.when(n >= 4, bound(hashes, none, found)).otherwise(none)


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, GAP, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": F.aggregate(
            F.array(lines), F.lit(0).cast("long"), lambda _, x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")
        ),
        "n_repeat_words": repeated_words(words),
    }


def fitted_weights(
    docs: DataFrame, trusted: DataFrame, doc_id: str, text: str, buckets: int = BUCKETS, most: int = MOST_TRUSTED
) -> DataFrame:
    """One row: `weights`, an array of `buckets` log ratios in millionths.

    trusted: identifiers of trusted documents, in a column of the same name; null
    and repeated ones don't count. The target is fitted to `most` of them at most,
    the corpus to every n-gram of every document. Without trusted documents all
    weights are 0.
    """
    marks = trusted.select(F.col(doc_id).alias("trusted_id")).where("trusted_id IS NOT NULL").distinct()
    marks = marks.orderBy(F.md5(F.col("trusted_id").cast("string")), "trusted_id").limit(most)
    counts = settled(
        docs.select(F.col(doc_id).alias("d"), text_or_empty(text).alias("t"))
        .join(F.broadcast(marks), F.col("d") == F.col("trusted_id"), "left")
        .select(F.col("trusted_id").isNotNull().cast("long").alias("good"), word_list("t").alias("w"))
        .select("good", F.explode(grams(F.col("w"), buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("good").alias("good"))
    )
    totals = counts.agg(F.sum("raw").alias("raw_all"), F.sum("good").alias("good_all"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    share = lambda n, all_n: (F.coalesce(F.col(n), F.lit(0)) + 1.0) / (F.col(all_n) + float(buckets))
    ratio = F.round(F.log(share("good", "good_all") / share("raw", "raw_all")) * SCALE).cast("long")
    table = every.join(counts, "bucket", "left").join(F.broadcast(totals), F.lit(True))
    weight = F.when(F.coalesce(F.col("good_all"), F.lit(0)) > 0, ratio).otherwise(F.lit(0).cast("long"))
    packed = F.array_sort(F.collect_list(F.struct("bucket", weight.alias("w"))))
    return table.agg(F.transform(packed, lambda x: x["w"]).alias("weights"))


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """One row per document: the base counts, base_failed, llr and kept.

    llr is the mean weight of a document's n-grams in millionths of a nat, rounded
    down; null without words. Null and empty texts have no words and fail the base
    rules. Repeated rows are judged alike, each on its own. Other columns of docs
    are not looked at; an empty table gives an empty result. Long texts are judged
    whole, and a document at the threshold is kept.
    """
    weights = fitted_weights(docs, trusted, doc_id, text, buckets).scalar()
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("t"))
    rows = rows.withColumn("w", word_list("t"))
    rows = rows.withColumn("weights", weights)
    total = F.aggregate(
        grams(F.col("w"), buckets), F.lit(0).cast("long"), lambda s, x: s + F.element_at(F.col("weights"), x + 1)
    )
    rows = rows.select(
        "doc_id",
        *[x.alias(n) for n, x in base_columns(F.col("t"), F.col("w")).items()],
        total.alias("sum"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    n_grams = 2 * F.col("n_words") - 1
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.when(F.col("n_words") > 0, F.floor(F.col("sum") / n_grams)).alias("llr"),
        (~failed & (F.col("sum") >= threshold * n_grams)).alias("kept"),
    )
