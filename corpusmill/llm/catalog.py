"""Registered queries of this subpackage, by name, and their oracle SQL."""

from __future__ import annotations

import os
import secrets
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import oracles, rollup
from corpusmill.llm.common import read, settled, word_total
from corpusmill.llm.divergence import divergence
from corpusmill.llm.exact import exact_dedup
from corpusmill.llm.language import identify
from corpusmill.llm.mixture import mix_sources
from corpusmill.llm.near import near_classes
from corpusmill.llm.packing import pack
from corpusmill.llm.pseudonyms import pseudonymised
from corpusmill.llm.quality import quality_rules
from corpusmill.llm.ranked import ranked_search
from corpusmill.llm.substrings import without_repeats
from corpusmill.llm.toxicity import toxicity
from corpusmill.llm.urls import url_verdicts
from corpusmill.session import checkpoint_dir

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
WORDS_VERSION, BPE_VERSION = "words-1", "byte_bpe_50k-1"
WITHDRAWN_BELOW = 20


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts."""
    return exact_dedup(read(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mix_sources(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the language predicted from its whole text."""
    return identify(read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences, no source or equal text twice in one."""
    return pack(read(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates."""
    return near_classes(read(spark, sf_dir, "documents")).drop("raw")


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, under the key of PSEUDONYM_KEY.

    Without that variable a random key is drawn, so no one can undo the result.
    """
    key = os.environ.get("PSEUDONYM_KEY", "").encode() or secrets.token_bytes(32)
    return pseudonymised(read(spark, sf_dir, "documents"), key)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's address judged by rules and model."""
    return url_verdicts(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Totals after four batches; they cover all documents, null and empty texts too.

    The first inserts every document with its words. The second revises every
    document to the byte-pair vocabulary and withdraws those of fewer than
    WITHDRAWN_BELOW words. The third delivers the second again. The last inserts
    the withdrawn documents again, with their byte-pair tokens.
    """
    docs = read(spark, sf_dir, "documents")
    state = f"{checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}"
    facts = ["doc_id", "source", "lang"]
    words = docs.select(*facts, word_total("text").alias("n_tokens"))
    first = words.withColumns(
        {"op": F.lit("insert"), "tokenizer_version": F.lit(WORDS_VERSION), "seq": F.lit(0).cast("long")}
    )
    rollup.commit(spark, state, 1, first)
    vocab = rollup.vocabulary(f"{tokenizers}/byte_bpe_50k.tiktoken")
    columns = [*facts, word_total("text").alias("n_words")]
    second = rollup.with_tokens(docs, "text", vocab, columns).withColumns(
        {
            "op": F.when(F.col("n_words") < WITHDRAWN_BELOW, "delete").otherwise("revise"),
            "tokenizer_version": F.lit(BPE_VERSION),
            "seq": F.lit(1).cast("long"),
        }
    )
    for _ in range(2):
        rollup.commit(spark, state, 2, second)
    # Rows without a doc_id were never withdrawn, nor were identifiers that have a longer text too.
    short = docs.where((word_total("text") < WITHDRAWN_BELOW) & F.col("doc_id").isNotNull())
    short = short.join(words.where(F.col("n_tokens") >= WITHDRAWN_BELOW).select("doc_id"), "doc_id", "left_anti")
    third = rollup.with_tokens(short, "text", vocab, facts).withColumns(
        {"op": F.lit("insert"), "tokenizer_version": F.lit(BPE_VERSION), "seq": F.lit(2).cast("long")}
    )
    rollup.commit(spark, state, 3, third)
    out = settled(rollup.totals(spark, state))
    rollup.removed(spark, state)
    return out


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left after repeated strings of 100 bytes."""
    return without_repeats(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged; trusted are the documents labelled good."""
    trusted = read(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules(read(spark, sf_dir, "documents"), trusted)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    found = ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score, learned from the labels that are not held out."""
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of a language against the others, and the terms it favours."""
    return divergence(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_mix_sources": op3_mix_sources,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_pii_pseudonyms": op6_pii_pseudonyms,
    "op7_url_filters": op7_url_filters,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_ranked_search": op11_ranked_search,
    "op12_toxicity": op12_toxicity,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES = {
    "op1_exact_dedup": oracles.EXACT,
    "op3_mix_sources": oracles.MIXTURE,
    "op10_quality_rules": oracles.QUALITY,
    "op11_ranked_search": oracles.RANKED,
    "op13_source_divergence": oracles.DIVERGENCE,
}
