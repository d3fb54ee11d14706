"""Compression by content type and intent, and the relevance of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import tables as T
from corpusmill.functions.text import constant, is_blank, let, percent, phase, round_to, shielded, strip, text_of, unfold
from corpusmill.operators.compress import minify, strings
from corpusmill.operators.detect import category, route_type
from corpusmill.operators.redact import redact
from corpusmill.operators.shape import outline_kind, with_skeleton
from corpusmill.operators.tokens import count_tokens, fixed
from corpusmill.session import written

SAFE_CONFIDENCE = 0.85
#: Postings of a question's rarest terms that are counted first.
SEED_POSTINGS = 5000
DEFAULT_INTENT = T.INTENTS[0]


def strategy(cat: Column, intent: str) -> Column:
    """struct(steps, confidence) of a category, from a small constant map."""
    rows = {
        c: {"steps": steps, "confidence": sure}
        for (c, i), (steps, sure) in T.STRATEGIES.items()
        if i == intent
    }
    schema = "map<string,struct<steps:array<string>,confidence:double>>"
    return F.element_at(constant(rows, schema), cat)


def strategy_steps(cat: Column, intent: str) -> Column:
    return strategy(cat, intent)["steps"]


def strategy_confidence(cat: Column, intent: str) -> Column:
    return strategy(cat, intent)["confidence"]


def _typed(df: DataFrame, text: str, name: str | None) -> DataFrame:
    n = F.col(name) if name else None
    return (
        df.withColumn("_rt_raw", text_of(text))
        .withColumn("_rt_type", phase(lambda t: route_type(t, n), F.col("_rt_raw")))
        .withColumn("_rt_cat", phase(category, F.col("_rt_type")))
        .withColumn("_rt_n", count_tokens(F.col("_rt_raw")))
        .withColumn("_rt_red", phase(redact, F.col("_rt_raw")))
        .withColumn("_rt_rn", count_tokens(F.col("_rt_red")))
    )


def _unchanged(name: str) -> Column:
    """Is a text still the raw one? Then redaction has found nothing in it."""
    return F.col(name) == F.col("_rt_raw")


def _skeletons(d: DataFrame, name: str | None, wanted: Column) -> DataFrame:
    kind = F.when(wanted, outline_kind(F.col("_rt_type"), F.col(name) if name else None))
    return with_skeleton(d, "_rt_red", kind, "_rt_skel").withColumn(
        "_rt_sn", F.when(wanted, count_tokens(F.col("_rt_skel"))).otherwise(F.col("_rt_rn"))
    )


def _skeleton_notes() -> tuple[Column, Column]:
    cut = F.col("_rt_rn") - F.col("_rt_sn")
    share = fixed(cut.cast("double") / F.nullif(F.col("_rt_rn"), F.lit(0)) * 100.0, 0)
    done = F.when(cut > 0, F.concat(F.lit("skeleton:"), F.col("_rt_type")))
    gone = F.when(
        cut > 0,
        F.concat(
            F.lit("Skeleton stripped "), cut.cast("string"), F.lit(" tokens ("), share,
            F.lit("% of structure)"),
        ),
    )
    return done, gone


@shielded("_rt_", "_mf_")
def smart_route(
    df: DataFrame,
    text: str = "text",
    name: str | None = "name",
    intent: str = DEFAULT_INTENT,
    out: str = "routed",
) -> DataFrame:
    """Adds a struct: text, strategy, type, what went, confidence, tokens.

    An unknown intent means to understand. Redaction runs as its own step and
    again inside compression, which can tag a UUID next to a new secret tag; the
    second run is spared where the first one changed nothing.
    """
    intent = intent if intent in T.INTENTS else DEFAULT_INTENT
    has = lambda step: F.array_contains(strategy_steps(F.col("_rt_cat"), intent), step)
    d = _skeletons(_typed(df, text, name), name, has("skeleton"))
    d = d.withColumn("_rt_in", F.when(has("compress"), F.col("_rt_skel")))
    d = minify(d, "_rt_in", "_rt_m", clean=_unchanged("_rt_skel")).withColumn(
        "_rt_out", F.when(has("compress"), F.col("_rt_m.text")).otherwise(F.col("_rt_skel"))
    )
    d = d.withColumn("_rt_new", count_tokens(F.col("_rt_out")))
    done, gone = _skeleton_notes()
    changed = F.col("_rt_red") != F.col("_rt_raw")
    none = F.array().cast("array<string>")
    steps = F.concat(
        strings(F.when(changed, F.lit("secret_redaction")), done),
        F.when(has("compress"), F.col("_rt_m.techniques_applied")).otherwise(none),
    )
    removed = F.concat(
        strings(F.when(changed, F.lit("Secrets redacted")), gone),
        F.when(has("compress"), F.col("_rt_m.what_was_removed")).otherwise(none),
    )
    result = F.struct(
        F.col("_rt_out").alias("text"),
        F.when(F.size(steps) > 0, F.array_join(steps, " → "))
        .otherwise(F.lit("passthrough"))
        .alias("strategy_used"),
        F.col("_rt_type").alias("content_type"),
        F.slice(removed, 1, 5).alias("what_was_removed"),
        strategy_confidence(F.col("_rt_cat"), intent).alias("confidence"),
        F.col("_rt_n").alias("original_tokens"),
        F.col("_rt_new").alias("compressed_tokens"),
        percent(F.col("_rt_n") - F.col("_rt_new"), F.col("_rt_n")).alias("saved_percent"),
    )
    zero = F.lit(0).cast("bigint")
    empty = F.struct(
        F.col("_rt_raw").alias("text"),
        F.lit("none").alias("strategy_used"),
        F.lit("empty").alias("content_type"),
        none.alias("what_was_removed"),
        F.lit(1.0).alias("confidence"),
        zero.alias("original_tokens"),
        zero.alias("compressed_tokens"),
        F.lit(0.0).alias("saved_percent"),
    )
    return d.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.when(is_blank(F.col("_rt_raw")), empty).otherwise(result).alias(out),
    )


@shielded("_rt_", "_mf_")
def explain_compression(
    df: DataFrame, text: str = "text", name: str | None = "name", out: str = "explained"
) -> DataFrame:
    """Adds per-intent outcomes and the intent with the best safe saving.

    The four intents share their work: a document is redacted once, outlined at
    most once and compressed only in the forms its strategies ask for.
    """
    is_code, is_data = F.col("_rt_cat") == "code", F.col("_rt_cat") == "data"
    d = _skeletons(_typed(df, text, name), name, is_code | is_data)
    d = d.withColumn("_rt_plain", F.when(~is_data, F.col("_rt_red")))
    d = d.withColumn("_rt_outline", F.when(is_code, F.col("_rt_skel")))
    d = minify(d, "_rt_plain", "_rt_mp", clean=_unchanged("_rt_red"))
    d = minify(d, "_rt_outline", "_rt_mo", clean=_unchanged("_rt_skel"))
    saving = lambda n: percent(F.col("_rt_n") - n, F.col("_rt_n"))

    def outcome(intent: str) -> Column:
        steps = strategy_steps(F.col("_rt_cat"), intent)
        both = F.array_contains(steps, "skeleton") & F.array_contains(steps, "compress")
        tokens = (
            F.when(both, F.col("_rt_mo.compressed_tokens"))
            .when(F.array_contains(steps, "skeleton"), F.col("_rt_sn"))
            .otherwise(F.col("_rt_mp.compressed_tokens"))
        )
        return F.struct(
            F.lit(intent).alias("intent"),
            tokens.alias("result_tokens"),
            saving(tokens).alias("saved_percent"),
            strategy_confidence(F.col("_rt_cat"), intent).alias("confidence"),
        )

    d = d.withColumn("_rt_all", F.array(*[outcome(i) for i in T.INTENTS]))
    safe = F.filter("_rt_all", lambda o: o["confidence"] >= SAFE_CONFIDENCE)
    best = let(
        safe,
        lambda s: F.get(
            F.filter(
                s,
                lambda o: o["saved_percent"]
                == F.array_max(F.transform(s, lambda x: x["saved_percent"])),
            ),
            F.lit(0),
        )["intent"],
    )
    return d.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.struct(
            F.col("_rt_type").alias("content_type"),
            F.col("_rt_n").alias("original_tokens"),
            F.col("_rt_all").alias("per_intent"),
            F.coalesce(best, F.lit(DEFAULT_INTENT)).alias("recommended_intent"),
        ).alias(out),
    )


NUMBER_GAPS = r"(?U)[\s\-./]+"


def compact_number(text: Column) -> Column:
    """A separated number without its separators, else NULL."""

    def check(s: Column) -> Column:
        return let(
            F.regexp_replace(s, NUMBER_GAPS, ""),
            lambda c: F.when(
                (c != "")
                & (c != s)
                & s.rlike(T.NUMBER_SEPARATORS)
                & (
                    F.length(F.regexp_replace(c, r"(?U)[^\d+]", "")).cast("double")
                    / F.length(c).cast("double")
                    >= 0.60
                ),
                c,
            ),
        )

    return let(
        text_of(text), lambda t: F.when(~t.contains("\n") & (strip(t) != ""), let(strip(t), check))
    )


def build_variants(df: DataFrame, text: str = "text", out: str = "variants") -> DataFrame:
    """Adds Original plus Compressed if that saved, else plus a compact number."""
    routed = smart_route(df.withColumn("_text", text_of(text)), "_text", None, out="_r")
    variant = lambda label, t, pct: F.struct(
        F.lit(label).alias("label"), t.alias("text"), pct.alias("saved_percent")
    )
    t, r = F.col("_text"), F.col("_r")
    saved = (r["text"] != "") & (r["text"] != t) & (r["saved_percent"] > 0)

    def extra(c: Column) -> Column:
        pct = percent(F.length(t) - F.length(c), F.length(t))
        return F.when(saved, variant("Compressed", r["text"], r["saved_percent"])).when(
            c.isNotNull() & (c != t), variant("Compact", c, pct)
        )

    return routed.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.array_compact(
            F.array(variant("Original", t, F.lit(0.0)), let(compact_number(t), extra))
        ).alias(out),
    )


def best_variant(variants: Column) -> Column:
    """The active one: the last that is not the original."""
    return F.element_at(variants, -1)


def split_terms(text: Column) -> Column:
    """Distinct lower-case terms of two characters or more, camel case split."""
    spaced = F.regexp_replace(text_of(text), r"([a-z])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.array_distinct(
        F.filter(F.split(F.lower(spaced), r"[\W_]+"), lambda w: F.length(w) >= 2)
    )


def question_hits(text: Column, question: Column) -> Column:
    """struct(hits, terms): question terms found in the text, and their number."""
    return let(
        split_terms(question),
        lambda q: F.struct(
            F.size(F.array_intersect(q, split_terms(text))).cast("bigint").alias("hits"),
            F.size(q).cast("bigint").alias("terms"),
        ),
    )


def relevance(text: Column, question: Column | str, head_chars: int | None = None) -> Column:
    """Share of the question terms found in the text; 1 without a question.

    The whole text counts; `head_chars` limits the score to the head of it.
    """
    q = F.lit(question) if isinstance(question, str) else question
    sample = text_of(text) if head_chars is None else F.left(text_of(text), F.lit(head_chars))
    return let(
        question_hits(sample, q),
        lambda h: F.when(h["terms"] == 0, F.lit(1.0)).otherwise(
            h["hits"].cast("double") / F.nullif(h["terms"], F.lit(0).cast("bigint"))
        ),
    )


def shown_score(score: Column) -> Column:
    return round_to(score, 2)


def _top(rows: DataFrame, group: str, order: list, k: int, parts: int = 32) -> DataFrame:
    """The k first rows of each group with their rank; first within parts of a group."""
    part = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(parts))
    some = rows.withColumn("_part", part)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)))
    some = some.where(F.col("rank") <= k).drop("_part", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def relevant_documents(
    docs: DataFrame,
    questions: DataFrame,
    k: int = 50,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    question: str = "text",
    seeds: int = SEED_POSTINGS,
) -> DataFrame:
    """item, key, hits, terms, rank: for each question the k documents with most of its terms.

    Only documents with at least one term; equal numbers go by key. The terms of the
    questions are an inverted list that meets the terms of the documents by value. Of
    a question, the rarest terms alone give k documents and so a number of terms that
    the k best reach for sure; a document that reaches it holds one of the rarest
    terms - number + 1 terms, so frequent terms make no candidates. Candidates are
    then counted against all terms. Rows of one key are one document, rows of one
    item one question; questions without terms have no rows.
    """
    per = questions.select(F.col(item).alias("q"), split_terms(F.col(question)).alias("t"))
    per = per.groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("asked"))
    per = written(per.where("size(asked) > 0").withColumn("terms", F.size("asked").cast("bigint")))
    asked = per.select("q", "terms", F.explode("asked").alias("term"))
    rows = unfold(docs, [F.col(key).alias("d")], split_terms(F.col(text)), "term")
    found = written(rows.join(asked.select("term").distinct(), "term").distinct())
    by_rarity = Window.partitionBy("q").orderBy("n", "term")
    upto = by_rarity.rowsBetween(Window.unboundedPreceding, -1)
    lists = asked.join(found.groupBy("term").agg(F.count("*").alias("n")), "term")
    lists = lists.withColumns(
        {"nth": F.row_number().over(by_rarity), "before": F.coalesce(F.sum("n").over(upto), F.lit(0))}
    )
    lists = written(lists)
    # How many terms the k best reach, by the lists of the rarest terms.
    first = found.join(lists.where((F.col("nth") == 1) | (F.col("before") < seeds)), "term")
    reached = first.groupBy("q", "d").agg(F.count("*").alias("hits")).groupBy("q", "hits").agg(F.count("*").alias("docs"))
    down = Window.partitionBy("q").orderBy(F.desc("hits"))
    reached = reached.withColumn("docs", F.sum("docs").over(down)).where(F.col("docs") >= k)
    reached = reached.groupBy("q").agg(F.max("hits").alias("sure"))
    lists = lists.join(reached, "q", "left").withColumn("sure", F.coalesce("sure", F.lit(1)))
    # Terms that no document holds have no list, and count as met by none.
    held = Window.partitionBy("q")
    lists = lists.withColumn("known", F.count("*").over(held))
    wanted = lists.where(F.col("nth") <= F.col("known") - F.col("sure") + 1).select("q", "term")
    candidates = found.join(wanted, "term").select("q", "d").distinct()
    whole = found.groupBy("d").agg(F.collect_list("term").alias("held"))
    counted = candidates.join(whole, "d").join(per, "q")
    counted = counted.select("q", "d", F.size(F.array_intersect("asked", "held")).cast("bigint").alias("hits"), "terms")
    best = _top(counted, "q", [F.desc("hits"), F.asc_nulls_first("d")], k)
    return best.select(F.col("q").alias(item), F.col("d").alias(key), "hits", "terms", "rank")
