"""Token counts, cost and context-window use per model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import tables as T
from corpusmill.functions.text import let, percent, round_to, text_of, word_count, words

TOKENS_PER_WORD = 1.3


def count_tokens(text: Column, tokenizer: Callable[[Column], Column] | None = None) -> Column:
    """Tokens of a text: 1.3 per word, or whatever `tokenizer` counts."""
    if tokenizer is not None:
        return tokenizer(text)
    return F.floor(word_count(text_of(text)) * F.lit(TOKENS_PER_WORD)).cast("bigint")


def bpe_tokenizer(encoding: str = T.ENCODINGS[0]) -> Callable[[Column], Column]:
    """Exact byte-pair counts, for sessions whose workers have the vocabulary."""
    import pandas as pd

    @F.pandas_udf("bigint")
    def counted(texts: pd.Series) -> pd.Series:
        import tiktoken

        codec = tiktoken.get_encoding(encoding)
        return texts.map(lambda t: len(codec.encode(t, disallowed_special=())) if t else 0)

    return counted


def model_encoding(model: Column) -> Column:
    marks = [model.contains(m) for m in T.O200K_MARKERS]
    known = marks[0] | marks[1] | marks[2]
    return F.when(known, F.lit(T.ENCODINGS[0])).otherwise(F.lit(T.ENCODINGS[1]))


def model_table(defaults: dict, overrides: dict | None, value_type: str) -> Column:
    """The model dimension as an array literal: defaults, then user overrides."""
    merged = {**defaults, **(overrides or {})}
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("model_ord"),
                F.lit(name).alias("model"),
                F.lit(value).cast(value_type).alias("value"),
            )
            for i, (name, value) in enumerate(merged.items())
        ]
    )


def dimension_table(spark, defaults: dict, overrides: dict | None = None) -> DataFrame:
    """A key/value dimension with overrides merged over the defaults."""
    value_type = "string" if isinstance(next(iter(defaults.values())), str) else "double"
    schema = f"key string, value {value_type}, ord int"
    cast = str if value_type == "string" else float
    base = spark.createDataFrame(
        [(k, cast(v), i) for i, (k, v) in enumerate(defaults.items())], schema
    )
    if not overrides:
        return base
    user = spark.createDataFrame(
        [(k, cast(v), len(defaults) + i) for i, (k, v) in enumerate(overrides.items())], schema
    )
    return (
        base.alias("d")
        .join(user.alias("u"), "key", "full_outer")
        .select(
            "key",
            F.coalesce("u.value", "d.value").alias("value"),
            F.coalesce("d.ord", "u.ord").alias("ord"),
        )
    )


def cost_cents(tokens: Column, usd_per_million: Column) -> Column:
    """US cents for `tokens`, to six places."""
    cents = tokens.cast("double") * usd_per_million / F.lit(1e6) * F.lit(100.0)
    return round_to(cents, 6)


def usage_percent(tokens: Column, window: Column) -> Column:
    return round_to(tokens.cast("double") / window.cast("double") * F.lit(100.0), 2)


def with_costs(df: DataFrame, tokens: str = "tokens", prices: dict | None = None) -> DataFrame:
    """One row per input row and model; no join, the dimension is a literal."""
    return (
        df.withColumn("m", F.explode(model_table(T.PRICES, prices, "double")))
        .withColumn("model_ord", F.col("m.model_ord"))
        .withColumn("model", F.col("m.model"))
        .withColumn("cost_cents", cost_cents(F.col(tokens), F.col("m.value")))
        .drop("m")
    )


def with_usage(df: DataFrame, tokens: str = "tokens", windows: dict | None = None) -> DataFrame:
    return (
        df.withColumn("m", F.explode(model_table(T.CONTEXT_WINDOWS, windows, "bigint")))
        .withColumn("model_ord", F.col("m.model_ord"))
        .withColumn("model", F.col("m.model"))
        .withColumn("usage_pct", usage_percent(F.col(tokens), F.col("m.value")))
        .drop("m")
    )


def context_warning(
    tokens: Column, threshold: float = T.CONTEXT_ALERT_PCT, windows: dict | None = None
) -> Column:
    """struct(model, usage_pct) of the fullest model at or over the threshold.

    The first listed model wins a tie; NULL if no model is that full.
    """
    used = F.transform(
        model_table(T.CONTEXT_WINDOWS, windows, "bigint"),
        lambda m: F.struct(
            usage_percent(tokens, m["value"]).alias("usage_pct"),
            (-m["model_ord"]).alias("rank"),
            m["model"].alias("model"),
        ),
    )
    worst = F.array_max(F.filter(used, lambda u: u["usage_pct"] >= threshold))
    return F.when(
        worst.isNotNull(), F.struct(worst["model"].alias("model"), worst["usage_pct"].alias("usage_pct"))
    )


def context_band(usage_pct: Column) -> Column:
    return (
        F.when(usage_pct >= T.CONTEXT_ALERT_PCT, F.lit("danger"))
        .when(usage_pct >= T.CONTEXT_WARN_PCT, F.lit("warn"))
        .otherwise(F.lit("safe"))
    )


def fixed(value: Column, digits: int) -> Column:
    """A number with fixed decimals and no grouping."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def format_cost(cents: Column) -> Column:
    """Four, three or two decimals by size, with the cent sign."""
    shown = (
        F.when(cents < 0.01, fixed(cents, 4))
        .when(cents < 1.0, fixed(cents, 3))
        .otherwise(fixed(cents, 2))
    )
    return F.concat(shown, F.lit(" ¢"))


def cut_to_budget(text: Column, budget: Column) -> Column:
    """struct(text, tokens): whole if it fits, else the budgeted share of it."""

    def cut(s: Column) -> Column:
        share = budget.cast("double") / s["n"].cast("double")
        at = F.floor(F.length(s["t"]).cast("double") * share).cast("int")
        return (
            F.when(
                (s["t"] == "") | (budget <= 0),
                F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("tokens")),
            )
            .when(s["n"] <= budget, F.struct(s["t"].alias("text"), s["n"].alias("tokens")))
            .otherwise(
                F.struct(
                    F.substring(s["t"], F.lit(1), at).alias("text"),
                    budget.cast("bigint").alias("tokens"),
                )
            )
        )

    return let(
        text_of(text),
        lambda t: let(F.struct(t.alias("t"), count_tokens(t).alias("n")), cut),
    )


def token_stats(raw_tokens: Column, new_tokens: Column) -> Column:
    saved = raw_tokens - new_tokens
    pct = percent(saved, raw_tokens)
    return F.struct(
        raw_tokens.alias("original_tokens"),
        new_tokens.alias("compressed_tokens"),
        saved.alias("tokens_saved"),
        pct.alias("saved_percent"),
        F.concat(
            raw_tokens.cast("string"), F.lit(" → "), new_tokens.cast("string"),
            F.lit(" tokens ("), fixed(pct, 1), F.lit("% saved)"),
        ).alias("summary"),
    )


def token_report(
    df: DataFrame, key: str = "doc_id", text: str = "text", prices: dict | None = None
) -> DataFrame:
    """Tokens, characters, ratio, cost map and one summary line per document."""
    t = text_of(text)
    per_model = F.transform(
        model_table(T.PRICES, prices, "double"),
        lambda m: F.struct(m["model"].alias("key"), cost_cents(F.col("tokens"), m["value"]).alias("value")),
    )
    shown = F.array_join(
        F.transform(
            F.map_entries("cost_cents"),
            lambda e: F.concat(
                e["key"],
                F.lit(": "),
                format_cost(e["value"]),
                F.when(e["key"].contains("Claude"), F.lit(" (~est)")).otherwise(F.lit("")),
            ),
        ),
        "  |  ",
    )
    return (
        df.where(t != "")
        .select(key, count_tokens(t).alias("tokens"), F.length(t).cast("bigint").alias("chars"))
        .withColumn(
            "chars_per_token",
            F.coalesce(
                round_to(F.col("chars").cast("double") / F.nullif(F.col("tokens"), F.lit(0)), 1), F.lit(0.0)
            ),
        )
        .withColumn("cost_cents", F.map_from_entries(per_model))
        .withColumn("cost_summary", shown)
    )


def token_length_classes(text: Column) -> Column:
    """struct(expensive, medium, cheap): tokens of 1, 2-3 and more characters."""
    def counted(ws: Column) -> Column:
        size = lambda test: F.size(F.filter(ws, test)).cast("bigint")
        return F.struct(
            size(lambda w: F.length(w) <= 1).alias("expensive"),
            size(lambda w: (F.length(w) > 1) & (F.length(w) <= 3)).alias("medium"),
            size(lambda w: F.length(w) > 3).alias("cheap"),
        )

    return let(words(text_of(text)), counted)
