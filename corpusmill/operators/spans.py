"""Spans a rewrite must not touch, and what a rewrite lost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import tables as T
from corpusmill.functions.text import (
    ANY_CASE, MULTI_ANY_CASE, constant, fill_marks, fold_case, join_segments, let, line_segments, percent, rstrip,
    segments, strip, text_of, unfold,
)
from corpusmill.operators.detect import lookup, route_type
from corpusmill.operators.redact import redact
from corpusmill.operators.tokens import count_tokens

MIN_CODE_SIGNALS = 2
MIN_INDENTED_LINES = 3
LOSS_SAMPLES = 5


def placeholder(template: str, number: Column) -> Column:
    before, after = template.split("%s")
    return F.concat(F.lit(before), number.cast("string"), F.lit(after))


def lift(
    seg: Column,
    template: str,
    accept: Callable[[Column], Column] | None = None,
    first: Column | None = None,
    tail: str = "",
) -> Column:
    """struct(text, spans): accepted hits out, numbered placeholders in."""
    start = F.lit(0) if first is None else first

    def marked(s: Column) -> Column:
        taken = F.transform(s["hits"], accept)
        at = lambda on: F.filter(
            F.transform(on, lambda ok, i: F.when(ok, i)), lambda i: i.isNotNull()
        )
        return let(
            F.struct(s["gaps"].alias("gaps"), s["hits"].alias("hits"), at(taken).alias("at")),
            swap,
        )

    def all_marked(s: Column) -> Column:
        put = F.transform(s["hits"], lambda h, i: F.concat(placeholder(template, i + start), F.lit(tail)))
        return F.struct(join_segments(s["gaps"], put).alias("text"), s["hits"].alias("spans"))

    def swap(s: Column) -> Column:
        number = lambda i: F.array_position(s["at"], i) + start - 1
        put = F.transform(
            s["hits"],
            lambda h, i: F.when(
                F.array_contains(s["at"], i), F.concat(placeholder(template, number(i)), F.lit(tail))
            ).otherwise(h),
        )
        return F.struct(
            join_segments(s["gaps"], put).alias("text"),
            F.transform(s["at"], lambda i: F.get(s["hits"], i)).alias("spans"),
        )

    return let(seg, marked if accept else all_marked)


def looks_like_code(block: Column) -> Column:
    signals = F.filter(constant(T.CODE_SIGNALS, "array<string>"), lambda s: block.contains(s))
    return F.size(signals) >= MIN_CODE_SIGNALS


def lift_code(text: Column) -> Column:
    """Fenced blocks, then runs of three or more indented code-like lines."""

    def indented(f: Column) -> Column:
        blocks = line_segments(
            f["text"], lambda l: l.rlike(r"(?d)^(?:    |\t).+"), MIN_INDENTED_LINES
        )
        return let(
            lift(blocks, T.CODE_PLACEHOLDER, looks_like_code, F.size(f["spans"])),
            lambda i: F.struct(
                i["text"].alias("text"), F.concat(f["spans"], i["spans"]).alias("spans")
            ),
        )

    return let(lift(segments(text_of(text), T.FENCED_BLOCK), T.CODE_PLACEHOLDER), indented)


def lift_tables(text: Column) -> Column:
    """Runs of lines that start and end with a pipe."""
    rows = line_segments(
        text_of(text), lambda l: l.rlike(r"(?d)^\|.+\|[ \t]*$"), needs_newline=True
    )
    return lift(rows, T.TABLE_PLACEHOLDER, tail="\n")


def lift_refs(text: Column) -> Column:
    """References in backticks, within one line."""
    return lift(segments(text_of(text), T.INLINE_REF), T.REF_PLACEHOLDER)


RULE_LITERALS = [
    "never", "always", "not", "be", "don", "important", "critical", "required",
    "forbidden", "prohibited", "verboten", "niemals", "immer", "muss", "nicht",
]


def lift_rules(text: Column) -> Column:
    """Lines that hold a rule word; lines with placeholders stay."""
    accept = lambda line: ~line.contains("⟨CODE_BLOCK_") & ~line.contains("⟨RULE_")
    untouched = lambda t: F.struct(
        t.alias("text"), F.array().cast("array<string>").alias("spans")
    )

    def search(t: Column) -> Column:
        literals = constant(RULE_LITERALS, "array<string>")
        may = let(fold_case(t), lambda low: F.exists(literals, lambda w: low.contains(w)))
        found = lift(segments(t, MULTI_ANY_CASE + T.RULE_LINE), T.RULE_PLACEHOLDER, accept)
        return F.when(may, found).otherwise(untouched(t))

    return let(text_of(text), search)


KINDS = {"code": lift_code, "table": lift_tables, "ref": lift_refs, "rule": lift_rules}


def explode_spans(df: DataFrame, kind: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per span of one kind, in order of appearance in its document."""
    return unfold(df, [key], KINDS[kind](F.col(text))["spans"], "pos", "span")


def lift_all(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds _code, _tables, _refs, _rules: each lifts from the text left before."""
    return (
        df.withColumn("_code", lift_code(F.col(text)))
        .withColumn("_tables", lift_tables(F.col("_code.text")))
        .withColumn("_refs", lift_refs(F.col("_tables.text")))
        .withColumn("_rules", lift_rules(F.col("_refs.text")))
    )


def placeholder_text(df: DataFrame, text: str = "text", out: str = "lifted") -> DataFrame:
    """Adds struct(text, code, tables, refs, rules): all spans lifted."""
    d = lift_all(df, text)
    return d.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.struct(
            F.col("_rules.text").alias("text"),
            F.col("_code.spans").alias("code"),
            F.col("_tables.spans").alias("tables"),
            F.col("_refs.spans").alias("refs"),
            F.col("_rules.spans").alias("rules"),
        ).alias(out),
    )


def put_back(text: Column, spans: Column, template: str, trim: bool = False) -> Column:
    before, after = template.split("%s")
    return fill_marks(text, before, after, F.transform(spans, rstrip) if trim else spans)


def reinsert(text: Column, lifted: Column) -> Column:
    """The spans back in their places, last lifted first."""
    t = put_back(text, lifted["rules"], T.RULE_PLACEHOLDER)
    t = put_back(t, lifted["refs"], T.REF_PLACEHOLDER)
    t = put_back(t, lifted["tables"], T.TABLE_PLACEHOLDER, trim=True)
    return put_back(t, lifted["code"], T.CODE_PLACEHOLDER)


def span_inventory(df: DataFrame, group: str = "source", text: str = "text") -> DataFrame:
    """Spans and documents per kind and group, each kind over the raw text.

    The counts are made inside the row; (group, kind, n) rows are shuffled after
    map-side aggregation.
    """
    counts = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.size(find(F.col(text))["spans"]).cast("bigint").alias("n"),
            )
            for kind, find in KINDS.items()
        ]
    )
    return (
        unfold(df, [group], F.filter(counts, lambda c: c["n"] > 0), "c")
        .groupBy(group, F.col("c.kind").alias("kind"))
        .agg(F.sum("c.n").alias("spans"), F.count("*").alias("documents"))
    )


def lost_values(raw: Column, new: Column) -> Column:
    """array of struct(kind, lost, samples) for the kinds that lost something."""

    def compare(s: Column) -> Column:
        def kind(label: str, pattern: str, any_case: bool) -> Column:
            rx = F.lit((ANY_CASE if any_case else "(?U)") + pattern)
            found = lambda t: F.regexp_extract_all(t, rx, F.lit(0))
            lost = F.array_except(found(s["raw"]), found(s["new"]))
            if label == "numbers":
                lost = F.filter(lost, lambda n: (F.length(n) >= 3) | ~n.startswith("0"))
            return let(
                lost,
                lambda l: F.struct(
                    F.lit(label).alias("kind"),
                    F.size(l).cast("bigint").alias("lost"),
                    F.slice(F.sort_array(l), 1, LOSS_SAMPLES).alias("samples"),
                ),
            )

        kinds = [kind(label, p, c) for label, (p, c) in T.LOSS_PATTERNS.items()]
        return F.filter(F.array(*kinds), lambda k: k["lost"] > 0)

    return let(F.struct(text_of(raw).alias("raw"), text_of(new).alias("new")), compare)


def loss_warnings(lost: Column) -> Column:
    return F.transform(
        lost,
        lambda k: F.concat(
            F.lit("["), k["kind"], F.lit("] lost "), k["lost"].cast("string"), F.lit(": "),
            F.array_join(k["samples"], ", "),
        ),
    )


# Rewrite profiles. The instructions are this library's own wording; pass other
# profiles to `prompt_requests` to use a different text, model or limit.
PROFILES = {
    "compress": {
        "provider": "openai",
        "model": "gpt-4o-mini",
        "temperature": 0.2,
        "max_output_tokens": 4000,
        "system_prompt": (
            "Shorten the text. Output only the shortened text, in its own language. Keep every "
            "fact, number, name, date, URL, command and line of code as it is. Copy placeholders "
            "in angle brackets exactly and in order. Drop filler, hedging and repetition."
        ),
    },
    "compress_aggressive": {
        "provider": "openai",
        "model": "gpt-4o-mini",
        "temperature": 0.1,
        "max_output_tokens": 4000,
        "system_prompt": (
            "Reduce the text to the fewest tokens from which all facts can be recovered. Use "
            "telegraphic style without formatting. Never change code, commands, rules, numbers "
            "or placeholders in angle brackets. Output only the result, in its own language."
        ),
    },
}


def prompt_requests(
    df: DataFrame,
    profile: str = "compress",
    key: str = "doc_id",
    text: str = "text",
    profiles: dict | None = None,
) -> DataFrame:
    """One rewrite request per document: redacted prose with placeholders.

    Secrets never reach the request; the lifted spans stay beside it for
    `accept_shorter`.
    """
    p = {**PROFILES, **(profiles or {})}[profile]
    red = df.where(strip(text_of(text)) != "").select(key, redact(F.col(text)).alias("original_text"))
    d = (
        placeholder_text(red, "original_text")
        .withColumn("original_tokens", count_tokens(F.col("original_text")))
        .withColumn("content_type", route_type(F.col("original_text")))
    )
    hint = lookup(F.col("content_type"), T.CONTENT_HINTS)
    system = F.concat(
        F.coalesce(F.concat(hint, F.lit("\n\n")), F.lit("")), F.lit(p["system_prompt"])
    )
    limit = F.greatest(F.lit(p["max_output_tokens"]).cast("bigint"), F.col("original_tokens"))
    request = F.struct(
        F.lit(p["model"]).alias("model"),
        F.lit(p["temperature"]).alias("temperature"),
        limit.alias("max_tokens"),
        F.array(
            F.struct(F.lit("system").alias("role"), system.alias("content")),
            F.struct(F.lit("user").alias("role"), F.col("lifted.text").alias("content")),
        ).alias("messages"),
    )
    return d.select(
        key,
        "original_text",
        "original_tokens",
        "content_type",
        "lifted",
        F.lit(p["provider"]).alias("provider"),
        limit.alias("max_output_tokens"),
        F.to_json(request).alias("request"),
    )


def accept_shorter(
    requests: DataFrame, responses: DataFrame, key: str = "doc_id", response: str = "response"
) -> DataFrame:
    """Responses with their spans back; one that is not shorter is rejected."""
    f = F.col
    d = (
        requests.join(responses.select(key, f(response).alias("_resp")), key)
        .withColumn("_new", reinsert(strip(text_of("_resp")), f("lifted")))
        .withColumn("_n", count_tokens(f("_new")))
    )
    ok = f("_n") < f("original_tokens")
    final = F.when(ok, f("_new")).otherwise(f("original_text"))
    tokens = F.when(ok, f("_n")).otherwise(f("original_tokens"))
    no_warnings = F.array().cast("array<string>")
    return d.select(
        key,
        "original_tokens",
        final.alias("compressed_text"),
        tokens.alias("compressed_tokens"),
        percent(f("original_tokens") - tokens, f("original_tokens")).alias("saved_percent"),
        F.when(~ok, F.lit("rewrite was not shorter than input")).alias("error"),
        F.when(ok, loss_warnings(lost_values(f("original_text"), f("_new"))))
        .otherwise(no_warnings)
        .alias("warnings"),
    )
