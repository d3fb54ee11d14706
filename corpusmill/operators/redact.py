"""Secret redaction as column expressions, and reports over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import tables as T
from corpusmill.functions.text import (
    ANY_CASE, WHITE, let, look_behind, replace_matches, replacement, text_of,
    unfold,
)

# A delimiter-free token of the minimum length, tried only at its start.
TOKEN_CLASS = f"[^{WHITE}{T.TOKEN_DELIMITERS}]"
LONG_WORD = rf"(?<!\S)\S{{{T.ENTROPY_MIN_LENGTH},}}"


# What stands in every match: a literal, and a quicker pattern where the literal is in many words.
SIGNS = {
    "[AWS_KEY_REDACTED]": ("AKIA", None),
    "[AWS_SECRET_REDACTED]": ("_", "(?i)_access_key"),
    "[STRIPE_KEY_REDACTED]": ("sk", "sk[_-](?:live|test)[_-]"),
    "[AI_API_KEY_REDACTED]": ("sk-", r"sk-[a-zA-Z0-9_\-]{20}"),
    "[GH_TOKEN_REDACTED]": ("ghp_", None),
    "[JWT_REDACTED]": ("eyJ", None),
    "[PRIVATE_KEY_REDACTED]": ("PRIVATE KEY-----", None),
}
IPV4_SIGN = r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"
UUID_SIGN = "-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-"


def long_token(min_length: int = T.ENTROPY_MIN_LENGTH) -> str:
    return f"(?U)(?<!{TOKEN_CLASS}){TOKEN_CLASS}{{{min_length},}}"


def redact_known(text: Column, extra: dict[str, str] | None = None) -> Column:
    """Secrets of known shape, in order; `extra` adds or replaces tag -> pattern.

    A pattern runs only in texts that hold its sign. Patterns are literals and so
    compiled once for each task.
    """
    patterns = {tag: (SIGNS[tag], pattern) for tag, _, pattern in T.SECRET_PATTERNS}
    patterns.update({tag: (None, pattern) for tag, pattern in (extra or {}).items()})

    def rewrite(tag: str, sign: tuple[str, str | None] | None, pattern: str) -> Callable[[Column], Column]:
        changed = lambda t: F.regexp_replace(t, pattern, replacement(tag))
        if sign is None:
            return changed
        literal, quick = sign
        some = lambda t: t.contains(literal) if quick is None else t.contains(literal) & t.rlike(quick)
        return lambda t: F.when(some(t), changed(t)).otherwise(t)

    for tag, (sign, pattern) in patterns.items():
        text = let(text, rewrite(tag, sign, pattern))
    return text


def redact_ips(text: Column) -> Column:
    """IPv4 addresses, unless a version or language name stands right before."""

    def decide(hit: Column, i: Column, seg: Column) -> Column:
        valid = F.forall(F.split(hit, r"\."), lambda o: o.cast("int") <= 255)
        before = F.right(F.get(seg["gaps"], i), F.lit(T.VERSION_LOOK_BACK))
        version = before.rlike(ANY_CASE + T.VERSION_WORD)
        return F.when(valid & ~version, F.lit(T.IP_TAG)).otherwise(hit)

    return replace_matches(text, T.IPV4, decide, IPV4_SIGN)


def redact_uuids(text: Column) -> Column:
    """UUIDs near a secret word; kept in URLs, after id keys and by default."""

    def decide(hit: Column, i: Column, seg: Column) -> Column:
        return let(
            look_behind(seg, i, T.UUID_LOOK_BACK, 36),
            lambda before: F.when(
                ~before.rlike(ANY_CASE + T.URL_BEFORE)
                & ~before.rlike(ANY_CASE + T.ID_KEY_BEFORE)
                & before.rlike(ANY_CASE + T.SECRET_WORD),
                F.lit(T.UUID_TAG),
            ).otherwise(hit),
        )

    return replace_matches(text, T.UUID, decide, UUID_SIGN)


def shannon_bits(token: Column) -> Column:
    """Entropy of the characters of a token, in bits per character."""
    chars = F.split(token, "", -1)

    def bits(c: Column) -> Column:
        n = F.size(c["all"]).cast("double")
        share = lambda x: F.size(F.filter(c["all"], lambda y: y == x)).cast("double") / n
        return F.aggregate(
            F.array_distinct(c["all"]),
            F.lit(0.0),
            lambda acc, x: let(share(x), lambda p: acc - p * F.log2(p)),
        )

    return let(F.struct(F.filter(chars, lambda x: x != "").alias("all")), bits)


def is_secret_token(token: Column) -> Column:
    """Long, dotless, mixed, mostly base64-like and of high entropy."""
    plain = F.length(F.regexp_replace(token, r"[^A-Za-z0-9+/=_\-]", ""))
    mixed = token.rlike(r"[\p{Lu}\p{Nd}+/=_\-]")
    ratio = plain.cast("double") / F.length(token).cast("double")
    cheap = (
        (F.length(token) >= T.ENTROPY_MIN_LENGTH)
        & ~token.contains(".")
        & mixed
        & (ratio >= T.ENTROPY_MIN_RATIO)
    )
    return F.when(cheap, shannon_bits(token) >= T.ENTROPY_MIN_BITS).otherwise(F.lit(False))


def redact_high_entropy(text: Column) -> Column:
    """Long random-looking tokens; only long words are looked into.

    The words are taken out with the blank before them, which is much quicker to find than
    `LONG_WORD`; that runs only in texts that change.
    """

    def token(hit: Column, i: Column, seg: Column) -> Column:
        return F.when(is_secret_token(hit), F.lit(T.ENTROPY_TAG)).otherwise(hit)

    def word(hit: Column, i: Column, seg: Column) -> Column:
        return replace_matches(hit, long_token(), token)

    def secret(t: Column) -> Column:
        taken = F.regexp_extract_all(F.concat(F.lit("\n"), t), F.lit(rf"\s(\S{{{T.ENTROPY_MIN_LENGTH},}})"), F.lit(1))
        return F.exists(taken, lambda w: word(w, None, None) != w)

    return let(text, lambda t: F.when(secret(t), replace_matches(t, LONG_WORD, word)).otherwise(t))


def redact(text: Column, extra: dict[str, str] | None = None) -> Column:
    """Known shapes, then addresses, then UUIDs, then high entropy."""
    known = redact_known(text_of(text), extra)
    return redact_high_entropy(redact_uuids(redact_ips(known)))


TAGS = [tag for tag, _, _ in T.SECRET_PATTERNS] + [T.IP_TAG, T.UUID_TAG, T.ENTROPY_TAG]


def redaction_report(
    df: DataFrame, group: str = "source", text: str = "text", extra: dict[str, str] | None = None
) -> DataFrame:
    """Findings and affected documents per group and tag.

    Tags already in the raw text are not findings. One narrow (group, tag) row
    per finding kind and document is shuffled, after map-side aggregation.
    """
    tags = TAGS + [t for t in (extra or {}) if t not in TAGS]
    raw = text_of(text)
    found = df.select(group, raw.alias("raw"), redact(raw, extra).alias("clean"))
    times = lambda c, tag: (
        (F.length(c) - F.length(F.replace(c, F.lit(tag), F.lit("")))) / F.lit(len(tag))
    ).cast("bigint")
    kinds = F.array(
        *[
            F.struct(
                F.lit(tag).alias("tag"),
                (times(F.col("clean"), tag) - times(F.col("raw"), tag)).alias("n"),
            )
            for tag in tags
        ]
    )
    return (
        unfold(found, [group], F.filter(kinds, lambda k: k["n"] > 0), "k")
        .groupBy(group, F.col("k.tag").alias("tag"))
        .agg(F.sum("k.n").alias("findings"), F.count("*").alias("documents"))
    )


def entropy_profile(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = T.ENTROPY_MIN_LENGTH
) -> DataFrame:
    """The tokens behind the entropy rule: length, bits, verdict. No shuffle."""
    long_words = F.regexp_extract_all(text_of(text), F.lit(rf"\S{{{min_length},}}"), F.lit(0))
    tokens = F.flatten(
        F.transform(
            long_words, lambda w: F.regexp_extract_all(w, F.lit(long_token(min_length)), F.lit(0))
        )
    )
    return (
        unfold(df, [key], tokens, "pos", "token")
        .withColumn("token_length", F.length("token").cast("bigint"))
        .withColumn("bits", shannon_bits(F.col("token")))
        .withColumn("is_secret", is_secret_token(F.col("token")))
    )
