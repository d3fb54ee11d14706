"""Content-type detection from the text and the file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import tables as T
from corpusmill.functions.text import (
    ANY_CASE, MULTI, MULTI_ANY_CASE, OTHER_NEWLINES, constant, count_matches, holds_any, is_blank, let,
    lines, split_lines, strip, text_of, unlines, with_totals,
)
from corpusmill.operators.tokens import count_tokens

# By default the rules look at the whole text. A head of so many lines and characters,
# given as a parameter, is what tools for single files commonly look at.
HEAD_LINES = 30
HEAD_CHARS = 5000
AGENT_CONFIG_HITS = 5
#: What stands in every text with one of the email markers, quicker to find than all of them.
EMAIL_SIGN = f":(?<={'|'.join(T.EMAIL_MARKERS)})"


def detect_raw_code(text: Column) -> Column:
    """code_python, code_js or code_generic for unfenced source, else ''."""

    def decide(t: Column) -> Column:
        indented = t.rlike(MULTI + r"^[ \t]{2,}\S")
        hits = F.struct(
            count_matches(t, MULTI + T.PYTHON_SIGNAL).alias("py"),
            count_matches(t, MULTI + T.SCRIPT_SIGNAL).alias("js"),
        )
        return let(
            hits,
            lambda h: F.when(
                (h["py"] >= 1)
                & (h["py"] >= h["js"])
                & ((h["py"] >= 2) | indented | t.rlike(MULTI + r":\s*$")),
                F.lit("code_python"),
            )
            .when(
                (h["js"] >= 1) & ((h["js"] >= 2) | t.rlike(MULTI + r"[;{}]\s*$")),
                F.lit("code_js"),
            )
            .when(
                indented & (count_matches(t, MULTI + T.GENERIC_SIGNAL) >= 3),
                F.lit("code_generic"),
            )
            .otherwise(F.lit("")),
        )

    return let(text, decide)


def detect_type(text: Column, head_lines: int | None = None) -> Column:
    """log, email, web_scrape, markdown, code_* or prose, by all lines or the first head_lines."""
    # Lines are taken apart only where a rule has to count them.
    first = lambda s: split_lines(s) if head_lines is None else F.slice(split_lines(s), 1, head_lines)

    def by_head(s: Column) -> Column:
        whole = s["head"]
        sample = F.lower(whole)
        matching = lambda pattern: F.size(F.filter(lines(whole), lambda l: l.rlike(pattern)))
        present = lambda low, marks: F.size(
            F.filter(constant(marks, "array<string>"), lambda m: low.contains(m))
        )
        code = let(
            detect_raw_code(s["text"]),
            lambda c: F.when(c != "", c).otherwise(F.lit("prose")),
        )
        typed = let(
            sample,
            lambda low: F.when(whole.rlike(MULTI_ANY_CASE + T.LOG_LINE) & (matching(ANY_CASE + T.LOG_LINE) >= 3), F.lit("log"))
            .when(low.rlike(EMAIL_SIGN) & (present(low, T.EMAIL_MARKERS) >= 2), F.lit("email"))
            .when(present(low, T.WEB_MARKERS) >= 3, F.lit("web_scrape"))
            .when(low.contains("#") & (matching(r"^#{1,6}\s") >= 2), F.lit("markdown"))
            .otherwise(code),
        )
        return F.when(whole == "", F.lit("prose")).otherwise(typed)

    def head(s: Column) -> Column:
        joined = unlines(first(s))
        return joined if head_lines is not None else F.when(holds_any(s, OTHER_NEWLINES), joined).otherwise(s)

    return let(
        text_of(text),
        lambda t: let(F.struct(t.alias("text"), let(strip(t), head).alias("head")), by_head),
    )


def lookup(key: Column, table: dict[str, str]) -> Column:
    """A small fixed table as a map literal: no join, no broadcast."""
    return F.try_element_at(constant(table, "map<string,string>"), key)


def type_by_name(name: Column, extensions: dict[str, str] | None = None) -> Column:
    """Type told by the file name alone, else NULL."""
    n = text_of(name)
    table = {**T.TYPE_BY_EXTENSION, **(extensions or {})}
    base = F.lower(F.regexp_extract(n, r"([^/\\]*)$", 1))
    ext = F.concat(F.lit("."), F.lower(F.regexp_extract(n, r"\.([^.]*)$", 1)))
    return F.when(F.array_contains(constant(T.AGENT_CONFIG_NAMES, "array<string>"), base), F.lit("agent_config")).when(
        n.contains("."), lookup(ext, table)
    )


def type_by_shape(text: Column) -> Column:
    return let(
        strip(text),
        lambda s: F.when(
            F.left(s, F.lit(1)).isin("{", "[") & F.right(s, F.lit(1)).isin("}", "]"),
            F.lit("data_json"),
        ).when(s.startswith("<") & s.endswith(">"), F.lit("data_xml")),
    )


def route_type(
    text: Column,
    name: Column | None = None,
    extensions: dict[str, str] | None = None,
    head_lines: int | None = None,
    head_chars: int | None = None,
) -> Column:
    """File name, then rule keywords, then text heuristics, then brackets."""
    by_name = type_by_name(name, extensions) if name is not None else F.lit(None).cast("string")

    def by_text(t: Column) -> Column:
        head = t if head_chars is None else F.left(t, F.lit(head_chars))
        keywords = count_matches(head, ANY_CASE + T.AGENT_CONFIG_KEYWORDS)
        told = let(
            detect_type(t, head_lines),
            lambda d: F.when(d.isin("log", "email", "web_scrape", "markdown"), d),
        )
        return F.when(keywords >= AGENT_CONFIG_HITS, F.lit("agent_config")).otherwise(
            F.coalesce(told, type_by_shape(t), F.lit("prose"))
        )

    return F.coalesce(by_name, let(text_of(text), by_text))


def category(content_type: Column) -> Column:
    return F.coalesce(lookup(content_type, T.CATEGORY_BY_TYPE), F.lit("prose"))


def type_mix(
    df: DataFrame, group: str = "source", text: str = "text", name: str | None = "name"
) -> DataFrame:
    """Documents, tokens and token share per type: each group, and all groups.

    The rows of all groups together have is_total true and no group. NULL is a
    group of its own. Documents reduce to (group, type, tokens) before the
    shuffle; the share divides by a window over those few rows.
    """
    t = text_of(text)
    typed = df.select(
        F.col(group),
        route_type(t, F.col(name) if name else None).alias("content_type"),
        count_tokens(t).alias("tokens"),
    )
    per_type = typed.groupBy(group, "content_type").agg(
        F.count("*").alias("docs"), F.sum("tokens").alias("tokens")
    )
    both = with_totals(
        per_type, group, ["content_type"], F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")
    )
    own = Window.partitionBy(group, "is_total")
    group_tokens = F.nullif(F.sum("tokens").over(own), F.lit(0))
    return both.select(
        group,
        "is_total",
        "content_type",
        "docs",
        "tokens",
        F.coalesce(F.col("tokens").cast("double") / group_tokens, F.lit(0.0)).alias("token_share"),
    )


CODE_WORDS = r"def |class |import |from .+ import |function |const |let |var |return "
COMMAND_LINE = r"^\s*(?:#|[$>]|\w+\s)"


def is_real_code_block(content: Column) -> Column:
    """Does the inside of a fenced block hold source code?"""

    def verdict(ls: Column) -> Column:
        n = F.size(ls)
        having = lambda test: F.size(F.filter(ls, test))
        code = having(
            lambda l: l.rlike(CODE_WORDS)
            | strip(l).rlike(r"[{};]$")
            | l.rlike(r"^\s*(?:if|for|while|try|except|catch)\b")
        )
        return (
            F.when(n == 0, F.lit(False))
            .when(having(lambda l: l.rlike("[├└│─]")) >= 2, F.lit(False))
            .when(n <= 3, F.lit(False))
            .when(code >= 2, F.lit(True))
            .when(having(lambda l: l.rlike(COMMAND_LINE)) >= n * F.lit(0.7), F.lit(False))
            .otherwise(n > 5)
        )

    return let(F.filter(split_lines(strip(content)), lambda l: ~is_blank(l)), verdict)
