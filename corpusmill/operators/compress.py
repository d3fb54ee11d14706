"""Rule-based text compression as column expressions.

Every phase maps a text column to a text column (or to a struct that carries
what the phase did), so compressing a corpus is one projection: no shuffle, no
Python worker. The ordered rewrite tables run through `fold_rules`, whose regex
work is limited to rules whose literal occurs in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import lexicons as L
from corpusmill.functions.text import (
    ANY_CASE, MULTI, MULTI_ANY_CASE, constant, count_matches, fill_marks, fold_case, fold_lines,
    fold_rules,
    is_blank, join_segments, let, line_segments, lines, percent, phase, phrase_rules, regex_literal,
    replace_matches, rstrip, segments, shielded,
    split_lines, strip, swap_where, swap_words, text_of, unfold, unlines, with_totals,
    without_words, words, words_of, words_present,
)
from corpusmill.operators.detect import detect_type, is_real_code_block
from corpusmill.operators.redact import redact
from corpusmill.operators.tokens import count_tokens, token_stats

MAX_SAMPLES = 5
DEDUP_WINDOW = 3
DEDUP_MIN_LINES = 5
LONG_LINE_WORDS = 8
PUNCTUATION = ".,!?();:"


def strings(*items: Column) -> Column:
    """An array of the items that are not NULL."""
    return F.array_compact(F.array(*items)) if items else F.array().cast("array<string>")


def counted(label: str, n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit(label + ":"), n.cast("string")))


# ------------------------------------------------- fenced block protection

FENCE = r"```[\s\S]*?```"
TREE = "[├└│]"
KEY = "__PROTECTED_"


def shorten_tree(content: Column) -> Column:
    """A directory tree without its drawing and its trailing comments."""

    def plain(line: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(line, TREE, ""), r"──\s*", " ")
        bare = F.regexp_replace(bare, r"\s{2,}#\s+.*$", "")
        return rstrip(F.regexp_replace(bare, r"^[ \t]+", " "))

    return unlines(F.filter(F.transform(split_lines(content), plain), lambda l: ~is_blank(l)))


def shorten_commands(content: Column) -> Column:
    """A command list without comment lines, blank lines and padding."""
    return unlines(
        F.filter(
            F.transform(split_lines(content), strip),
            lambda l: (l != "") & (~l.startswith("#") | l.startswith("#!")),
        )
    )


def block_decision(block: Column) -> Column:
    """struct(keep, text): kept verbatim, or replaced by a shorter text."""

    def decide(b: Column) -> Column:
        inner = F.substring(b["full"], F.lit(1) + b["cut"], F.length(b["full"]))
        parts = F.struct(
            strip(F.lower(F.substring(b["full"], F.lit(4), b["cut"] - 4))).alias("hint"),
            F.when(
                inner.endswith("```"), rstrip(F.left(inner, F.length(inner) - 3))
            ).otherwise(inner).alias("content"),
        )
        refenced = lambda body: F.struct(
            F.lit(False).alias("keep"), F.concat(F.lit("```\n"), body, F.lit("\n```")).alias("text")
        )
        kept = F.struct(F.lit(True).alias("keep"), b["full"].alias("text"))

        def by_content(p: Column) -> Column:
            tree_lines = F.size(F.filter(split_lines(p["content"]), lambda l: l.rlike(TREE)))
            return (
                F.when(F.array_contains(constant(L.CODE_HINTS, "array<string>"), p["hint"]), kept)
                .when(tree_lines >= 2, refenced(shorten_tree(p["content"])))
                .when(F.array_contains(constant(L.SHELL_HINTS, "array<string>"), p["hint"]), refenced(shorten_commands(p["content"])))
                .when(is_real_code_block(p["content"]), kept)
                .otherwise(
                    let(
                        shorten_commands(p["content"]),
                        lambda s: F.when(s != p["content"], refenced(s)).otherwise(kept),
                    )
                )
            )

        on_one_line = F.struct(F.lit(False).alias("keep"), b["full"].alias("text"))
        return F.when(b["cut"] == 0, on_one_line).otherwise(let(parts, by_content))

    return let(
        block,
        lambda full: let(F.struct(full.alias("full"), F.instr(full, "\n").alias("cut")), decide),
    )


def protect_blocks(text: Column) -> Column:
    """struct(text, blocks): code blocks out of the text, numbered keys in."""

    def decided(seg: Column) -> Column:
        made = F.transform(seg["hits"], block_decision)
        return let(F.struct(seg["gaps"].alias("gaps"), made.alias("made")), numbered)

    def numbered(s: Column) -> Column:
        kept = F.filter(
            F.transform(s["made"], lambda d, i: F.when(d["keep"], i)), lambda i: i.isNotNull()
        )
        return let(
            F.struct(s["gaps"].alias("gaps"), s["made"].alias("made"), kept.alias("kept")), swapped
        )

    def swapped(s: Column) -> Column:
        key = lambda i: F.concat(
            F.lit(KEY), (F.array_position(s["kept"], i) - 1).cast("string"), F.lit("__")
        )
        put = F.transform(s["made"], lambda d, i: F.when(d["keep"], key(i)).otherwise(d["text"]))
        return F.struct(
            join_segments(s["gaps"], put).alias("text"),
            F.transform(s["kept"], lambda i: F.get(s["made"], i)["text"]).alias("blocks"),
        )

    untouched = lambda t: F.struct(
        t.alias("text"), F.array().cast("array<string>").alias("blocks")
    )
    return let(
        text,
        lambda t: F.when(t.contains("```"), let(segments(t, FENCE), decided)).otherwise(
            untouched(t)
        ),
    )


def restore_blocks(text: Column, blocks: Column) -> Column:
    return fill_marks(text, KEY, "__", blocks)


# --------------------------------------------------------------- normalise


def normalize_prose(text: Column) -> Column:
    def fancy(t: Column) -> Column:
        for sign, plain in L.SMART_PUNCTUATION:
            t = F.replace(t, F.lit(sign), F.lit(plain))
        return F.regexp_replace(t, MULTI + f"^[ \\t]*[{L.FANCY_BULLETS}]", "- ")

    # Signs beyond ASCII are looked for only in texts that hold any.
    t = let(text, lambda c: F.when(F.octet_length(c) == F.length(c), c).otherwise(fancy(c)))
    t = F.replace(t, F.lit("\t"), F.lit("  "))
    t = let(t, lambda c: F.when(c.contains(" \n") | c.endswith(" "), F.regexp_replace(c, MULTI + r"[ \t]+$", "")).otherwise(c))
    t = swap_where(t, ["  "], r"(?<=[^\n])[ \t]{2,}", " ")
    return swap_where(t, ["!!!", "???", "..."], r"([!?.])\1{2,}", "$1")


def normalize_code(text: Column) -> Column:
    t = F.replace(text, F.lit("\t"), F.lit("  "))
    t = F.regexp_replace(t, MULTI + r"[ \t]+$", "")
    return F.regexp_replace(t, r"(?U)(?<=\S)[ \t]{2,}", " ")


def normalize(text: Column, is_code: Column) -> Column:
    return let(
        text, lambda t: F.when(is_code, normalize_code(t)).otherwise(normalize_prose(t))
    )


# ------------------------------------------------------ fillers, stop words


def longest_first(items, length=len) -> list:
    return sorted(items, key=length, reverse=True)


FILLER_RULES = phrase_rules(
    (ANY_CASE + r"\b" + regex_literal(p) + r"\b", "", p) for p in longest_first(L.FILLER_PHRASES)
)


def drop_fillers(text: Column, have: Column | None = None) -> Column:
    """struct(text, n, found) without filler phrases. have: see `rule_words`."""
    return fold_rules(text, FILLER_RULES, samples=MAX_SAMPLES, have=have)


DIGITS = r"(?U)\d[./:\-]\d"


def critical_lines(text: Column) -> Column:
    """Which lines are critical, in order; NULL if none can be.

    Digits or one of the literals stand in every critical line. Lines are only searched
    for what the whole text holds, and only lines with something of it run the pattern.
    """

    def by_line(t: Column, s: Column) -> Column:
        named = lambda low: F.exists(s["named"], lambda w: low.contains(w))
        some = lambda l: (s["digits"] & l.rlike(DIGITS)) | ((F.size(s["named"]) > 0) & let(fold_case(l), named))
        critical = lambda l: some(l) & l.rlike(ANY_CASE + L.CRITICAL_LINE)
        return F.when(
            s["digits"] | (F.size(s["named"]) > 0), F.transform(lines(t), lambda l: let(strip(l), critical))
        )

    def signs(t: Column) -> Column:
        held = lambda low: F.filter(constant(L.CRITICAL_WORDS, "array<string>"), lambda w: low.contains(w))
        return F.struct(t.rlike(DIGITS).alias("digits"), let(fold_case(t), held).alias("named"))

    return let(text, lambda t: let(signs(t), lambda s: by_line(t, s)))


def each_line(text: Column, shorten: Callable[[Column], Column]) -> Column:
    """The text with all lines shortened that are not critical."""

    def by_line(t: Column, stays: Column) -> Column:
        some = F.transform(lines(t), lambda l, i: F.when(F.get(stays, i), l).otherwise(shorten(l)))
        return unlines(F.when(stays.isNull(), F.transform(lines(t), shorten)).otherwise(some))

    return let(text, lambda t: let(critical_lines(t), lambda stays: by_line(t, stays)))


STOP_MARKS = ("__PROTECTED_", "#", "//", "/*", "*", "|")
LONG_MARKS = ("__PROTECTED_", "|", "```")


def marked(line: Column, marks: tuple[str, ...]) -> Column:
    return let(strip(line), lambda s: reduce(or_, [s.startswith(m) for m in marks]))


def drop_stop_words(text: Column) -> Column:
    """Prose lines without stop words; markup and critical lines stay."""

    def shorten(line: Column) -> Column:
        kept = let(words(line), lambda ws: without_words(ws, line, L.STOP_WORDS, PUNCTUATION))
        return F.when(marked(line, STOP_MARKS), line).otherwise(F.array_join(kept, " "))

    return each_line(text, shorten)


# ----------------------------------------------- synonyms, references, style

SINGLE_SYNONYMS = {k: v for k, v in L.SYNONYMS.items() if " " not in k}
PHRASE_SYNONYMS = phrase_rules(
    (ANY_CASE + r"\b" + k + r"\b", v, k) for k, v in L.SYNONYMS.items() if " " in k
)


def synonyms(text: Column, have: Column | None = None) -> Column:
    """struct(text, n): the shorter form of every known word or phrase.

    A text without any known word is not taken apart. have: see `rule_words`.

    Single words are one lookup pass over the words. No short form is a key, and
    only a phrase can be completed by a short form, so phrases run after it.
    """

    def phrases(w: Column) -> Column:
        return let(
            fold_rules(w["text"], PHRASE_SYNONYMS),
            lambda p: F.struct(p["text"].alias("text"), (w["n"] + p["n"]).alias("n")),
        )

    known = sorted(SINGLE_SYNONYMS)
    some = F.arrays_overlap(
        words_present(text, known) if have is None else have, constant(known, "array<string>")
    )

    def swapped(t: Column) -> Column:
        same = F.struct(t.alias("text"), F.lit(0).alias("n"))
        return F.when(some, swap_words(t, SINGLE_SYNONYMS)).otherwise(same)

    return let(let(text, swapped), phrases)


URL = r"(?U)https?://\S+"
TRACKING = r"(?U)[?&](?:utm_\w+|ref|source|campaign|medium|content|fbclid|gclid)=[^&\s]*"
EMAIL = r"(?U)\b[\w.\-]+@[\w.\-]+\.\w+\b"
# Possessive repeats of a group are matched in a loop; others recurse per segment.
WINDOWS_PATH = r"(?U)[A-Z]:\\(?:[\w.\-]++\\){2,}+"
UNIX_PATH = r"(?U)(?:/[\w.\-]++){3,}+"


def shorten_refs(text: Column) -> Column:
    """struct(text, urls, paths): URLs and addresses as tags, paths cut short."""

    def urls(t: Column) -> Column:
        n = F.when(t.contains("://"), count_matches(t, URL)).otherwise(F.lit(0))
        return let(
            F.struct(n.alias("n"), t.alias("t")),
            lambda s: let(
                F.when(s["n"] > 0, F.regexp_replace(s["t"], URL, "[URL]")).otherwise(s["t"]),
                lambda u: rest(u, s["n"]),
            ),
        )

    def rest(t: Column, n: Column) -> Column:
        clean = F.when(t.contains("="), F.regexp_replace(t, TRACKING, "")).otherwise(t)
        mailed = let(
            clean,
            lambda c: F.when(c.contains("@"), F.regexp_replace(c, EMAIL, "[EMAIL]")).otherwise(c),
        )
        return let(mailed, lambda m: paths(m, n))

    def paths(t: Column, n: Column) -> Column:
        found = F.when(
            t.contains("/") | t.contains("\\"),
            count_matches(t, WINDOWS_PATH) + count_matches(t, UNIX_PATH),
        ).otherwise(F.lit(0))
        last_two = lambda h: F.translate(F.substring_index(h, "\\", -3), "\\", "/")
        drive = replace_matches(
            t,
            WINDOWS_PATH,
            lambda h, i, s: F.concat(F.lit(".../"), F.regexp_replace(last_two(h), "/$", "")),
        )
        short = replace_matches(
            drive, UNIX_PATH, lambda h, i, s: F.concat(F.lit(".../"), F.substring_index(h, "/", -2))
        )
        return let(
            found,
            lambda p: F.struct(
                F.when(p > 0, short).otherwise(t).alias("text"),
                n.alias("urls"),
                p.alias("paths"),
            ),
        )

    return let(text, urls)


def rule_phrase(pattern: str) -> str:
    """The longest literal every match of a wordy pattern contains."""
    parts = re.split(r"\\b|\^|\(\?:[^)]*\)\??|\.\{\d+,\d+\}", pattern)
    return max((p for p in parts if not set(p) & set("?*+[]{}\\|")), key=len).lower()


VERBOSE_RULES = phrase_rules(
    (MULTI_ANY_CASE + p, put, rule_phrase(p))
    for p, put in longest_first(L.VERBOSE_PATTERNS, lambda rule: len(rule[0]))
)


#: Words that the rules of all phases look for, and those of them that the phases
#: before `telegraphic` can bring into a text.
RULE_WORDS = words_of(FILLER_RULES) | set(SINGLE_SYNONYMS) | words_of(VERBOSE_RULES)
MADE_WORDS = RULE_WORDS & {
    w for put in [*L.SYNONYMS.values(), "[URL]", "[EMAIL]"] for w in re.findall("[a-z0-9_]+", put.lower())
}


def rule_words(text: Column) -> Column:
    """The words of the rules that a text holds or that its rewrites can bring in.

    One pass over the words of a text serves all phases: fillers and stop words only
    go, and what synonyms and tags put in is added here.
    """
    made = constant(sorted(MADE_WORDS), "array<string>")
    return F.array_union(words_present(text, RULE_WORDS), made)


def telegraphic(text: Column, have: Column | None = None) -> Column:
    """struct(text, n): compact wording, fewer words on long lines. have: see `rule_words`."""

    def shorten(line: Column) -> Column:
        plain = lambda ws: without_words(ws, line, L.EXTRA_STOP_WORDS, PUNCTUATION, min_length=2)
        cut = let(
            words(line),
            lambda ws: F.when(
                F.size(ws) > LONG_LINE_WORDS, F.array_join(plain(ws), " ")
            ).otherwise(line),
        )
        return F.when(marked(line, LONG_MARKS), line).otherwise(cut)

    def finish(r: Column) -> Column:
        t = swap_where(each_line(r["text"], shorten), ["  "], " {2,}", " ")
        edge = lambda c: c.startswith(" ") | c.contains("\n ") | c.contains(" \n") | c.endswith(" ")
        t = let(t, lambda c: F.when(edge(c), F.regexp_replace(c, MULTI + "^ +| +$", "")).otherwise(c))
        return F.struct(t.alias("text"), r["n"].alias("n"))

    return let(fold_rules(text, VERBOSE_RULES, have=have), finish)


# --------------------------------------------------------------- structure

RULE_OFF = MULTI + r"^[ \t]*[-*_]{3,}[ \t]*$"
INLINE = r"`([^`\n]+)`"
HEADER = MULTI + r"^#{1,6}\s+(.*\S)[^\S\n]*$"
SEPARATOR_ROW = r"^\|?[ \t]*[-:]+[-| :]*$"


def is_table_line(line: Column) -> Column:
    return let(
        strip(line),
        lambda s: (s.startswith("|") & s.endswith("|")) | s.rlike(SEPARATOR_ROW),
    )


def compact_row(line: Column) -> Column:
    cells = F.array_join(F.transform(F.split(line, r"\|", -1), strip), "|")

    def edged(c: Column) -> Column:
        left = F.when(c.startswith("|"), c).otherwise(F.concat(F.lit("|"), c))
        return let(
            left,
            lambda l: let(
                F.when(l.endswith("|"), l).otherwise(F.concat(l, F.lit("|"))),
                lambda e: F.when(
                    e.rlike(r"^\|{2,}$"), F.lit("||")
                ).otherwise(F.regexp_replace(e, r"\|{2,}", "|")),
            ),
        )

    return F.when(line.contains("|"), let(cells, edged)).otherwise(line)


def compact_tables(text: Column) -> Column:
    """struct(text, n): separator rows out, cells without padding."""

    def compact(t: Column) -> Column:
        def rows(seg: Column) -> Column:
            body = lambda block: let(
                F.struct(block.endswith("\n").alias("open"), block.alias("b")),
                lambda s: let(
                    F.transform(
                        F.filter(
                            lines(F.when(s["open"], F.left(s["b"], F.length(s["b"]) - 1)).otherwise(s["b"])),
                            lambda l: ~l.rlike(SEPARATOR_ROW),
                        ),
                        compact_row,
                    ),
                    lambda rs: F.when(F.size(rs) == 0, F.lit("")).otherwise(
                        F.concat(unlines(rs), F.when(s["open"], F.lit("\n")).otherwise(F.lit("")))
                    ),
                ),
            )
            joined = join_segments(seg["gaps"], F.transform(seg["hits"], body))
            # a dropped last block takes the line end before it along
            tail_gone = (F.element_at(seg["gaps"], -1) == "") & ~t.endswith("\n")
            fixed = let(
                joined,
                lambda j: F.when(tail_gone & j.endswith("\n"), F.left(j, F.length(j) - 1)).otherwise(j),
            )
            return F.struct(
                F.when(F.size(seg["hits"]) == 0, t).otherwise(fixed).alias("text"),
                F.size(seg["hits"]).alias("n"),
            )

        return let(line_segments(t, is_table_line), rows)

    nothing = lambda t: F.struct(t.alias("text"), F.lit(0).alias("n"))
    return let(
        text,
        lambda t: F.when(
            t.contains("|") | t.rlike(MULTI + r"^\s*[-:][-| :]*\s*$"), compact(t)
        ).otherwise(nothing(t)),
    )


def structural(text: Column) -> Column:
    """struct(text, done): markup reduced to its content, done = counts."""

    def rules_off(t: Column) -> Column:
        return let(
            F.struct(
                swap_where(t, ["-", "*", "_"], RULE_OFF, "").alias("t"),
                F.when(t.contains("-") | t.contains("*") | t.contains("_"), count_matches(t, RULE_OFF))
                .otherwise(F.lit(0))
                .alias("rules"),
            ),
            lambda s: inline(s),
        )

    def inline(s: Column) -> Column:
        t = swap_where(s["t"], ["`"], INLINE, "$1")
        t = swap_where(t, ["]("], r"\[([^\]]+)\]\([^\)]+\)", "$1")
        t = swap_where(t, ["**"], r"(?d)\*\*(.+?)\*\*", "$1")
        t = swap_where(t, ["*"], r"(?<!\*)\*([^*]+?)\*(?!\*)", "$1")
        refs = F.when(s["t"].contains("`"), count_matches(s["t"], INLINE)).otherwise(F.lit(0))
        return let(F.struct(t.alias("t"), s["rules"].alias("rules"), refs.alias("refs")), headers)

    def headers(s: Column) -> Column:
        t = swap_where(s["t"], ["#"], HEADER, "$1:")
        t = swap_where(t, ["-", "*", "+"], MULTI + r"^[ \t]*[-*+][ \t]+", "")
        titles = F.when(s["t"].contains("#"), count_matches(s["t"], HEADER)).otherwise(F.lit(0))
        done = lambda tables: strings(
            counted("hr_removal", s["rules"]),
            counted("inline_code_strip", s["refs"]),
            counted("header_compact", titles),
            F.lit("list_compact"),
            counted("table_compact", tables),
        )
        return let(
            compact_tables(t),
            lambda c: F.struct(c["text"].alias("text"), done(c["n"]).alias("done")),
        )

    return let(text, rules_off)


# ------------------------------------------------------------ repeated lines


def dedup_lines(text: Column) -> Column:
    """struct(text, done, removed): no line repeats one of the last 3 kept."""

    def step(carry: Column, line: Column) -> Column:
        def decide(s: Column) -> Column:
            state = lambda window, blank, removed: F.struct(
                window.alias("window"), blank.alias("blank"), removed.alias("removed")
            )
            sample = F.concat(F.lit("Dedup: '"), F.left(s, F.lit(50)), F.lit("...'"))
            longer = F.concat(carry["window"], F.array(s))
            pushed = F.when(
                F.size(longer) > DEDUP_WINDOW, F.slice(longer, 2, DEDUP_WINDOW)
            ).otherwise(longer)
            noted = F.when(
                F.size(carry["removed"]) < MAX_SAMPLES, F.concat(carry["removed"], F.array(sample))
            ).otherwise(carry["removed"])
            out = lambda keep, c: F.struct(keep.alias("keep"), c.alias("carry"))
            return (
                F.when(s == "", out(~carry["blank"], state(carry["window"], F.lit(True), carry["removed"])))
                .when(
                    F.array_contains(carry["window"], s),
                    out(F.lit(False), state(carry["window"], carry["blank"], noted)),
                )
                .otherwise(out(F.lit(True), state(pushed, F.lit(False), carry["removed"])))
            )

        return let(strip(line), decide)

    empty = F.array().cast("array<string>")
    zero = F.struct(empty.alias("window"), F.lit(False).alias("blank"), empty.alias("removed"))
    result = lambda t, done, removed: F.struct(
        t.alias("text"), done.alias("done"), removed.alias("removed")
    )

    def repeats(ls: Column) -> Column:
        full = F.filter(F.transform(ls, strip), lambda s: s != "")
        twice = let(full, lambda f: F.size(F.array_distinct(f)) < F.size(f))
        return twice | unlines(ls).rlike(r"(?U)(?:^|\n)\s*\n\s*(?:\n|$)")

    def fold(t: Column) -> Column:
        return let(
            lines(t),
            lambda ls: F.when(F.size(ls) <= DEDUP_MIN_LINES, result(t, empty, empty))
            .when(~repeats(ls), result(t, strings(F.lit("dedup")), empty))
            .otherwise(
                let(
                    fold_lines(ls, zero, step),
                    lambda r: result(
                        unlines(r["kept"]), strings(F.lit("dedup")), r["carry"]["removed"]
                    ),
                )
            ),
        )

    return let(text, fold)


def finalize(text: Column, is_code: Column) -> Column:
    def tidy(t: Column) -> Column:
        spaced = F.when(is_code, F.regexp_replace(t, r"(?U)(?<=\S) {2,}", " ")).otherwise(
            swap_where(t, ["  ", "\t"], r"[ \t]{2,}", " ")
        )
        return strip(swap_where(spaced, ["\n\n", "\n ", "\n\t"], r"\n[ \t]*\n+", "\n"))

    return let(text, tidy)


# ------------------------------------------------------------- whole rewrite


@lru_cache(maxsize=None)
def _phases(application: str) -> tuple[dict[str, Column], Column]:
    """The phase columns, and the result struct, over `_mf_red` and `_mf_out`.

    They do not depend on the input columns, and building them takes some
    thousand driver calls, so a session builds them once.
    """
    f = F.col
    no_strings = F.array().cast("array<string>")
    is_code = f("_mf_kind").startswith("code_")
    columns = {
        "_mf_n": count_tokens(f("_mf_red")),
        "_mf_safe": phase(protect_blocks, f("_mf_red")),
        "_mf_kind": phase(detect_type, f("_mf_safe.text")),
        "_mf_prose": F.when(~is_code, phase(normalize_prose, f("_mf_safe.text"))),
        "_mf_have": phase(rule_words, f("_mf_prose")),
        "_mf_fill": phase(lambda t: drop_fillers(t, f("_mf_have")), f("_mf_prose")),
        "_mf_stop": phase(drop_stop_words, f("_mf_fill.text")),
        "_mf_syn": phase(lambda t: synonyms(t, f("_mf_have")), f("_mf_stop")),
        "_mf_refs": phase(shorten_refs, f("_mf_syn.text")),
        "_mf_tele": phase(lambda t: telegraphic(t, f("_mf_have")), f("_mf_refs.text")),
        "_mf_form": phase(structural, f("_mf_tele.text")),
        "_mf_body": F.when(is_code, normalize_code(f("_mf_safe.text"))).otherwise(f("_mf_form.text")),
        "_mf_uniq": phase(dedup_lines, f("_mf_body")),
        "_mf_tidy": phase(lambda t: finalize(t, is_code), f("_mf_uniq.text")),
        "_mf_out": phase(lambda t: restore_blocks(t, f("_mf_safe.blocks")), f("_mf_tidy")),
    }
    prose_done = F.concat(
        strings(
            F.lit("normalize"),
            F.lit("filler_trim"),
            counted("synonyms", f("_mf_syn.n")),
            counted("urls", f("_mf_refs.urls")),
            counted("paths", f("_mf_refs.paths")),
            counted("telegraphic", f("_mf_tele.n")),
            F.lit("extra_stop"),
        ),
        f("_mf_form.done"),
    )
    code_done = strings(F.lit("normalize"), F.lit("code_safe_mode"))
    done = F.concat(
        F.array(F.concat(F.lit("detect:"), f("_mf_kind"))),
        F.when(is_code, code_done).otherwise(prose_done),
        f("_mf_uniq.done"),
    )
    fillers = F.transform(
        f("_mf_fill.found"), lambda x: F.concat(F.lit("Filler: '"), x, F.lit("'"))
    )
    removed = F.concat(F.when(is_code, no_strings).otherwise(fillers), f("_mf_uniq.removed"))
    empty = f("_mf_n") == 0
    zero = F.lit(0).cast("bigint")
    result = F.struct(
        F.when(empty, f("_mf_red")).otherwise(f("_mf_out")).alias("text"),
        f("_mf_n").alias("original_tokens"),
        F.when(empty, zero).otherwise(f("_mf_new")).alias("compressed_tokens"),
        F.when(empty, F.lit(0.0))
        .otherwise(percent(f("_mf_n") - f("_mf_new"), f("_mf_n")))
        .alias("saved_percent"),
        F.when(empty, F.lit("empty")).otherwise(f("_mf_kind")).alias("content_type"),
        F.when(empty, no_strings).otherwise(done).alias("techniques_applied"),
        F.when(empty, no_strings)
        .otherwise(F.slice(removed, 1, MAX_SAMPLES))
        .alias("what_was_removed"),
    )
    return columns, result


@shielded("_mf_")
def minify(
    df: DataFrame,
    text: str = "text",
    out: str = "compressed",
    wrap_tag: str | None = None,
    clean: Column | None = None,
) -> DataFrame:
    """Redact, protect code, compress by type: adds one struct of text and stats.

    `clean` tells the rows whose text redaction is known to leave as it is.

    One narrow projection per phase; every phase result is a column of its own,
    which the optimizer computes once. Code skips the prose phases as NULL.
    """
    columns, result = _phases(df.sparkSession.sparkContext.applicationId)
    source = text_of(text)
    red = redact(source) if clean is None else F.when(clean, source).otherwise(redact(source))
    d = df.withColumn("_mf_red", red)
    for name, column in columns.items():
        d = d.withColumn(name, column)
    if wrap_tag:
        d = d.withColumn(
            "_mf_out",
            F.concat(F.lit(f"<{wrap_tag}>\n"), F.col("_mf_out"), F.lit(f"\n</{wrap_tag}>")),
        )
    d = d.withColumn("_mf_new", count_tokens(F.col("_mf_out")))
    return d.select(*[F.col(f"`{c}`") for c in df.columns], result.alias(out))


def compression_rollup(df: DataFrame, group: str = "source", text: str = "text") -> DataFrame:
    """Token totals before and after, per group and for all groups together.

    Only the counts leave the map side; the total (is_total, no group) sums the
    group rows. NULL is a group of its own.
    """
    counts = minify(df.select(group, text), text).select(
        group,
        count_tokens(text_of(text)).alias("raw"),
        count_tokens(F.col("compressed.text")).alias("new"),
    )
    sums = [F.sum("raw").alias("raw"), F.sum("new").alias("new")]
    per_group = counts.groupBy(group).agg(F.count("*").alias("docs"), *sums)
    return (
        with_totals(per_group, group, [], F.sum("docs").alias("docs"), *sums)
        .select(group, "is_total", "docs", token_stats(F.col("raw"), F.col("new")).alias("s"))
        .select(
            group, "is_total", "docs", "s.original_tokens", "s.compressed_tokens", "s.tokens_saved", "s.saved_percent"
        )
    )


def boilerplate_lines(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 2
) -> DataFrame:
    """Lines that several documents share: occurrences and document frequency.

    Lines are counted inside each document, by the runs of its sorted lines, so
    there is one shuffle, of one row per distinct line and document at most,
    which the map side combines further.
    """

    def runs(ls: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ls) - 1),
            lambda i: (i == 0) | (F.get(ls, i) != F.get(ls, i - 1)),
        )
        run = lambda at, k, i: F.struct(
            F.get(ls, i).alias("line"), (F.coalesce(F.get(at, k + 1), F.size(ls)) - i).alias("n")
        )
        return F.when(
            F.size(ls) > 0, let(starts, lambda at: F.transform(at, lambda i, k: run(at, k, i)))
        )

    trimmed = F.filter(F.transform(lines(text_of(text)), strip), lambda l: l != "")
    return (
        unfold(df, [key], let(F.sort_array(trimmed), runs), "x")
        .groupBy(F.col("x.line").alias("line"))
        .agg(F.sum("x.n").alias("occurrences"), F.count("*").alias("documents"))
        .where(F.col("documents") >= min_docs)
    )


def repair_ocr_text(text: Column) -> Column:
    """Recognised text without blank lines, look-alike zeros and a lead artefact."""
    kept = F.filter(F.transform(lines(text_of(text)), strip), lambda l: l != "")
    t = F.translate(unlines(kept), "øØ", "00")
    t = F.regexp_replace(t, r"(?U)(?<=\d)e(?=\d)", "0")
    return F.regexp_replace(t, "(?U)^[•·\\-|*>]\\s*", "")
