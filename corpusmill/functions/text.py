"""Column helpers shared by all text operators.

Everything here maps a string Column to a Column and stays on the JVM side, so
operators compose into one projection per document without a shuffle. A function
that needs its argument more than once binds it with `let`, so that composing
functions never evaluates an inner one twice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce, wraps
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode white space, as str.split and str.strip understand it.
WHITE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITE = r"\s\x1c-\x1f"  # inside a class, under (?U)
WORD_GAP = f"(?U)[{WHITE}]+"
NEWLINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
OTHER_NEWLINES = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# Regex flags: (?d) only \n ends a line, (?m) anchors per line,
# (?i)(?U) ignore case and use Unicode classes.
MULTI = "(?md)"
MULTI_ANY_CASE = "(?mdiU)"
ANY_CASE = "(?diU)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it any number of times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def phase(body: Callable[[Column], Column], value: Column) -> Column:
    """`body` of a column that may be NULL, for which the phase is skipped.

    Naming the column twice also keeps the phase a projection of its own: the
    optimizer does not inline an expensive column that is used twice, and so a
    chain of phases stays flat and quick to plan.
    """
    return F.when(value.isNotNull(), body(value))


def unfold(df: DataFrame, keep: list, items: Column, *names: str) -> DataFrame:
    """One row per array element (with its position, if two names are given).

    An outer explode with a filter behind it: a plain one would make the
    optimizer test the array in a filter below and so compute it twice.
    """
    explode = F.posexplode_outer if len(names) == 2 else F.explode_outer
    return df.select(*keep, explode(items).alias(*names)).where(F.col(names[-1]).isNotNull())


def shielded(*prefixes: str):
    """Lets an operator use helper columns that begin with the prefixes.

    Columns of the caller that begin alike are given other names while it runs, in
    the frames and where arguments name them, and get their own names back after.
    """

    def clashing(df: DataFrame) -> dict[str, str]:
        taken = {c.lower() for c in df.columns}
        found = {}
        for c in df.columns:
            if c.lower().startswith(prefixes):
                new = f"own{c}"
                while new.lower() in taken:
                    new += "_"
                taken.add(new.lower())
                found[c] = new
        return found

    def wrap(operator):
        @wraps(operator)
        def run(df: DataFrame, *args, **how):
            names = clashing(df)
            if not names:
                return operator(df, *args, **how)
            there = lambda a: (
                names.get(a, a) if isinstance(a, str) else [names.get(x, x) for x in a] if isinstance(a, list) else a
            )
            out = operator(df.withColumnsRenamed(names), *map(there, args), **{k: there(a) for k, a in how.items()})
            return out.withColumnsRenamed({new: c for c, new in names.items()})

        return run

    return wrap


def with_totals(per_group: DataFrame, group: str, keys: list[str], *sums: Column) -> DataFrame:
    """Sums per group and keys, and over all groups: is_total, with a NULL group."""
    every = F.array(
        F.struct(F.col(group).alias("of"), F.lit(False).alias("total")),
        F.struct(F.lit(None).alias("of"), F.lit(True).alias("total")),
    )
    rows = per_group.withColumn("_g", F.explode(every)).drop(group)
    rows = rows.groupBy(F.col("_g.of").alias(group), F.col("_g.total").alias("is_total"), *keys)
    return rows.agg(*sums)


def constant(value, schema: str) -> Column:
    """A literal table; the optimizer folds it to one constant."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def sql_text(literal: str) -> str:
    return "'" + literal.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_list(literals: Iterable[str]) -> str:
    return ", ".join(sql_text(x) for x in literals)


def text_of(col: Column | str) -> Column:
    """NULL and '' take the same branch everywhere."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE_CHARS))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(WHITE_CHARS))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def words(col: Column) -> Column:
    return F.filter(F.split(col, WORD_GAP), lambda w: w != "")


def word_count(col: Column) -> Column:
    return let(
        strip(col),
        lambda s: F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, WORD_GAP))),
    ).cast("bigint")


def lines(col: Column) -> Column:
    return F.split(col, "\n", -1)


def holds_any(col: Column, literals: Iterable[str]) -> Column:
    """Does the text hold one of the literals?"""
    return reduce(or_, [col.contains(x) for x in literals])


def split_lines(col: Column) -> Column:
    """Lines without their ends; a final line end opens no further line.

    Only texts with other line ends than \\n need the pattern, which costs more.
    """
    parts = lambda t: F.when(holds_any(t, OTHER_NEWLINES), F.split(t, NEWLINE, -1)).otherwise(lines(t))
    return let(
        let(col, parts),
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts),
    )


def unlines(col: Column) -> Column:
    return F.array_join(col, "\n")


def round_to(col: Column, digits: int) -> Column:
    """Half-up rounding of a double, by the same arithmetic in any engine."""
    scale = float(10**digits)
    return F.floor(col * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """part / whole in percent, 0 when there is no whole."""
    ratio = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * F.lit(100.0)
    return F.coalesce(round_to(ratio, digits), F.lit(0.0))


def replacement(literal: str) -> str:
    """Escape a literal for the replacement side of regexp_replace."""
    return literal.replace("\\", "\\\\").replace("$", "\\$")


def regex_literal(literal: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}-/&~#" else c for c in literal)


def count_matches(col: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)))


# --------------------------------------------------------------- segments


def segments(col: Column, pattern: str) -> Column:
    """struct(gaps, hits) with text = gap 0, hit 0, gap 1, ..., gap n."""
    return let(
        col,
        lambda t: F.struct(
            F.split(t, pattern, -1).alias("gaps"),
            F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("hits"),
        ),
    )


def line_segments(
    col: Column,
    member: Callable[[Column], Column],
    min_lines: int = 1,
    needs_newline: bool = False,
) -> Column:
    """Like `segments`, where a hit is a maximal run of lines with `member`.

    Works on the line array instead of one long regex, so a block of any number
    of lines costs linear time and no regex recursion. `needs_newline` leaves a
    last line without line end outside of any run. Hits keep their line ends.
    """

    def from_lines(ls: Column) -> Column:
        last = F.size(ls) - 1
        flags = F.transform(
            ls, lambda l, i: member(l) & (i < last) if needs_newline else member(l)
        )
        return let(F.struct(ls.alias("ls"), flags.alias("on")), from_flags)

    def from_flags(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(s["on"]) - 1)
        previous = lambda i: F.coalesce(F.get(s["on"], i - 1), F.lit(False))
        following = lambda i: F.coalesce(F.get(s["on"], i + 1), F.lit(False))
        first = F.filter(at, lambda i: F.get(s["on"], i) & ~previous(i))
        final = F.filter(at, lambda i: F.get(s["on"], i) & ~following(i))
        runs = F.filter(
            F.zip_with(first, final, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            lambda r: r["b"] - r["a"] + 1 >= min_lines,
        )
        return let(F.struct(s["ls"].alias("ls"), runs.alias("runs")), cut)

    def cut(s: Column) -> Column:
        n = F.size(s["ls"])

        def piece(start: Column, end: Column) -> Column:
            body = unlines(F.slice(s["ls"], start + 1, F.greatest(end - start, F.lit(0))))
            return F.when(end <= start, F.lit("")).otherwise(
                F.concat(body, F.when(end < n, F.lit("\n")).otherwise(F.lit("")))
            )

        hits = F.transform(s["runs"], lambda r: piece(r["a"], r["b"] + 1))
        gaps = F.transform(
            F.concat(s["runs"], F.array(F.struct(n.alias("a"), n.alias("b")))),
            lambda r, k: piece(F.coalesce(F.get(s["runs"], k - 1)["b"] + 1, F.lit(0)), r["a"]),
        )
        return F.struct(gaps.alias("gaps"), hits.alias("hits"))

    return let(lines(col), from_lines)


def join_segments(gaps: Column, hits: Column) -> Column:
    return F.array_join(
        F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), ""
    )


def look_behind(seg: Column, i: Column, chars: int, min_hit: int) -> Column:
    """The `chars` characters of the original text before hit `i`.

    A hit has at least `min_hit` characters, so a fixed number of earlier
    pieces always covers the window.
    """
    parts = []
    for back in range(-(-chars // min_hit), 0, -1):
        parts.append(F.coalesce(F.get(seg["gaps"], i - back), F.lit("")))
        parts.append(F.coalesce(F.get(seg["hits"], i - back), F.lit("")))
    parts.append(F.get(seg["gaps"], i))
    return F.right(F.concat(*parts), F.lit(chars))


def replace_matches(
    col: Column,
    pattern: str,
    decide: Callable[[Column, Column, Column], Column],
    sign: str | None = None,
) -> Column:
    """Replace every match by decide(hit, index, segments).

    sign: a quicker pattern, of which every text with a match holds one.
    """

    def rebuild(seg: Column) -> Column:
        return join_segments(
            seg["gaps"], F.transform(seg["hits"], lambda h, i: decide(h, i, seg))
        )

    def found(t: Column) -> Column:
        return t.rlike(pattern) if sign is None else t.rlike(sign) & t.rlike(pattern)

    return let(col, lambda t: F.when(found(t), let(segments(t, pattern), rebuild)).otherwise(t))


def swap_where(col: Column, needs: Iterable[str], pattern: str, put: str) -> Column:
    """regexp_replace for texts that hold one of the literals that every match needs.

    Looking for a literal costs a tenth of running the pattern.
    """
    needs = list(needs)
    return let(
        col, lambda t: F.when(holds_any(t, needs), F.regexp_replace(t, pattern, put)).otherwise(t)
    )


def fill_marks(col: Column, before: str, after: str, values: Column) -> Column:
    """Marks `before`, number, `after` replaced by the value of that number, in one pass.

    A number without a value stays as it is.
    """
    mark = regex_literal(before) + "([0-9]{1,9})" + regex_literal(after)

    def value(hit: Column, known: Column) -> Column:
        n = F.regexp_extract(hit, mark, 1).cast("int")
        plain = F.concat(F.lit(before), n.cast("string"), F.lit(after)) == hit
        return F.coalesce(F.when(plain, F.get(known, n)), hit)

    return let(values, lambda known: replace_matches(col, mark, lambda h, i, s: value(h, known)))


# ------------------------------------------------------------- rule folds


MANY_RULES = 10  # from here on a pass over the words pays


@dataclass(frozen=True)
class Rule:
    """One rewrite with two cheap necessary conditions, both in lower case.

    `phrase` is a literal that every match contains, `words` ASCII word fragments
    (maximal runs of a-z, 0-9, _) one of which it contains; '' or none stands for no
    condition.
    """

    pattern: str
    replacement: str
    phrase: str = ""
    words: tuple[str, ...] = ()


def fold_case(col: Column) -> Column:
    """Lower case in which every case-insensitive match shows its literals."""
    odd = lambda c: c.contains("\u0130") | c.contains("\u017f") | c.contains("\u212a")
    plain = lambda c: F.when(odd(c), F.translate(c, "\u0130\u017f\u212a", "isk")).otherwise(c)
    return let(col, lambda c: F.lower(plain(c)))


def phrase_rules(items: Iterable[tuple[str, str, str]]) -> list[Rule]:
    """Rules from (pattern, replacement, phrase) with the longest usable word.

    A word that some replacement could bring into the text is not usable, since
    the words are looked up once, before the first rewrite. Where the phrase has
    none, a choice between words in the pattern is taken, the one of longest words.
    """
    items = list(items)
    made = {w for _, put, _ in items for w in re.findall("[a-z0-9_]+", put.lower())}

    def longest(text: str) -> str:
        return max((w for w in re.findall("[a-z0-9_]+", text.lower()) if w not in made), key=len, default="")

    def choice(pattern: str) -> tuple[str, ...]:
        """Only groups that stand between blanks or line starts, so of whole words."""
        groups = re.findall(r"(?:^| |\?\)?)\(\?:([\w |]+)\)(?= )", pattern)
        options = [tuple(longest(x) for x in g.split("|")) for g in groups if not g.endswith(" ")]
        return max((o for o in options if all(o)), key=lambda o: min(map(len, o)), default=())

    rules = []
    for pattern, put, phrase in items:
        word = longest(phrase)
        rules.append(Rule(pattern, put, phrase, (word,) if word else choice(pattern)))
    return rules


def words_of(rules: Iterable[Rule]) -> set[str]:
    return {w for r in rules for w in r.words}


def words_present(col: Column, keywords: Iterable[str]) -> Column:
    """Which of some ASCII words a text holds, in one hash pass over its words."""
    table = constant(sorted(set(keywords)), "array<string>")
    return F.array_intersect(F.split(fold_case(col), r"\W+"), table)


def fold_rules(
    col: Column, rules: Iterable[Rule], samples: int = 0, have: Column | None = None
) -> Column:
    """Apply ordered rewrites; struct(text, n, found).

    One hash pass over the words of the text selects the rules that can match
    at all; of those, a rule runs its regex only if its phrase occurs. `found`
    holds the first match of the first `samples` rules that matched. have: the words
    of the rules that the text may hold, where they are known already.
    """
    rules = list(rules)
    table = constant(
        [
            {"phrase": r.phrase, "words": list(r.words), "pattern": r.pattern, "put": replacement(r.replacement)}
            for r in rules
        ],
        "array<struct<phrase:string,words:array<string>,pattern:string,put:string>>",
    )
    keywords = constant(sorted(words_of(rules)), "array<string>")

    def state(text: Column, n: Column, found: Column) -> Column:
        return let(
            text,
            lambda t: F.struct(
                t.alias("text"), fold_case(t).alias("low"), n.alias("n"), found.alias("found")
            ),
        )

    def apply(acc: Column, rule: Column) -> Column:
        def rewrite(hits: Column) -> Column:
            found = acc["found"]
            if samples:
                found = F.when(
                    F.size(found) < samples, F.concat(found, F.slice(hits, 1, 1))
                ).otherwise(found)
            changed = state(
                F.regexp_replace(acc["text"], rule["pattern"], rule["put"]),
                acc["n"] + F.size(hits),
                found,
            )
            return F.when(F.size(hits) == 0, acc).otherwise(changed)

        return F.when(
            acc["low"].contains(rule["phrase"]),
            let(F.regexp_extract_all(acc["text"], rule["pattern"], F.lit(0)), rewrite),
        ).otherwise(acc)

    def selected(start: Column) -> Column:
        if not any(r.words for r in rules) or len(rules) < MANY_RULES:
            return table
        always = constant([k for k, r in enumerate(rules) if not r.words], "array<int>")
        present = F.array_intersect(F.split(start["low"], r"\W+") if have is None else have, keywords)
        wanted = lambda found: F.filter(
            table, lambda r: (F.size(r["words"]) == 0) | F.arrays_overlap(found, r["words"])
        )
        fixed = F.transform(always, lambda k: F.get(table, k))
        return let(present, lambda found: F.when(F.size(found) == 0, fixed).otherwise(wanted(found)))

    return let(
        state(col, F.lit(0), F.array().cast("array<string>")),
        lambda start: F.aggregate(
            selected(start),
            start,
            apply,
            lambda acc: F.struct(
                acc["text"].alias("text"), acc["n"].alias("n"), acc["found"].alias("found")
            ),
        ),
    )


def swap_words(col: Column, table: dict[str, str]) -> Column:
    """Replace whole words by a lookup in one pass; struct(text, n)."""
    shortest = min(len(word) for word in table)
    known = f"length(p) >= {shortest} AND lower(p) IN ({sql_list(table)})"
    shorter = "map(" + ", ".join(sql_text(x) for pair in table.items() for x in pair) + ")"
    swapped = F.expr(f"p -> CASE WHEN {known} THEN element_at({shorter}, lower(p)) ELSE p END")

    def swap(pieces: Column) -> Column:
        return F.array_join(F.call_function("transform", pieces, swapped), "")

    def count(t: Column) -> Column:
        return let(
            F.split(t, r"(?U)\b", -1),
            lambda pieces: let(
                F.size(F.call_function("filter", pieces, F.expr(f"p -> {known}"))),
                lambda n: F.struct(
                    F.when(n == 0, t).otherwise(swap(pieces)).alias("text"), n.alias("n")
                ),
            ),
        )

    return let(col, count)


def without_words(
    items: Column, line: Column, stop: list[str], punctuation: str, min_length: int = 1
) -> Column:
    """Of the words (items) of a line those whose lower form without punctuation is no stop word.

    Words shorter than `min_length` always stay. Where punctuation only ends words,
    as in most lines, it is cut off the end, which is quicker than looking at all signs.
    """

    def kept(bare: str) -> Column:
        rule = f"w -> lower({bare}) NOT IN ({sql_list(stop)}) OR length(w) < {min_length}"
        return F.call_function("filter", items, F.expr(rule))

    marks = regex_literal(punctuation)
    inside = line.rlike(rf"[{marks}][^\s{marks}]")
    signs = sql_text(punctuation)
    anywhere, at_end = f"translate(w, {signs}, '')", f"trim(TRAILING {signs} FROM w)"
    return F.when(inside, kept(anywhere)).otherwise(kept(at_end))


def fold_lines(
    items: Column, zero: Column, step: Callable[[Column, Column], Column], block: int = 256
) -> Column:
    """Ordered fold that keeps some lines; `step` returns struct(keep, carry).

    The fold runs block by block, so the kept list is appended once per block
    and a text of very many lines stays cheap.
    """

    def in_block(acc: Column, part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(F.array().cast("array<string>").alias("kept"), acc["carry"].alias("carry")),
            lambda a, line: let(
                step(a["carry"], line),
                lambda r: F.struct(
                    F.when(r["keep"], F.concat(a["kept"], F.array(line)))
                    .otherwise(a["kept"])
                    .alias("kept"),
                    r["carry"].alias("carry"),
                ),
            ),
            lambda a: F.struct(
                F.concat(acc["kept"], a["kept"]).alias("kept"), a["carry"].alias("carry")
            ),
        )

    def blocks(ls: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(ls), F.lit(block))
        return F.transform(starts, lambda s: F.slice(ls, s, F.lit(block)))

    return F.aggregate(
        let(items, blocks),
        F.struct(F.array().cast("array<string>").alias("kept"), zero.alias("carry")),
        in_block,
    )


def fold_blocks(
    items: Column, zero: Column, step: Callable[[Column, Column], Column], none: Column, block: int = 256
) -> Column:
    """Ordered fold with outputs; `step` returns struct(out, carry), out an array.

    All outputs in order; `none` is an empty array of their type. Like `fold_lines`
    it appends to the whole once per block.
    """

    def in_block(acc: Column, part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(none.alias("out"), acc["carry"].alias("carry")),
            lambda a, item: let(
                step(a["carry"], item),
                lambda r: F.struct(F.concat(a["out"], r["out"]).alias("out"), r["carry"].alias("carry")),
            ),
            lambda a: F.struct(F.concat(acc["out"], a["out"]).alias("out"), a["carry"].alias("carry")),
        )

    def blocks(xs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(block))
        return F.transform(starts, lambda s: F.slice(xs, s, F.lit(block)))

    start = F.struct(none.alias("out"), zero.alias("carry"))
    return F.aggregate(let(items, blocks), start, in_block)["out"]
