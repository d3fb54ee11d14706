"""Source divergence audit over the terms that an iceberg prefix refinement keeps.

A language keeps the terms that at least `least` of its documents hold. They are
found level by level: a level counts, for every byte prefix of its width, the
documents of a language that hold a term with that prefix, and discards prefixes
below the threshold. Only what extends a prefix that stood is counted at the next,
twice as wide level. A term that ends within a level is complete; the levels end
when all that stands is complete. A document counts once for a prefix, however many
of its terms share it, so no kept term is ever lost with its prefix.

The prefixes that stood reach the next level as a bitmap of fixed size, whose false
hits cost a count and never a wrong result. Counts are made per task in bounded
tables and added up by key, so no language, source or term is one task's work.

Sources of a language are compared on tiles: some sources by some terms, as dense
blocks. What is read for a tile is bounded, and all pairs of sources exist only as
the sums that are asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import mixed, text_or_empty, written

BREAK = re.compile(rb"[^A-Za-z\x80-\xff]")
LEAST = 30
#: Bytes of the first level's prefixes; later levels have 8, 16, 32, ... bytes.
FIRST_WIDTH = 4
#: Bits of the map of standing prefixes: 8 MB, whatever the corpus.
MAP_BITS = 1 << 26
#: Entries of a task's table of counts before it is given out.
ENTRIES = 1 << 20
#: Bytes of text that are taken apart at once.
BLOCK = 1 << 23
UNIT = 1_000_000_000
PRIOR = 5
TOP = 50
#: Terms and sources of a tile, about.
TILE_TERMS, TILE_SOURCES = 1024, 128
#: Parts of a source's terms that are ranked apart first.
PARTS = 64


def _letters() -> np.ndarray:
    """Letters of ASCII in lower case and all beyond it; a space for anything else."""
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    for lo, hi in ((65, 90), (97, 122)):
        table[lo : hi + 1] = np.arange(97, 123)
    return table


LETTERS = _letters()
FOLDED = LETTERS.tobytes()


def spans(raw: bytes, span: int) -> Iterator[bytes]:
    """The text in parts of about `span` bytes that cut no term."""
    at = 0
    while at < len(raw):
        cut = BREAK.search(raw, at + span)
        to = cut.start() if cut else len(raw)
        yield raw[at:to]
        at = to


def distinct_terms(raw: bytes, span: int = BLOCK) -> bytes:
    """A long text as its distinct terms, between spaces."""
    found: set[bytes] = set()
    for part in spans(raw, span):
        found.update(part.translate(FOLDED).split())
    return b" ".join(sorted(found))


class Terms:
    """The terms of some texts as places in one buffer, in order of the texts."""

    def __init__(self, raws: list[bytes]):
        self.bytes = LETTERS[np.frombuffer(b" ".join([*raws, b""]) + b" " * 8, np.uint8)]
        letter = self.bytes != 32
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        edges = np.concatenate(([0], edges)) if letter[0] else edges
        self.start, self.size = edges[0::2], edges[1::2] - edges[0::2]
        ends = np.cumsum([len(r) + 1 for r in raws])
        self.text = np.searchsorted(ends, self.start, "right")
        # Eight bytes from every place of the buffer on, the first one highest.
        self.words = np.ndarray(max(len(self.bytes) - 7, 0), ">u8", self.bytes, strides=(1,))

    def prefix(self, some: np.ndarray, width: int) -> np.ndarray:
        """The first `width` bytes of some terms, zeros behind their ends, as rows of words."""
        out = np.zeros((len(some), max(1, width // 8)), np.uint64)
        for k in range(out.shape[1]):
            left = np.clip(np.minimum(self.size[some], width) - 8 * k, 0, 8)
            at = np.minimum(self.start[some] + 8 * k, len(self.words) - 1)
            shift = (8 * (8 - left)).astype(np.uint64)
            word = self.words[at].astype(np.uint64)
            out[:, k] = np.where(left > 0, word >> np.minimum(shift, np.uint64(63)) << np.minimum(shift, np.uint64(63)), 0)
        return out


def slots(lang: bytes, words: np.ndarray, bits: int) -> np.ndarray:
    """Places of prefixes in the map."""
    h = np.full(len(words), crc32(lang) + 1, np.uint64)
    for k in range(words.shape[1]):
        h = mixed(h ^ words[:, k])
    return (h % np.uint64(bits)).astype(np.int64)


def stands(known: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (known[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def in_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of the rows, and where in it a new row begins."""
    order = np.argsort(words[:, 0], kind="stable") if words.shape[1] == 1 else np.lexsort(words.T[::-1])
    found = words[order]
    new = np.ones(len(order), bool)
    new[1:] = (found[1:] != found[:-1]).any(1)
    return order, new


class Counts:
    """Counts by key and prefix, added up over the blocks of a task."""

    def __init__(self) -> None:
        self.parts: dict[tuple, list] = {}
        self.rows = 0

    def add(self, key: tuple, words: np.ndarray, n: np.ndarray) -> None:
        """key ends with the width of the prefixes in words."""
        parts = self.parts.setdefault(key, [])
        parts.append((words, n))
        self.rows += len(n)
        if len(parts) > 8:
            self.merge(key)

    def merge(self, key: tuple) -> tuple[np.ndarray, np.ndarray]:
        parts = self.parts[key]
        words, n = np.concatenate([w for w, _ in parts]), np.concatenate([x for _, x in parts])
        if len(parts) > 1 and len(n):
            order, new = in_order(words)
            self.rows -= len(n) - int(new.sum())
            words, n = words[order][new], np.add.reduceat(n[order], np.flatnonzero(new))
        self.parts[key] = [(words, n)]
        return words, n

    def batches(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        """All counts, which are then forgotten: the key's parts, prefix, n."""
        for key in list(self.parts):
            words, n = self.merge(key)
            if len(n):
                raw = words.astype(">u8").tobytes()
                width = 8 * words.shape[1]
                whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(n), [None, pa.py_buffer(raw)])
                own = [pa.array([x] * len(n), pa.binary()) for x in key[:-1]]
                yield pa.RecordBatch.from_arrays([*own, whole.cast(pa.binary()), pa.array(n, pa.int64())], names)
        self.parts, self.rows = {}, 0


def blocks(batch: pa.RecordBatch, key: int, split: bool, most: int) -> Iterator[tuple[list, list[bytes]]]:
    """Keys (the first `key` columns) and texts, ordered by key, some `most` bytes at a time.

    Longer texts come in parts with `split`, else as their distinct terms.
    """
    keys = list(zip(*[batch.column(k).to_pylist() for k in range(key)]))
    names, raws, size = [], [], 0
    for i in sorted(range(len(keys)), key=keys.__getitem__):
        raw = batch.column(key)[i].as_py()
        parts = [raw] if len(raw) <= most else list(spans(raw, most)) if split else [distinct_terms(raw, most)]
        for part in parts:
            if size + len(part) > most and raws:
                yield names, raws
                names, raws, size = [], [], 0
            names.append(keys[i])
            raws.append(part)
            size += len(part)
    if raws:
        yield names, raws


def groups_of(names: list, text: np.ndarray) -> Iterator[tuple[tuple, slice]]:
    """The terms of each key, which stand together."""
    starts = [k for k, x in enumerate(names) if k == 0 or x != names[k - 1]]
    cuts = np.searchsorted(text, [*starts, len(names)])
    for k, lo, hi in zip(starts, cuts[:-1], cuts[1:]):
        if hi > lo:
            yield names[k], slice(int(lo), int(hi))


def _level(
    batches: Iterator[pa.RecordBatch], before: int, width: int, standing, bits: int, most: int
) -> Iterator[pa.RecordBatch]:
    known = np.frombuffer(standing.value, np.uint8) if standing is not None else None
    counts = Counts()
    for batch in batches:
        for names, raws in blocks(batch, 1, False, most):
            terms = Terms(raws)
            for (lang,), part in groups_of(names, terms.text):
                some = np.arange(part.start, part.stop)
                if known is not None:
                    some = some[terms.size[some] >= before]
                    some = some[stands(known, slots(lang, terms.prefix(some, before), bits))]
                words = terms.prefix(some, width)
                order, new = in_order(words)
                # The order is stable: equal prefixes of one text stand together.
                text = terms.text[some[order]]
                first = new.copy()
                first[1:] |= text[1:] != text[:-1]
                if len(order):
                    counts.add((lang, width), words[order][new], np.add.reduceat(first.astype(np.int64), np.flatnonzero(new)))
            if counts.rows > ENTRIES:
                yield from counts.batches(["lang", "prefix", "n"])
    yield from counts.batches(["lang", "prefix", "n"])


def _slots(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        words = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u8").astype(np.uint64)
        words = words.reshape(len(langs), -1)
        found = np.zeros(len(langs), np.int64)
        of = np.array([crc32(x) for x in langs], np.int64)
        for lang in set(langs):
            own = of == crc32(lang)
            found[own] = slots(lang, words[own], bits)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["at"])


def bitmap(rows: DataFrame, bits: int = MAP_BITS) -> bytes:
    """The map of rows (lang, prefix); what reaches the driver is bits / 8 bytes at most."""
    at = rows.select("lang", "prefix").mapInArrow(lambda it: _slots(it, bits), "at bigint")
    # Words of 32 bits, so that none is negative.
    words = at.groupBy((F.col("at") / 32).cast("long").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("set")
    )
    got = words.toArrow()
    table = np.zeros(bits // 32, "<u4")
    table[got.column("word").to_numpy()] = got.column("set").to_numpy().astype(np.uint32)
    return table.tobytes()


def kept_terms(
    docs: DataFrame, least: int = LEAST, first: int = FIRST_WIDTH, bits: int = MAP_BITS, block: int = BLOCK
) -> DataFrame:
    """lang, prefix, width, n_docs: the terms of at least `least` documents of a language.

    A term is the prefix without the zeros behind it, in the level of `width` bytes
    that it ended in. docs: lang, source and text without nulls. Every row is a
    document of its own. first: 1 to 8 bytes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("lang").cast("binary"), F.col("text").cast("binary"))
    before, width, standing, kept = 0, first, None, None
    while True:
        sent = spark.sparkContext.broadcast(standing) if standing is not None else None
        part = rows.mapInArrow(
            lambda it, b=before, w=width, s=sent: _level(it, b, w, s, bits, block), "lang binary, prefix binary, n bigint"
        )
        level = part.groupBy("lang", "prefix").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= least)
        level = written(level)
        # Complete is what has a zero byte within the level's width.
        ended = F.expr(f"substring(prefix, {width}, 1) = X'00'")
        whole = level.where(ended).select("lang", "prefix", F.lit(width).alias("width"), "n_docs")
        kept = whole if kept is None else kept.unionByName(whole)
        open_ = level.where(~ended)
        if sent is not None:
            sent.unpersist()
        if open_.isEmpty():
            return kept
        standing = bitmap(open_, bits)
        before, width = width, 8 if width < 8 else 2 * width


def _cells(batches: Iterator[pa.RecordBatch], standing: dict, bits: int, most: int) -> Iterator[pa.RecordBatch]:
    known = {w: np.frombuffer(sent.value, np.uint8) for w, sent in standing.items()}
    names_of = ["lang", "source", "prefix", "n"]
    counts = Counts()
    for batch in batches:
        for names, raws in blocks(batch, 2, True, most):
            terms = Terms(raws)
            for (lang, source), part in groups_of(names, terms.text):
                size = terms.size[part]
                below = 0
                for width in sorted(known):
                    some = np.flatnonzero((size >= below) & (size < width)) + part.start
                    below = width
                    words = terms.prefix(some, width)
                    words = words[stands(known[width], slots(lang, words, bits))]
                    if len(words):
                        order, new = in_order(words)
                        n = np.diff(np.append(np.flatnonzero(new), len(order)))
                        counts.add((lang, source, width), words[order][new], n)
            if counts.rows > ENTRIES:
                yield from counts.batches(names_of)
    yield from counts.batches(names_of)


def occurrences(docs: DataFrame, kept: DataFrame, bits: int = MAP_BITS, block: int = BLOCK) -> DataFrame:
    """lang, source, term, n: how often the documents of a source hold each kept term."""
    spark = docs.sparkSession
    widths = sorted(r.width for r in kept.select("width").distinct().collect())
    sent = {w: spark.sparkContext.broadcast(bitmap(kept.where(F.col("width") == w), bits)) for w in widths}
    rows = docs.select(*[F.col(c).cast("binary") for c in ("lang", "source", "text")])
    part = rows.mapInArrow(
        lambda it: _cells(it, sent, bits, block), "lang binary, source binary, prefix binary, n bigint"
    )
    sums = part.groupBy("lang", "source", "prefix").agg(F.sum("n").alias("n"))
    exact = sums.join(kept.select("lang", "prefix"), ["lang", "prefix"], "left_semi")
    # No term holds a zero byte; what is left without them is the term.
    term = F.unhex(F.regexp_replace(F.hex("prefix"), "(00)+$", "")).alias("term")
    return exact.select("lang", "source", term, "n")


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * terms)) of named columns, exactly."""
    up = f"cast({n} + {PRIOR} as decimal(28,0)) * cast({UNIT} as decimal(10,0))"
    over = f"cast(greatest({total} + {PRIOR}L * {terms}, 1L) as decimal(28,0))"
    return F.expr(f"1L + ({up} div {over})")


def _tile(frame: pd.DataFrame) -> pd.DataFrame:
    """Summed differences between the sources of two tiles over the terms of one chunk.

    A row with a null term brings in a source that may hold none of the terms. What a
    source gives for a term it doesn't hold is `base`. The first chunk adds the
    difference of bases for all terms of the language; every chunk takes those off
    that it has counted itself.
    """
    real = frame[frame["term"].notna()]
    who = frame.drop_duplicates(["side", "source"]).reset_index(drop=True)
    spot = {(s, x): k for k, (s, x) in enumerate(zip(who["side"], who["source"]))}
    base = who["base"].to_numpy(np.int64)
    names = {t: k for k, t in enumerate(dict.fromkeys(real["term"]))}
    p = np.repeat(base[:, None], len(names), 1)
    at = [spot[k] for k in zip(real["side"], real["source"])]
    p[at, [names[t] for t in real["term"]]] = real["p"].to_numpy(np.int64)
    left = np.flatnonzero(who["side"] == 0)
    right = np.flatnonzero(who["side"] == 1)
    rest = (int(frame["n_terms"].iloc[0]) if frame["chunk"].iloc[0] == 0 else 0) - len(names)
    out = []
    for g in left:
        gap = np.abs(p[right] - p[g]).sum(1) + rest * np.abs(base[right] - base[g])
        out.append(pd.DataFrame({"source": who["source"][g], "other": who["source"][right], "f": gap}))
    shape = pd.concat(out) if out and len(right) else pd.DataFrame({"source": [], "other": [], "f": []})
    return shape.assign(lang=frame["lang"].iloc[0])


def source_gaps(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """lang, source, other, f: summed differences of every pair of sources, both ways.

    groups: lang, source, base, n_terms, and tiles, chunks of the language.
    cells: lang, source, term, p. Every source has the same tile in both.
    """
    own = ["lang", "source", "base", "n_terms", "tiles", "chunks"]
    chunk = F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int")
    held = cells.select("lang", "source", "term", "p").join(groups.select(*own), ["lang", "source"])
    held = held.select(*own, chunk.alias("chunk"), "term", "p")
    every = F.explode(F.expr("sequence(0, cast(chunks as int) - 1)"))
    marks = groups.select(*own, every.alias("chunk"), F.lit(None).cast("binary").alias("term"), F.col("base").alias("p"))
    rows = held.unionByName(marks).withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")))
    sides = []
    for side in (0, 1):
        other = F.explode(F.expr("sequence(0L, tiles - 1L)"))
        keyed = rows.withColumn("far", other)
        a, b = ("tile", "far") if side == 0 else ("far", "tile")
        sides.append(
            keyed.select(
                "lang", "source", "base", "n_terms", "chunk", "term", "p",
                F.lit(side).alias("side"), F.col(a).alias("a"), F.col(b).alias("b"),
            )
        )
    sums = (
        sides[0]
        .unionByName(sides[1])
        .groupBy("lang", "chunk", "a", "b")
        .applyInPandas(_tile, "source binary, other binary, f bigint, lang binary")
    )
    return sums.where("source <> other").groupBy("lang", "source", "other").agg(F.sum("f").alias("f"))


def divergence(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least: int = LEAST,
    top: int = TOP,
    first: int = FIRST_WIDTH,
    bits: int = MAP_BITS,
    block: int = BLOCK,
) -> DataFrame:
    """lang, source, part, item, value, rank: how each source departs within its language.

    Part `pair`: every other source of the language with the difference of shares
    summed over all kept terms. Part `term`: the `top` kept terms that the source holds
    and uses more than its language does. Ranks go by value descending, item ascending.

    Null text, language or source count as empty; each row is a document, repeated
    ones too. A source without kept terms, and a language without any, have their
    pairs. A language of one source has no pair. An empty table gives an empty result.
    Other columns are not looked at; texts are read whole, long ones in parts.
    """
    rows = docs.select(*[text_or_empty(c).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    kept = written(kept_terms(rows, least, first, bits, block))
    cells = written(occurrences(rows, kept, bits, block))
    bytes_ = [F.col(c).cast("binary").alias(c) for c in ("lang", "source")]
    groups = rows.select("lang", "source").distinct().select(*bytes_)
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["total", "n_terms"])
    sized = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("total").alias("lang_total"))
    groups = groups.join(sized, "lang").withColumn("none", F.lit(0).cast("long"))
    groups = written(
        groups.select(
            "lang", "source", "total", "n_terms", "lang_total",
            share("none", "total", "n_terms").alias("base"),
            F.ceil(F.col("n_sources") / TILE_SOURCES).alias("tiles"),
            F.greatest(F.ceil(F.col("n_terms") / TILE_TERMS), F.lit(1).cast("long")).alias("chunks"),
        )
    )
    with_p = cells.join(groups.select("lang", "source", "total", "n_terms", "lang_total"), ["lang", "source"])
    with_p = with_p.withColumn("p", share("n", "total", "n_terms"))
    pair = source_gaps(groups, with_p).select("lang", "source", F.col("other").alias("item"), F.col("f").alias("value"))
    of_lang = cells.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    term = with_p.join(of_lang, ["lang", "term"]).withColumn("q", share("lang_n", "lang_total", "n_terms"))
    term = term.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), F.expr("p - q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # First among the terms of a part of the source, so that no source is one task.
    term = term.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(PARTS)))
    within = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    term = term.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top).drop("part", "rank")
    ranked = [
        pair.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")),
        term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term")),
    ]
    found = ranked[0].unionByName(ranked[1])
    names = [F.decode(F.col(c), "UTF-8").alias(c) for c in ("lang", "source")]
    return found.select(*names, "part", F.decode("item", "UTF-8").alias("item"), "value", "rank")
