"""Ranked lexical search by MaxScore with bounds on pairs of terms.

The index holds blocks of documents. A block has a posting list with the impacts of
every queried term and its greatest impact, and for chosen pairs of terms the list
of documents that hold both and the greatest joint impact. An item's terms are taken
two by two in order of weight; a document gets from a pair at most the greatest of
the joint impact and the two single ones, which is far less than their sum where the
rare terms of an item don't meet.

At query time these bounds, added up over an item's pairs, skip a whole block, or
part the pairs into those that can lift a document to the threshold and those that
can't: only documents of the former are scored, the latter are looked up for what is
still in the race. Where only the joint impact reaches the threshold, the documents
are those of the intersection list. The threshold starts at what the lists guarantee
for `k` documents over the whole corpus and rises within a task. All comparisons
keep ties, so the result is that of a full scan.

Postings, lists and scores stay with their block of documents; what crosses the
network are sums by term and at most `k` rows an item and task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import text_or_empty, written

#: Letters and digits of ASCII and all beyond it, in UTF-8 bytes.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
TOP = 50
UNIT = 1_000_000_000
#: Documents of a block, 32,767 at most, and blocks of a file, so that no task reads many at once.
BLOCK, FILE_BLOCKS = 8192, 4
#: Characters of items searched for at once; more items come in several turns.
ITEM_CHARS = 8_000_000
SPAN = 1 << 20
#: Parts of an item's rows in the first merge.
SALTS = 32
INDEX = (
    "ids array<{id}>, terms array<int>, ends array<int>, at array<smallint>, part array<int>, "
    "pair array<int>, pair_ends array<int>, both array<smallint>, joint array<bigint>, seeds array<bigint>, seed_ends array<int>"
)


def term_counts(raw: bytes, span: int = SPAN) -> Counter:
    """How often the text holds each term, A-Z lower-cased; long texts in parts."""
    found: Counter = Counter()
    at = 0
    while at < len(raw):
        cut = BREAK.search(raw, at + span)
        to = cut.start() if cut else len(raw)
        found.update(TERM.findall(raw[at:to].lower()))
        at = to
    return found


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    known = vocabulary.value
    for batch in batches:
        sizes, terms, counts = [], [], []
        for raw in batch.column(1):
            found = term_counts(raw.as_py())
            held = [(known[t], n) for t, n in found.items() if t in known]
            sizes.append(found.total())
            terms.append([t for t, _ in held])
            counts.append([n for _, n in held])
        cols = [pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "n", "terms", "counts"])


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n and the counts of the vocabulary's terms, for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).cast("binary").alias("raw"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, n bigint, terms array<int>, counts array<bigint>"
    return rows.mapInArrow(lambda it: _vectors(it, sent), shape)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def paired(items: list[list[int]], weights: np.ndarray) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int]]]:
    """Units of every item and all pairs: its terms two by two, by weight; a rest is alone (-1)."""
    units = []
    for terms in items:
        order = sorted((t for t in terms if weights[t] > 0), key=lambda t: (-weights[t], t))
        units.append([(min(x), max(x)) if len(x) == 2 else (x[0], -1) for x in (order[i : i + 2] for i in range(0, len(order), 2))])
    return units, sorted({u for own in units for u in own if u[1] >= 0})


def highest(values: np.ndarray, k: int) -> np.ndarray:
    return values if len(values) <= k else np.partition(values, len(values) - k)[-k:]


class Block:
    """The posting lists of one block, with dense look-up of single terms."""

    def __init__(self, size: int, terms: np.ndarray, ends: np.ndarray, at: np.ndarray, impact: np.ndarray):
        self.size, self.at, self.impact = size, at, impact  # places are kept small, impacts whole
        self.spot = {int(t): k for k, t in enumerate(terms)}
        self.ends = ends
        self.most = np.maximum.reduceat(impact, ends[:-1]) if len(terms) else np.zeros(0, np.int64)

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        k = self.spot.get(term)
        if k is None:
            return self.at[:0], self.impact[:0]
        return self.at[self.ends[k] : self.ends[k + 1]], self.impact[self.ends[k] : self.ends[k + 1]]

    def greatest(self, term: int) -> int:
        k = self.spot.get(term)
        return 0 if k is None else int(self.most[k])

    def dense(self, term: int) -> np.ndarray:
        out = np.zeros(self.size, np.int64)
        at, impact = self.list_of(term)
        out[at] = impact
        return out


def postings(frame: list[pa.RecordBatch], scale: tuple[int, int], weights: np.ndarray):
    """The posting lists, by term and document, of some rows of `vectors`: a block, its
    terms, and the impacts without the terms' weights."""
    n = np.concatenate([b.column(1).to_numpy() for b in frame])
    lists = [b.column(2) for b in frame]
    held = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
    term = np.concatenate([x.flatten().to_numpy() for x in lists]).astype(np.int64)
    count = np.concatenate([b.column(3).flatten().to_numpy() for b in frame]).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), held)
    n_docs, length = scale
    m = 50 + (50 * n * n_docs) // max(length, 1)
    part = (UNIT * count) // (1000 * count + 20 * m[doc])
    real = weights[term] * part > 0
    term, doc, part = term[real], doc[real], part[real]
    order = np.argsort(term, kind="stable")
    term, doc, part = term[order], doc[order], part[order]
    names, starts = np.unique(term, return_index=True)
    ends = np.append(starts, len(term)).astype(np.int64)
    return Block(len(n), names, ends, doc, weights[term] * part), names, part


def _indexed(batches: Iterator[pa.RecordBatch], plan, kind: pa.DataType, most: int) -> Iterator[pa.RecordBatch]:
    scale, weights, units, pairs, k = plan.value
    spot = {p: i for i, p in enumerate(pairs)}
    partners: dict[int, list[int]] = {}
    for a, b in pairs:
        partners.setdefault(a, []).append(b)

    def block(frame: list[pa.RecordBatch]) -> pa.RecordBatch:
        own, names, part = postings(frame, scale, weights)
        pair, both, joint = [], [], []
        for a in sorted(partners.keys() & own.spot.keys()):
            first = own.dense(a)
            for b in partners[a]:
                at, impact = own.list_of(b)
                met = first[at] > 0
                if met.any():
                    pair.append(spot[a, b])
                    both.append(at[met])
                    joint.append(first[at[met]] + impact[met])
        found = dict(zip(pair, joint))
        # What some documents of the block have for sure, by item: its best pair or term.
        seeds = []
        for unit in units:
            best, value = None, 0
            for a, b in unit:
                if b >= 0 and (x := found.get(spot[a, b])) is not None and x.max() > value:
                    best, value = x, x.max()
                for t in (a, b):
                    if own.greatest(t) > value:
                        best, value = own.list_of(t)[1], own.greatest(t)
            seeds.append(highest(best, k) if best is not None else np.zeros(0, np.int64))
        ids = pa.concat_arrays([b.column(0) for b in frame])

        def one(values, dtype) -> pa.Array:
            values = np.concatenate(values) if isinstance(values, list) and values else np.asarray(values)
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(dtype)))

        def ends_of(lists: list[np.ndarray]) -> np.ndarray:
            return np.cumsum([0, *map(len, lists)])

        cols = [
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(kind)),
            one(names, np.int32), one(own.ends, np.int32), one(own.at, np.int16), one(part, np.int32),
            one(np.array(pair), np.int32), one(ends_of(both), np.int32), one(both, np.int16),
            one(np.array([x.max() for x in joint]), np.int64),
            one(seeds, np.int64), one(ends_of(seeds), np.int32),
        ]
        return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in INDEX.split(", ")])

    waiting, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            some = batch.slice(0, most - rows)
            batch = batch.slice(some.num_rows)
            waiting.append(some)
            rows += some.num_rows
            if rows == most:
                yield block(waiting)
                waiting, rows = [], 0
    if rows:
        yield block(waiting)


def _search(batches: Iterator[pa.RecordBatch], plan, floors, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    _, weights, units, pairs, k = plan.value
    least = floors.value.copy()
    spot = {p: i for i, p in enumerate(pairs)}
    found: list[list] = [[] for _ in units]
    for batch in batches:
        for row in range(batch.num_rows):
            part = {name: batch.column(i)[row].values for i, name in enumerate(batch.schema.names)}
            ids = part["ids"]
            num = {name: part[name].to_numpy() for name in batch.schema.names[1:]}
            impact = np.repeat(weights[num["terms"]], np.diff(num["ends"])) * num["part"]
            own = Block(len(ids), num["terms"], num["ends"], num["at"], impact)
            met = {int(p): i for i, p in enumerate(num["pair"])}
            ends, tops = num["pair_ends"], num["joint"]
            for q, unit in enumerate(units):
                bounds = []
                for a, b in unit:
                    single = max(own.greatest(a), own.greatest(b))
                    i = met.get(spot[a, b]) if b >= 0 else None
                    bounds.append((max(single, int(tops[i])) if i is not None else single, single, i, a, b))
                bounds = sorted((x for x in bounds if x[0]), key=lambda x: -x[0])
                got = score_block(own, bounds, num["both"], ends, int(least[q]))
                if got is None:
                    continue
                at, score = got
                found[q].append((pa.array(ids).take(pa.array(at)), score))
                if sum(len(s) for _, s in found[q]) > 4 * k:
                    found[q] = [kept(found[q], k)]
                scores = np.concatenate([s for _, s in found[q]])
                if len(scores) >= k:
                    least[q] = max(least[q], highest(scores, k).min())
    for q, rows in enumerate(found):
        if rows:
            own_ids, score = kept(rows, k)
            cols = [pa.array(np.full(len(score), q), pa.int32()), own_ids.cast(kind), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, ["q", "doc_id", "score"])


def kept(rows: list, k: int) -> tuple[pa.Array, np.ndarray]:
    """The k best rows, ties by identifier."""
    ids = pa.concat_arrays([x for x, _ in rows])
    score = np.concatenate([s for _, s in rows])
    table = pa.table({"s": score, "i": ids, "at": np.arange(len(score))})
    order = table.sort_by([("s", "descending")]) if len(score) <= k else table
    if len(score) > k:
        order = order.filter(pa.array(score >= highest(score, k).min()))
        order = order.take(pa.compute.sort_indices(order, [("s", "descending"), ("i", "ascending")], null_placement="at_start"))
    at = order["at"].to_numpy()[:k]
    return ids.take(pa.array(at)), score[at]


def score_block(own: Block, bounds: list, both: np.ndarray, ends: np.ndarray, least: int):
    """Places and scores of the documents of a block that reach `least`; None if none can.

    bounds: (bound, bound without the pair, place of the pair's list, term, term), highest first.
    """
    rest = np.cumsum([0, *[b[0] for b in reversed(bounds)]])[::-1]
    floor = max(least, 1)
    if rest[0] < floor:
        return None
    scores = np.zeros(own.size, np.int64)
    taken = 0
    while taken < len(bounds) and rest[taken] >= floor:
        _, single, listed, a, b = bounds[taken]
        if listed is not None and single + rest[taken + 1] < floor:
            break
        for t in (a, b):
            at, impact = own.list_of(t)
            scores[at] += impact
        taken += 1
    in_race = scores > 0
    if taken < len(bounds) and rest[taken] >= floor:
        # Documents new at this pair can only come from its intersection list.
        i = bounds[taken][2]
        in_race[both[ends[i] : ends[i + 1]]] = True
    at = np.flatnonzero(in_race)
    score = scores[at]
    for j in range(taken, len(bounds)):
        fit = score + rest[j] >= floor
        at, score = at[fit], score[fit]
        if not len(at):
            return None
        for t in bounds[j][3:]:
            score = score + own.dense(t)[at]
    fit = score >= floor
    return (at[fit], score[fit]) if fit.any() else None


def thresholds(index: DataFrame, n_items: int, k: int) -> np.ndarray:
    """By item, a score that k documents of the corpus reach for sure; 0 if unknown."""
    n = F.explode(F.sequence(F.lit(0), F.lit(n_items - 1)))
    one = index.select("seeds", "seed_ends", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).alias("salt"))
    part = one.select("seeds", "seed_ends", "salt", n.alias("q"))
    own = F.expr("slice(seeds, seed_ends[q] + 1, seed_ends[q + 1] - seed_ends[q])")
    top = F.slice(F.sort_array(F.flatten(F.collect_list("v")), asc=False), 1, k)
    part = part.select("q", "salt", own.alias("v")).where(F.size("v") > 0)
    found = part.groupBy("q", "salt").agg(top.alias("v")).groupBy("q").agg(top.alias("v"))
    out = np.zeros(n_items, np.int64)
    for r in found.where(F.size("v") >= k).select("q", F.element_at("v", k).alias("least")).collect():
        out[r.q] = r.least
    return out


def search(
    docs: DataFrame,
    items: list[str | None],
    k: int = TOP,
    doc_id: str = "doc_id",
    text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """q, doc_id, score: the k best documents of every item, which q numbers from 0."""
    spark = docs.sparkSession
    words = [sorted(term_counts((x or "").encode())) for x in items]
    vocabulary = {t: k for k, t in enumerate(sorted({t for own in words for t in own}))}
    kind = docs.schema[doc_id].dataType
    shape = f"q int, doc_id {kind.simpleString()}, score bigint"
    if not vocabulary:
        return spark.createDataFrame([], shape)
    rows = written(vectors(docs, vocabulary, doc_id, text))
    scale = rows.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():
        df[r.t] = r.n
    weights = np.array([weight(scale.n, int(x)) for x in df], np.int64)
    units, pairs = paired([[vocabulary[t] for t in own] for own in words], weights)
    plan = spark.sparkContext.broadcast(((scale.n, scale["all"]), weights, units, pairs, k))
    arrow = rows.limit(0).select("id").toArrow().schema.field("id").type
    index = rows.mapInArrow(lambda it: _indexed(it, plan, arrow, block), INDEX.format(id=kind.simpleString()))
    index = written(index, FILE_BLOCKS)
    floors = spark.sparkContext.broadcast(thresholds(index, len(items), k))
    return index.mapInArrow(lambda it: _search(it, plan, floors, arrow), shape)


def best(found: DataFrame, k: int = TOP) -> DataFrame:
    """The k best rows of every q with their rank, merged in two steps."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("q", "salt").orderBy(*order)))
    some = some.where(F.col("rank") <= k).drop("salt", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item with score above 0.

    Equal scores go by ascending identifier, null first; among repeated rows of one
    identifier the order makes no difference. Every row of items is an item of its own,
    repeated ones too; items without terms, or whose terms no document holds, have no
    rows. Null texts have no terms. Items come to the driver ITEM_CHARS characters at a
    time; documents never do, and long texts are read in parts. Empty tables give an
    empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), text_or_empty(item_text).alias("item_text"))
    chars = asked.agg(F.sum(F.length("item_text") + 1)).first()[0] or 0
    turns = -(-chars // ITEM_CHARS)
    out = None
    for turn in range(max(turns, 1)):
        here = F.pmod(F.xxhash64("item_id", "item_text"), F.lit(max(turns, 1))) == turn
        rows = sorted(asked.where(here).collect(), key=lambda r: (str(r.item_id), r.item_text))
        found = best(search(docs, [r.item_text for r in rows], k, doc_id, text, block), k)
        names = spark.createDataFrame(
            [(i, r.item_id) for i, r in enumerate(rows)], f"own_q int, item_id {asked.schema['item_id'].dataType.simpleString()}"
        )
        named = found.join(F.broadcast(names), F.col("q") == F.col("own_q")).select("item_id", "rank", "doc_id", "score")
        out = named if out is None else out.unionByName(named)
    return out
