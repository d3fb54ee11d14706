"""Near-duplicate detection with Order MinHash.

The k-mers are shingles of five words, each labelled with its occurrence number
within the text, so that repeats count. A sketch takes the few labelled k-mers
that hash lowest and keeps them in the order of the text; equal sketches make a
candidate. Several sketches are taken, each under its own hash.

A candidate is verified by a banded alignment of the two shingle sequences: the
similarity is the shingles matched in order over all shingles of both. To reach a
similarity of s, at most (1 - s) / (1 + s) of the shingles may be unmatched, which
bounds the band. Word sequences that are equal meet first, by digest, and are one
node from then on; texts of one identifier are nodes of their own, joined at the end.

Candidates are stars, not pairs: in a round the members of a bucket meet a few
members of it, the pivots: those that share most buckets with others, as the text
that the others were copied from does. Documents linked so are joined into components.
Buckets whose members still lie in several components are dealt again with other
pivots, for the members outside a pivot's component, until a round links nothing
new. So the candidates of a round grow with the rows of the buckets only.

What the pivots leave is finished exactly: members of every bucket that still has
several components meet by their rarest shingles (prefix filter). Texts of the
similarity have a shingle in common among their rarest, at places that leave enough
to share behind it; a passage of many texts stands behind these, so it makes no
candidate. Every other pair of different components in a bucket is thereby excluded.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh, mixed, packed, row_blocks, spread, text_or_empty, unpacked, utf8, written

SHINGLE = 5
SKETCHES = 16
TAKEN = 3
SIMILARITY = 0.8
#: Parts of a bucket, and so pivots, in one turn.
PIVOTS = 3
BLOCK = 1 << 20
#: Counters of shingles, by hash; what they hold decides the order of shingles only.
COUNTERS = 1 << 20
#: Rows of a shingle that meet in one task.
PER_KEY = 1000


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the rows, and how many words each row has.

    A word's hash adds up its bytes times odd powers, counted from its start.
    """
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(ends) - 1, np.int64)
    first = np.zeros(n, bool)
    first[ends[:-1][ends[:-1] < n]] = True
    start = ~gap & (first | np.concatenate(([True], gap[:-1])))
    at = np.flatnonzero(start)
    if len(at) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(ends) - 1, np.int64)
    number = np.cumsum(start) - 1
    spot = np.arange(n) - at[np.maximum(number, 0)]
    odd = mixed(np.arange(1, int(spot.max()) + 2, dtype=np.uint64)) | np.uint64(1)
    value = mixed(data.astype(np.uint64) + np.uint64(257)) * odd[np.maximum(spot, 0)]
    value[gap] = 0
    total = np.add.reduceat(value, at)
    counts = np.diff(np.searchsorted(at, ends))
    return mixed(total), counts


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of `size` words; a shorter text is one run."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        size = n
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total = mixed(total * np.uint64(31) + words[k : n - size + 1 + k] + np.uint64(k + 1))
    return total


def occurrences(keys: np.ndarray) -> np.ndarray:
    """How often each key came before, at its place."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    begin = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(s)) - begin
    return out


def labelled(keys: np.ndarray) -> np.ndarray:
    return mixed(keys + mixed(occurrences(keys).astype(np.uint64) + np.uint64(11)))


def sketches(keys: np.ndarray, n: int = SKETCHES, taken: int = TAKEN) -> np.ndarray:
    """Order MinHash: n hashes, each of the `taken` lowest labelled k-mers in text order."""
    own = labelled(keys)
    seeds = mixed(np.arange(1, n + 1, dtype=np.uint64))
    step = max(1, (1 << 18) // len(own))
    out = []
    for j in range(0, n, step):
        if len(own) > taken:
            h = mixed(own[None, :] ^ seeds[j : j + step, None])
            low = np.sort(np.argpartition(h, taken - 1, axis=1)[:, :taken], axis=1)
        else:
            low = np.tile(np.arange(len(own)), (len(seeds[j : j + step]), 1))
        total = np.full(len(low), low.shape[1], np.uint64)
        for k in range(low.shape[1]):
            total = mixed(total * np.uint64(31) + own[low[:, k]])
        out.append(total)
    return np.concatenate(out)


def matched(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Most keys matched in order, or -1 if more than `most` stay unmatched.

    Greedy alignment over the diagonals of a band: for each number of unmatched
    keys the furthest point on each diagonal, runs of equal keys being free.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return -1
    far = {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            if k < -m or k > n:
                continue
            if k == -d or (k != d and far.get(k - 1, -1) < far.get(k + 1, -1)):
                x = far.get(k + 1, 0)
            else:
                x = far.get(k - 1, 0) + 1
            x = min(x, n)
            y = x - k
            x = run(a, b, x, y)
            far[k] = x
            if x >= n and x - k >= m:
                return (n + m - d) // 2
    return -1


def run(a: np.ndarray, b: np.ndarray, x: int, y: int) -> int:
    """Where the run of equal keys from a[x] and b[y] ends in a."""
    step = 16
    while x < len(a) and y < len(b):
        to = min(step, len(a) - x, len(b) - y)
        differ = np.flatnonzero(a[x : x + to] != b[y : y + to])
        if len(differ):
            return x + int(differ[0])
        x, y, step = x + to, y + to, step * 4
    return x


def in_order(spots: np.ndarray) -> int:
    """Length of the longest increasing part of distinct numbers."""
    if len(spots) < 2 or (spots[1:] > spots[:-1]).all():
        return len(spots)
    tails: list[int] = []
    for x in spots.tolist():
        at = bisect_left(tails, x)
        tails[at : at + 1] = [x]
    return len(tails)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the keys matched in order reach the share `least` of all keys.

    Keys in common with their labels bound the match from above, those of them
    that stand in order from below; the band is aligned where the bounds differ.
    """
    if len(a) == 0 or len(b) == 0:
        return len(a) == len(b)
    total = len(a) + len(b)
    enough = lambda hit: hit >= least * (total - hit) - 1e-9
    if not enough(min(len(a), len(b))):
        return False
    _, at_a, at_b = np.intersect1d(labelled(a), labelled(b), assume_unique=True, return_indices=True)
    if not enough(len(at_a)):
        return False
    if enough(in_order(at_b[np.argsort(at_a)])):
        return True
    return matched(a, b, int(total * (1 - least) / (1 + least) + 1e-9)) >= 0


def _sketched(batches: Iterator[pa.RecordBatch], n: int, taken: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, ends = utf8(batch.column(2))
        marks, sizes, found = [], [], []
        for i, j in row_blocks(ends, BLOCK):
            words, counts = word_hashes(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
            at = 0
            for c in counts.tolist():
                own = words[at : at + c]
                at += c
                keys = shingles(own)
                marks.append(blake2b(own.tobytes(), digest_size=16).digest())
                sizes.append(len(keys))
                found.append(sketches(keys, n, taken).view(np.int64) if c else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32()),
            pa.array(np.concatenate([np.zeros(0, np.int64), *found])),
        )
        cols = [batch.column(0), batch.column(1), pa.array(marks, pa.binary()), pa.array(sizes, pa.int64()), lists]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "raw", "words", "size", "sketch"])


def _keys(body: bytes) -> np.ndarray:
    raw = np.frombuffer(unpacked(body), np.uint8)
    return shingles(word_hashes(raw, np.array([0, len(raw)]))[0])


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    last, own = None, None
    for batch in batches:
        ok = np.zeros(batch.num_rows, bool)
        for k, (p, text, other) in enumerate(
            zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True)
        ):
            if p != last:
                last, own = p, _keys(text.as_py())
            ok[k] = similar(own, _keys(other.as_py()), least)
        keep = pa.array(ok)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"]
        )


def components(links: DataFrame) -> DataFrame:
    """rep, label: the smallest identifier that links lead to, for every end of a link.

    Labels go down by the least label of the neighbours, then by the label of the
    label, until none changes. The rounds are written tables: those, unlike
    checkpoints, don't carry the constraints of all earlier rounds along, which
    would make planning slower from round to round.
    """
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = written(links.select("a", "b").unionByName(back).distinct())
    labels = written(both.groupBy(F.col("a").alias("rep")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        at = labels.select(F.col("rep").alias("b"), F.col("label").alias("lb"))
        near = both.join(at, "b").groupBy(F.col("a").alias("rep")).agg(F.min("lb").alias("near"))
        down = labels.join(near, "rep").select("rep", F.least("label", "near").alias("next"), "label")
        hop = labels.select(F.col("rep").alias("next"), F.col("label").alias("further"))
        new = written(down.join(hop, "next").select("rep", F.least("next", "further").alias("next"), "label"))
        labels = new.select("rep", F.col("next").alias("label"))
        if new.where(F.col("next") != F.col("label")).isEmpty():
            return labels


def relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """rep, label after further links, of which only those between components count."""
    if labels is None:
        return components(links)
    ends = links
    for x in ("a", "b"):
        own = labels.select(F.col("rep").alias(x), F.col("label").alias("at"))
        ends = ends.join(own, x, "left").withColumn(x, F.coalesce("at", x)).drop("at")
    moved = components(ends.where("a <> b"))
    to = moved.select(F.col("rep").alias("label"), F.col("label").alias("to"))
    old = labels.join(to, "label", "left").select("rep", F.coalesce("to", "label").alias("label"))
    return written(old.unionByName(moved.join(labels.select("rep"), "rep", "left_anti")))


def linked(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar. texts: rep, packed, one row each."""
    left = texts.select(F.col("rep").alias("a"), F.col("packed").alias("ta"))
    right = texts.select(F.col("rep").alias("b"), F.col("packed").alias("tb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "tb", "ta")
    kind = pairs.schema["a"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _verified(it, least), f"a {kind}, b {kind}")


def candidates(
    buckets: DataFrame, turn: int, least: float, labels: DataFrame | None, tested: DataFrame | None
) -> DataFrame:
    """a < b: every member of a bucket with the bucket's pivots of this turn.

    A bucket is parted by a hash that changes from turn to turn; the pivots are the
    heaviest member of every part. Only pairs whose sizes allow the similarity, that lie in different components and
    were not tested before. Buckets within one component are out of it.
    """
    at = ["j", "sketch"]
    rows = buckets.withColumn("label", F.col("rep"))
    if labels is not None:
        rows = written(buckets.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")))
    part = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(PIVOTS))
    first = lambda k: F.min(
        F.struct((part != k).alias("o"), (-F.col("weight")).alias("w"), "rep", "size", "label")
    )
    pivots = rows.groupBy(at).agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.array(*map(first, range(PIVOTS))).alias("ps")
    )
    pivots = pivots.where("low <> high").select(*at, F.transform("ps", lambda p: p.dropFields("o", "w")).alias("ps"))
    pairs = spread(rows, pivots, at, "rep").withColumn("p", F.explode(F.array_distinct("ps")))
    fit = F.least("size", "p.size") >= least * F.greatest("size", "p.size") - 1e-9
    pairs = pairs.where((F.col("label") != F.col("p.label")) & fit)
    pairs = pairs.select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b")).distinct()
    return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for body in batch.column(1):
            n += np.bincount((labelled(_keys(body.as_py())) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])


def rarest(keys: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The labelled keys by which a text must meet its partners, and for each the
    largest partner that it may be the first common key with.

    Keys stand in one order for all texts, the rarest first. If the first common key
    leaves `rest` keys in a text of n, a partner of m needs rest >= least / (1 + least) * (n + m).
    """
    own = labelled(keys)
    own = own[np.lexsort((own, counts[(own % np.uint64(COUNTERS)).astype(np.int64)]))]
    upto = (len(own) - np.arange(len(own))) * (1 + least) / least - len(own) + 1e-6
    some = int(np.searchsorted(-upto, -least * len(own), side="right"))
    return own[:some], upto[:some]


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for body in batch.column(1):
            keys = _keys(body.as_py())
            found.append((len(keys), *rarest(keys, counts, least)))
        nth = np.repeat(np.arange(len(found)), [len(f[1]) for f in found])
        cols = [
            batch.column(0).take(pa.array(nth)),
            batch.column(2).take(pa.array(nth)),
            pa.array(np.array([f[0] for f in found], np.int64)[nth]),
            pa.array(np.concatenate([np.zeros(0, np.uint64), *[f[1] for f in found]]).view(np.int64)),
            pa.array(np.concatenate([np.zeros(0), *[f[2] for f in found]])),
        ]
        yield pa.RecordBatch.from_arrays(cols, ["rep", "label", "size", "key", "upto"])


def unsettled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rep, label: members of the buckets of three or more that lie in several components.

    The two of a bucket of two have met.
    """
    rows = buckets.select("j", "sketch", "rep", F.col("rep").alias("label"))
    if labels is not None:
        rows = written(rows.drop("label").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")))
    at = ["j", "sketch"]
    open_ = rows.groupBy(at).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"))
    open_ = open_.where("low <> high AND n > 2").select(*at)
    return spread(rows, open_, at, "rep").select("rep", "label").distinct()


def remaining(left: DataFrame, texts: DataFrame, least: float, tested: DataFrame) -> DataFrame:
    """a < b: all pairs of `left` in different components that can be similar and were not tested.

    A pair meets at its first common key, where one of the two can have a partner of
    its own size or more (`wide`); keys that are wide for no text, as those of a
    common passage, are left out. The most frequent component of a key does not meet itself.
    """
    rows = written(texts.join(left, "rep").select("rep", "packed", "label"))
    sums = rows.mapInArrow(_counted, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[sums["at"].to_numpy()] = sums["n"].to_numpy()
    kind = left.schema["rep"].dataType.simpleString()
    shape = f"rep {kind}, label {kind}, size bigint, key bigint, upto double"
    rows = rows.mapInArrow(lambda it: _prefixes(it, counts, least), shape)
    rows = written(rows.withColumn("wide", F.col("upto") >= F.col("size")))
    keys = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.max("wide").alias("wide"))
    keys = keys.groupBy("key").agg(
        F.max_by("label", "n").alias("most"),
        F.count("*").alias("labels"),
        F.max("wide").alias("some"),
        F.ceil(F.sum("n") / PER_KEY).cast("int").alias("parts"),
    )
    keys = keys.where("labels > 1 AND some").select("key", "most", "parts")
    rows = written(rows.join(keys, "key"))
    # Of a frequent key one side is parted and the other repeated for every part.
    x = rows.where("label <> most").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).alias("x")
    y = rows.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).alias("y")
    fit = "x.key = y.key AND x.part = y.part AND x.label <> y.label AND x.size <= y.upto AND y.size <= x.upto"
    ends = [F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")]
    met = x.where("wide").join(y, F.expr(fit)).select(ends)
    met = met.unionByName(x.where("NOT wide").join(y.where("wide"), F.expr(fit)).select(ends))
    return met.distinct().join(tested, ["a", "b"], "left_anti")


def near_classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least: float = SIMILARITY,
    n: int = SKETCHES,
    taken: int = TAKEN,
) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept, raw.

    class_id is the smallest identifier of the class, raw the SHA-256 of the text.
    Texts are compared by their words; those without words (null, empty, blank)
    are equal to each other and to nothing else. Rows that share an identifier
    share a class, and each of their texts has its own links. Documents without an identifier join the class of equal words;
    where no document with one has these words, they form a class with a null
    class_id. One (identifier, text) of a class is kept: the smallest. An empty
    table gives an empty result; other columns are not looked at.
    """
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(text_or_empty(text), 256)).alias("raw"), text_or_empty(text)
    )
    shape = f"doc_id {kind}, raw binary, words binary, size bigint, sketch array<bigint>"
    own = written(rows.mapInArrow(lambda it: _sketched(it, n, taken), shape))
    # Equal word sequences are one node, told by their digest; its text is that of one row.
    named = F.struct("doc_id", "raw")
    groups = own.groupBy("words").agg(
        F.count("*").alias("n"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("best"),
        F.min(F.when(F.col("doc_id").isNotNull(), named)).alias("text_of"),
        F.any_value("size").alias("size"),
        F.any_value("sketch").alias("sketch"),
    )
    groups = written(groups.withColumnRenamed("words", "rep"))
    nodes = groups.where("text_of IS NOT NULL")
    buckets = nodes.select("rep", "size", F.posexplode("sketch").alias("j", "sketch"))
    shared = buckets.groupBy("j", "sketch").agg(F.count("*").alias("n")).where("n > 1")
    buckets = written(buckets.join(shared, ["j", "sketch"]))
    # The text that others were copied from shares buckets with the most of them.
    weights = buckets.groupBy("rep").agg(F.sum("n").alias("weight"))
    buckets = written(buckets.drop("n").join(weights, "rep"))
    met = nodes.join(buckets.select("rep").distinct(), "rep").select("rep", "text_of.*")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(text_or_empty(text), 256)).alias("raw"), text_or_empty(text))
    texts = texts.mapInArrow(packed, f"doc_id {kind}, raw binary, packed binary")
    # Grouped by what they are joined by, the texts move once; a node has one such pair.
    texts = texts.join(met, ["doc_id", "raw"]).groupBy("doc_id", "raw", "rep").agg(F.max("packed").alias("packed"))
    texts = written(texts.select("rep", "packed"))
    labels, tested, turn = None, None, 0
    while True:
        pairs = written(candidates(buckets, turn, least, labels, tested))
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = written(linked(pairs, texts, least))
        if new.isEmpty():
            break
        labels = relabelled(labels, new)
        turn += 1
    left = written(unsettled(buckets, labels))
    if not left.isEmpty():
        new = written(linked(written(remaining(left, texts, least, tested)), texts, least))
        if not new.isEmpty():
            labels = relabelled(labels, new)
    same = written(same_identifier(own))
    if not same.isEmpty():
        labels = relabelled(labels, same)
    if labels is None:
        members = groups.withColumn("label", F.col("rep"))
    else:
        members = groups.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    members = written(members.select("rep", "label", "n", "best", F.col("text_of.doc_id").alias("id")))
    classes = members.groupBy("label").agg(
        F.min("id").alias("class_id"), F.sum("n").alias("class_size"), F.min("best").alias("class_best")
    )
    members = written(spread(members.select("rep", "label"), classes, ["label"], "rep").withColumnRenamed("rep", "words"))
    found = spread(own.select("doc_id", "raw", "words"), members, ["words"], "doc_id")
    kept = F.col("doc_id").eqNullSafe(F.col("class_best.doc_id")) & (F.col("raw") == F.col("class_best.raw"))
    return found.select("doc_id", "class_id", "class_size", kept.alias("kept"), "raw")


def same_identifier(own: DataFrame) -> DataFrame:
    """a, b: links between different word sequences of one identifier."""
    rows = own.where("doc_id IS NOT NULL").select("doc_id", "words").distinct()
    ends = rows.groupBy("doc_id").agg(F.min("words").alias("a"), F.max("words").alias("z")).where("a <> z").drop("z")
    return spread(rows, ends, ["doc_id"], "words").where("a <> words").select("a", F.col("words").alias("b"))


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs, in their own columns, with one document of each class.

    Rows equal in identifier and text come out once: the one whose other columns
    hash lowest.
    """
    key, tie, nth = (fresh(docs, x) for x in ("near_key", "near_tie", "near_nth"))
    named = lambda ident, sha: F.concat_ws(":", F.coalesce(ident.cast("string"), F.lit("none")), F.lower(sha))
    kept = near_classes(docs, doc_id, text, **how).where("kept")
    kept = kept.select(named(F.col("doc_id"), F.hex("raw")).alias(key))
    first = Window.partitionBy(key).orderBy(tie)
    rest = F.xxhash64(*[F.col(f"`{x}`") for x in docs.columns if x != text])
    return (
        docs.withColumns({key: named(F.col(doc_id), F.sha2(text_or_empty(text), 256)), tie: rest})
        .join(kept, key, "left_semi")
        .withColumn(nth, F.row_number().over(first))
        .where(F.col(nth) == 1)
        .select(*[F.col(f"`{x}`") for x in docs.columns])
    )
