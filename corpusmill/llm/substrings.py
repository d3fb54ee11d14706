"""Removal of repeated byte strings, by radix passes over windows of fixed depth.

Suffixes need ordering through the first WINDOW bytes only: where they agree so
far, the string repeats. Most-significant-digit passes put equal windows together,
and whatever a pass shows to be alone is dropped from the next one.

The digits. Every window names one of its GRAM-byte strings, the one that hashes
lowest, its anchor; equal windows name equal anchors at equal places. The first
digit is the anchor's string, the second the bytes around it as far as a window
can reach, the third, where those differ, each half of them, and the last the
window itself. Digits are 64-bit hashes; windows count as equal only where the
anchor's and the window's agree. Neighbours in the sorted order tell everything: a
row whose predecessor has the same digits repeats an earlier string. Equal rows of
a batch are folded before they are shuffled, so that a passage in very many
documents sends a row per batch and not one per copy.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import mixed, packed, row_blocks, text_or_empty, unpacked, utf8, written

WINDOW, GRAM = 100, 16
CLASSES, CLASS_BITS = 4, 15
#: Contexts of one anchor string beyond which its windows are dealt one by one.
HOT = 200_000
BLOCK = 1 << 19
PAD = 256
LAST = (1 << 63) - 1
U = np.uint64


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a string from those of its left and its right part."""
    return mixed(a * U(0x9E3779B97F4A7C15) + b)


class Hashes:
    """Hashes of the strings that start at each place of a padded byte sequence."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.by = {1: mixed(values.astype(U) + U(0x51ED270B))}
        size = 1
        while size < 64:
            low = self.by[size]
            self.by[size * 2] = joined(low[: len(low) - size], low[size:]) if len(low) > size else low[:0]
            size *= 2

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the strings of this length from the places on."""
        out, size = None, 64
        while length:
            while size > length:
                size //= 2
            part = self.by[size][places]
            out = part if out is None else joined(out, part)
            places, length = places + size, length - size
        return out


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width], for every i that has so many."""
    size = 1
    while size * 2 <= width:
        x = best(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return best(x[: len(x) - rest], x[rest:]) if rest else x


class Block:
    """Padded documents, or a part of one, with their windows and anchors.

    values: bytes, PAD outside of documents; own: whether a window that starts
    here lies in one document and belongs to this block.
    """

    def __init__(self, values: np.ndarray, own: np.ndarray, window: int, gram: int):
        self.reach = window - gram
        self.hashes = Hashes(values)
        self.grams = self.hashes.at(np.arange(len(values) - gram + 1), gram)
        self.least = sliding(self.grams, self.reach + 1, np.minimum)
        self.own = own[: len(self.least)]
        seen = np.where(self.own, self.least, U(0))
        seen = np.concatenate((np.zeros(self.reach, U), seen, np.zeros(self.reach, U)))
        high = sliding(seen, self.reach + 1, np.maximum)
        self.anchors = np.flatnonzero((high == self.grams) & (high != 0))

    def contexts(self, gram: int) -> np.ndarray:
        """Hash around each anchor, of all that a window can reach."""
        p, r = self.anchors, self.reach
        return joined(self.hashes.at(p - r, r), self.hashes.at(p + gram, r))

    def shared(self, places: np.ndarray, gram: int, c: int) -> np.ndarray:
        """Hash of what the windows of class c around the places have in common.

        Class c holds the windows that start c to c + 1 steps before their anchor.
        """
        step = self.reach // CLASSES
        left, right = step * c, self.reach - step * (c + 1) if c < CLASSES - 1 else 0
        out = self.grams[places]
        out = joined(out, self.hashes.at(places - left, left)) if left else out
        return joined(out, self.hashes.at(places + gram, right)) if right else out

    def class_of(self, before: np.ndarray) -> np.ndarray:
        return np.minimum(before // (self.reach // CLASSES), CLASSES - 1)

    def windows(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that name one of the wanted places, and those places."""
        if len(wanted) == 0:
            return wanted, wanted
        g = self.grams[self.anchors]
        order = np.lexsort((self.anchors, g))
        before = np.full(len(g), -1)
        same = g[order][1:] == g[order][:-1]
        before[order[1:]] = np.where(same, self.anchors[order[:-1]], -1)
        at = np.searchsorted(self.anchors, wanted)
        starts = wanted[:, None] - np.arange(self.reach, -1, -1)[None]
        ok = (starts >= 0) & (starts < len(self.least)) & (starts > before[at][:, None])
        inside = np.clip(starts, 0, len(self.least) - 1)
        ok &= self.own[inside] & (self.least[inside] == self.grams[wanted][:, None])
        return starts[ok], np.broadcast_to(wanted[:, None], starts.shape)[ok]


def blocks(data: np.ndarray, ends: np.ndarray, window: int, gram: int) -> Iterator[tuple]:
    """(block, first row, row starts, shift of each row) over the rows of a batch.

    A place p of row k in a block is byte p - starts[k] + shift of its text. Texts
    beyond BLOCK bytes come in parts that overlap by as much as a window can reach.
    """
    edge = 2 * window
    for i, j in row_blocks(ends, BLOCK):
        if j == i + 1 and ends[j] - ends[i] > BLOCK:
            text = data[ends[i] : ends[j]]
            for at in range(0, len(text), BLOCK):
                lo, hi = max(0, at - edge), min(len(text), at + BLOCK + edge)
                pad = np.full(edge, PAD, np.uint16)
                values = np.concatenate((pad, text[lo:hi].astype(np.uint16), pad))
                places = np.arange(len(values)) - edge + lo
                # A window on a border is seen by both parts; a part keeps the
                # anchors of its core, around which it sees every window.
                own = (places >= lo) & (places + window <= hi)
                yield Block(values, own, window, gram), i, np.array([edge - lo]), (at, min(at + BLOCK, len(text)))
            continue
        sizes = np.diff(ends[i : j + 1])
        starts = np.concatenate(([0], np.cumsum(sizes + edge)))[:-1] + edge
        values = np.full(int(sizes.sum() + edge * (len(sizes) + 1)), PAD, np.uint16)
        places = np.arange(int(sizes.sum())) + np.repeat(starts - (ends[i:j] - ends[i]), sizes)
        values[places] = data[ends[i] : ends[j]]
        step = np.zeros(len(values) + 1, np.int64)
        fits = sizes >= window
        np.add.at(step, starts[fits], 1)
        np.add.at(step, (starts + sizes - window + 1)[fits], -1)
        yield Block(values, np.cumsum(step[:-1]) > 0, window, gram), i, starts, None


def _column(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(k).to_numpy(zero_copy_only=False)


def _rows(schema: list[tuple[str, object]], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(a, t) for a, (_, t) in zip(arrays, schema, strict=True)], [n for n, _ in schema]
    )


ANCHOR = [("gram", pa.int64()), ("ctx", pa.int64()), ("parts", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())]
ANCHOR_SQL = "gram bigint, ctx bigint, parts bigint, doc bigint, at bigint"
LATE = -1
TOLD = [("doc", pa.int64()), ("at", pa.int64()), ("mask", pa.int64())]
TOLD_SQL = "doc bigint, at bigint, mask bigint"
EVERY = (1 << CLASSES) - 1
ALONE = 1 << CLASSES
SPAN = [("key", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("body", pa.binary())]
SPAN_SQL = "key bigint, doc bigint, at bigint, size bigint, body binary"


def scattered(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key of its own for rows that are decided already."""
    return mixed(doc.astype(U) * U(0x9E3779B97F4A7C15) + at.astype(U)).view(np.int64)


def _located(block: Block, i: int, starts: np.ndarray, core, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and byte of each place, and whether the place is in the block's own part."""
    k = np.searchsorted(starts, places, "right") - 1 if core is None else np.zeros(len(places), np.int64)
    byte = places - starts[k]
    mine = np.ones(len(places), bool) if core is None else (byte >= core[0]) & (byte < core[1])
    return i + k, byte, mine


def _anchored(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The anchors of the texts; `parts` is LATE, or some bits of every class's hash."""
    for batch in batches:
        docs, ties = _column(batch, 0), _column(batch, 1)
        data, ends = utf8(batch.column(2))
        found = []
        for block, i, starts, core in blocks(data, ends, window, gram):
            row, byte, mine = _located(block, i, starts, core, block.anchors)
            parts = np.zeros(len(block.anchors), U)
            for c in range(CLASSES):
                parts = (parts << U(CLASS_BITS)) | (block.shared(block.anchors, gram, c) >> U(64 - CLASS_BITS))
            at = (byte << 32) | ties[row]
            own = (block.grams[block.anchors].view(np.int64), block.contexts(gram).view(np.int64), parts.view(np.int64))
            found.append([x[mine] for x in (*own, docs[row], at)])
        if not found:
            continue
        g, ctx, parts, doc, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((at, doc, ctx, g))
        g, ctx, parts, doc, at = (x[order] for x in (g, ctx, parts, doc, at))
        late = np.zeros(len(g), bool)
        late[1:] = (g[1:] == g[:-1]) & (ctx[1:] == ctx[:-1]) & ((doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))
        g[late] = scattered(doc[late], at[late])
        ctx[late] = 0
        parts[late] = LATE
        yield _rows(ANCHOR, [g, ctx, parts, doc, at])


def _sorted_anchors(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Anchors in order of gram, ctx, doc, at: late ones, and those that share a class.

    mask: LATE where the whole context came before, else a bit for every class
    that another context of the same string shares. The rows of a string are held
    until they are complete, `hot` rows at most; beyond, all its classes count as
    shared and ALONE is set too.
    """
    held: list[np.ndarray] | None = None
    wide, before = None, None
    for batch in batches:
        cols = [_column(batch, k) for k in range(5)]
        if held is not None:
            cols = [np.concatenate((h, c)) for h, c in zip(held, cols, strict=True)]
        g = cols[0]
        if len(g) == 0:
            continue
        cut = int(np.searchsorted(g, g[-1], "left"))
        if len(g) - cut > hot:
            wide, cut = g[-1], len(g)
        if cut:
            yield _told([c[:cut] for c in cols], wide, before)
            before = [c[cut - 1] for c in cols]
        held = [c[cut:] for c in cols]
    if held is not None and len(held[0]):
        yield _told(held, wide, before)


def _told(cols: list[np.ndarray], wide, before: list | None) -> pa.RecordBatch:
    """Decide whole strings, and what there is of the one that is `wide`."""
    g, ctx, parts, doc, at = cols
    n = len(g)
    seen = np.zeros(n, bool)
    seen[1:] = (g[1:] == g[:-1]) & (ctx[1:] == ctx[:-1])
    twin = np.zeros(n, bool)
    twin[1:] = seen[1:] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])
    if before is not None and before[0] == g[0] and before[1] == ctx[0]:
        seen[0], twin[0] = True, before[3] == doc[0] and before[4] == at[0]
    late = (parts == LATE) | (seen & ~twin)
    mask = np.where(late, LATE, 0)
    open_ = np.flatnonzero(~late & ~twin)
    if wide is not None:
        mask[open_[g[open_] == wide]] = EVERY | ALONE
        open_ = open_[g[open_] != wide]
    for c in range(CLASSES):
        part = (parts[open_] >> (CLASS_BITS * (CLASSES - 1 - c))) & ((1 << CLASS_BITS) - 1)
        order = np.lexsort((part, g[open_]))
        same = (np.diff(g[open_][order]) == 0) & (np.diff(part[order]) == 0)
        both = np.zeros(len(order), bool)
        both[1:] |= same
        both[:-1] |= same
        mask[open_[order[both]]] |= 1 << c
    keep = (mask != 0) & ~twin
    return _rows(TOLD, [doc[keep], at[keep], mask[keep]])


def _windowed(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The windows of the wanted anchors by class; those repeated in the batch as spans.

    body: the places of a class's windows before the anchor, a byte each, and their
    hashes. A window that is dealt alone has itself for its class.
    """
    for batch in batches:
        docs, ties = _column(batch, 0), _column(batch, 1)
        texts = [unpacked(z.as_py()) for z in batch.column(2)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        wanted = batch.column(3)
        found = []
        for block, i, starts, core in blocks(data, ends, window, gram):
            own = [np.array(wanted[k].as_py(), np.int64) for k in range(i, i + len(starts))]
            places = np.concatenate([(w >> 8) + at for w, at in zip(own, starts, strict=True)])
            masks = np.concatenate(own) & 255
            order = np.argsort(places)
            places, masks = places[order], masks[order]
            # Of a long text, the anchors of this part only.
            _, _, mine = _located(block, i, starts, core, places)
            places, masks = places[mine], masks[mine]
            begin, name = block.windows(places)
            back = name - begin
            kind = block.class_of(back)
            mask = masks[np.searchsorted(places, name)]
            take = (mask >> kind) & 1 == 1
            begin, name, back, kind, mask = (x[take] for x in (begin, name, back, kind, mask))
            value = block.hashes.at(begin, window)
            key = np.empty(len(begin), U)
            for c in range(CLASSES):
                key[kind == c] = block.shared(name[kind == c], gram, c)
            alone = mask & ALONE != 0
            key[alone] = joined(key[alone], value[alone])
            row, byte, _ = _located(block, i, starts, core, name)
            found.append([key.view(np.int64), value.view(np.int64), docs[row], (byte << 32) | ties[row], back])
        if not found:
            continue
        key, value, doc, at, back = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((at, doc, value, key))
        key, value, doc, at, back = (x[order] for x in (key, value, doc, at, back))
        late = np.zeros(len(key), bool)
        late[1:] = (key[1:] == key[:-1]) & (value[1:] == value[:-1]) & ((doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))
        d, a, size = _runs(doc[late], at[late] - (back[late] << 32), window)
        yield _rows(SPAN, [scattered(d, a), d, a, size, [None] * len(d)])
        yield _packed(*(x[~late] for x in (key, value, doc, at, back)))


def _packed(key: np.ndarray, value: np.ndarray, doc: np.ndarray, at: np.ndarray, back: np.ndarray) -> pa.RecordBatch:
    """One row for each key and anchor."""
    order = np.lexsort((back, at, doc, key))
    key, value, doc, at, back = (x[order] for x in (key, value, doc, at, back))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(key))[: len(head)]
    places = back.astype(np.uint8)
    body = [places[i:j].tobytes() + value[i:j].tobytes() for i, j in zip(head.tolist(), tail.tolist(), strict=True)]
    return _rows(SPAN, [key[head], doc[head], at[head], np.zeros(len(head), np.int64), body])


def _runs(doc: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that start next to each other as one span: doc, at, size."""
    tie, byte = at & 0xFFFFFFFF, at >> 32
    order = np.lexsort((byte, tie, doc))
    doc, at, byte, tie = doc[order], at[order], byte[order], tie[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (byte[1:] > byte[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc))[: len(head)] - 1
    return doc[head], at[head], byte[tail] - byte[head] + window


def _sorted_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Spans decided before, and windows seen before, in order of key, doc, at.

    What was seen of the last key is carried on: HOT times the windows of a class
    at most, one window where they are dealt alone.
    """
    last, known = None, np.zeros(0, np.int64)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        key, doc, at, size = (_column(batch, k) for k in range(4))
        told = size > 0
        yield _rows(SPAN, [key[told], doc[told], at[told], size[told], [None] * int(told.sum())])
        twin = np.zeros(len(key), bool)
        twin[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])
        if last is not None:
            twin[0] = (key[0], doc[0], at[0]) == last
        rows = np.flatnonzero(~told & ~twin)
        raw = [b.as_py() for b in batch.column(4).take(pa.array(rows))]
        counts = np.array([len(b) // 9 for b in raw], np.int64)
        back = np.frombuffer(b"".join(b[:n] for b, n in zip(raw, counts.tolist(), strict=True)), np.uint8)
        value = np.frombuffer(b"".join(b[n:] for b, n in zip(raw, counts.tolist(), strict=True)), np.int64)
        row = np.repeat(rows, counts)
        keys = key[row]
        if last is not None:
            value, keys = np.concatenate((known, value)), np.concatenate((np.full(len(known), last[0]), keys))
        old = len(value) - len(row)
        order = np.lexsort((value, keys))
        again = np.zeros(len(order), bool)
        again[order[1:]] = (keys[order][1:] == keys[order][:-1]) & (value[order][1:] == value[order][:-1])
        late = np.flatnonzero(again[old:])
        start = at[row[late]] - (back[late].astype(np.int64) << 32)
        d, a, n = _runs(doc[row[late]], start, window)
        yield _rows(SPAN, [np.zeros(len(d), np.int64), d, a, n, [None] * len(d)])
        last = (key[-1], doc[-1], at[-1])
        known = np.unique(value[keys == last[0]])


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, spans, shas = [], [], [], []
        for text, cuts in zip(batch.column(1), batch.column(2), strict=True):
            raw = unpacked(text.as_py())
            runs: list[list[int]] = []
            for c in sorted((c["lo"], c["hi"]) for c in cuts.as_py() or ()):
                lo, hi = max(c[0], 0), min(c[1], len(raw))
                if hi - lo < window:
                    continue
                if runs and lo <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], hi)
                else:
                    runs.append([lo, hi])
            kept, at = sha256(), 0
            for lo, hi in runs:
                kept.update(raw[at:lo])
                at = hi
            kept.update(raw[at:])
            sizes.append(len(raw))
            removed.append(sum(hi - lo for lo, hi in runs))
            spans.append(len(runs))
            shas.append(kept.hexdigest())
        cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(shas, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(
    docs: DataFrame, doc_id: str, text: str, window: int = WINDOW, gram: int = GRAM, hot: int = HOT
) -> tuple[DataFrame, DataFrame]:
    """The packed texts with their keys, and for each key the spans [lo, hi) to remove.

    Both are dealt by (doc, tie), so that texts move once for both of their uses.
    """
    reach = window - gram
    low = F.lit(0xFFFFFFFF)
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"),
        F.xxhash64(text_or_empty(text)).bitwiseAND(low).alias("tie"),
        text_or_empty(text).alias("text"),
    )
    anchors = keyed.select("doc", "tie", "text").mapInArrow(lambda it: _anchored(it, window, gram), ANCHOR_SQL)
    anchors = anchors.repartition("gram").sortWithinPartitions("gram", "ctx", "doc", "at")
    told = written(anchors.mapInArrow(lambda it: _sorted_anchors(it, hot), TOLD_SQL)).withColumns(
        {"tie": F.col("at").bitwiseAND(low), "byte": F.shiftright("at", 32)}
    )
    wanted = told.where(F.col("mask") != LATE).groupBy("doc", "tie")
    wanted = wanted.agg(F.collect_list(F.shiftleft("byte", 8) + F.col("mask")).alias("wanted"))
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    texts = keyed.mapInArrow(packed, f"doc_id {kind}, doc bigint, tie bigint, packed binary").repartition("doc", "tie")
    windows = texts.join(wanted, ["doc", "tie"]).select("doc", "tie", "packed", "wanted", "doc_id")
    windows = windows.mapInArrow(lambda it: _windowed(it, window, gram), SPAN_SQL)
    windows = windows.repartition("key").sortWithinPartitions("key", "doc", "at")
    spans = windows.mapInArrow(lambda it: _sorted_windows(it, window), SPAN_SQL).select(
        "doc",
        F.col("at").bitwiseAND(low).alias("tie"),
        F.shiftright("at", 32).alias("lo"),
        (F.shiftright("at", 32) + F.col("size")).alias("hi"),
    )
    late = told.where(F.col("mask") == LATE).select(
        "doc", "tie", (F.col("byte") - reach).alias("lo"), (F.col("byte") + window).alias("hi")
    )
    return texts, spans.unionByName(late)


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Bytes (UTF-8; null text is empty) that lie in a string of `window` bytes which
    also starts earlier are removed: in a document of smaller id, or in the same
    document further left. Identifiers are whole numbers; a null one comes last.
    Rows that share an identifier with different texts count as further documents,
    in order of a hash of the text; equal rows are one document and come out alike.
    Texts shorter than `window` lose nothing. An empty table gives an empty result;
    other columns are not looked at.
    """
    if not 0 < gram <= window - CLASSES or window - gram > 255:
        raise ValueError("window must be 4 to 255 bytes longer than gram")
    texts, spans = repeated_spans(docs, doc_id, text, window, gram, hot)
    cuts = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))
    rows = texts.join(cuts, ["doc", "tie"], "left").select("doc_id", "packed", "cuts")
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    shape = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return rows.mapInArrow(lambda it: _cut(it, window), shape)
