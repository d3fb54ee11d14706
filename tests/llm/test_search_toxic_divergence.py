"""Ranked search, toxicity and divergence against plain models."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from llm_rows import prose, row
from pyspark.sql import functions as F

from corpusmill.llm import catalog, ranked, toxicity
from corpusmill.llm import divergence as div

SF1 = "/root/testdata/sf0.1"

UPPER = {c: chr(c + 32) for c in range(65, 91)}


def terms_of(text, digits=True):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" if digits else r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    return re.findall(pattern, (text or "").translate(UPPER))


def some_text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


# ------------------------------------------------------------------ ranked search


def full_scan(docs, items, k):
    """The contract, word for word: docs (doc_id, text), items (item_id, text)."""
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = set(terms_of(text))
        found = []
        for doc, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // length
            score = 0
            for t in asked & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, doc is not None, doc))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(found[:k])]
    return sorted(out, key=str)


def results(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block", [3, 50, 8192])
def test_ranked_search_equals_a_full_scan(spark, block):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Éa", "ÜB", "x9"]
    common = ["the", "of", "and"]
    docs = []
    for k in range(300):
        own = some_text(rng, words[: rng.randint(2, 63)] + common * 4, rng.randint(0, 60))
        docs.append((k, own))
    docs += [(400 + k, "w1 w2 w3") for k in range(40)]  # ties beyond the k-th place
    items = [(k, some_text(rng, words + common, rng.randint(1, 14))) for k in range(25)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    got = results(ranked.ranked_search(frame, asked, k=10, block=block))
    assert got == full_scan(docs, items, 10)


def test_ranked_search_on_odd_rows(spark, frame, odd):
    items = [(1, prose(1)), (1, prose(3)), (2, None), (3, "!!"), (None, prose(2)), (4, "ÜB nowhere"), (1, prose(1))]
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit("x"))
    docs = [(r[0], r[1]) for r in odd]
    assert results(ranked.ranked_search(frame(odd), asked)) == full_scan(docs, items, 50)
    empty = frame([])
    assert ranked.ranked_search(empty, asked).collect() == []
    assert ranked.ranked_search(frame(odd), asked.limit(0)).collect() == []
    assert ranked.ranked_search(frame([row(1, None), row(2, "")]), asked).collect() == []


def test_items_in_several_turns(spark, monkeypatch):
    docs = [(k, prose(k, 20)) for k in range(60)]
    items = [(k, prose(k, 6)) for k in range(20)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(ranked, "ITEM_CHARS", 200)
    assert results(ranked.ranked_search(frame, asked, k=5)) == full_scan(docs, items, 5)


def test_pair_bounds_skip_what_single_bounds_do_not():
    # Terms 0 and 1 are each in the block with high impact, never in one document.
    block = ranked.Block(4, np.array([0, 1]), np.array([0, 1, 2]), np.array([0, 3]), np.array([10, 9]))
    none = np.zeros(0, np.int64)
    apart = [(10, 10, None, 0, 1)]
    assert ranked.score_block(block, apart, none, none, 15) is None
    alone = [(10, 10, None, 0, -1), (9, 9, None, 1, -1)]
    assert ranked.score_block(block, alone, none, none, 15) is None  # found out only by scoring
    assert sum(b[0] for b in apart) < 15 <= sum(b[0] for b in alone)
    # Both meet in document 2: only that one can reach the threshold.
    block = ranked.Block(4, np.array([0, 1]), np.array([0, 2, 4]), np.array([0, 2, 2, 3]), np.array([10, 8, 9, 9]))
    met = [(17, 10, 0, 0, 1)]
    at, score = ranked.score_block(block, met, np.array([2]), np.array([0, 1]), 15)
    assert at.tolist() == [2] and score.tolist() == [17]


def test_terms_of_parts_equal_the_whole():
    text = ("Été x1-yy ZZ\n" * 50 + "a" * 40 + " é").encode()
    for span in (1, 3, 16, 1000, 1 << 20):
        assert ranked.term_counts(text, span) == Counter(x.encode() for x in terms_of(text.decode()))
        got = [t for part in div.spans(text, span) for t in part.translate(div.FOLDED).split()]
        assert got == [x.encode() for x in terms_of(text.decode(), digits=False)]


# ---------------------------------------------------------------------- toxicity


def is_held_out(doc_id):
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def toxic_corpus(n=1500):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(n):
        text, bad = prose(k, rng.randint(5, 60)), k % 5 == 0
        if bad:
            spot = rng.randint(0, len(text))
            text = text[:spot] + rng.choice([" Zorkwit ", " zorkwits\n", " blagtuz "]) + text[spot:]
        docs.append(row(k, text))
        labels.append((k, int(bad)))
    return docs, labels


def test_toxicity_of_held_out_documents(spark, frame):
    docs, labels = toxic_corpus()
    given = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame(docs), given).collect()}
    assert len(got) == len(docs)
    own = dict(labels)
    out = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in out} == {k for k in own if is_held_out(k)}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert sum(r.predicted == own[r.doc_id] for r in out) >= 0.97 * len(out)
    # Held-out labels, languages and sources don't bear on any score.
    turned = [(k, 1 - v if is_held_out(k) else v) for k, v in labels]
    other = [(d[0], d[1], "xx", None, *d[4:]) for d in docs]
    again = toxicity.toxicity(frame(other), spark.createDataFrame(turned, "doc_id bigint, toxic int"))
    assert {r.doc_id: r.score for r in again.collect()} == {k: r.score for k, r in got.items()}


def test_toxicity_scores_equal_a_plain_model(spark, frame):
    docs, labels = toxic_corpus(300)
    given = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(frame(docs), given)
    long = "abc zorkwit " * 40_000
    docs = [*docs, row(9001, long), row(9002, None), row(9003, "")]
    got = {r.doc_id: r.score for r in toxicity.scores(frame(docs), ["doc_id"], "text", model).collect()}

    def feature(gram):
        key = 0
        for c in gram:
            key = (key * 0x100000001B3 + ord(c) + 1) % 2**64
        return ((key * 0x9E3779B97F4A7C15) % 2**64 >> 32) % toxicity.BUCKETS

    for d in docs[::17] + docs[-3:]:
        text = re.sub(r"[\t-\r]", " ", f" {(d[1] or '').lower()} ")
        grams = {text[i : i + n] for n in (4, 5, 6) for i in range(len(text) - n + 1)}
        held = {feature(g) for g in grams}
        margin = sum(model["weights"][b] for b in held) + model["bias"]
        assert got[d[0]] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)


def test_toxicity_query_on_held_out_documents(spark):
    """The registered query over the whole table against the labels it has not seen."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "lang").collect()}
    got = catalog.op12_toxicity(spark, SF1).collect()
    assert len(got) == len(langs)
    out = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in out) >= 0.95 * len(out)
    clean = [r for r in out if not labels[r.doc_id]]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    english = [r for r in out if labels[r.doc_id] and langs[r.doc_id] == "en"]
    assert sum(r.predicted for r in english) >= 0.85 * len(english)


def test_ratios_count_every_learning_row(spark, frame):
    docs, labels = toxic_corpus(200)
    given = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    rows = toxicity.learning_rows(frame(docs), given, "doc_id", "text", "toxic", 10_000).collect()
    own = dict(labels)
    assert Counter(r.label for r in rows) == Counter(own[k] for k in own if not is_held_out(k))
    few = toxicity.learning_rows(frame(docs), given, "doc_id", "text", "toxic", 7).collect()
    assert Counter(r.label for r in few) == {0: 7, 1: 7}


def test_toxicity_on_odd_rows(spark, frame, odd):
    shape = "doc_id bigint, toxic int, score string, held_out int"
    labels = [(1, 1, "x", 0), (1, 0, "x", 0), (2, 0, "x", 0), (None, 1, "x", 0), (4, None, "x", 0), (7, 3, "x", 0), (8, 0, "x", 0), (6, 1, "x", 0)]
    for given in (labels, labels[:1], [(2, 0, "x", 0)], []):
        got = toxicity.toxicity(frame(odd), spark.createDataFrame(given, shape)).collect()
        assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
        assert got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    assert toxicity.toxicity(frame([]), spark.createDataFrame(labels, shape)).collect() == []
    one = toxicity.toxicity(frame(odd), spark.createDataFrame([(2, 0, "x", 0)], shape)).collect()
    assert {r.score for r in one} == {0.0}


# -------------------------------------------------------------------- divergence


def plain_divergence(docs, least, top=50):
    """docs: (lang, source, text)."""
    docs = [(a or "", b or "", terms_of(t, digits=False)) for a, b, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= least]
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, ts in own:
            counts[s].update(t for t in ts if df[t] >= least)
        total = sum(counts.values(), Counter())
        p_of = lambda c, t: 1 + (10**9 * (c[t] + 5)) // (c.total() + 5 * len(kept))
        for s in counts:
            pairs = [
                (sum(abs(p_of(counts[s], t) - p_of(counts[o], t)) for t in kept), o) for o in counts if o != s
            ]
            terms = [
                (p_of(counts[s], t) - p_of(total, t), t)
                for t in kept
                if counts[s][t] > 0 and p_of(counts[s], t) > p_of(total, t)
            ]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, x, v, r + 1) for r, (v, x) in enumerate(found[:most])]
    return sorted(out, key=str)


def audited(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()), key=str)


@pytest.mark.parametrize("first, bits, tiles", [(4, 1 << 26, (1024, 128)), (1, 64, (5, 2)), (2, 1 << 12, (7, 3))])
def test_divergence_equals_a_plain_model(spark, monkeypatch, first, bits, tiles):
    rng = random.Random(first)
    words = [prose(k, 1) for k in range(40)] + ["a", "ab", "abc", "abcd", "abcde", "Éé", "é", "x" * 70, "B7c"]
    rows = []
    for k in range(400):
        lang = rng.choice(["en", "en", "en", "de", None])
        source = rng.choice(["s0", "s1", "s2", "s3", "s4", "S", "é", None])
        rows.append((lang, source, some_text(rng, words[: rng.randint(1, len(words))], rng.randint(0, 30))))
    rows += [("fr", "f1", "rare words"), ("fr", "f2", None), ("it", "only", "x"), ("en", "empty", "")]
    monkeypatch.setattr(div, "TILE_TERMS", tiles[0])
    monkeypatch.setattr(div, "TILE_SOURCES", tiles[1])
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert audited(div.divergence(frame, least=12, top=9, first=first, bits=bits)) == plain_divergence(rows, 12, 9)


def test_divergence_on_odd_rows(frame, odd):
    rows = [(r[2], r[3], r[1]) for r in odd]
    assert audited(div.divergence(frame(odd), least=2)) == plain_divergence(rows, 2)
    assert audited(div.divergence(frame(odd))) == plain_divergence(rows, 30)
    assert div.divergence(frame([])).collect() == []


def test_prefixes_below_the_threshold_are_discarded(frame, monkeypatch):
    docs = frame([row(k, f"common{'xyz'[k % 3]}long rare{chr(97 + k % 26)}{chr(97 + k // 26)}word") for k in range(90)])
    levels = []
    own = div.written
    monkeypatch.setattr(div, "written", lambda df: levels.append(own(df)) or levels[-1])
    kept = div.kept_terms(docs.select("lang", "source", "text"), least=30, first=4)
    assert {bytes(r.prefix).rstrip(b"\0").decode(): r.n_docs for r in kept.collect()} == {f"common{c}long": 30 for c in "xyz"}
    assert [sorted(bytes(r.prefix).rstrip(b"\0") for r in x.collect()) for x in levels] == [
        [b"comm", b"rare"],
        [b"commonxl", b"commonyl", b"commonzl"],
        [b"commonxlong", b"commonylong", b"commonzlong"],
    ]


def test_terms_and_prefixes_of_a_block():
    texts = ["", "Abc dé", "x", "1a2", "", "word " + "q" * 40, "ÄÖ", "tail"]
    got = div.Terms([t.encode() for t in texts])
    want = [(k, t.encode()) for k, x in enumerate(texts) for t in terms_of(x, digits=False)]
    assert [(k, bytes(got.bytes[a : a + n])) for k, a, n in zip(got.text, got.start, got.size)] == want
    for width in (1, 4, 8, 16, 64):
        words = got.prefix(np.arange(len(want)), width).astype(">u8")
        assert [bytes(w.tobytes()).rstrip(b"\0") for w in words] == [t[:width] for _, t in want]
    assert len(div.Terms([]).start) == len(div.Terms([b"", b" 1"]).start) == 0


def test_long_texts_count_once_for_a_prefix(frame):
    """Texts beyond a block: distinct terms for the levels, parts for the occurrences."""
    rows = [row(k, f"alpha beta {'gamma ' * 30} w{'xyz'[k % 3]}", source="ab"[k % 2]) for k in range(6)] + [row(9, "alpha", source="a")]
    got = audited(div.divergence(frame(rows), least=3, block=40))
    assert got == plain_divergence([(r[2], r[3], r[1]) for r in rows], 3)
    raw = rows[0][1].encode()
    assert div.distinct_terms(raw) == b"alpha beta gamma wx" and len(list(div.spans(raw, 40))) > 3
