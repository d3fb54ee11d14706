"""Near duplicates, repeated strings, packing and the pipeline against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from llm_rows import prose, row

import corpus_pipeline
from corpusmill.llm import catalog, near, packing, substrings

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------------------- near


def labelled(text):
    w = (text or "").split()
    n, out = Counter(), set()
    for k in range(max(len(w) - 4, 1)):
        g = tuple(w[k : k + 5])
        n[g] += 1
        out.add((g, n[g]))
    return out if w else set()


def classes(texts):
    """Components of documents with labelled shingle similarity of 0.8 or more."""
    sets = {k: labelled(t) for k, t in texts.items()}
    at = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            at[x].append(k)
    both = Counter()
    for ks in at.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                both[b, a] += 1
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, b), n in both.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    blank = [k for k, s in sets.items() if not s]
    for k in blank:
        root[k] = min(blank)
    return {k: find(k) for k in texts}


def edited(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_against_brute_force(frame):
    rng = random.Random(3)
    texts = {}
    for k in range(60):
        texts[k] = prose(k, rng.choice((3, 20, 100, 300)))
    for k in range(60, 160):
        t = texts[rng.randrange(60)]
        texts[k] = edited(t, len(t.split()) * rng.choice((0, 1, 2, 3, 6)) // 100, rng)
    common = prose(999, 60)
    for k in range(160, 200):
        texts[k] = prose(k, 40) + " " + common + " " + prose(-k, 40)
    texts |= {200: None, 201: "", 202: " \n", 203: "x " * 500, 204: "x " * 480, 205: "x " * 100}
    got = near.near_classes(frame([row(k, t) for k, t in texts.items()])).collect()
    want = classes(texts)
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.class_id for r in catalog.op5_minhash_near_dedup(spark, SF).collect()}
    assert got == classes(texts)


def test_near_odd_rows(frame, odd):
    docs = frame(odd)
    got = near.near_classes(docs).collect()
    assert len(got) == len(odd)
    by = defaultdict(list)
    for r in got:
        by[r.class_id if r.class_id is not None else "none"].append(r)
    assert {r.doc_id for r in by[1]} == {1, 2} and {r.doc_id for r in by[7]} == {7, 8}
    left = near.drop_near(docs)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert max(ids.values()) == 1 and 2 not in ids and 8 not in ids and {1, 3, 6, 7, 10} <= set(ids)
    assert near.near_classes(docs.limit(0)).collect() == [] and near.drop_near(docs.limit(0)).collect() == []


def test_near_texts_of_one_identifier_keep_their_links(frame):
    rng = random.Random(2)
    a, b = prose(1, 100), prose(2, 100)
    rows = [row(1, a), row(1, b), row(2, edited(a, 2, rng)), row(3, edited(b, 2, rng)), row(4, prose(4)), row(5, a), row(None, b)]
    got = near.near_classes(frame(rows)).collect()
    assert [r.class_id for r in sorted(got, key=str) if r.doc_id != 4] == [1] * 6
    assert {r.doc_id: (r.class_id, r.class_size) for r in got if r.doc_id == 4} == {4: (4, 1)}
    assert sum(r.kept for r in got if r.class_id == 1) == 1
    # Without the shared identifier the two stay apart.
    apart = [row(10, b) if r[1] == b and r[0] == 1 else r for r in rows]
    got = {(r.doc_id, r.class_id) for r in near.near_classes(frame(apart)).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (3, 3), (10, 3), (None, 3), (4, 4)}


def test_near_frequent_shingles_meet_in_parts(frame, monkeypatch):
    """The parts of a shingle's rows change nothing in the classes."""
    rng = random.Random(12)
    passage = prose(5000, 100)
    texts = {k: f"{passage} {prose(6000 + k, 18)}" for k in range(120)}
    for k in range(120, 160, 2):
        own = prose(6000 + k, 7)
        for i in (k, k + 1):
            texts[i] = f"{passage} {own} {prose(7000 + i, 11)}"
    order = list(texts)
    rng.shuffle(order)
    rows = [row(k, texts[k]) for k in order]
    monkeypatch.setattr(near, "PER_KEY", 2)
    got = {r.doc_id: r.class_id for r in near.near_classes(frame(rows)).collect()}
    assert got == classes(texts)


def test_near_hot_group_stays_linear(frame, monkeypatch):
    rng = random.Random(5)
    text = prose(1, 400)
    rows = [row(k, edited(text, 4, rng)) for k in range(300)]
    asked = []
    real = near.candidates
    monkeypatch.setattr(near, "candidates", lambda *a: asked.append(real(*a).count()) or real(*a))
    got = near.near_classes(frame(rows)).collect()
    assert {r.class_id for r in got} == {0}
    assert asked[0] < 300 * near.SKETCHES * near.PIVOTS and sum(asked[1:]) == 0


def test_near_pairs_behind_a_hot_passage(frame, monkeypatch):
    rng = random.Random(11)
    passage = prose(5000, 200)
    texts = {k: f"{passage} {prose(6000 + k, 35)}" for k in range(400)}
    for k in range(400, 480, 2):
        own = prose(6000 + k, 13)
        for i in (k, k + 1):
            texts[i] = f"{passage} {own} {prose(7000 + i, 22)}"
    order = list(texts)
    rng.shuffle(order)
    asked = []
    real = near.remaining
    monkeypatch.setattr(near, "remaining", lambda *a: asked.append(real(*a).count()) or real(*a))
    want = classes(texts)
    assert sum(k != v for k, v in want.items()) >= 30
    got = near.near_classes(frame([row(k, texts[k]) for k in order])).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert asked and asked[0] < 2 * len(texts)


def test_alignment_against_dynamic_programming():
    rng = random.Random(7)
    for _ in range(200):
        a = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 40))], np.uint64)
        b = a.tolist()
        for _ in range(rng.randrange(6)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(6)) if rng.random() < 0.5 else b and b.pop(rng.randrange(len(b)))
        b = np.array(b, np.uint64)
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        hit = int(best[-1, -1])
        assert near.matched(a, b, len(a) + len(b)) == hit
        if len(b):
            assert near.similar(a, b) == (hit >= 0.8 * (len(a) + len(b) - hit))


def test_word_hashes():
    texts = ["a bc  d\n", "", " \t", "bc", "é\x0bbc a"]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([0, *map(len, raw)])
    words, counts = near.word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends)
    assert counts.tolist() == [3, 0, 0, 1, 3]
    assert words[1] == words[3] == words[5] and words[0] == words[6] and len(set(words.tolist())) == 4


# ---------------------------------------------------------------- substrings


def removed(texts, window):
    seen, out = set(), {}
    for k in sorted(texts):
        raw = (texts[k] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if raw[i : i + window] in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(raw[i : i + window])
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def facts(r):
    return r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256


def test_substrings_against_brute_force(frame):
    for seed in range(3):
        rng = random.Random(seed)
        pool = ["".join(rng.choice("ab é\n") for _ in range(rng.randrange(20, 300))) for _ in range(12)]
        texts = {k: "".join(rng.choice(pool)[rng.randrange(15) :] for _ in range(rng.randrange(5))) for k in range(40)}
        texts |= {40: None, 41: "a" * 700, 42: "ab" * 300, 43: "a" * 99, 44: "a" * 100}
        docs = frame([row(k, t) for k, t in texts.items()])
        for window, gram in ((100, 32), (30, 9)):
            got = substrings.without_repeats(docs, window=window, gram=gram).collect()
            assert {r.doc_id: facts(r) for r in got} == removed(texts, window)


def test_substrings_long_text_in_parts(frame):
    rng = random.Random(9)
    big = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    texts = {1: big, 2: big[400_000:700_000] + "zz" + big[10:900_000], 3: big[524_200:524_400], 4: "q" + big[-150:]}
    got = substrings.without_repeats(frame([row(k, t) for k, t in texts.items()])).collect()
    assert {r.doc_id: facts(r) for r in got} == removed(texts, 100)


def test_substrings_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = catalog.op9_substring_dedup(spark, SF).collect()
    assert {r.doc_id: facts(r) for r in got} == removed(texts, 100)


def test_substrings_odd_rows(frame, odd):
    got = substrings.without_repeats(frame(odd)).collect()
    assert len(got) == len(odd)
    twice = [r for r in got if r.doc_id == 2]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].n_removed == twice[0].n_bytes
    assert next(r for r in got if r.doc_id == 1).n_removed == 0
    none = [r for r in got if r.doc_id is None]
    assert all(r.n_removed == r.n_bytes > 0 for r in none), "a null identifier comes last"
    assert substrings.without_repeats(frame(odd).limit(0)).collect() == []


# ------------------------------------------------------------------- packing


def plain_pack(sizes, sources, clusters, capacity):
    bins, out = [], []
    for s, a, b in zip(sizes, sources, clusters, strict=True):
        fits = [
            (room, k)
            for k, (room, sa, sb) in enumerate(bins)
            if room >= s and not (a >= 0 and a in sa) and not (b >= 0 and b in sb)
        ]
        if fits:
            _, k = min(fits)
        else:
            k = len(bins)
            bins.append([capacity, set(), set()])
        bins[k][0] -= s
        bins[k][1].add(a)
        bins[k][2].add(b)
        out.append(k)
    return out


def test_best_fit_against_a_full_search():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 80)
        sizes = sorted((rng.randrange(1, 100) for _ in range(n)), reverse=True)
        sources = [rng.randrange(-1, 6) for _ in range(n)]
        clusters = [rng.randrange(-1, 20) for _ in range(n)]
        got = packing.best_fit(*map(np.array, (sizes, sources, clusters)), 100)
        assert got.tolist() == plain_pack(sizes, sources, clusters, 100)


def test_pack_keeps_every_word_and_no_conflict(frame, odd):
    rows = [*odd, *(row(100 + k, prose(k % 50, 30 + k % 90), source="abcdefg"[k % 7]) for k in range(400))]
    docs = frame(rows)
    got = packing.pack(docs, capacity=200, shard_rows=150).collect()
    words = Counter()
    for r in rows:
        words[r[0]] += len((r[1] or "").split())
    have = Counter()
    for r in got:
        have[r.doc_id] += r.n_words
        assert r.start_word == r.piece * 200 and (r.n_words > 0) == (r.bin_id is not None)
    assert +have == +words
    bins = defaultdict(list)
    for r in got:
        if r.bin_id:
            bins[r.bin_id].append(r)
    known = {r[0]: r for r in rows if r[0] not in (None, 2, 9)}
    for own in bins.values():
        assert sum(r.n_words for r in own) == own[0].bin_words <= 200 and len(own) == own[0].bin_docs
        named = [known[r.doc_id] for r in own if r.doc_id in known]
        for key in (3, 1):
            held = [r[key] for r in named if r[key] is not None]
            assert len(held) == len(set(held)), "one source, one text to a bin"
    assert {r.bin_id for r in got if r.doc_id in (3, 4)} == {None}
    assert packing.pack(docs.limit(0)).collect() == []


def test_pack_by_a_given_cluster(frame):
    docs = frame([row(k, prose(k, 10), source=None, extra=1 if k < 5 else None) for k in range(10)])
    got = {r.doc_id: r.bin_id for r in packing.pack(docs, cluster="label", capacity=1000).collect()}
    assert len({got[k] for k in range(5)}) == 5 and all(got[k] in {got[j] for j in range(5)} for k in range(5, 10))


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        seen[name] = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert seen[name].columns == docs.columns
        before = seen[name]
    ids = {k: Counter(r.doc_id for r in v.select("doc_id").collect()) for k, v in seen.items()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(ids["language_id"]) == {k for k, t in texts.items() if any(c.isalpha() for c in t)}
    last = {}
    for k in sorted(ids["language_id"]):
        last[texts[k]] = k
    assert set(ids["exact_dedup"]) == set(last.values())
    assert set(ids["near_dedup"]) == set(classes({k: texts[k] for k in ids["exact_dedup"]}).values())
    assert set(ids["mix_sources"]) <= set(ids["near_dedup"]) and max(ids["mix_sources"].values()) <= 3
    packed = seen["best_fit_packing"]
    words = Counter()
    for r in packed.collect():
        words[r.doc_id] += r.n_words
    assert words == {k: n * len(texts[k].split()) for k, n in ids["mix_sources"].items()}
    assert sorted(map(str, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "n_words").collect())) == sorted(
        map(str, packed.select("doc_id", "piece", "n_words").collect())
    )


def test_pipeline_on_odd_rows(frame, odd):
    docs = frame(odd)
    for rows in (docs, docs.limit(0)):
        left = rows
        for name, stage in corpus_pipeline.STAGES:
            left = stage(rows.sparkSession, left, SF)
            if name != "best_fit_packing":
                assert left.columns == docs.columns
        left.collect()
