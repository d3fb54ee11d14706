"""Exact dedup, mixing and quality rules against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from llm_rows import prose, row
from pyspark.sql import functions as F

from corpusmill.llm import catalog, exact, mixture, quality

SF = "/root/testdata/sf0.001"


def test_exact_groups(frame, odd):
    for runs, fan_in in ((4096, 64), (8, 2), (1, 2)):
        got = exact.exact_dedup(frame(odd), runs=runs, fan_in=fan_in).collect()
        assert len(got) == len(odd)
        texts = Counter(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in odd)
        best = {}
        for r in odd:
            k = hashlib.sha256((r[1] or "").encode()).hexdigest()
            ids = [x for x in (best.get(k), r[0]) if x is not None]
            best[k] = max(ids) if ids else None
        for r in got:
            assert r.group_size == texts[r.text_sha256] and r.keep_id == best[r.text_sha256]
        assert Counter(r.text_sha256 for r in got if r.kept) == dict.fromkeys(texts, 1)


def test_exact_smallest_and_normalised(frame):
    docs = frame([row(3, "A b"), row(1, "a B"), row(2, "c")])
    got = {r.doc_id: r for r in exact.exact_dedup(docs, keep="smallest", normalise=F.lower).collect()}
    assert got[3].keep_id == 1 and not got[3].kept and got[1].kept and got[2].group_size == 1
    assert got[1].text_sha256 == hashlib.sha256(b"a b").hexdigest()


def test_exact_drop_keeps_columns_and_one_row_each(frame, odd):
    docs = frame(odd)
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    assert Counter(r.text or "" for r in left.collect()) == dict.fromkeys({r[1] or "" for r in odd}, 1)
    assert exact.drop_copies(docs.limit(0)).collect() == []


def test_exact_hot_group_meets_few_entries(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact.exact_dedup(docs).where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id")).first()
    assert tuple(got) == (6667, 19998, 19998)


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > most * sizes[s] + 1e-9}
        if not over:
            return out | {s: w[s] * level for s in open_}
        out |= {s: most * sizes[s] for s in over}
        open_ -= over
    return out


def test_mix_meets_targets(frame):
    rows = [row(k, prose(k, 1 + k % 37), source="abc"[k % 3]) for k in range(300)]
    rows += [row(1000 + k, prose(k, 40), source=None) for k in range(40)]
    rows += [row(2000, "one two", source="aa"), row(2001, None, source="e"), row(2002, "", source="e")]
    docs = frame(rows)
    got = mixture.mix_sources(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = targets(sizes)
    taken = Counter()
    for r in got:
        assert r.size == len((next(x[1] for x in rows if x[0] == r.doc_id) or "").split())
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 3
    assert sorted(map(str, got)) == sorted(map(str, mixture.mix_sources(docs.repartition(7)).collect()))
    copies = Counter(r.doc_id for r in mixture.mixed_documents(docs).collect())
    assert copies == {r.doc_id: r.copies for r in got if r.copies}


def test_mix_with_inclusion_weights(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text"), F.lit("s").alias("source"),
                                    F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    other = docs.withColumn("source", F.lit("t")).limit(400)
    got = mixture.mix_sources(docs.unionByName(other), inclusion="w", weights=(1, 3)).where("source = 's'")
    n = {r.even: r.n for r in got.groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(F.sum((F.col("taken") > 0).cast("int")).alias("n")).collect()}
    assert n[True] > n[False]


def test_mix_with_null_and_repeated_identifiers(frame):
    """Rows that share an identifier are taken one by one: targets are met."""
    rows = [row(None, prose(k, 30 + k % 50), source="nulls") for k in range(600)]
    rows += [row(7, "one two three " * 15, source="equal")] * 600
    rows += [row(8, prose(k, 20), source="shared") for k in range(300)]
    rows += [row(1000 + k, prose(k, 60), source="own") for k in range(500)]
    docs = frame(rows)
    got = mixture.mix_sources(docs).collect()
    assert len(got) == len(rows)
    per = {}
    for r in got:
        target, taken = per.get(r.source, (r.target, 0))
        per[r.source] = (target, taken + r.taken)
        assert 0 <= r.taken <= 3 * r.size
    for source, (target, taken) in per.items():
        assert abs(taken - target) <= 80, source
    again = mixture.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mixture.mixed_documents(docs)
    words = out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " +"))).alias("n")).collect()
    assert {r.source: r.n for r in words} == {s: taken for s, (_, taken) in per.items()}


def test_mix_inclusion_by_size_over_many_seeds(spark):
    """Long and short documents are taken for the fraction as often as their inclusion says."""
    sizes = [100, 1000]
    docs = spark.range(1200).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), F.when(F.col("id") % 2 == 0, sizes[0]).otherwise(sizes[1])).alias("text"),
        F.when(F.col("id") < 800, "a").otherwise("b").alias("source"),
    )
    seen, runs = {0: 0, 1: 0}, 6
    for seed in range(runs):
        got = mixture.mix_sources(docs, weights=(1, 3), seed=f"s{seed}").where("source = 'a'")
        first = got.first()
        assert first.target < first.source_size
        for r in got.groupBy((F.col("doc_id") % 2).alias("kind")).agg(F.sum("copies").alias("n")).collect():
            seen[r.kind] += r.n
    share = first.target / first.source_size
    tilt = [1000 + s for s in sizes]
    mean = sum(t * s for t, s in zip(tilt, sizes)) / sum(sizes)
    for kind in (0, 1):
        assert abs(seen[kind] / (400 * runs) - share * tilt[kind] / mean) <= 0.02


def test_mix_many_repeated_identifiers_take_the_spread_join(frame, monkeypatch):
    rows = [row(k // 3, prose(k // 2, 10 + k % 9), source=f"s{k % 3}") for k in range(200)]
    docs = frame(rows)
    want = sorted(map(str, mixture.mix_sources(docs).collect()))
    monkeypatch.setattr(mixture, "BROADCAST_IDS", 3)
    assert sorted(map(str, mixture.mix_sources(docs).collect())) == want


def test_mix_many_sources_take_the_salted_join(frame, monkeypatch):
    docs = frame([row(k, prose(k, 5 + k % 9), source=f"s{k % 20}") for k in range(200)])
    want = sorted(map(str, mixture.mix_sources(docs).collect()))
    monkeypatch.setattr(mixture, "BROADCAST_SOURCES", 3)
    assert sorted(map(str, mixture.mix_sources(docs).collect())) == want


def test_mix_odd_rows_and_empty_table(frame, odd):
    docs = frame(odd)
    assert mixture.mix_sources(docs).count() == len(odd)
    assert mixture.mixed_documents(docs).columns == docs.columns
    assert mixture.mix_sources(docs.limit(0)).collect() == []
    assert mixture.mixed_documents(docs.limit(0)).collect() == []


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    text = text or ""
    w = words(text)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def buckets_of(w, n):
    b = [zlib.crc32(x.encode()) % n for x in w]
    return b + [(x * quality.PAIR + y + 1) % n for x, y in zip(b, b[1:])]


def test_quality_against_python(frame, odd):
    rows = [*odd, row(20, "a b c\na b c\n\n#x a b c" * 20), row(21, "a a a a"), row(22, "a b c a b c")]
    rows += [row(30 + k, prose(k, 60)) for k in range(6)]
    trusted = frame([row(k, "other") for k in (30, 31, 32, 32, None)])
    buckets = 512
    raw, good = Counter(), Counter()
    for r in rows:
        w = words(r[1])
        grams = buckets_of(w, buckets)
        raw.update(grams)
        good.update(grams if r[0] in (30, 31, 32) else [])
    a, b = sum(good.values()), sum(raw.values())
    weight = {k: round(math.log((good[k] + 1) / (a + buckets) / ((raw[k] + 1) / (b + buckets))) * 1e6) for k in range(buckets)}
    got = quality.quality_rules(frame(rows), trusted, buckets=buckets, threshold=-100_000).collect()
    want = []
    for r in rows:
        n = base(r[1])
        w = words(r[1])
        grams = buckets_of(w, buckets)
        total = sum(weight[g] for g in grams)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        llr = math.floor(total / len(grams)) if grams else None
        want.append((r[0], *n, failed, llr, not failed and total >= -100_000 * (2 * n[0] - 1)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_quality_without_trusted_and_empty(frame, odd):
    docs = frame(odd)
    got = quality.quality_rules(docs, docs.limit(0)).collect()
    assert {r.llr for r in got} <= {0, None} and all(r.kept != r.base_failed for r in got)
    assert quality.quality_rules(docs.limit(0), docs).collect() == []


def test_native_plans_run_no_python(spark):
    for name in ("op1_exact_dedup", "op3_mix_sources", "op10_quality_rules"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|Cartesian", plan), name
