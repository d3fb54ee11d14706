"""Ordered line deltas: round trips, minimal change, moves, hunks."""

import difflib
import random
import re

from pyspark.sql import functions as F

from corpusmill.operators import delta as V
from corpusmill.plans import catalog
from corpusmill.plans.seeded import new_version, seeded_corpus

SF = "/root/testdata/sf0.01"


def pairs_of(spark, texts):
    old = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(texts)], "id int, text string")
    new = spark.createDataFrame([(k, b) for k, (_, b) in enumerate(texts)], "id int, text string")
    return V.snapshot_pairs(old, new, "id")


def by_doc(rows, key="id"):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r[key]), r.seq)):
        out.setdefault(r[key], []).append(r)
    return out


def patched(old, changes):
    """The text that a unified diff makes of old; lines keep their ends."""
    lines, out, at = re.split(V.LINE_END, old), [], 0
    lines = [x for x in lines if x]
    body = [x for x in re.split(V.LINE_END, changes.removeprefix("--- \n+++ \n")) if x]
    for line in body:
        if line.startswith("@@"):
            start, n = re.match(r"@@ -(\d+)(?:,(\d+))?", line).groups()
            to = int(start) - (0 if n == "0" else 1)
            out += lines[at:to]
            at = to
        elif line[0] in " -":
            assert lines[at] == line[1:]
            out += [line[1:]] if line[0] == " " else []
            at += 1
        else:
            out.append(line[1:])
    return "".join(out + lines[at:])


def check(rows, old, new):
    """Both texts come out of the operations; no gap has a line in common."""
    assert "".join(r.line for r in rows if r.op != "+") == old
    assert "".join(r.line for r in rows if r.op != "-") == new
    assert [r.seq for r in rows] == list(range(1, len(rows) + 1))
    gone, come = set(), set()
    for r in rows:
        if r.op == " ":
            assert not gone & come
            gone, come = set(), set()
        else:
            (gone if r.op == "-" else come).add(r.line)
    assert not gone & come


def test_random_edits(spark):
    rng = random.Random(4)
    texts = []
    for k in range(150):
        words = [f"line {rng.randrange(rng.choice([5, 400]))}\n" for _ in range(rng.randint(0, 60))]
        new = [x for x in words if rng.random() > 0.1]
        for _ in range(rng.randint(0, 5)):
            new.insert(rng.randint(0, len(new)), f"new {rng.randrange(9)}\n")
        if k % 5 == 0 and len(new) > 6:
            a, b, c = sorted(rng.sample(range(len(new)), 3))
            new = new[:a] + new[b:c] + new[a:b] + new[c:]
        if k % 7 == 0:
            rng.shuffle(new)
        texts.append(("".join(words), "".join(new) + rng.choice(["", "no end"])))
    got = by_doc(V.ordered_delta(pairs_of(spark, texts), "id").collect())
    ours = theirs = 0
    for k, (old, new) in enumerate(texts):
        if old == new:
            assert k not in got
            continue
        check(got[k], old, new)
        if k % 5 and k % 7:
            ours += sum(r.op != " " for r in got[k])
            theirs += sum(x[0] in "+-" for x in list(difflib.ndiff(old.splitlines(True), new.splitlines(True))))
    assert ours <= 1.05 * theirs
    whole = {r.id: r.changes for r in V.delta_text(pairs_of(spark, [t for t in texts if t[0].endswith("\n") and t[1].endswith("\n")]), "id").collect()}
    ended = [t for t in texts if t[0].endswith("\n") and t[1].endswith("\n")]
    for k, (old, new) in enumerate(ended):
        assert (patched(old, whole[k]) if k in whole else old) == new


def test_simple_changes_equal_the_usual_diff(spark):
    base = [f"l{k}\n" for k in range(30)]
    edits = [
        base[:3] + base[4:],
        base[:10] + ["x\n"] + base[10:],
        ["x\n", *base],
        [*base, "x\n"],
        base[:5] + ["y\n"] + base[6:20] + base[22:],
        base[:5] + ["y\n"] + base[6:11] + ["z\n"] + base[12:],
        [],
    ]
    texts = [("".join(base), "".join(e)) for e in edits] + [("", "a\nb\n")]
    got = {r.id: r.changes for r in V.delta_text(pairs_of(spark, texts), "id").collect()}
    for k, (old, new) in enumerate(texts):
        assert got[k] == "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), n=3))


def test_moves_are_told(spark):
    block = ["move 1\n", "move 2\n", "same\n"]
    rest = [f"l{k}\n" for k in range(10)]
    old, new = "".join(block + rest + ["same\n"]), "".join(rest + ["same\n"] + block)
    rows = by_doc(V.ordered_delta(pairs_of(spark, [(old, new)]), "id").collect())[0]
    check(rows, old, new)
    assert [(r.op, r.line, r.moved) for r in rows if r.op != " "] == [("-", x, True) for x in block] + [("+", x, True) for x in block]
    hunks = V.delta_hunks(V.ordered_delta(pairs_of(spark, [(old, new)]), "id"), "id").collect()
    assert sum(h.moved for h in hunks) == 6 and len(hunks) == 2


def test_line_ends_nulls_and_missing_documents(spark):
    texts = [("a\r\nb\rc d", "a\r\nb\nc d"), (None, "a\n"), ("a", None), ("x\n", "x\n"), ("", None)]
    pairs = pairs_of(spark, texts)
    more = pairs.unionByName(pairs.where("id = 0").withColumn("id", F.lit(None).cast("int")))
    gone = pairs.where("id = 3").select(F.lit(9).alias("id"), "old_text", F.lit(None).cast("string").alias("new_text"), "old_id", F.lit(None).cast("string").alias("new_id"))
    got = by_doc(V.ordered_delta(more.unionByName(gone), "id").collect())
    assert set(got) == {0, 1, 2, None}
    assert [(r.op, r.line) for r in got[0]] == [(" ", "a\r\n"), ("-", "b\r"), ("+", "b\n"), (" ", "c "), (" ", "d")]
    assert [(r.op, r.line, r.old_pos, r.new_pos) for r in got[1]] == [("+", "a\n", None, 1)]
    assert [tuple(r)[1:] for r in got[None]] == [tuple(r)[1:] for r in got[0]]
    assert V.ordered_delta(more.limit(0), "id").collect() == []


def test_heaviest_chain_against_all_subsets(spark):
    rng = random.Random(1)
    cases = []
    for _ in range(40):
        n = rng.randint(1, 8)
        js = rng.sample(range(20), n)
        cases.append([(i, j, rng.randint(1, 4)) for i, j in enumerate(js)])
    df = spark.createDataFrame([(c,) for c in cases], "b array<struct<i:int,j:int,n:int>>")
    for case, got in zip(cases, df.select(V.heaviest_chain(F.col("b")).alias("c")).collect(), strict=True):
        kept = sorted(tuple(x) for x in got.c)
        assert all(a[1] < b[1] for a, b in zip(kept, kept[1:])) and set(kept) <= set(case)
        best = 0
        for mask in range(1 << len(case)):
            some = [x for k, x in enumerate(case) if mask >> k & 1]
            if all(a[1] < b[1] for a, b in zip(some, some[1:])):
                best = max(best, sum(x[2] for x in some))
        assert sum(x[2] for x in kept) == best


def test_whole_table(spark):
    old = seeded_corpus(spark, SF)
    new = new_version(old)
    texts = {r.doc_id: r.text for r in old.collect()}
    wanted = {r.doc_id: r.text for r in new.collect()}
    delta = V.ordered_delta(V.changed_pairs(old, new, "doc_id"), "doc_id")
    got = by_doc(delta.collect(), "doc_id")
    assert set(got) == {k for k in texts if k in wanted and texts[k] != wanted[k]}
    for k, rows in got.items():
        check(rows, texts[k], wanted[k])
    plan = delta._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    moved = {r.doc_id: r.n for r in delta.where("moved").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    listed = {r.doc_id: r for r in catalog.QUERIES["ordered_delta"](spark, SF).collect()}
    for k, rows in got.items():
        assert (listed[k].added, listed[k].removed, listed[k].moved) == (
            sum(r.op == "+" for r in rows), sum(r.op == "-" for r in rows), moved.get(k, 0),
        )


def versions(spark):
    """Old and new texts with long lines, repeats and a NULL key."""
    lines = [f"{n} " + "word " * 60 + "\n" for n in range(12)]
    rows = []
    for n, key in enumerate([None, *range(30)]):
        old = [lines[(n + k * k) % 12] for k in range(15)]
        rows.append((key, "".join(old), "".join(l for k, l in enumerate(old[2:] + old[:2]) if k % 5 != n % 5)))
    frame = spark.createDataFrame(rows, "id bigint, old string, new string")
    return frame.selectExpr("id", "old AS text"), frame.selectExpr("id", "new AS text")


def test_lines_of_a_document_travel_once(spark, capsys):
    old, new = versions(spark)
    delta = V.ordered_delta(V.changed_pairs(old, new, "id"), "id")
    delta.explain("formatted")
    moved = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", capsys.readouterr().out)
    assert not [columns for columns in moved if re.search(r"\bline#", columns)]
    texts = {r.id: r.text for r in old.collect()}, {r.id: r.text for r in new.collect()}
    for id_, rows in by_doc(delta.collect()).items():
        of = lambda ops: "".join(r.line for r in sorted(rows, key=lambda r: r.seq) if r.op in ops)
        assert (of(" -"), of(" +")) == (texts[0][id_], texts[1][id_])
    assert None in texts[0] and delta.where("id IS NULL").count() > 0


def test_lines_of_a_diff_travel_once(spark, capsys):
    old, new = versions(spark)
    diff = V.delta_text(V.changed_pairs(old, new, "id"), "id")
    diff.explain("formatted")
    moved = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", capsys.readouterr().out)
    assert len([columns for columns in moved if re.search(r"\bline#", columns)]) == 1
    before, after = ({r.id: r.text for r in side.collect()} for side in (old, new))
    changes = {r.id: r.changes for r in diff.collect()}
    assert None in changes
    assert all(patched(before[id_], c) == after[id_] for id_, c in changes.items())


def test_matching_moves_marks_and_writes_no_texts(spark, monkeypatch):
    old, new = versions(spark)
    tables, real = [], V.written

    def noted(df):
        out = real(df)
        tables.append((df._jdf.queryExecution().executedPlan().toString(), out))
        return out

    monkeypatch.setattr(V, "written", noted)
    diff = V.delta_text(V.changed_pairs(old, new, "id"), "id")
    assert len(tables) > 2
    for plan, table in tables:
        assert not [name for name in table.columns if "text" in name]
        assert not re.search(r"\b(old|new)_text#", plan)
    before, after = ({r.id: r.text for r in side.collect()} for side in (old, new))
    changes = {r.id: r.changes for r in diff.collect()}
    assert changes.keys() == before.keys() and None in changes
    assert all(patched(before[id_], c) == after[id_] for id_, c in changes.items())
