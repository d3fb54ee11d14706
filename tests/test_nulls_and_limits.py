"""Nulls, total rows, empty containers and texts of any length."""

from pyspark.sql import functions as F

from corpusmill.functions.text import text_of
from corpusmill.operators import budget as B
from corpusmill.operators import compress as C
from corpusmill.operators import delta as V
from corpusmill.operators import detect as D
from corpusmill.operators import history as H
from corpusmill.operators import route as R
from corpusmill.operators import shape as K
from corpusmill.sources.files import read_corpus


def test_long_paths_are_shortened(mapped):
    unix = "/seg" * 100_000 + "/last/file.py"
    windows = "C:\\" + "seg\\" * 100_000 + "last\\dir\\"
    got = mapped(C.shorten_refs, f"see {unix} end", f"see {windows} end", "/a/b", "/a/b/c", "a C:\\x\\y\\ b")
    assert got[0].text == "see .../last/file.py end" and got[0].paths == 1
    assert got[1].text == "see .../last/dir end" and got[1].paths == 1
    assert got[2].text == "/a/b" and got[3].text == ".../b/c" and got[4].text == "a .../x/y b"


def docs(spark):
    rows = [(1, "a b c", "s", "x.txt"), (2, "d e", None, "y.txt"), (3, "f g h i", "(all)", "z.txt"), (4, None, None, "n.txt")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, name string")


def test_totals_stand_apart_from_groups(spark):
    rows = D.type_mix(docs(spark)).collect()
    total = [r for r in rows if r.is_total]
    assert sum(r.docs for r in total) == 4 and all(r.source is None for r in total)
    own = {r.source: r.docs for r in rows if not r.is_total}
    assert own == {"s": 1, "(all)": 1, None: 2}
    rows = C.compression_rollup(docs(spark)).collect()
    assert {(r.source, r.is_total): r.docs for r in rows} == {
        ("s", False): 1, (None, False): 2, ("(all)", False): 1, (None, True): 4,
    }


def test_null_groups_get_a_budget_and_a_block(spark):
    weighed = docs(spark).withColumn("weight", F.lit(1))
    got = B.allocate_budget(weighed, 1000, "source", "doc_id").collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4}
    blocks = {r.source: r for r in B.pack_block(docs(spark), "source", "doc_id", max_files=1).collect()}
    assert set(blocks) == {"s", None, "(all)"} and blocks[None].files == 1
    many = docs(spark).withColumn("source", F.lit(None).cast("string"))
    (block,) = B.pack_block(many, "source", "doc_id", max_files=2).collect()
    assert (block.files, block.files_skipped) == (2, 1)


EVENTS = "k string, ts timestamp, seq int, text string"


def events(spark):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", None, "y"), (None, 1, "x"), (None, 1000, "z"), (None, None, "z")]
    df = spark.createDataFrame([(k, t, n, x) for n, (k, t, x) in enumerate(rows)], "k string, t int, seq int, text string")
    return df.select("k", F.timestamp_seconds("t").alias("ts"), "seq", "text")


def test_events_without_key_or_time(spark):
    ev = events(spark)
    left = {r.seq for r in H.adjacent_dedup(ev, "k", ["ts", "seq"], "text").collect()}
    assert left == {0, 2, 3, 4, 5}
    assert {r.seq for r in H.debounce(ev, "k", ["ts", "seq"], 5).collect()} == {1, 2, 3, 4, 5}
    bursts = {(r.k, r.events) for r in H.burst_stats(ev, "k", ["ts", "seq"], 5).collect()}
    assert bursts == {("a", 2), (None, 1)}
    assert H.burst_stats(ev, "k", ["ts", "seq"], 5).count() == 3


def test_null_texts_in_snapshots(spark):
    old = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, text string")
    new = spark.createDataFrame([(1, None), (2, "b"), (3, None), (4, None)], "id int, text string")
    assert {r.id: r.status for r in V.changed_docs(old, new, "id").collect()} == {
        1: "same", 2: "changed", 3: "changed", 4: "new",
    }
    modes = {r.id: r.mode for r in V.delta_mode(old, new, "id").collect()}
    assert set(modes) == {1, 2, 3, 4} and modes[1] == "unchanged" and modes[4] == "full"


def test_empty_json_containers(spark):
    df = spark.createDataFrame([(1, '{"a":{},"b":[],"c":1}'), (2, "{}"), (3, "[]"), (4, "no json")], "id int, js string")
    got = {(r.id, r.path): r.type for r in K.json_leaves(df, "id", "js").collect()}
    assert got[1, "$.a"] == "object<>" and got[1, "$.b"] == "array<>" and (1, "$.c") in got
    assert got[2, "$"] == "object<>" and got[3, "$"] == "array<>" and got[4, "$"] == "invalid"


def test_file_scan_without_a_cap(spark, tmp_path):
    root = tmp_path / "c(x+"
    root.mkdir()
    (root / "big.txt").write_text("word " * 3_000_000)
    (root / "small.txt").write_text("one")
    found = read_corpus(spark, str(root)).select("name", F.length(text_of("text")).alias("n")).collect()
    assert {r.name: r.n for r in found} == {"big.txt": 15_000_000, "small.txt": 3}
    capped = {r.name: (r.text, r.error) for r in read_corpus(spark, str(root), max_bytes=100, report_large=True).collect()}
    assert capped["small.txt"] == ("one", None) and capped["big.txt"][0] is None and "100 bytes" in capped["big.txt"][1]


def test_helper_columns_leave_the_callers_alone(spark):
    """Columns of the caller that are named like an operator's own come out as they went in."""
    names = ["_n", "_red", "_type", "_how", "_cut", "_text", "_new", "_mf_red", "_MF_out", "_rt_raw", "_rt_skel", "_b", "_near"]
    base = spark.createDataFrame(
        [(1, "n.py", "def f():\n    return 1\n", "s", 5), (2, "t.md", "# A\n\nthe words of it\n", "s", 6)],
        "doc_id int, name string, text string, source string, at int",
    )
    clash = base.select("*", *[F.lit(777 + k).alias(n) for k, n in enumerate(names)])
    for op in (
        lambda d: B.budget_load(d, 3),
        lambda d: C.minify(d),
        lambda d: R.smart_route(d),
        lambda d: R.explain_compression(d),
    ):
        plain, got = op(base), op(clash)
        assert got.columns == [*clash.columns, plain.columns[-1]]
        extra = {r.doc_id: tuple(r[n] for n in names) for r in got.collect()}
        assert set(extra.values()) == {tuple(777 + k for k in range(len(names)))}
        assert {str((r.doc_id, r[-1])) for r in plain.collect()} == {str((r.doc_id, r[-1])) for r in got.collect()}
    times = clash.withColumn("ts", F.timestamp_seconds(F.col("at")))
    got = H.debounce(times, "source", ["ts", "doc_id"], 0.5).collect()
    assert {r["_b"] for r in got} == {777 + names.index("_b")} and len(got) == 2
    renamed = clash.withColumnRenamed("_near", "_prev").withColumnRenamed("_red", "_body").withColumn("_body", F.col("text"))
    assert C.minify(renamed.withColumn("_mf_n", F.col("text")), "_mf_n").select("compressed.text").collect() == C.minify(base).select("compressed.text").collect()


def test_pins_with_null_keys(spark):
    shape = "k int, o string, at int"
    pinned = spark.createDataFrame([(None, "a", 1), (1, None, 2)], shape)
    new = spark.createDataFrame([(None, "a", 5), (1, None, 6), (None, None, 7)], shape)
    got = sorted(map(tuple, H.pin_entries(pinned, new, "k", "o", "at").collect()), key=str)
    assert got == sorted([(None, "a", 1), (1, None, 2), (None, None, 7)], key=str)


def test_detection_reads_whole_texts_by_default(spark):
    log = "plain\n" * 40 + "2025-01-01 INFO a\n" * 3
    df = spark.createDataFrame([(log,)], "log string")
    got = df.select(
        D.detect_type(F.col("log")).alias("whole"), D.detect_type(F.col("log"), D.HEAD_LINES).alias("head"),
    ).first()
    assert (got.whole, got.head) == ("log", "prose")


def test_pack_block_takes_all_files_by_default(spark):
    many = spark.createDataFrame([("s", k, f"f{k}", "text") for k in range(50)], "source string, doc_id int, name string, text string")
    (block,) = B.pack_block(many, "source", "doc_id").collect()
    assert (block.files, block.files_skipped) == (50, 0)
