import datetime as dt
import random

from pyspark.sql import functions as F

from corpusmill.operators import history as H
from corpusmill.sources.files import read_corpus, write_compressed
from corpusmill.operators.compress import minify
from corpusmill.streaming import events as E

START = dt.datetime(2024, 1, 1)


def events(spark, seed, n=3000, texts=30, spread=40):
    """A third and more of the events belong to key 0."""
    rng = random.Random(seed)
    rows = []
    at = START
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice([1, 5, 600, 90000]))
        key = 0 if rng.random() < 0.4 else rng.randrange(1, spread)
        rows.append((i, at, key, f"t{rng.randrange(texts)}"))
    return rows, spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, k bigint, text string")


def model_history(rows, window, keep):
    stacks = {}
    for i, at, key, text in rows:
        stack = stacks.setdefault(key, [])
        spot = next((j for j, e in enumerate(stack[:window]) if e[0] == text), None)
        entry = stack.pop(spot) if spot is not None else [text, at, at, 0, i]
        entry[2], entry[3], entry[4] = at, entry[3] + 1, i
        stack.insert(0, entry)
        del stack[keep:]
    return {(k, r + 1): tuple(e) for k, s in stacks.items() for r, e in enumerate(s)}


def test_move_to_front_equals_model_for_any_bucket(spark):
    rows, df = events(spark, 1)
    for window, keep, bucket in ((10, 50, 7 * 86400), (10, 50, 3600 * 20), (3, 8, 86400), (1, 50, 86400)):
        got = {
            (r.k, r.recency): (r.text, r.created_at, r.touched_at, r.touches, r.last_seq)
            for r in H.history_dedup(df, "k", "ts", "id", "text", window, keep, bucket).collect()
        }
        assert got == model_history(rows, window, keep), (window, keep, bucket)


def test_few_texts_over_many_buckets(spark):
    rows, df = events(spark, 2, n=1500, texts=4, spread=3)
    got = {
        (r.k, r.recency): (r.text, r.created_at, r.touched_at, r.touches, r.last_seq)
        for r in H.history_dedup(df, "k", "ts", "id", "text", 10, 50, 3600).collect()
    }
    assert got == model_history(rows, 10, 50)


def by_key(rows):
    out = {}
    for row in rows:
        out.setdefault(row[2], []).append(row)
    return out


def test_neighbours_cross_buckets(spark):
    rows, df = events(spark, 3)
    for bucket in (3600, 7 * 86400):
        same = {r.id for r in H.adjacent_dedup(df, "k", ["ts", "id"], "text", bucket).collect()}
        quiet = {r.id for r in H.debounce(df, "k", ["ts", "id"], 600, bucket).collect()}
        bursts = {
            (r.k, r.burst_start, r.burst_end, r.events)
            for r in H.burst_stats(df, "k", ["ts", "id"], 90000, bucket).collect()
        }
        want_same, want_quiet, want_bursts = set(), set(), set()
        for key, es in by_key(rows).items():
            for a, b in zip([None] + es, es + [None]):
                if b and (a is None or a[3] != b[3]):
                    want_same.add(b[0])
                if a and (b is None or (b[1] - a[1]).total_seconds() >= 600):
                    want_quiet.add(a[0])
            run = [es[0]]
            for a, b in zip(es, es[1:]):
                if (b[1] - a[1]).total_seconds() >= 90000:
                    want_bursts.add((key, run[0][1], run[-1][1], len(run)))
                    run = []
                run.append(b)
            want_bursts.add((key, run[0][1], run[-1][1], len(run)))
        assert (same, quiet, bursts) == (want_same, want_quiet, want_bursts)


def test_debounce_off_and_guards(spark):
    rows, df = events(spark, 4, n=50)
    assert H.debounce(df, "k", ["ts", "id"], 0).count() == 50
    short = spark.createDataFrame([(" ab ",), ("abcdef",), (None,)], "text string")
    assert H.min_length(short, 5).count() == 1 and H.min_length(short, 0).count() == 3


def test_pins_are_capped_and_unique(spark):
    pinned = spark.createDataFrame([(1, f"p{i}", i) for i in range(9)], "k int, o string, at int")
    new = spark.createDataFrame([(1, "p0", 100), (1, "n1", 101), (1, "n2", 102), (1, "n1", 103)], "k int, o string, at int")
    got = {(r.o, r["at"]) for r in H.pin_entries(pinned, new, "k", "o", "at").collect()}
    assert got == {(f"p{i}", i) for i in range(1, 9)} | {("n1", 101), ("n2", 102)}


def test_labels(spark):
    ages = [0, 9.9, 10, 59, 60, 3599, 3600, 86400, 200000]
    df = spark.createDataFrame([(i, float(a)) for i, a in enumerate(ages)], "i int, a double")
    out = [r.l for r in df.orderBy("i").select(H.age_label(F.col("a")).alias("l")).collect()]
    assert out == ["now", "now", "10s", "59s", "1m", "59m", "1h", "1d", "2d"]


def stream_folder(spark, tmp_path, rows):
    folder = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "id bigint, ts timestamp, k bigint, text string")
    df.coalesce(1).write.parquet(folder)
    end = [(-1, rows[-1][1] + dt.timedelta(days=30), -1, "end")]
    spark.createDataFrame(end, df.schema).coalesce(1).write.mode("append").parquet(folder)
    return folder, df


def run(spark, stream, tmp_path, mode="append"):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    sink = lambda batch, _: batch.write.mode("append").parquet(out)
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", state)
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_stream_debounce_equals_batch(spark, tmp_path):
    rows, _ = events(spark, 5, n=400)
    folder, df = stream_folder(spark, tmp_path, rows)
    source = E.read_event_stream(spark, "id bigint, ts timestamp, k bigint, text string", folder)
    got = run(spark, E.debounce_stream(source, "k", "ts", 600, seq="id"), tmp_path)
    want = {r.id for r in H.debounce(df, "k", ["ts", "id"], 600).collect()}
    assert {r.id for r in got.collect()} - {-1} == want
    assert got.where("k >= 0").agg(F.sum("burst_events")).first()[0] == 400


def test_stream_history_keeps_state(spark, tmp_path):
    rows, _ = events(spark, 6, n=300, texts=12, spread=4)
    folder, _ = stream_folder(spark, tmp_path, rows)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", E.STATE_STORE)
    source = E.read_event_stream(spark, "id bigint, ts timestamp, k bigint, text string", folder)
    got = run(spark, E.history_stream(source, "k", "ts"), tmp_path, "update").where("k >= 0")
    last = {}
    for r in got.collect():
        spot = (r.k, r.text)
        if spot not in last or last[spot].touched_at < r.touched_at:
            last[spot] = r
    want = {}
    for (k, _), e in sorted(model_history(rows, 10, 50).items(), key=lambda x: -x[0][1]):
        want[(k, e[0])] = (e[2], e[3])
    assert {k: (r.touched_at, r.touches) for k, r in last.items()} == want


def test_stream_crunch_writes_back_only_changes(spark, tmp_path):
    rows = [(1, START, 1, "the cat is the best"), (2, START, 1, "abc"), (3, START, 1, "plain words")]
    folder, _ = stream_folder(spark, tmp_path, rows)
    source = E.read_event_stream(spark, "id bigint, ts timestamp, k bigint, text string", folder)
    out = run(spark, E.crunch_stream(source).select("id", "write_back"), tmp_path)
    assert {r.id: r.write_back for r in out.collect()} == {1: "cat best", 3: None}


def crunch_rows(seed, n=260):
    rng = random.Random(seed)
    texts = ["the cat is the best of all", "plain words here", "ab", "4111 1111 1111 1111", "in order to see the house", " "]
    at, rows = START, []
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice([1, 5, 600, 5000]))
        rows.append((i, at, 0 if rng.random() < 0.4 else rng.randrange(1, 6), rng.choice(texts) + rng.choice(["", " x", " y"])))
    return rows


def batch_history(df, delay, keep):
    """The batch operators, one after the other."""
    quiet = H.debounce(df, "k", ["ts", "id"], delay)
    made = E.with_variant(quiet)
    variants = {r.text: (r.label, r.saved_percent, r.write_back) for r in made.collect()}
    got = H.history_dedup(made, "k", "ts", "id", "text", 10, keep).collect()
    return {(r.k, r.text, r.created_at, r.touched_at, r.touches, *variants[r.text]) for r in got}


def entries(df):
    return {(r.k, r.text, r.created_at, r.touched_at, r.touches, r.label, r.saved_percent, r.write_back) for r in df.collect()}


def test_chained_stream_equals_the_batch_operators(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", E.STATE_STORE)
    rows = crunch_rows(9)
    folder, df = stream_folder(spark, tmp_path, rows)
    source = E.read_event_stream(spark, "id bigint, ts timestamp, k bigint, text string", folder, files_per_batch=1)
    stream = E.crunch_history_stream(source, "k", "ts", "id", delay_seconds=600, keep=12)
    out = str(tmp_path / "hist")
    E.write_batches(stream, E.batch_folder(out), str(tmp_path / "hs"), True).awaitTermination()
    done = E.written_batches(spark, out, stream.schema).where("k >= 0")
    want = batch_history(df.where("trim(text) <> ''"), 600, 12)
    assert len(want) > 10 and any(x[-1] for x in want)
    assert entries(E.latest_entries(done, "k", keep=12)) == want


def test_replay_after_a_death_between_sink_and_commit(spark, tmp_path):
    """The sink has written, the batch is not committed: the next start writes it again, once."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", E.STATE_STORE)
    rows, _ = events(spark, 21, n=200, texts=9, spread=4)
    shape = "id bigint, ts timestamp, k bigint, text string"
    folder = str(tmp_path / "in")
    for part in range(4):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], shape).coalesce(1).write.mode("append").parquet(folder)

    def stream():
        source = E.read_event_stream(spark, shape, folder, files_per_batch=1)
        return E.history_stream(source, "k", "ts", seq="id")

    out, state = str(tmp_path / "hist"), str(tmp_path / "state")
    write = E.batch_folder(out)

    def dies(batch, number):
        write(batch, number)
        if number == 1:
            raise RuntimeError("lost after the writing")

    try:
        E.write_batches(stream(), dies, state, True, "update").awaitTermination()
        raise AssertionError("the query should have died")
    except Exception as e:
        assert "lost after the writing" in str(e)
    E.write_batches(stream(), write, state, True, "update").awaitTermination()
    got = E.written_batches(spark, out, stream().schema)
    assert got.count() == 200 and got.select("batch").distinct().count() == 4
    last = {(r.k, r.text, r.touches) for r in E.latest_entries(got, "k").collect()}
    whole = H.history_dedup(spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, k bigint, text string"), "k", "ts", "id", "text")
    assert last == {(r.k, r.text, r.touches) for r in whole.collect()}


def test_folder_scan_and_typed_output(spark, tmp_path):
    root = tmp_path / "proj"
    for path, text in {
        "b.md": "# T\n## U\nthe text", "a.py": "x = 1", "skip.bin": "x", "blank.txt": " \n",
        "node_modules/c.js": "let a", "sub/d.TXT": "words", "big.txt": "y" * 200,
    }.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    (root / "bad.log").write_bytes(b"ok \xff end")
    found = read_corpus(spark, str(root), max_bytes=100)
    assert sorted(r.name for r in found.collect()) == ["a.py", "b.md", "bad.log", "d.TXT"]
    assert found.where("name = 'bad.log'").first().text == "ok \ufffd end"
    first = read_corpus(spark, str(root), max_bytes=100, max_files=2)
    assert sorted(r.name for r in first.collect()) == ["a.py", "b.md"]
    out = str(tmp_path / "out")
    write_compressed(minify(found), out)
    back = {r.name: r.content_type for r in spark.read.parquet(out).collect()}
    assert back["b.md"] == "markdown" and len(back) == 4


def test_typed_output_has_files_of_a_size(spark, tmp_path):
    """A frequent type has several files, a rare one a single file, whatever the tasks."""
    body = F.repeat(F.sha2(F.col("id").cast("string"), 512), 4)
    kind = F.when(F.col("id") % 500 == 0, "log").when(F.col("id") % 50 == 0, "email").otherwise("prose")
    rows = spark.range(0, 20_000, 1, 16).select(F.struct(kind.alias("content_type"), body.alias("text")).alias("compressed"))
    size, key = 1 << 18, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before, least = spark.conf.get(key), "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    first = spark.conf.get(least)
    spark.conf.set(key, size)
    spark.conf.set(least, "false")
    try:
        write_compressed(rows, str(tmp_path / "typed"))
    finally:
        spark.conf.set(key, before)
        spark.conf.set(least, first)
    files = {}
    for f in (tmp_path / "typed").rglob("*.parquet"):
        files.setdefault(f.parent.name, []).append(f.stat().st_size)
    assert set(files) == {"content_type=log", "content_type=email", "content_type=prose"}
    assert len(files["content_type=log"]) == 1 and len(files["content_type=email"]) == 1
    want = -(-sum(files["content_type=prose"]) // size)
    assert want > 3 and want / 2 <= len(files["content_type=prose"]) <= 2 * want
    assert spark.read.parquet(str(tmp_path / "typed")).count() == 20_000
