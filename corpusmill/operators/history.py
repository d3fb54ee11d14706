"""Per-key event histories: order, recency, repetition and bursts.

A single key may hold a large part of all events. Nothing here brings all
events of one key into one task: rows are partitioned by (key, time bucket), and
only one summary row per bucket (a number bounded by the time span, not by the
event count) crosses bucket borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import is_blank, shielded, strip, text_of

HISTORY_SIZE = 50
PINNED_SIZE = 10
DEDUP_WINDOW = 10
BUCKET_SECONDS = 7 * 86400


def min_length(df: DataFrame, n: int = 5, text: str = "text") -> DataFrame:
    """Rows whose stripped text has at least n characters; n <= 0 keeps all."""
    return df if n <= 0 else df.where(F.length(strip(text_of(text))) >= n)


def search_history(df: DataFrame, query: str = "", text: str = "text") -> DataFrame:
    """Rows that contain the query in any case, each with the total size.

    The size is a scalar subquery over the row count: it reads no column and
    needs no window over all rows.
    """
    total = df.agg(F.count("*")).scalar()
    hit = F.lower(text_of(text)).contains(query.lower()) if query else F.lit(True)
    return df.where(hit).withColumn("history_size", total)


def search_with_variants(
    pinned: DataFrame, history: DataFrame, query: str, original: str, compact: str
) -> DataFrame:
    """Pinned and history rows whose original or compact text holds the query.

    `listed` orders the result: pinned rows first (0), then history (1).
    """
    both = pinned.withColumn("kind", F.lit("pinned")).unionByName(
        history.withColumn("kind", F.lit("history"))
    )
    corpus = F.lower(F.concat(text_of(original), F.lit(" "), text_of(compact)))
    return both.where(corpus.contains(query.strip().lower())).withColumn(
        "listed", (F.col("kind") == "history").cast("int")
    )


def preview(text: Column, n: int = 40) -> Column:
    """A label of at most n characters."""
    t = text_of(text)
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n - 3)), F.lit("..."))).otherwise(t)


def history_preview(text: Column, n: int = 100) -> Column:
    return F.left(text_of(text), F.lit(n))


def one_line(text: Column) -> Column:
    return strip(F.replace(text_of(text), F.lit("\n"), F.lit(" ")))


def age_label(seconds: Column) -> Column:
    """now, 42s, 5m, 3h or 2d."""
    part = lambda unit, letter: F.concat(
        F.floor(seconds / F.lit(unit)).cast("bigint").cast("string"), F.lit(letter)
    )
    return (
        F.when(seconds < 10, F.lit("now"))
        .when(seconds < 60, part(1, "s"))
        .when(seconds < 3600, part(60, "m"))
        .when(seconds < 86400, part(3600, "h"))
        .otherwise(part(86400, "d"))
    )


def freshness(rank: Column) -> Column:
    """full, dark, medium or light, by the recency rank from 0."""
    return (
        F.when(rank <= 1, F.lit("full"))
        .when(rank <= 3, F.lit("dark"))
        .when(rank <= 6, F.lit("medium"))
        .otherwise(F.lit("light"))
    )


def pin_entries(
    pinned: DataFrame,
    candidates: DataFrame,
    key: str,
    original: str,
    at: str,
    cap: int = PINNED_SIZE,
) -> DataFrame:
    """Pinned entries plus new ones, at most `cap` per key; the oldest fall out.

    A candidate whose original is pinned already is ignored, and of equal
    candidates the first counts; NULL is a key, and an original, like any other. The cap is the feature; it is applied per task
    before the shuffle.
    """
    fresh = candidates.groupBy(key, original).agg(F.min(at).alias(at))
    there = pinned.select(F.col(key).alias("at_key"), F.col(original).alias("at_original"))
    same = F.col(key).eqNullSafe(F.col("at_key")) & F.col(original).eqNullSafe(F.col("at_original"))
    new = fresh.join(there, same, "left_anti")
    both = pinned.select(key, original, at).unionByName(new.select(key, original, at))
    newest = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(original))
    return both.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= cap).drop("_r")


def bounded_history(
    df: DataFrame, key: str, order: list[str], n: int = HISTORY_SIZE
) -> DataFrame:
    """The newest n rows per key, ranked from 1; limited per task before the shuffle."""
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)


def neighbour_entry(
    history: DataFrame, key: str, value: str, step: int = 1, recency: str = "recency"
) -> DataFrame:
    """The entry `step` positions older (+) or newer (-); NULL at the edges.

    Works on a bounded history, so a window holds at most its size.
    """
    by_age = Window.partitionBy(key).orderBy(recency)
    return history.withColumn("neighbour", F.lead(value, step).over(by_age))


# ------------------------------------------------------- rows next to each other


def micros(ts: Column) -> Column:
    """Microseconds; a timestamp without zone is read in the session time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def bucket_of(ts: str, seconds: int) -> Column:
    return F.floor(micros(F.col(ts)) / F.lit(seconds * 1_000_000)).cast("bigint")


@shielded("_")
def with_adjacent(
    df: DataFrame,
    key: str,
    order: list[str],
    values: list[str],
    out: str,
    step: int = -1,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Adds struct `out` with the values of the previous (or next) row of the key.

    Neighbours inside a time bucket come from a window over (key, bucket). The
    first (last) row of a bucket takes the edge row of the bucket before
    (after), found among one row per key and bucket. order[0] is the timestamp.
    NULL is a key of its own; rows without a time come first.
    """
    picked = F.struct(*values)
    back = step < 0
    rows = df.withColumn("_b", bucket_of(order[0], bucket_seconds))
    inside = Window.partitionBy(key, "_b").orderBy(*order)
    shift = F.lag if back else F.lead
    at = F.struct(*order)
    edge = (F.max_by if back else F.min_by)(picked, at)
    across = Window.partitionBy(key).orderBy("_b")
    edges = (
        rows.groupBy(key, "_b")
        .agg(edge.alias("_edge"))
        .withColumn("_over", shift("_edge").over(across))
        .select(F.col(key).alias("_k"), F.col("_b").alias("_at"), "_over")
    )
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_at"))
    return (
        rows.withColumn("_near", shift(picked).over(inside))
        .join(edges, same)
        .withColumn(out, F.coalesce("_near", "_over"))
        .drop("_b", "_near", "_over", "_k", "_at")
    )


@shielded("_")
def adjacent_dedup(
    df: DataFrame, key: str, order: list[str], text: str, bucket_seconds: int = BUCKET_SECONDS
) -> DataFrame:
    """Rows whose text differs from that of the row before."""
    near = with_adjacent(df, key, order, [text], "_prev", -1, bucket_seconds)
    same = F.col("_prev").isNotNull() & F.col(f"_prev.{text}").eqNullSafe(F.col(text))
    return near.where(~same).drop("_prev")


def gap_seconds(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


@shielded("_")
def debounce(
    df: DataFrame,
    key: str,
    order: list[str],
    delay_seconds: float = 0.3,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """The last row of every burst: no further one follows within the delay.

    Rows without a time follow nothing and are kept.
    """
    if delay_seconds <= 0:
        return df
    timed = df.where(F.col(order[0]).isNotNull())
    near = with_adjacent(timed, key, order, [order[0]], "_next", 1, bucket_seconds)
    quiet = gap_seconds(F.col(f"_next.{order[0]}"), F.col(order[0])) >= delay_seconds
    last = near.where(F.col("_next").isNull() | quiet).drop("_next")
    return last.unionByName(df.where(F.col(order[0]).isNull()))


@shielded("_")
def burst_stats(
    df: DataFrame,
    key: str,
    order: list[str],
    delay_seconds: float,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Bursts per key: start, end, events, length.

    Bursts are aggregated inside each time bucket first. Only the first and the
    last part of a bucket can go on beyond it; these few parts are chained.
    Events without a time belong to no burst.
    """
    ts = order[0]
    df = df.where(F.col(ts).isNotNull())
    near = with_adjacent(df, key, order, [ts], "_prev", -1, bucket_seconds)
    starts = F.col("_prev").isNull() | (
        gap_seconds(F.col(ts), F.col(f"_prev.{ts}")) >= delay_seconds
    )
    inside = Window.partitionBy(key, "_b").orderBy(*order)
    parts = (
        near.select(key, *order, starts.cast("bigint").alias("_start"))
        .withColumn("_b", bucket_of(ts, bucket_seconds))
        .withColumn("_part", F.sum("_start").over(inside))
        .groupBy(key, "_b", "_part")
        .agg(
            F.min(ts).alias("burst_start"),
            F.max(ts).alias("burst_end"),
            F.count("*").alias("events"),
        )
        .withColumn("_last", F.max("_part").over(Window.partitionBy(key, "_b")))
    )
    edge = (F.col("_part") == 0) | (F.col("_part") == F.col("_last"))
    chain = Window.partitionBy(key).orderBy("_b", "_part")
    chained = (
        parts.where(edge)
        .withColumn("_run", F.sum((F.col("_part") > 0).cast("bigint")).over(chain))
        .groupBy(key, "_run")
        .agg(
            F.min("burst_start").alias("burst_start"),
            F.max("burst_end").alias("burst_end"),
            F.sum("events").alias("events"),
        )
    )
    columns = [key, "burst_start", "burst_end", "events"]
    return (
        parts.where(~edge)
        .select(*columns)
        .unionByName(chained.select(*columns))
        .withColumn("seconds", gap_seconds(F.col("burst_end"), F.col("burst_start")))
    )


# ------------------------------------------------- history with move to front


class RecentTexts:
    """The most recent distinct texts of one key, newest first."""

    def __init__(self, size: int):
        self.size = size
        self.entries: list[dict] = []

    def push(self, entry: dict) -> dict | None:
        """Merge into an entry with the same text, else add; the entry that left."""
        for i, old in enumerate(self.entries):
            if old["text"] == entry["text"]:
                old["last"] = entry["last"]
                old["touches"] += entry["touches"]
                self.entries.insert(0, self.entries.pop(i))
                return None
        self.entries.insert(0, entry)
        return self.entries.pop() if len(self.entries) > self.size else None


def history_dedup(
    df: DataFrame,
    key: str,
    ts: str,
    seq: str,
    text: str,
    window: int = DEDUP_WINDOW,
    keep: int = HISTORY_SIZE,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Per key: a text among the `window` newest entries moves to the front.

    Any other text is a new entry; the newest `keep` entries stay, with first
    and last time and number of touches. The state that matters is the `window`
    last distinct texts, so the events of a key split at time buckets (rows
    without a key have no history):

    1. the last distinct texts per (key, bucket), by aggregation;
    2. the state each bucket starts with, from those few rows per bucket;
    3. every bucket on its own, as a stream of rows with bounded state;
    4. entries that go on in a later bucket are chained, and ranked.
    """
    types = dict(df.dtypes)
    events = (
        df.where(~is_blank(text_of(text)) & F.col(key).isNotNull())
        .select(
            F.col(key).alias("k"),
            bucket_of(ts, bucket_seconds).alias("b"),
            micros(F.col(ts)).alias("at"),
            F.col(seq).cast("bigint").alias("seq"),
            F.col(text).alias("text"),
        )
    )
    newest = Window.partitionBy("k", "b").orderBy(F.col("last").desc())
    tails = (
        events.groupBy("k", "b", "text")
        .agg(F.max(F.struct("at", "seq")).alias("last"))
        .withColumn("r", F.row_number().over(newest))
        .where(F.col("r") <= window)
        .select("k", "b", "text", F.col("last.at").alias("at"), F.col("last.seq").alias("seq"))
    )

    def incoming(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, bucket, state, waiting = None, None, {}, []
        for pdf in batches:
            out = []
            for k, b, text, at, seq in pdf[["k", "b", "text", "at", "seq"]].itertuples(index=False):
                if k != current:
                    current, bucket, state, waiting = k, b, {}, []
                if b != bucket:
                    for t in waiting:
                        state.pop(t[0], None)
                        state[t[0]] = t[1:]
                    state = dict(list(state.items())[-window:])
                    out += [(k, b, t, *v) for t, v in state.items()]
                    bucket, waiting = b, []
                waiting.append((text, at, seq))
            yield pd.DataFrame(out, columns=["k", "b", "text", "at", "seq"])

    row = f"k {types[key]}, b bigint, text string, at bigint, seq bigint"
    carried = (
        tails.repartition("k").sortWithinPartitions("k", "b", "at", "seq").mapInPandas(incoming, row)
    )
    rows = carried.withColumn("fresh", F.lit(0)).unionByName(events.withColumn("fresh", F.lit(1)))

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["k", "b", "part", "text", "carried", "first", "first_seq", "last", "last_seq", "touches"]
        group, recent, done, part = None, RecentTexts(window), [], 0

        def flush():
            nonlocal done
            live = [e for e in done + recent.entries[::-1] if e["touches"]]
            live.sort(key=lambda e: e["last"])
            done = []
            return [
                (*group, e["part"], e["text"], e["carried"], *e["first"], *e["last"], e["touches"])
                for e in live[-max(keep, window):]
            ]

        for pdf in batches:
            out = []
            for k, b, fresh, at, seq, text in pdf[["k", "b", "fresh", "at", "seq", "text"]].itertuples(
                index=False
            ):
                if (k, b) != group:
                    if group is not None:
                        out += flush()
                    group, recent, part = (k, b), RecentTexts(window), 0
                part += 1
                spot = (at, seq)
                left = recent.push(
                    {"text": text, "part": part, "carried": not fresh, "first": spot, "last": spot,
                     "touches": int(fresh)}
                )
                if left is not None:
                    done.append(left)
                    if len(done) > 4 * keep:
                        done = sorted(done, key=lambda e: e["last"])[-keep:]
            yield pd.DataFrame(out, columns=names)
        if group is not None:
            yield pd.DataFrame(flush(), columns=names)

    schema = (
        f"k {types[key]}, b bigint, part bigint, text string, carried boolean, first bigint, "
        "first_seq bigint, last bigint, last_seq bigint, touches bigint"
    )
    pieces = (
        rows.repartition("k", "b")
        .sortWithinPartitions("k", "b", "fresh", "at", "seq")
        .mapInPandas(entries, schema)
    )
    chain = Window.partitionBy("k", "text").orderBy("b", "last", "last_seq")
    # a carried piece goes on with the piece before it; any other starts an entry
    whole = (
        pieces.withColumn("entry", F.sum((~F.col("carried")).cast("int")).over(chain))
        .groupBy("k", "text", "entry")
        .agg(
            F.min(F.when(~F.col("carried"), F.col("first"))).alias("first"),
            F.max(F.struct("last", "last_seq")).alias("last"),
            F.sum("touches").alias("touches"),
        )
    )
    ranked = Window.partitionBy("k").orderBy(F.col("last").desc())
    return (
        whole.withColumn("recency", F.row_number().over(ranked))
        .where(F.col("recency") <= keep)
        .select(
            F.col("k").alias(key),
            F.col("text").alias(text),
            F.timestamp_micros("first").cast(types[ts]).alias("created_at"),
            F.timestamp_micros("last.last").cast(types[ts]).alias("touched_at"),
            F.col("last.last_seq").alias("last_seq"),
            "touches",
            "recency",
        )
    )
