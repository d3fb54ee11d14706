"""Event streams: source, debouncing, variants, bounded history, exactly-once output.

`crunch_history_stream` chains them in one query: bursts, guard, variants, history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusmill.functions.text import is_blank, text_of
from corpusmill.operators.history import DEDUP_WINDOW, HISTORY_SIZE, min_length
from corpusmill.operators.route import best_variant, build_variants

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_event_stream(
    spark: SparkSession, schema: str, folder: str, text: str = "text", files_per_batch: int = 100
) -> DataFrame:
    """New parquet files of a folder as a stream, without blank events."""
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )
    return stream.where(~is_blank(text_of(text)))


def debounce_stream(
    events: DataFrame,
    key: str,
    ts: str,
    delay_seconds: float = 0.3,
    lateness: str = "1 minute",
    seq: str | None = None,
) -> DataFrame:
    """One event per burst: its last one, emitted once the key was quiet.

    A session window per key; state is one partial row per open burst. Rows
    later than the watermark are dropped. A session takes in an event exactly
    one gap later, a burst does not, hence the gap one microsecond short.
    """
    if delay_seconds <= 0:
        return events
    gap = f"{round(delay_seconds * 1_000_000) - 1} microseconds"
    last = F.max_by(F.struct(*events.columns), F.struct(ts, *([seq] if seq else [])))
    return (
        events.withWatermark(ts, lateness)
        .groupBy(key, F.session_window(ts, gap))
        .agg(last.alias("e"), F.count("*").alias("burst_events"))
        .select("e.*", "burst_events")
    )


def crunch_stream(events: DataFrame, text: str = "text", min_chars: int = 5) -> DataFrame:
    """Guarded events with their variants, the active one, and what to write back.

    `write_back` is NULL unless the active variant differs from the text, so a
    writer never echoes an unchanged event.
    """
    kept = min_length(events.where(~is_blank(text_of(text))), min_chars, text)
    active = best_variant(F.col("variants"))
    return (
        build_variants(kept, text)
        .withColumn("active", active)
        .withColumn(
            "write_back", F.when(F.col("active.text") != F.col(text), F.col("active.text"))
        )
    )


def write_batches(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, mode: str = "append"
):
    """Run a batch sink on a stream; `once` works off what is there and stops."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def batch_folder(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink with one folder per batch, so that a batch that runs again replaces itself.

    The stream's checkpoint repeats a batch with the same input and state, so each
    batch is there exactly once, whether it died before, in or after the writing.
    """
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def written_batches(spark: SparkSession, folder: str, schema) -> DataFrame:
    """What a `batch_folder` holds, with the number of the batch."""
    fields = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(fields).option("basePath", folder).parquet(f"{folder}/batch=*")


class HistoryProcessor(StatefulProcessor):
    """Keeps the newest entries of a key; emits the entry each event touched.

    An entry keeps the columns `along` of the event that made it.
    """

    def __init__(
        self,
        key: str,
        ts: str,
        text: str,
        window: int,
        keep: int,
        seq: str | None = None,
        ttl: int | None = None,
        along: Sequence[tuple[str, T.DataType]] = (),
    ):
        self.key, self.ts, self.text, self.seq = key, ts, text, seq
        self.window, self.keep, self.ttl, self.along = window, keep, ttl, list(along)

    def init(self, handle: StatefulProcessorHandle) -> None:
        own = [
            T.StructField("text", T.StringType()),
            T.StructField("created_at", T.TimestampType()),
            T.StructField("touches", T.LongType()),
        ]
        self.entries = handle.getListState(
            "entries",
            T.StructType(own + [T.StructField(f"along_{name}", kind) for name, kind in self.along]),
            ttlDurationMs=self.ttl * 1000 if self.ttl else None,
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        kept = [tuple(e) for e in self.entries.get()]
        touched = []
        order = [self.ts, self.seq] if self.seq else [self.ts]
        names = [name for name, _ in self.along]
        events = pd.concat(list(rows)).sort_values(order, kind="stable")
        for at, text, *more in events[[self.ts, self.text, *names]].itertuples(index=False):
            at = pd.Timestamp(at).to_pydatetime()
            spot = next((i for i, e in enumerate(kept[: self.window]) if e[0] == text), None)
            old = kept.pop(spot) if spot is not None else (text, at, 0, *(None if pd.isna(x) else x for x in more))
            entry = (text, old[1], int(old[2]) + 1, *old[3:])
            kept.insert(0, entry)
            del kept[self.keep :]
            touched.append((key[0], text, old[1], at, entry[2], *entry[3:]))
        self.entries.put(kept)
        yield pd.DataFrame(touched, columns=[self.key, self.text, "created_at", "touched_at", "touches", *names])

    def close(self) -> None:
        pass


def history_stream(
    events: DataFrame,
    key: str,
    ts: str,
    text: str = "text",
    window: int = DEDUP_WINDOW,
    keep: int = HISTORY_SIZE,
    seq: str | None = None,
    ttl_seconds: int | None = None,
    along: Sequence[str] = (),
    mode: str = "Update",
) -> DataFrame:
    """Move-to-front history per key as keyed state of at most `keep` entries.

    seq orders events of equal time, as in the batch form. With ttl_seconds the
    state of a key that gets no events for that long is given up. `along` names
    columns that an entry keeps from the event that made it.
    """
    types = {f.name: f.dataType for f in events.schema.fields}
    schema = T.StructType(
        [
            T.StructField(key, types[key]),
            T.StructField(text, T.StringType()),
            T.StructField("created_at", T.TimestampType()),
            T.StructField("touched_at", T.TimestampType()),
            T.StructField("touches", T.LongType()),
            *[T.StructField(name, types[name]) for name in along],
        ]
    )
    own = [(name, types[name]) for name in along]
    return (
        events.where(~is_blank(text_of(text)))
        .select(key, ts, *([seq] if seq else []), text, *along)
        .groupBy(key)
        .transformWithStateInPandas(
            statefulProcessor=HistoryProcessor(key, ts, text, window, keep, seq, ttl_seconds, own),
            outputStructType=schema,
            outputMode=mode,
            timeMode="ProcessingTime" if ttl_seconds else "None",
        )
    )


VARIANT = ["label", "saved_percent", "write_back"]


def with_variant(events: DataFrame, text: str = "text", min_chars: int = 5) -> DataFrame:
    """Guarded events with label, saving and text to write back of their active variant."""
    crunched = crunch_stream(events, text, min_chars)
    return crunched.select(*events.columns, "active.label", "active.saved_percent", "write_back")


def crunch_history_stream(
    events: DataFrame,
    key: str,
    ts: str,
    seq: str,
    text: str = "text",
    delay_seconds: float = 0.3,
    lateness: str = "1 minute",
    min_chars: int = 5,
    window: int = DEDUP_WINDOW,
    keep: int = HISTORY_SIZE,
) -> DataFrame:
    """Bursts, guard, variants and history in one query: the entry that each event touched.

    key, text, created_at, touched_at, touches, label, saved_percent, write_back. Two
    stateful operators follow each other: the last event of a burst, and the history of
    its key, whose entries keep the variant they were made with. Rows later than the
    watermark are dropped, and a burst comes out when the watermark has passed it.
    """
    own = [key, ts, seq, text]
    quiet = debounce_stream(events.select(*own), key, ts, delay_seconds, lateness, seq)
    return history_stream(
        with_variant(quiet.select(*own), text, min_chars), key, ts, text, window, keep, seq, along=VARIANT, mode="Append"
    )


def latest_entries(touched: DataFrame, key: str, text: str = "text", keep: int = HISTORY_SIZE) -> DataFrame:
    """The history that the touched entries amount to: the newest `keep` of a key, ranked.

    An entry is told by key, text and when it was created.
    """
    entry = [key, text, "created_at"]
    rest = [c for c in touched.columns if c not in (*entry, "touched_at", "touches", "batch")]
    last = touched.groupBy(*entry).agg(
        F.max(F.struct("touches", "touched_at")).alias("last"), *[F.first(c).alias(c) for c in rest]
    )
    newest = Window.partitionBy(key).orderBy(F.desc("last.touched_at"), F.desc("created_at"), text)
    ranked = last.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= keep)
    return ranked.select(*entry, "last.touched_at", "last.touches", *rest, "recency")
