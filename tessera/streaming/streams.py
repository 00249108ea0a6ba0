"""Structured Streaming forms of what arrives piece by piece."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import dedup
from tessera.operators.storage import shared_dir


def files_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Parquet files as they arrive in a folder; a single file is read through its folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path)


def events_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return files_stream(spark, path, schema, files).withColumn("ts", F.col("ts").cast("timestamp"))


def owned_stream(detections: DataFrame, cores: DataFrame) -> DataFrame:
    """Ownership needs no neighbours, so it is stateless: a stream-static join."""
    return dedup.owned(detections, cores)


def live_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per window and type under a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def current_generation(events: DataFrame, generations: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Drops events of another generation than the static table's ``current`` one, and repeats within the watermark."""
    df = events.join(generations, "user_id").where(F.col("generation") == F.col("current"))
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def above_threshold(events: DataFrame, thresholds: DataFrame) -> DataFrame:
    return events.join(thresholds, "event_type").where(F.col("value") >= F.col("threshold"))


#: Places of a history that are kept together: each call on the state takes its time, whatever it carries.
BLOCK = 256


class History(StatefulProcessor):
    """A session's undo history: the events at its places as map state, in blocks of ``BLOCK`` places (-1: none yet), cursor,
    length and last event as value state.

    A batch reads and writes the blocks that its events touch, and returns their places, however long the history is. With
    ``idle_ms`` a timer is put off at each batch; when it expires, the session is closed and its state dropped.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "block long", "seqs array<long>")
        self.ends = handle.getValueState("ends", "cursor long, length long, last_seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cursor, length, last = self.ends.get() or (0, 0, -1)
        old, written = length, {}
        events = [e for b in rows for e in zip(b["seq"].tolist(), b["action"].tolist())]
        for seq, action in sorted(events, key=lambda e: e[0]):
            if action == "undo":
                cursor = max(0, cursor - 1)
            elif action == "redo":
                cursor = min(length, cursor + 1)
            else:
                written[cursor] = seq
                cursor = length = cursor + 1
            last = max(last, seq)
        blocks: dict[int, dict[int, int]] = {}
        for place, seq in written.items():
            blocks.setdefault(place // BLOCK, {})[place % BLOCK] = seq
        for block, news in blocks.items():
            held = self.blocks.getValue((block,)) if block * BLOCK < old else None  # none of its places is in use yet
            seqs = list(held[0]) if held else []
            seqs += [-1] * (max(news) + 1 - len(seqs))
            for k, seq in news.items():
                seqs[k] = seq
            self.blocks.updateValue((block,), (seqs,))
        self.ends.update((cursor, length, last))
        if self.idle_ms is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._rows(key, last, cursor, written, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cursor, _, last = self.ends.get()
        self.ends.clear()
        self.blocks.clear()
        yield self._rows(key, last, cursor, {}, True)

    @staticmethod
    def _rows(key, last: int, cursor: int, written: dict[int, int], closed: bool) -> pd.DataFrame:
        n, none = len(written) + 1, np.array([*[False] * len(written), True])
        place, seq = (pd.arrays.IntegerArray(np.array([*v, 0], np.int64), none.copy()) for v in (written.keys(), written.values()))
        fixed = {"session_id": [key[0]] * n, "last_seq": np.full(n, last), "cursor": np.full(n, cursor), "closed": np.full(n, closed)}
        return pd.DataFrame(fixed | {"place": place, "seq": seq}, copy=False)


CHANGES = "session_id long, last_seq long, cursor long, closed boolean, place long, seq long"


def standing_events(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Undo and redo while events (session_id, seq, action) arrive in a session's order. A session gives, for each batch that
    touches it, a row with its last event and its cursor, and one more for each place of its history that got another event.

    ``idle_ms``: for queries that go on; one that ends with the available data does not end while timers are open.
    """
    mode = "None" if idle_ms is None else "ProcessingTime"
    return events.groupBy("session_id").transformWithStateInPandas(History(idle_ms), CHANGES, "Update", mode)


def standing(changes: DataFrame) -> DataFrame:
    """(session_id, place, seq) of the events that stand, from all that ``standing_events`` gave."""
    now = changes.groupBy("session_id").agg(F.max_by("cursor", "last_seq").alias("cursor"))
    held = changes.where("place IS NOT NULL").groupBy("session_id", "place").agg(F.max_by("seq", "last_seq").alias("seq"))
    return held.join(now, "session_id").where("place < cursor").select("session_id", "place", "seq")


def arrived_rasters(tiles: DataFrame) -> DataFrame:
    """Statistics per raster of tiles (raster_id, payload) that arrive over time: each batch leaves partial ones."""
    parts = "raster_id int, tiles long, n long, total double, low double, high double"

    def partial(df: DataFrame, epoch: int) -> DataFrame:
        v = F.col("payload")
        add = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
        agg = [F.count("*").alias("tiles"), F.sum(F.size(v)).alias("n"), F.sum(add).alias("total"), F.min(F.array_min(v)).cast("double").alias("low"), F.max(F.array_max(v)).cast("double").alias("high")]
        return df.groupBy("raster_id").agg(*agg)

    done = run_to_table(tiles, "arrivals", each=partial, schema=parts)
    return done.groupBy("raster_id").agg(F.sum("tiles").alias("tiles"), (F.sum("total") / F.sum("n")).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))


#: Stateful processors keep their state in RocksDB.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_to_table(stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None, schema: str | None = None, rocksdb: bool = False, at: str | None = None) -> DataFrame:
    """Runs all available data through ``stream`` (and each batch through ``each``, whose result has ``schema``) into a
    Parquet table in the shared folder and reads it. A batch that is run again overwrites its own files. With the same
    folder ``at`` a later run goes on from the checkpoint."""
    spark = stream.sparkSession
    at = at or f"{shared_dir(spark)}/tessera/{uuid.uuid4().hex}/{name}"

    def put(df: DataFrame, epoch: int) -> None:
        df = each(df, epoch) if each else df
        df.write.mode("overwrite").parquet(f"{at}/rows/batch={0 if mode == 'complete' else epoch}")

    before = spark.conf.get(STORE[0])
    try:
        if rocksdb:
            spark.conf.set(*STORE)
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start()
        q.awaitTermination()
    finally:
        spark.conf.set(STORE[0], before)
    return spark.read.schema(schema or stream.schema).parquet(f"{at}/rows").drop("batch")
