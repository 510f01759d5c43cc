"""Structured Streaming over events: windows, sessions, deduplication, a join to a dimension, and a stateful detector.

Every function takes a batch or a streaming frame; a watermark bounds the state of a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "1 hour"


def read_events(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the events table, a folder or one file; times become timestamps, as watermarks ask for."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        folder, name = path.rsplit("/", 1)
        return with_time(reader.option("pathGlobFilter", name).parquet(folder))
    return with_time(reader.parquet(path))


def with_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = LATE) -> DataFrame:
    """Counts and values by kind in windows that do not overlap."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", slide: str = "1 day", late: str = LATE) -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = LATE) -> DataFrame:
    """Runs of a user's events with no gap of that length."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end_"), "n")


def distinct_events(events: DataFrame, by: tuple = ("user_id", "event_type"), late: str = LATE) -> DataFrame:
    """The first event of each key within the watermark; on a batch, of each key."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(by))
    from pyspark.sql import Window

    return events.withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy("ts", "event_id"))).where("rk = 1").drop("rk")


def with_dimension(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events with a column of a dimension table (user_id, name); the plan broadcasts it only if its size is under the session's limit."""
    return events.join(users, "user_id", "left")


# --- a detector that carries what sounds from event to event -------------------------------------------

_OUT = "user_id long, event_id long, held string, name string"
_STATE = "tones array<int>"


def detect(events: DataFrame, keep: int = 4) -> DataFrame:
    """For each user and event: the last distinct tones (event value mod 12) held, and their chord's name if it has one.

    On a stream the tones are state (``applyInPandasWithState``), dropped when the watermark is a day past a user's last event; events of one
    trigger are taken in time order.  On a batch the same fold runs over each user's events."""
    from partita.functions.theory import NoMatch, name_chord

    def step(tones: list[int], tone: int) -> list[int]:
        return ([t for t in tones if t != tone] + [tone])[-keep:]

    def name(tones: list[int]) -> str | None:
        try:
            return name_chord(frozenset(tones), tones[0]) if len(tones) > 2 else None
        except NoMatch:
            return None

    def fold(user: int, tones: list[int], rows: pd.DataFrame) -> tuple[list[int], pd.DataFrame]:
        out = []
        for event_id, value in zip(*(rows.sort_values(["ts", "event_id"])[c] for c in ("event_id", "value")), strict=True):
            tones = step(tones, int(abs(value)) % 12)
            out.append((user, event_id, " ".join(map(str, tones)), name(tones)))
        return tones, pd.DataFrame(out, columns=["user_id", "event_id", "held", "name"])

    chosen = events.where(F.col("value").isNotNull()).select("user_id", "event_id", "ts", "value")
    if not events.isStreaming:
        return chosen.groupBy("user_id").applyInPandas(lambda key, rows: fold(key[0], [], rows)[1], _OUT)

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def live(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tones = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches))
        tones, out = fold(key[0], tones, rows)
        state.update((tones,))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + 24 * 3600 * 1000)
        yield out

    return chosen.withWatermark("ts", LATE).groupBy("user_id").applyInPandasWithState(live, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote.  ``complete`` goes through one batch's table."""
    spark = stream.sparkSession
    if mode == "append":
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    else:
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.parquet(path)
