"""Ingest as a stream: each micro-batch goes through the batch operators and is appended once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import events as ev, ingest as ing
from ..storage import Folder

#: Batches whose time is kept; only the last one may run again.
KEPT_CLOCKS = 100


def read_or_none(spark, path: str) -> DataFrame | None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def append_events(events: DataFrame, path: str) -> None:
    """Appends events the store has not got, by month. Only months in the batch are read for that."""
    rows = events.withColumn("event_month", F.date_format("timestamp", "yyyy-MM"))
    have = read_or_none(events.sparkSession, path)
    if have is not None:
        months = [r[0] for r in rows.select("event_month").distinct().collect()]
        rows = ev.append_new(have.filter(F.col("event_month").isin(months)), rows)
    else:
        rows = ev.append_new(rows.limit(0), rows)
    rows.write.mode("append").partitionBy("event_month").parquet(path)


def batch_time(spark, checkpoint: str, number: int, now: datetime) -> datetime:
    """The time at which a batch was first worked on, kept beside the checkpoint: a batch that runs again has the same."""
    clock = Folder(spark, f"{checkpoint}/clock")
    if (known := clock.read(str(number))) is None:
        clock.swap(str(number), known := now.isoformat())
        for old in clock.names():
            if old.isdigit() and int(old) < number - KEPT_CLOCKS:
                clock.drop(old)
    return datetime.fromisoformat(known)


def start_ingest(records: DataFrame, sources: Sequence[Mapping], systems: DataFrame, events_path: str, discovery_path: str, checkpoint: str, now: Callable[[], datetime] | None = None, redaction: bool = False, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query over streamed records (column ``record``): normalise, route, redact, hash and append as one step that may run twice.

    A batch that runs again, because it was lost between writing and its commit, works at the time of its
    first run, gives events the same ids and hashes, adds none that the store has, and puts its discovery
    rows into the folder of its own number, replacing what is there.
    Processes what is there and stops, unless ``trigger`` says otherwise; run again, it goes on from its checkpoint.
    """

    def batch(df: DataFrame, number: int) -> None:
        at = F.lit(batch_time(df.sparkSession, checkpoint, number, now() if now else datetime.now(UTC))).cast("timestamp")
        df = df.persist()
        try:
            events, seen = ing.ingest(df, sources, systems, at, redaction=redaction)
            append_events(events, events_path)
            seen.write.mode("overwrite").parquet(f"{discovery_path}/batch={number}")
        finally:
            df.unpersist()

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def deduplicated(events: DataFrame, watermark: str = "48 hours") -> DataFrame:
    """A stream without repeats of hash and time within the watermark; the sink's anti-join does the rest."""
    return events.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["normalized_hash"])


def windowed_max(scores: DataFrame, minutes: int = 5, watermark: str = "48 hours") -> DataFrame:
    """The greatest score of each window, system and criterion of a stream (timestamp, system_id, criterion_id, score)."""
    w = F.window("timestamp", f"{minutes} minutes")
    return scores.withWatermark("timestamp", watermark).groupBy(w, "system_id", "criterion_id").agg(F.max("score").alias("highest")).select("system_id", "criterion_id", F.col("window.start").alias("from_ts"), F.col("window.end").alias("to_ts"), "highest")


def next_interval(minutes: float, active: bool, least: float = 15, most: float = 120) -> float:
    """How long until the next run: the least after activity, else twice as long, up to the most."""
    return least if active else min(minutes * 2, most)


def score_feed(meta: DataFrame, now, seconds: int = 30) -> DataFrame:
    """What a live view is sent: results of the last seconds, or one heartbeat row."""
    fresh = meta.filter(F.unix_micros("created_at") > F.unix_micros(now) - seconds * 1_000_000).select(F.lit("scores").alias("kind"), "window_id", "created_at")
    beat = meta.sparkSession.range(1).select(F.lit("heartbeat").alias("kind"), F.lit(None).cast(dict(meta.dtypes)["window_id"]).alias("window_id"), F.lit(None).cast("timestamp").alias("created_at"))
    one = fresh.limit(1).select(F.lit(1).alias("_x"))
    return fresh.unionByName(beat.join(F.broadcast(one), F.lit(True), "left_anti"))  # one row against one row
