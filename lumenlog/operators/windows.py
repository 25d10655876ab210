"""Time windows, effective scores and their recalculation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HOUR = 3_600_000_000


def micros(c: str | Column) -> Column:
    return F.unix_micros(c)


def tumbling(events: DataFrame, stored: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Windows to add: system_id, from_ts, to_ts of closed non-empty windows after each system's last one.

    Windows continue from the end of the system's last stored window; a system without any starts one
    window before ``now``.
    """
    width = minutes * 60_000_000
    last = stored.groupBy("system_id").agg(F.max("to_ts").alias("_last"))
    df = events.select("system_id", micros("timestamp").alias("_t")).join(last, "system_id", "left")  # one row a system
    start = F.coalesce(micros("_last"), micros(now) - width)
    df = df.withColumn("_k", F.floor((F.col("_t") - start) / width)).withColumn("_from", start + F.col("_k") * width)
    found = df.filter((F.col("_k") >= 0) & (F.col("_from") + width <= micros(now))).select("system_id", "_from").distinct()
    return found.select("system_id", F.timestamp_micros("_from").alias("from_ts"), F.timestamp_micros(F.col("_from") + width).alias("to_ts"), F.lit("time").alias("trigger"))


def blend(meta: Column, highest: Column, w_meta: float = 0.7) -> Column:
    return F.lit(w_meta) * meta + F.lit(1 - w_meta) * highest


def scores_of_both(events: DataFrame, metadata: DataFrame, scores: DataFrame) -> DataFrame:
    """system_id, timestamp, criterion_id, score of unacknowledged events, own ones and those an external index holds.

    ``metadata``: system_id, event_id, event_timestamp, acknowledged_at of external events. Both kinds meet
    the scores in one join.
    """
    own = events.filter("acknowledged_at is null").select("system_id", F.col("id").cast("string").alias("event_id"), "timestamp")
    far = metadata.filter("acknowledged_at is null").select("system_id", F.col("event_id").cast("string").alias("event_id"), F.col("event_timestamp").alias("timestamp"))
    s = scores.filter("score_type = 'event'").select(F.col("event_id").cast("string").alias("event_id"), "criterion_id", "score")
    return own.unionByName(far).join(s, "event_id").select("system_id", "timestamp", "criterion_id", "score")


def window_max(windows: DataFrame, scored_events: DataFrame, closed: bool = False, bucket: int = HOUR, criteria: tuple[int, ...] = (1, 2, 3, 4, 5, 6)) -> DataFrame:
    """window_id, system_id, criterion_id, highest: the greatest event score in each window, 0 where there is none.

    A range join by time buckets: a window is listed under each bucket it touches, an event under its
    own, so the join has an equality key. ``closed``: the window's end belongs to it. ``scored_events``:
    system_id, timestamp, criterion_id, score.
    """
    w = windows.select("window_id", "system_id", micros("from_ts").alias("_a"), micros("to_ts").alias("_b"))
    last = F.col("_b") if closed else F.greatest(F.col("_b") - 1, F.col("_a"))
    listed = w.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_a") / bucket), F.floor(last / bucket))))
    e = scored_events.select("system_id", micros("timestamp").alias("_t"), "criterion_id", "score").withColumn("_bucket", F.floor(F.col("_t") / bucket))
    # Events at the same instant fold before they meet windows.
    e = e.groupBy("system_id", "_bucket", "_t", "criterion_id").agg(F.max("score").alias("score"))
    inside = (F.col("_t") >= F.col("_a")) & ((F.col("_t") <= F.col("_b")) if closed else (F.col("_t") < F.col("_b")))
    best = listed.join(e, ["system_id", "_bucket"]).filter(inside).groupBy("window_id", "criterion_id").agg(F.max("score").alias("highest"))
    grid = windows.select("window_id", "system_id", F.explode(F.array(*[F.lit(c) for c in criteria])).alias("criterion_id"))
    return grid.join(best, ["window_id", "criterion_id"], "left").select("window_id", "system_id", "criterion_id", F.coalesce("highest", F.lit(0.0)).alias("highest"))


def effective(windows: DataFrame, meta: DataFrame, scored_events: DataFrame, w_meta: float = 0.7, closed: bool = False) -> DataFrame:
    """The effective score of each window and criterion. ``meta``: window_id, criterion_id, meta_score; missing ones are 0."""
    highest = window_max(windows, scored_events, closed)
    joined = highest.join(meta, ["window_id", "criterion_id"], "left").withColumn("meta_score", F.coalesce("meta_score", F.lit(0.0)))
    return joined.withColumn("effective", blend(F.col("meta_score"), F.col("highest"), w_meta))


def upserted(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("window_id", "system_id", "criterion_id")) -> DataFrame:
    """All rows with the newer of equal keys: untouched old rows and all new ones, without a sort."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def recalculated(windows: DataFrame, stored: DataFrame, scored_events: DataFrame, now: Column, days: int = 7, w_meta: float = 0.7) -> DataFrame:
    """Effective scores of the last days' windows anew, both ends inclusive; meta scores stay."""
    recent = windows.filter(micros("to_ts") >= micros(now) - days * 24 * HOUR)
    highest = window_max(recent, scored_events, closed=True)
    again = stored.drop("highest").join(highest, ["window_id", "system_id", "criterion_id"]).withColumn("effective", blend(F.col("meta_score"), F.col("highest"), w_meta))
    return upserted(stored, again.select(*stored.columns))


def live_max(scored_events: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """system_id, criterion_id, live: the greatest score of the last days."""
    return scored_events.filter(micros("timestamp") >= micros(now) - days * 24 * HOUR).groupBy("system_id", "criterion_id").agg(F.max("score").alias("live"))


def latest_windows(windows: DataFrame) -> DataFrame:
    """Each system's window with the latest end; ties go to the greatest id."""
    best = F.max_by(F.struct(*windows.columns), F.struct("to_ts", "window_id"))
    return windows.groupBy("system_id").agg(best.alias("_w")).select("_w.*")


def supplemented(stored: DataFrame, windows: DataFrame, live: DataFrame, w_meta: float = 0.7) -> DataFrame:
    """The latest window's highest scores raised to the live maximum where that is greater."""
    latest = latest_windows(windows).select("window_id", F.lit(True).alias("_latest"))
    df = stored.join(latest, "window_id", "left").join(live, ["system_id", "criterion_id"], "left")  # one window a system
    raised = F.when(F.col("_latest") & (F.col("live") > F.col("highest")), F.col("live")).otherwise(F.col("highest"))
    return df.withColumn("highest", raised).withColumn("effective", F.when(F.col("_latest"), blend(F.col("meta_score"), F.col("highest"), w_meta)).otherwise(F.col("effective"))).select(*stored.columns)


def seeded(windows: DataFrame, live: DataFrame, w_meta: float = 0.7) -> DataFrame:
    """Rows for a latest window that has none: meta 0, the live maximum weighed as event score."""
    latest = latest_windows(windows).select("window_id", "system_id")
    grid = latest.withColumn("criterion_id", F.explode(F.sequence(F.lit(1), F.lit(6))))
    high = F.coalesce("live", F.lit(0.0))
    return grid.join(live, ["system_id", "criterion_id"], "left").select("window_id", "system_id", "criterion_id", F.lit(0.0).alias("meta_score"), high.alias("highest"), blend(F.lit(0.0), high, w_meta).alias("effective"))


def zero_rows(windows: DataFrame) -> DataFrame:
    """Six zero rows for windows in which nothing happened, instead of an analysis."""
    return windows.select("window_id", "system_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("criterion_id"), *[F.lit(0.0).alias(c) for c in ("meta_score", "highest", "effective")])


def manual_window(events: DataFrame, system_id: int, now: Column, days: int = 7, most: int = 500) -> DataFrame:
    """The events of a window asked for by hand: the first ``most`` unacknowledged ones of the last days, with the window's bounds."""
    start = micros(now) - days * 24 * HOUR
    inside = micros("timestamp").between(start, micros(now)) & F.col("acknowledged_at").isNull() & (F.col("system_id") == system_id)
    return events.filter(inside).orderBy("timestamp", "id").limit(most).withColumns({"from_ts": F.timestamp_micros(start), "to_ts": now})


def forgotten(stored: DataFrame, system_id: int, window_id: int, w_meta: float = 0.7) -> DataFrame:
    """Effective scores after a window asked for by hand: the system's other windows lose their meta score."""
    other = (F.col("system_id") == system_id) & (F.col("window_id") != window_id)
    again = blend(F.lit(0.0), F.col("highest"), w_meta)
    return stored.withColumns({"effective": F.when(other, again).otherwise(F.col("effective")), "meta_score": F.when(other, 0.0).otherwise(F.col("meta_score"))})


def all_zero(windows: DataFrame, scored_events: DataFrame) -> DataFrame:
    """window_id and whether all its event scores are 0, also if it has none."""
    return window_max(windows, scored_events).groupBy("window_id").agg((F.max("highest") == 0).alias("all_zero"))


def best_effective(effective_rows: DataFrame, windows: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """For each system and criterion the greatest effective score of the recent windows, with its window; ties go to the later, then the greater id."""
    recent = windows.filter(micros("to_ts") >= micros(now) - days * 24 * HOUR).select("window_id", "to_ts")
    joined = effective_rows.join(recent, "window_id")
    best = F.max_by(F.struct("window_id", "effective", "meta_score", "highest", "to_ts"), F.struct("effective", "to_ts", "window_id"))
    return joined.groupBy("system_id", "criterion_id").agg(best.alias("b")).select("system_id", "criterion_id", "b.*")


def with_fallback(best: DataFrame, live: DataFrame, systems: DataFrame) -> DataFrame:
    """Systems whose effective scores are all 0 or missing show the live maximum itself."""
    grid = systems.select("system_id").withColumn("criterion_id", F.explode(F.sequence(F.lit(1), F.lit(6))))
    df = grid.join(best.select("system_id", "criterion_id", "effective"), ["system_id", "criterion_id"], "left").join(live, ["system_id", "criterion_id"], "left")
    quiet = F.max(F.coalesce("effective", F.lit(0.0))).over(W.partitionBy("system_id")) == 0
    return df.withColumn("shown", F.when(quiet, F.coalesce("live", F.lit(0.0))).otherwise(F.coalesce("effective", F.lit(0.0)))).select("system_id", "criterion_id", "shown")


def orphans(windows: DataFrame, events: DataFrame, bucket: int = HOUR) -> DataFrame:
    """Windows in which no event lies, by the same buckets as :func:`window_max`."""
    w = windows.select("window_id", "system_id", micros("from_ts").alias("_a"), micros("to_ts").alias("_b"))
    listed = w.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_a") / bucket), F.floor(F.col("_b") / bucket))))
    e = events.select("system_id", micros("timestamp").alias("_t")).withColumn("_bucket", F.floor(F.col("_t") / bucket)).distinct()
    used = listed.join(e, ["system_id", "_bucket"]).filter((F.col("_t") >= F.col("_a")) & (F.col("_t") < F.col("_b"))).select("window_id").distinct()
    return windows.join(used, "window_id", "left_anti")
