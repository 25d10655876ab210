"""What a window's analysis is given, and what its answer does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.masking import mask_private
from . import normal, scoring


def window_events(events: DataFrame, windows: DataFrame, most: int | None = 500, unacked: bool = True) -> DataFrame:
    """window_id with its earliest events, unacknowledged ones unless told otherwise, ``most`` at most (None: all); the cap comes before any other step."""
    hour = 3_600_000_000
    t = F.unix_micros("timestamp")
    w = windows.select("window_id", "system_id", F.unix_micros("from_ts").alias("_a"), F.unix_micros("to_ts").alias("_b"))
    w = w.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_a") / hour), F.floor((F.col("_b") - 1) / hour))))
    e = (events.filter("acknowledged_at is null") if unacked else events).withColumn("_bucket", F.floor(t / hour))
    inside = e.join(w, ["system_id", "_bucket"]).filter((t >= F.col("_a")) & (t < F.col("_b")))
    if most is None:
        return inside.drop("_a", "_b", "_bucket")
    order = W.partitionBy("window_id").orderBy("timestamp", "id")
    return inside.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= most).drop("_at", "_a", "_b", "_bucket")


def window_counts(events: DataFrame, windows: DataFrame, unacked: bool = True) -> DataFrame:
    """window_id and the number of its events, 0 where there are none."""
    n = window_events(events, windows, None, unacked).groupBy("window_id").agg(F.count(F.lit(1)).alias("n"))
    return windows.select("window_id", "system_id").join(n, "window_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def results_with_systems(results: DataFrame, windows: DataFrame, systems: DataFrame) -> DataFrame:
    """Analyses (window_id and others) with their window's times and their system's id and name."""
    own = windows.select("window_id", "system_id", "from_ts", "to_ts")
    return results.drop("system_id", "from_ts", "to_ts").join(own, "window_id").join(systems.select("system_id", F.col("name").alias("system_name")), "system_id")


def meta_input(events: DataFrame, windows: DataFrame, scores: DataFrame, templates: DataFrame, most: int = 500, least_groups: int = 5, privacy: bool = False) -> DataFrame:
    """Grouped events of each window, the highest scores first.

    Cap, drop normal behaviour, join scores, group by template, drop zero groups (only if there are more
    than ``least_groups`` and one is not zero), mask, sort.
    """
    kept = normal.kept(window_events(events, windows, most), templates)
    high = scores.groupBy(F.col("event_id").alias("id")).agg(F.max("score").alias("score"))
    key = F.coalesce("template_id", F.col("id").cast("string")).alias("group_key")
    first = F.min_by(F.struct("id", "message", "severity", "host", "program"), F.struct("timestamp", "id"))
    g = kept.join(high, "id", "left").groupBy("window_id", "system_id", key).agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"), first.alias("e"))
    w = W.partitionBy("window_id")
    g = g.withColumns({"_n": F.count(F.lit(1)).over(w), "_top": F.max("score").over(w)}).filter((F.col("_n") <= least_groups) | (F.col("_top") == 0) | (F.col("score") > 0))
    text = mask_private(F.col("e.message")) if privacy else F.col("e.message")
    out = g.select("window_id", "system_id", "group_key", "n", "score", F.col("e.id").alias("id"), text.alias("message"), F.col("e.severity").alias("severity"), F.col("e.host").alias("host"), F.col("e.program").alias("program"))
    return out.withColumn("at", F.row_number().over(W.partitionBy("window_id").orderBy(F.desc("score"), "id")))


def parsed_answers(answers: DataFrame) -> DataFrame:
    """window_id, and the parts of a model's JSON answer; scores are clamped to 0..1, missing ones are 0."""
    from ..functions.similarity import json_in
    from ..schema import CRITERIA

    shape = "struct<meta_scores:map<string,double>,summary:string,new_findings:array<struct<text:string,severity:string,criterion:string>>,resolved_indices:array<struct<index:int,evidence:string,event_refs:array<int>>>,still_active_indices:array<int>>"
    df = answers.withColumn("a", F.from_json(json_in(F.col("answer")), shape))
    scores = F.create_map(*[x for i, n in CRITERIA.items() for x in (F.lit(i), scoring.clamp01(F.try_element_at("a.meta_scores", F.lit(n))))])
    return df.select("window_id", scores.alias("meta_scores"), "a.summary", "a.new_findings", "a.resolved_indices", "a.still_active_indices")


def padded_scores(scores: Column, n: int) -> Column:
    """A list of score arrays as long as the batch: extra ones go, missing ones are zero."""
    zero = F.array_repeat(F.lit(0.0), 6)
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.get(scores, i - 1), zero))


def distinct_events(events: DataFrame, most: int = 500) -> DataFrame:
    """One event for each hash, the earliest, the first ``most``."""
    first = F.row_number().over(W.partitionBy("normalized_hash").orderBy("timestamp", "id"))
    return events.withColumn("_n", first).filter("_n = 1").drop("_n").orderBy("timestamp", "id").limit(most)
