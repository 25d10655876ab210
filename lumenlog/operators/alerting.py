"""Alerts: rules over effective scores, silences, throttles and recoveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def last_state(history: DataFrame) -> DataFrame:
    """The newest alert of each rule, system and criterion."""
    best = F.max_by(F.struct("state", "created_at", "id"), F.struct("created_at", "id"))
    return history.groupBy("rule_id", "system_id", "criterion_id").agg(best.alias("b")).select("rule_id", "system_id", "criterion_id", F.col("b.state").alias("last_state"), F.col("b.created_at").alias("last_at"))


def is_silenced(silences: DataFrame, now: Column) -> DataFrame:
    """Silences in force: [start, end). Scope: is_global, system_ids, rule_ids."""
    return silences.filter((F.col("starts_at") <= now) & (now < F.col("ends_at")))


def evaluate(effective: DataFrame, rules: DataFrame, channels: DataFrame, history: DataFrame, silences: DataFrame, now: Column) -> DataFrame:
    """Alerts to write: rule_id, channel_id, system_id, criterion_id, score, state (firing or resolved).

    A rule fires on its system and criterion (null: all) from its min_score on; only a change of state
    is written, not before the throttle has passed, and nothing under a silence. Rules, channels and
    silences are configuration and broadcast. ``schedule`` rules are evaluated elsewhere.
    """
    active = rules.filter("enabled and trigger_type != 'schedule'").join(channels.filter("enabled").select(F.col("id").alias("channel_id")), "channel_id")
    active = active.select(F.col("id").alias("rule_id"), "channel_id", F.col("system_id").alias("_system"), F.col("criterion_id").alias("_criterion"), "min_score", "throttle_seconds", "notify_recovery")
    fits = (F.col("_system").isNull() | (F.col("_system") == F.col("system_id"))) & (F.col("_criterion").isNull() | (F.col("_criterion") == F.col("criterion_id")))
    seen = effective.select("system_id", "criterion_id", F.col("effective").alias("score")).join(F.broadcast(active), fits)
    quiet = is_silenced(silences, now).select("is_global", "system_ids", "rule_ids")
    covers = F.col("is_global") | F.array_contains("system_ids", F.col("system_id")) | F.array_contains("rule_ids", F.col("rule_id"))
    seen = seen.join(F.broadcast(quiet), covers, "left_anti")
    df = seen.join(last_state(history), ["rule_id", "system_id", "criterion_id"], "left")
    firing = F.col("score") >= F.coalesce("min_score", F.lit(0.75))
    was = F.coalesce(F.col("last_state") == "firing", F.lit(False))
    rested = F.col("last_at").isNull() | (F.unix_micros(now) - F.unix_micros("last_at") >= F.coalesce("throttle_seconds", F.lit(0)).cast("long") * 1_000_000)
    state = F.when(firing & ~was & rested, "firing").when(~firing & was & F.coalesce("notify_recovery", F.lit(True)), "resolved")
    return df.withColumn("state", state).filter("state is not null").select("rule_id", "channel_id", "system_id", "criterion_id", "score", "state")


def title(system: Column, criterion: Column, score: Column, state: Column) -> Column:
    """``[CRITICAL] name: criterion at 80%``."""
    from ..functions.severity import score_band

    return F.concat(F.lit("["), F.when(state == "resolved", "RESOLVED").otherwise(score_band(score)), F.lit("] "), system, F.lit(": "), F.replace(criterion, F.lit("_"), F.lit(" ")), F.lit(" at "), F.round(score * 100).cast("int").cast("string"), F.lit("%"))


#: A channel's priority by score band.
PRIORITIES = {"ntfy": {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2}, "pushover": {"CRITICAL": 1, "HIGH": 1, "MEDIUM": 0, "LOW": -1}, "gotify": {"CRITICAL": 10, "HIGH": 7, "MEDIUM": 5, "LOW": 2}}


def payloads(alerts: DataFrame) -> DataFrame:
    """A JSON body for each alert by its channel's kind (webhook, pushover, ntfy, gotify, telegram). Sending is left to the sink.

    ``alerts``: kind, title, body, band, system_id, criterion_id, score, state.
    """
    level = lambda kind: F.try_element_at(F.create_map(*[F.lit(x) for p in PRIORITIES[kind].items() for x in p]), F.col("band"))
    body = {
        "webhook": F.to_json(F.struct("title", "body", F.lower("band").alias("severity"), "system_id", "criterion_id", "score", "state")),
        "pushover": F.to_json(F.struct("title", F.col("body").alias("message"), level("pushover").alias("priority"))),
        "ntfy": F.to_json(F.struct("title", F.col("body").alias("message"), level("ntfy").alias("priority"))),
        "gotify": F.to_json(F.struct("title", F.col("body").alias("message"), level("gotify").alias("priority"))),
        "telegram": F.to_json(F.struct(F.concat(F.col("title"), F.lit("\n"), F.col("body")).alias("text"), F.lit(True).alias("disable_web_page_preview"))),
    }
    out = F.lit(None).cast("string")
    for kind, c in body.items():
        out = F.when(F.col("kind") == kind, c).otherwise(out)
    return alerts.withColumn("payload", out).filter("payload is not null")


def states_over_time(scores: DataFrame, least: float = 0.75) -> DataFrame:
    """The changes of state that a run over all windows would write, from system_id, criterion_id, at and score."""
    w = W.partitionBy("system_id", "criterion_id").orderBy("at")
    df = scores.withColumn("firing", F.col("score") >= least).withColumn("was", F.coalesce(F.lag("firing").over(w), F.lit(False)))
    return df.filter("firing != was").select("system_id", "criterion_id", "at", "score", F.when(F.col("firing"), "firing").otherwise("resolved").alias("state"))
