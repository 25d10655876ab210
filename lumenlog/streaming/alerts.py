"""Alert states over a stream of effective scores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEYS = ("rule_id", "channel_id", "system_id", "criterion_id")
OUT = "rule_id long, channel_id long, system_id long, criterion_id long, at timestamp, score double, state string"


def next_state(last: tuple[str, int] | None, at: int, score: float, least: float, throttle_s: int, recovers: bool) -> str | None:
    """What a rule writes at ``at`` (microseconds) after its last alert (state, time): a change of state, not before the throttle has passed."""
    firing, was = score >= least, last is not None and last[0] == "firing"
    if firing and not was and (last is None or at - last[1] >= throttle_s * 1_000_000):
        return "firing"
    return "resolved" if not firing and was and recovers else None


class Rule(StatefulProcessor):
    """The last alert of one rule, system and criterion is all that is kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "state string, at long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        newest = initialState.sort_values("at").iloc[-1]
        self.last.update((newest["state"], int(newest["at"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        frames = [f for f in rows if len(f)]
        for r in pd.concat(frames).sort_values("micros", kind="stable").to_dict("records") if frames else []:
            state = next_state(last, int(r["micros"]), r["score"], r["least"], int(r["throttle"]), bool(r["recovers"]))
            if state:
                last = (state, int(r["micros"]))
                out.append((*key, r["micros"], float(r["score"]), state))
        if out:
            self.last.update(last)
        frame = pd.DataFrame(out, columns=[*KEYS, "at", "score", "state"]).astype(dict.fromkeys(KEYS, "int64"))
        frame["at"] = pd.to_datetime(frame["at"], unit="us", utc=True)
        yield frame.astype({"score": float, "state": object})

    def close(self) -> None:
        pass


def alert_stream(scores: DataFrame, rules: DataFrame, channels: DataFrame, silences: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The alerts of a stream of effective scores (system_id, criterion_id, at, score), by the rules of ``alerting.evaluate`` at the time of each score.

    Rules, channels and silences are static sides: Spark reads them anew for each micro-batch, so a change
    in their tables takes effect with the next one. ``history``, earlier alerts (rule_id, channel_id,
    system_id, criterion_id, state, created_at), is the state to begin with. Needs the RocksDB state store.
    """
    active = rules.filter("enabled and trigger_type != 'schedule'").join(channels.filter("enabled").select(F.col("id").alias("channel_id")), "channel_id")
    active = active.select(
        F.col("id").cast("long").alias("rule_id"), F.col("channel_id").cast("long").alias("channel_id"), F.col("system_id").alias("_system"), F.col("criterion_id").alias("_criterion"),
        F.coalesce("min_score", F.lit(0.75)).alias("least"), F.coalesce("throttle_seconds", F.lit(0)).cast("long").alias("throttle"), F.coalesce("notify_recovery", F.lit(True)).alias("recovers"),
    )
    fits = (F.col("_system").isNull() | (F.col("_system") == F.col("system_id"))) & (F.col("_criterion").isNull() | (F.col("_criterion") == F.col("criterion_id")))
    seen = scores.select(F.col("system_id").cast("long").alias("system_id"), F.col("criterion_id").cast("long").alias("criterion_id"), "at", F.col("score").cast("double").alias("score")).filter("at is not null and score is not null").join(active, fits)
    quiet = silences.select("is_global", "system_ids", "rule_ids", "starts_at", "ends_at")
    covers = (F.col("starts_at") <= F.col("at")) & (F.col("at") < F.col("ends_at")) & (F.col("is_global") | F.coalesce(F.array_contains("system_ids", F.col("system_id")), F.lit(False)) | F.coalesce(F.array_contains("rule_ids", F.col("rule_id")), F.lit(False)))
    heard = seen.join(quiet, covers, "left_anti").select(*KEYS, F.unix_micros("at").alias("micros"), "score", "least", "throttle", "recovers")
    begin = None
    if history is not None:
        begin = history.select(*[F.col(c).cast("long").alias(c) for c in KEYS], "state", F.unix_micros("created_at").alias("at")).groupBy(*KEYS)
    return heard.groupBy(*KEYS).transformWithStateInPandas(Rule(), OUT, "Append", "None", initialState=begin)
