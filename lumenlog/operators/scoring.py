"""Templates and scores: group, route, score once per template, fan out."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.templates import parameterize, pattern_hash
from ..schema import CRITERIA
from ..storage import KeyedTable, numbered, stored

NAMES = tuple(CRITERIA.values())
SCORES = ", ".join(f"{n} double" for n in NAMES)


class Scorer(Protocol):
    """Scores a batch of templates: rows with template_text, severity and system_id in, six columns out."""

    def score(self, batch: pd.DataFrame) -> pd.DataFrame: ...


class RuleScorer:
    """A deterministic scorer: severity gives a base, words raise single criteria."""

    #: A severity's base and words by criterion.
    BASE = {"emergency": 0.9, "alert": 0.8, "critical": 0.7, "error": 0.5, "warning": 0.3, "notice": 0.1}
    WORDS = {
        "it_security": r"denied|unauthor|login|attack|invalid user|permission", "performance_degradation": r"timeout|slow|latency|queue", "failure_prediction": r"fail|retry|disk|memory",
        "anomaly": r"unexpected|unknown|anomal", "compliance_audit": r"audit|policy|complian", "operational_risk": r"restart|crash|down|panic",
    }

    def score(self, batch: pd.DataFrame) -> pd.DataFrame:
        base = batch["severity"].map(self.BASE).fillna(0.0)
        text = batch["template_text"].fillna("")
        return pd.DataFrame({n: (base * 0.5 + 0.5 * text.str.contains(w, case=False, regex=True) * (base > 0)).clip(0, 1) for n, w in self.WORDS.items()})


def clamp01(c: Column) -> Column:
    """Into 0 to 1; NaN and null are 0."""
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def max_score(*columns: str) -> Column:
    return F.greatest(*[F.col(c) for c in columns or NAMES])


def with_templates(events: DataFrame, normalize_sql: bool = False) -> DataFrame:
    text = parameterize(F.col("message"), normalize_sql)
    return events.withColumn("template_text", text).withColumn("pattern_hash", pattern_hash(F.col("template_text"), F.col("system_id")))


def extract_templates(events: DataFrame, normalize_sql: bool = False) -> DataFrame:
    """One row for each template: counts, first and last time and a representative, the earliest event. Ids stay with the events."""
    df = with_templates(events, normalize_sql)
    first = F.min_by(F.struct("id", "message", "severity", "host", "program"), F.struct("timestamp", "id"))
    return df.groupBy("pattern_hash", "system_id", "template_text").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), first.alias("r")
    ).select("pattern_hash", "system_id", "template_text", "n", "first_seen", "last_seen", F.col("r.id").alias("representative"), F.col("r.message").alias("message"), F.col("r.severity").alias("severity"))


def accumulated(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Template counts after a batch: counts add up, first_seen stays, last_seen of touched templates is ``now``."""
    a = old.select("pattern_hash", "system_id", "template_text", "first_seen", "last_seen", "occurrence_count")
    b = new.select("pattern_hash", "system_id", "template_text", now.alias("first_seen"), now.alias("last_seen"), F.col("n").alias("occurrence_count"))
    return a.unionByName(b).groupBy("pattern_hash", "system_id", "template_text").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("occurrence_count").alias("occurrence_count"))


TEMPLATES = "pattern_hash string, system_id long, template_text string, first_seen timestamp, last_seen timestamp, occurrence_count long, cached_scores string, last_scored_at timestamp, avg_max_score double, score_count long"


def template_table(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """The templates as a keyed table: a batch rewrites only the buckets of the templates it touches."""
    return KeyedTable(spark, path, TEMPLATES, ["pattern_hash"], buckets)


def accumulate_into(table: KeyedTable, new: DataFrame, now: Column) -> list[int]:
    """``accumulated`` in place: counts add up, first_seen and the score cache stay, last_seen is ``now``."""
    known = ("cached_scores", "last_scored_at", "avg_max_score", "score_count")
    rows = new.select("pattern_hash", "system_id", "template_text", now.alias("first_seen"), now.alias("last_seen"), F.col("n").cast("long").alias("occurrence_count"), *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in known])
    first = lambda a, b: F.coalesce(a, b)
    return table.upsert(rows, {c: first for c in ("template_text", "first_seen", *known)} | {"last_seen": lambda a, b: F.greatest(a, b), "occurrence_count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))})


def refresh_cache_in(table: KeyedTable, fresh: DataFrame, now: Column) -> list[int]:
    """``cache_refreshed`` in place, for the templates that ``fresh`` (pattern_hash and the six columns) names."""
    names = table.schema.names
    known = table.read().join(fresh.select("pattern_hash"), "pattern_hash", "left_semi")
    return table.upsert(cache_refreshed(known, fresh, now).select(*names))


def route_of(now: Column, skip_severities: tuple[str, ...] = ("debug",), cache_minutes: int = 360, low_score: float = 0.0, least_count: int = 5) -> Column:
    """severity_skip, cached, low_score_skip or score, in this order of precedence."""
    fresh = F.unix_micros(now) - F.unix_micros("last_scored_at") < cache_minutes * 60_000_000
    return (
        F.when(F.lower("severity").isin(*skip_severities), "severity_skip")
        .when(F.col("last_scored_at").isNotNull() & fresh, "cached")
        .when((F.col("score_count") >= least_count) & (F.col("avg_max_score") <= low_score), "low_score_skip")
        .otherwise("score")
    )


def scored(templates: DataFrame, scorer: Scorer) -> DataFrame:
    """Runs a scorer over templates in batches: one call scores a template for all its events."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[["pattern_hash", "system_id"]].reset_index(drop=True), scorer.score(b.reset_index(drop=True))[list(NAMES)]], axis=1)

    out = templates.select("pattern_hash", "system_id", "template_text", "severity").mapInPandas(run, f"pattern_hash string, system_id long, {SCORES}")
    return out.select("pattern_hash", "system_id", *[clamp01(F.col(n)).alias(n) for n in NAMES])


def unpivoted(df: DataFrame, keys: list[str], columns: dict[int, str] | None = None) -> DataFrame:
    """Six score columns as rows of criterion_id and score; zero scores are not kept."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("criterion_id"), F.col(c).alias("score")) for i, c in (columns or CRITERIA).items()]))
    return df.select(*keys, pairs.alias("p")).select(*keys, "p.criterion_id", "p.score").filter("score > 0")


def fanned_out(events: DataFrame, template_scores: DataFrame) -> DataFrame:
    """Every event's scores from its template's. ``events`` carry pattern_hash."""
    joined = events.select(F.col("id").alias("event_id"), "pattern_hash").join(template_scores.drop("system_id"), "pattern_hash")
    return unpivoted(joined, ["event_id"]).withColumn("score_type", F.lit("event"))


def new_scores(stored: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores to append: positive ones whose event, criterion and type have none yet."""
    keys = ["event_id", "criterion_id", "score_type"]
    return scores.filter("score > 0").dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def running_mean(mean: Column, n: Column, x: Column) -> Column:
    """The mean after one more value, to four places."""
    return F.round((F.coalesce(mean, F.lit(0.0)) * n + x) / (n + 1), 4)


def cache_refreshed(templates: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """Templates with their score cache after ``fresh`` scores (pattern_hash and the six columns)."""
    new = fresh.select("pattern_hash", F.to_json(F.struct(*NAMES)).alias("_scores"), max_score().alias("_max"))
    df = templates.join(new, "pattern_hash", "left")
    hit, n = F.col("_max").isNotNull(), F.coalesce("score_count", F.lit(0))
    return df.withColumns({
        "cached_scores": F.coalesce("_scores", "cached_scores"), "last_scored_at": F.when(hit, now).otherwise(F.col("last_scored_at")),
        "avg_max_score": F.when(hit, running_mean(F.col("avg_max_score"), n, F.col("_max"))).otherwise(F.col("avg_max_score")), "score_count": F.when(hit, n + 1).otherwise(F.col("score_count")),
    }).drop("_scores", "_max")


def cache_invalidated(templates: DataFrame) -> DataFrame:
    kinds = dict(templates.dtypes)
    return templates.withColumns({c: F.lit(None).cast(kinds[c]) for c in ("cached_scores", "last_scored_at", "avg_max_score", "score_count") if c in kinds})


def marked_scored(events: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Events with scored_at and template_id set for ``done`` (id, pattern_hash)."""
    hit = done.select("id", F.col("pattern_hash").alias("_t"))
    df = events.join(hit, "id", "left")
    return df.withColumns({"scored_at": F.when(F.col("_t").isNotNull(), now).otherwise(F.col("scored_at")), "template_id": F.coalesce("_t", "template_id")}).drop("_t")


def score_events(events: DataFrame, cache: DataFrame, scorer: Scorer, now: Column, **routing) -> tuple[DataFrame, DataFrame]:
    """(event scores, templates with their route) of one batch of unscored events.

    ``cache``: pattern_hash, last_scored_at, score_count, avg_max_score and the six scores.
    """
    routes = routed_templates(events, cache, now, **routing)
    fresh = scored(routes.filter("route = 'score'"), scorer)
    return fanned_out(with_templates(events), fresh.unionByName(cached(routes))), routes


def routed_templates(events: DataFrame, cache: DataFrame, now: Column, **routing) -> DataFrame:
    own = extract_templates(events).join(cache.select("pattern_hash", "last_scored_at", "score_count", "avg_max_score", *[F.col(n).alias(f"cached_{n}") for n in NAMES]), "pattern_hash", "left")
    return own.withColumn("route", route_of(now, **routing))


def cached(routes: DataFrame) -> DataFrame:
    return routes.filter("route = 'cached'").select("pattern_hash", "system_id", *[F.col(f"cached_{n}").alias(n) for n in NAMES])


def cache_of(table: KeyedTable) -> DataFrame:
    """The score cache as ``score_events`` reads it."""
    kept = F.from_json("cached_scores", ", ".join(f"{n} double" for n in NAMES))
    return table.read().select("pattern_hash", "last_scored_at", "score_count", "avg_max_score", *[kept[n].alias(n) for n in NAMES])


def score_in_chunks(events: DataFrame, table: KeyedTable, scorer: Scorer, now: Column, size: int = 5000, **routing) -> Iterator[DataFrame]:
    """``score_events`` of all unscored events, newest first, ``size`` at a time; gives each chunk's event scores.

    Between chunks the template table takes the chunk's counts and fresh scores, so that a template that
    one chunk scored is cached for the next. A chunk is one pass over its own rows; what a run has written
    stays if a later chunk fails.
    """
    places = numbered(events.withColumn("_newest", -F.unix_micros("timestamp")), ["_newest", "id"]).drop("_newest")
    parts = stored(places.withColumn("_chunk", F.floor(F.col("place") / size)).drop("place"), "chunks")
    for k in range((parts.agg(F.max("_chunk")).head()[0] or 0) + 1 if not parts.isEmpty() else 0):
        own = parts.filter(F.col("_chunk") == k).drop("_chunk")
        routes = stored(routed_templates(own, cache_of(table), now, **routing), "routes")
        fresh = stored(scored(routes.filter("route = 'score'"), scorer), "fresh")
        scores = stored(fanned_out(with_templates(own), fresh.unionByName(cached(routes))), "scores")
        accumulate_into(table, routes, now)
        refresh_cache_in(table, fresh, now)
        yield scores


def cost(tokens_in: Column, tokens_out: Column, model: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Price in dollars per million tokens; null for unknown models."""
    table = lambda i: F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, float(p[i]))])
    return (tokens_in * F.try_element_at(table(0), model) + tokens_out * F.try_element_at(table(1), model)) / 1e6
