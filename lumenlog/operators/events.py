"""Event scans: search, facets, drill-down, traces, acknowledgement and retention."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.regexes import escape_like
from . import fulltext

#: Columns a search may be sorted by.
SORTABLE = ("timestamp", "severity", "host", "source_ip", "program", "service")
SEARCH_COLUMNS = ("id", "system_id", "timestamp", "message", "severity", "host", "source_ip", "service", "program", "facility", "trace_id", "span_id", "acked")
TRACE_COLUMNS = ("id", "system_id", "timestamp", "message", "severity", "host", "program", "trace_id", "span_id")
MOST_PAGE, USUAL_PAGE, MOST_FACETS = 200, 100, 200
EXACT = ("host", "source_ip", "program")


def listed(value: str | Sequence[str] | None) -> list[str]:
    """``"a, b,"`` or a sequence as a list of non-empty values."""
    parts = value.split(",") if isinstance(value, str) else value or ()
    return [p for x in parts if (p := str(x).strip())]


def instant(value: str | datetime | None) -> datetime | None:
    """A time bound; what can't be read is no bound."""
    if isinstance(value, datetime) or value is None:
        return value
    try:
        return datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        return None


@dataclass(frozen=True)
class Search:
    """Filters of a search. Lists may be given as comma-separated text."""

    text: str | None = None
    mode: str = "contains"
    system_ids: Sequence[int] = ()
    severity: str | Sequence[str] | None = None
    host: str | Sequence[str] | None = None
    source_ip: str | Sequence[str] | None = None
    program: str | Sequence[str] | None = None
    service: str | None = None
    trace_id: str | None = None
    since: str | datetime | None = None
    until: str | datetime | None = None
    sort: str = "timestamp"
    ascending: bool = False
    page: int = 1
    limit: int = USUAL_PAGE
    extra: Sequence[Column] = field(default=())


def conditions(events: DataFrame, s: Search) -> list[Column]:
    """Conjuncts of a search over columns that the table has."""
    out: list[Column] = []
    if s.system_ids:
        out.append(F.col("system_id").isin(list(s.system_ids)))
    if v := listed(s.severity):
        out.append(F.lower("severity").isin([x.lower() for x in v]))
    out += [F.col(c).isin(v) for c in EXACT if (v := listed(getattr(s, c)))]
    out += [F.col(c) == getattr(s, c) for c in ("service", "trace_id") if getattr(s, c) and c in events.columns]
    if t := instant(s.since):
        out.append(F.col("timestamp") >= F.lit(t))
    if t := instant(s.until):
        out.append(F.col("timestamp") <= F.lit(t))
    if s.text and s.mode != "fulltext":
        out.append(F.col("message").ilike(f"%{escape_like(s.text)}%"))
    return [*out, *s.extra]


def matching(events: DataFrame, s: Search) -> DataFrame:
    """The rows of a search; full text looks at the words of what the other conditions leave."""
    found = reduce(lambda df, c: df.filter(c), conditions(events, s), events)
    return fulltext.matching(found, s.text) if s.text and s.mode == "fulltext" else found


def search(events: DataFrame, systems: DataFrame, s: Search) -> DataFrame:
    """One page of a search with system names. Ties in the sort column go by id; severity sorts as text."""
    by = s.sort if s.sort in SORTABLE else "timestamp"
    limit = min(max(s.limit, 1), MOST_PAGE)
    key = F.col(by).asc() if s.ascending else F.col(by).desc()
    found = matching(events, s).join(systems.select("system_id", F.col("name").alias("system_name")), "system_id")
    return found.orderBy(key, "id").offset((max(s.page, 1) - 1) * limit).limit(limit)


def page_info(found: DataFrame, s: Search) -> DataFrame:
    """One row for a page of ``found``, the matching rows: total, page, page_size, has_more."""
    page, limit = max(s.page, 1), min(max(s.limit, 1), MOST_PAGE)
    total = F.count(F.lit(1)).alias("total")
    return found.agg(total).select("total", F.lit(page).alias("page"), F.lit(limit).alias("page_size"), (F.col("total") > page * limit).alias("has_more"))


def external_matching(hits: DataFrame, s: Search) -> DataFrame:
    """Hits of an external index. Severities are a list; other fields must equal the whole given value.

    ``contains`` takes * and ? as wildcards, in either case; any other mode asks for all words of the text.
    """
    out: list[Column] = []
    if v := listed(s.severity):
        out.append(F.col("severity").isin([x.lower() for x in v]))
    out += [F.col(c) == v for c in (*EXACT, "service", "trace_id") if (v := getattr(s, c)) and c in hits.columns]
    out += [F.col("timestamp") >= F.lit(t) for t in (instant(s.since),) if t]
    out += [F.col("timestamp") <= F.lit(t) for t in (instant(s.until),) if t]
    if text := (s.text or "").strip():
        if s.mode == "contains":
            out.append(F.col("message").ilike(f"%{escape_like(text).replace('*', '%').replace('?', '_')}%"))
        else:
            words = F.split(F.lower("message"), r"[^\p{L}\p{N}]+")
            asked = F.filter(F.split(F.lower(F.lit(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
            out.append(F.size(F.array_except(asked, words)) == 0)
    return reduce(lambda df, c: df.filter(c), [*out, *s.extra], hits)


def external_search(hits: DataFrame, s: Search) -> DataFrame:
    """One page of an external index, in the order of :func:`search`."""
    by = s.sort if s.sort in SORTABLE else "timestamp"
    limit = min(max(s.limit, 1), MOST_PAGE)
    key = F.col(by).asc() if s.ascending else F.col(by).desc()
    return external_matching(hits, s).orderBy(key, "id").offset((max(s.page, 1) - 1) * limit).limit(limit)


def after(events: DataFrame, timestamp: Column, row_id: Column, limit: int) -> DataFrame:
    """Keyset paging: the next rows in the order of (timestamp, id)."""
    later = (F.col("timestamp") > timestamp) | ((F.col("timestamp") == timestamp) & (F.col("id") > row_id))
    return events.filter(later).orderBy("timestamp", "id").limit(limit)


def facets(events: DataFrame, fields: Iterable[str] = ("severity", "host", "source_ip", "program"), most: int = MOST_FACETS) -> DataFrame:
    """facet, value: the first distinct non-empty values of each field, sorted; one pass and one shuffle for all fields."""
    names = list(fields)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in names]))
    distinct = events.select(pairs.alias("p")).select("p.facet", "p.value").filter("value is not null and value != ''").distinct()
    rank = F.row_number().over(W.partitionBy("facet").orderBy("value"))
    return distinct.withColumn("at", rank).filter(F.col("at") <= most).drop("at")


def traced(events: DataFrame, value: str, field: str = "all") -> DataFrame:
    """All events that carry an id as trace, span or in their message."""
    within = F.lower("message").contains(value.lower())
    tests = {"trace_id": F.col("trace_id") == value, "message": within}
    tests["all"] = tests["trace_id"] | within | (F.col("span_id") == value if "span_id" in events.columns else F.lit(False))
    return events.filter(tests[field])


def trace(events: DataFrame, value: str, field: str = "all", limit: int = 1000) -> DataFrame:
    """The page of ``traced``, oldest first."""
    return traced(events, value, field).orderBy("timestamp", "id").limit(min(max(limit, 1), 1000))


def around(events: DataFrame, anchor: Column, hours: int) -> DataFrame:
    """Events within ``hours`` (168 at most) of an anchor."""
    micros = min(max(hours, 0), 168) * 3_600_000_000
    return events.filter(F.unix_micros("timestamp").between(F.unix_micros(anchor) - micros, F.unix_micros(anchor) + micros))


def by_system(found: DataFrame) -> DataFrame:
    """system_id, n, first and last time, ids in time order, of a page or a whole trace: a group holds what its row returns."""
    ordered = F.array_sort(F.collect_list(F.struct("timestamp", "id")))
    return found.groupBy("system_id").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), ordered.alias("rows")).withColumn("ids", F.col("rows.id")).drop("rows")


def unscored(events: DataFrame, system_id: int, now: Column, hours: int = 48, limit: int = 5000) -> DataFrame:
    recent = F.unix_micros("timestamp") >= F.unix_micros(now) - hours * 3_600_000_000
    return events.filter((F.col("system_id") == system_id) & F.col("scored_at").isNull() & F.col("acknowledged_at").isNull() & recent).orderBy(F.desc("timestamp"), "id").limit(limit)


def without_metadata(hits: DataFrame, metadata: DataFrame, scored: DataFrame) -> DataFrame:
    """External events that are neither acknowledged, nor marked as scored, nor scored: two anti-joins."""
    done = metadata.filter("acknowledged_at is not null or scored_at is not null").select("system_id", F.col("event_id").alias("id"))
    return hits.join(done, ["system_id", "id"], "left_anti").join(scored.select(F.col("event_id").alias("id")), "id", "left_anti")


def with_metadata(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """External events with their acknowledgement and template from the side table."""
    side = metadata.select("system_id", F.col("event_id").alias("id"), "acknowledged_at", "template_id")
    return hits.drop("acknowledged_at", "template_id").join(side, ["system_id", "id"], "left")


def external_scores(scores: DataFrame, metadata: DataFrame, system_id: int, least: float = 0.0, limit: int = 100) -> DataFrame:
    """Scores of a system's unacknowledged external events, greatest first. Scores have no system: the side table gives it."""
    own = metadata.filter((F.col("system_id") == system_id) & F.col("acknowledged_at").isNull()).select("system_id", "event_id")
    return scores.filter(F.col("score") >= least).join(own, "event_id").orderBy(F.desc("score"), "event_id", "criterion_id").limit(limit)


def backfilled(metadata: DataFrame, scores: DataFrame, now: Column) -> DataFrame:
    """The side table with scored_at set for events that have scores and no mark yet."""
    known = scores.select("event_id").distinct().withColumn("_known", F.lit(True))
    return metadata.join(known, "event_id", "left").withColumn("scored_at", F.when(F.col("_known"), F.coalesce("scored_at", now)).otherwise(F.col("scored_at"))).drop("_known")


def by_ids(sources: Sequence[DataFrame], ids: Sequence[str], most: int = 50) -> DataFrame:
    """The chosen rows of all sources, newest first."""
    picked = [s.filter(F.col("id").isin(list(ids)[:most])) for s in sources]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), picked).orderBy(F.desc("timestamp"), "id")


def acknowledged(events: DataFrame, scores: DataFrame, now: Column, until: Column, since: Column | None = None, system_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Acknowledges unacknowledged events up to a time; their scores go."""
    hit = F.col("acknowledged_at").isNull() & (F.col("timestamp") <= until)
    if since is not None:
        hit &= F.col("timestamp") >= since
    if system_id is not None:
        hit &= F.col("system_id") == system_id
    return events.withColumn("acknowledged_at", F.when(hit, now).otherwise(F.col("acknowledged_at"))), without_scores_of(scores, events.filter(hit))


def unacknowledged(events: DataFrame, scores: DataFrame, until: Column, since: Column | None = None, system_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Takes acknowledgement and scoring back, so that the events are scored anew."""
    hit = F.col("acknowledged_at").isNotNull() & (F.col("timestamp") <= until)
    if since is not None:
        hit &= F.col("timestamp") >= since
    if system_id is not None:
        hit &= F.col("system_id") == system_id
    cleared = {c: F.when(hit, F.lit(None)).otherwise(F.col(c)) for c in ("acknowledged_at", "scored_at")}
    return events.withColumns(cleared), without_scores_of(scores, events.filter(hit))


def acknowledged_group(events: DataFrame, group_key: str, system_id: int, stamp: Column) -> DataFrame:
    """Sets (or with a null stamp clears) acknowledgement of a template's events or of a single event."""
    hit = (F.col("system_id") == system_id) & ((F.col("template_id") == group_key) | (F.col("id").cast("string") == group_key))
    return events.withColumn("acknowledged_at", F.when(F.coalesce(hit, F.lit(False)), stamp).otherwise(F.col("acknowledged_at")))


def without_scores_of(scores: DataFrame, events: DataFrame) -> DataFrame:
    return scores.join(events.select(F.col("id").alias("event_id")), "event_id", "left_anti")


def retained(events: DataFrame, systems: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Events younger than their system's retention."""
    own = systems.select("system_id", F.coalesce("retention_days", F.lit(days)).alias("_days"))
    return events.join(own, "system_id").filter(F.unix_micros("timestamp") >= F.unix_micros(now) - F.col("_days").cast("long") * 86_400_000_000).drop("_days")


def bulk_deleted(events: DataFrame, windows: DataFrame, since: Column | None = None, until: Column | None = None, system_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Events outside the filter, and windows that don't lie inside it. No filter deletes nothing."""
    inside, held = F.lit(True), F.lit(True)
    if since is None and until is None and system_id is None:
        return events, windows
    if since is not None:
        inside, held = inside & (F.col("timestamp") >= since), held & (F.col("from_ts") >= since)
    if until is not None:
        inside, held = inside & (F.col("timestamp") <= until), held & (F.col("to_ts") <= until)
    if system_id is not None:
        inside, held = inside & (F.col("system_id") == system_id), held & (F.col("system_id") == system_id)
    return events.filter(~F.coalesce(inside, F.lit(False))), windows.filter(~F.coalesce(held, F.lit(False)))


def without_system(tables: dict[str, DataFrame], system_id: int) -> dict[str, DataFrame]:
    """All tables without a system's rows; score tables follow their events."""
    gone = tables["events"].filter(F.col("system_id") == system_id) if "events" in tables else None
    out = {}
    for name, df in tables.items():
        if "system_id" in df.columns:
            out[name] = df.filter(F.col("system_id").isNull() | (F.col("system_id") != system_id))
        elif gone is not None and "event_id" in df.columns:
            out[name] = without_scores_of(df, gone)
        else:
            out[name] = df
    return out


def keep_last(rows: DataFrame, n: int = 100, by: str = "created_at", key: str = "id") -> DataFrame:
    """The newest n rows of a log."""
    return rows.orderBy(F.desc(by), F.desc(key)).limit(n)


def append_new(target: DataFrame, rows: DataFrame, keys: Sequence[str] = ("normalized_hash", "timestamp"), order: str = "id") -> DataFrame:
    """Rows to append so that a replay adds none: the first of each key, unless the target has it."""
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
    return first.join(target.select(*keys), list(keys), "left_anti")


def normalized_hash(millis: str = "timestamp") -> Column:
    """Identity of an event: time in milliseconds and all fields but severity; nulls count as empty."""
    from ..functions.timefix import iso_millis

    parts = [iso_millis(F.col(millis)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("message", "host", "source_ip", "service", "program", "facility")]]
    return F.sha2(F.concat_ws("\0", *parts), 256)
