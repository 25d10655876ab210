"""Dashboards, costs, question context and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.similarity import csv_field
from ..schema import CRITERIA
from ..storage import stored
from . import findings as fi, scoring, windows as wi


def overview(systems: DataFrame, sources: DataFrame, events: DataFrame, windows: DataFrame, effective: DataFrame, scored_events: DataFrame, findings: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """One row a system: counts, latest window, open findings by severity, and the six shown scores."""
    best = wi.best_effective(effective, windows, now, days)
    shown = wi.with_fallback(best, wi.live_max(scored_events, now, days), systems)
    scores = shown.groupBy("system_id").agg(*[F.round(F.max(F.when(F.col("criterion_id") == i, F.col("shown"))), 9).alias(n) for i, n in CRITERIA.items()])
    last = wi.latest_windows(windows).select("system_id", F.col("window_id").alias("latest_window"))
    counts = lambda df, name: df.groupBy("system_id").agg(F.count(F.lit(1)).alias(name))
    out = systems.select("system_id", "name")
    # All of these have one row a system.
    for part in (counts(sources, "n_sources"), counts(events, "n_events"), last, fi.severity_counts(findings).select("system_id", "critical", "high", F.col("total").alias("open_findings")), scores):
        out = out.join(part, "system_id", "left")
    return out.fillna(0, ["n_sources", "n_events", "critical", "high", "open_findings"])


def top_events(scores: DataFrame, events: DataFrame, n: int = 10, system_id: int | None = None) -> DataFrame:
    """The n events with the greatest score of each criterion. Ranks come before the events are joined."""
    own = scores if system_id is None else scores.join(events.filter(F.col("system_id") == system_id).select(F.col("id").alias("event_id")), "event_id", "left_semi")
    rank = F.row_number().over(W.partitionBy("criterion_id").orderBy(F.desc("score"), "event_id"))
    top = own.withColumn("rank", rank).filter(F.col("rank") <= n)
    return top.join(events.select(F.col("id").alias("event_id"), "system_id", "message", "severity"), "event_id")


def grouped_scores(scores: DataFrame, events: DataFrame, criterion: int | None = None, least: float = 0.0, limit: int = 100) -> DataFrame:
    """Event scores by template (or event), severity, program and criterion: top score and its message, count, times, hosts, whether acknowledged."""
    s = scores if criterion is None else scores.filter(F.col("criterion_id") == criterion)
    df = s.join(events.select(F.col("id").alias("event_id"), "system_id", "template_id", "severity", "program", "message", "timestamp", "host", "source_ip", "acked"), "event_id")
    key = F.coalesce("template_id", F.col("event_id").cast("string")).alias("group_key")
    latest = F.max_by("message", F.struct("timestamp", "event_id"))
    g = df.groupBy(key, "severity", "program", "criterion_id").agg(
        F.max("score").alias("score"), latest.alias("message"), F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.array_sort(F.collect_set("host")).alias("hosts"), F.array_sort(F.collect_set("source_ip")).alias("ips"), F.bool_or("acked").alias("acked"),
    )
    return g.filter(F.col("score") >= least).orderBy(F.desc("score"), "group_key", "severity", "program", "criterion_id").limit(limit)


def usage_totals(usage: DataFrame) -> DataFrame:
    return usage.groupBy("run_type").agg(F.count(F.lit(1)).alias("n"), F.sum("token_input").alias("token_input"), F.sum("token_output").alias("token_output"), F.sum("cost").alias("cost"))


def usage_sums(usage: DataFrame, since: Column | None = None, until: Column | None = None, system_id: int | None = None) -> DataFrame:
    """One row of sums over all rows of a filter, whatever page is shown; rows without a cost add none."""
    df = newest(usage, {"system_id": system_id}, since, until, most=None)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("token_input", "token_output", "request_count") if c in usage.columns]
    return df.agg(*sums, F.sum("cost").alias("cost"))


def newest(rows: DataFrame, equal: dict[str, object], since: Column | None = None, until: Column | None = None, most: int | None = 100) -> DataFrame:
    """A filtered list, newest first, of ``most`` rows (1 to 500; None: all, unsorted). A null value filters nothing, a list means any of it."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name).isin(value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    if since is not None:
        rows = rows.filter(F.col("created_at") >= since)
    if until is not None:
        rows = rows.filter(F.col("created_at") <= until)
    return rows if most is None else rows.orderBy(F.desc("created_at"), "id").limit(min(max(most, 1), 500))


def table_counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    parts = [df.select(F.lit(n).alias("name")) for n, df in tables.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.agg(*[F.count_if(F.col("name") == n).alias(n) for n in tables])


def usage_daily(usage: DataFrame, days: int = 30) -> DataFrame:
    """The newest days with their sums."""
    d = usage.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("token_input").alias("token_input"), F.sum("token_output").alias("token_output"), F.sum("cost").alias("cost"))
    return d.orderBy(F.desc("day")).limit(days)


def with_cost(usage: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    return usage.withColumn("cost", scoring.cost(F.col("token_input"), F.col("token_output"), F.col("model"), prices))


def finding_stats(findings: DataFrame) -> DataFrame:
    return findings.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg("occurrence_count").alias("avg_occurrences"), F.max("occurrence_count").alias("max_occurrences"))


def cache_stats(templates: DataFrame) -> DataFrame:
    return templates.agg(F.count(F.lit(1)).alias("templates"), F.count("last_scored_at").alias("cached"), F.avg("avg_max_score").alias("avg_max_score"))


def meta_limit(hours: Column) -> Column:
    """How many summaries a question's time range asks for."""
    return F.when(hours <= 2, 24).when(hours <= 24, 50).when(hours <= 168, 80).otherwise(100)


def daily_summaries(summaries: DataFrame) -> DataFrame:
    """The newest summary of each day and system."""
    best = F.max_by(F.struct("window_id", "to_ts", "summary"), F.struct("to_ts", "window_id"))
    return summaries.groupBy(F.to_date("to_ts").alias("day"), "system_id").agg(best.alias("b")).select("day", "system_id", "b.*")


def uniform(rows: DataFrame, order: list[str], n: int = 60) -> DataFrame:
    """n rows evenly spread over an order: places floor(i * (rows - 1) / (n - 1)).

    ``order`` tells rows apart, its last column being their key. Its columns alone are dealt into ranges;
    from the ranges' counts follows in which range, and where, each place lies, and only those ranges are
    ranked, each in a task of its own.
    """
    keys = rows.select(*order).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = stored(keys, "ranges")
    counts = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())  # a row a partition
    total = sum(c for _, c in counts)
    if total <= n:
        return rows
    places, wanted, start = sorted({i * (total - 1) // (n - 1) for i in range(n)}), [], 0
    for k, c in counts:
        wanted += [(k, p - start) for p in places if start <= p < start + c]
        start += c
    at = rows.sparkSession.createDataFrame(wanted, "_range int, _at int")
    rank = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    chosen = ranged.filter(F.col("_range").isin(sorted({k for k, _ in wanted}))).withColumn("_at", rank).join(F.broadcast(at), ["_range", "_at"], "left_semi")
    picked = F.broadcast(chosen.select(*order).alias("p"))  # n rows
    same = F.lit(True)
    for c in order:
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}"))
    return rows.alias("r").join(picked, same, "left_semi")


def question_context(findings: DataFrame, summaries: DataFrame, now: Column, most_findings: int = 50, recent_hours: int = 24) -> DataFrame:
    """Lines for a question: findings by status, severity and last sight, recent summaries, and one summary a day before."""
    status = F.when(F.col("status") == "open", 0).when(F.col("status") == "acknowledged", 1).otherwise(2)
    from ..functions.severity import finding_rank

    f = findings.orderBy(status, finding_rank(F.col("severity")).desc(), F.col("last_seen_at").desc_nulls_last(), "id").limit(most_findings)
    f = f.select(F.lit("finding").alias("kind"), F.col("last_seen_at").alias("at"), F.concat(F.lit("["), F.col("status"), F.lit("] ["), F.col("severity"), F.lit("] "), F.col("text")).alias("line"))
    edge = F.unix_micros(now) - recent_hours * 3_600_000_000
    new = summaries.filter(F.unix_micros("to_ts") >= edge).select(F.lit("summary").alias("kind"), F.col("to_ts").alias("at"), F.col("summary").alias("line"))
    old = daily_summaries(summaries.filter(F.unix_micros("to_ts") < edge)).select(F.lit("daily").alias("kind"), F.col("to_ts").alias("at"), F.col("summary").alias("line"))
    return f.unionByName(new).unionByName(old)


def compliance(windows: DataFrame, effective: DataFrame, systems: DataFrame) -> DataFrame:
    """One row a window with its six effective scores to three places."""
    pivot = effective.groupBy("window_id").agg(*[F.max(F.when(F.col("criterion_id") == i, F.col("effective"))).alias(n) for i, n in CRITERIA.items()])
    names = systems.select("system_id", F.col("name").alias("system_name"))
    df = windows.join(pivot, "window_id", "left").join(names, "system_id")
    return df.select("window_id", "system_name", "from_ts", "to_ts", *[F.round(F.coalesce(n, F.lit(0.0)), 3).alias(n) for n in CRITERIA.values()])


def csv_lines(df: DataFrame) -> DataFrame:
    """Rows as CSV lines without line end: quotes where needed, formulas disarmed."""
    return df.select(F.concat_ws(",", *[csv_field(F.col(c).cast("string")) for c in df.columns]).alias("value"))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and CRLF, as text files; each file has its header."""
    head = ",".join(df.columns)

    def with_head(batches):
        import pandas as pd

        yield pd.DataFrame({"value": [head]})
        yield from batches

    csv_lines(df).mapInPandas(with_head, "value string").write.option("lineSep", "\r\n").text(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


#: The columns of an audit export, the most rows it has, and the sizes of a page.
AUDIT_COLUMNS = ("id", "at", "actor", "user_id", "session_id", "action", "resource_type", "resource_id", "details", "ip")
MOST_EXPORTED, USUAL_AUDIT_PAGE, MOST_AUDIT_PAGE = 50_000, 50, 200


def audit_export(audit: DataFrame, most: int = MOST_EXPORTED) -> DataFrame:
    """The newest audit rows with AUDIT_COLUMNS, for ``export_csv`` or ``export_json``; columns that the table lacks are null."""
    have = audit.columns
    return audit.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in AUDIT_COLUMNS]).orderBy(F.desc("at"), F.desc("id")).limit(most)


def audit_page(found: DataFrame, page: int = 1, limit: int = USUAL_AUDIT_PAGE, by: str = "created_at") -> DataFrame:
    """One page of what an audit search found, newest first."""
    n = min(max(limit or USUAL_AUDIT_PAGE, 1), MOST_AUDIT_PAGE)
    return found.orderBy(F.desc(by), F.desc("id")).offset((max(page, 1) - 1) * n).limit(n)


def top_reasons(scores: DataFrame, events: DataFrame, criterion: int | None = None) -> DataFrame:
    """group_key, severity, program, criterion_id, score, reason_codes and severity_label of the greatest score of each group of ``grouped_scores``; ties go to the smallest event."""
    s = scores if criterion is None else scores.filter(F.col("criterion_id") == criterion)
    df = s.join(events.select(F.col("id").alias("event_id"), "template_id", "severity", "program"), "event_id")
    best = F.max_by(F.struct("score", "reason_codes", "severity_label"), F.struct("score", -F.col("event_id")))
    return df.groupBy(F.coalesce("template_id", F.col("event_id").cast("string")).alias("group_key"), "severity", "program", "criterion_id").agg(best.alias("b")).select("group_key", "severity", "program", "criterion_id", "b.*")


def distinct_values(rows: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """The distinct non-empty values of a column, sorted: what a filter offers."""
    found = rows.select(F.col(column).cast("string").alias("value")).filter("value is not null and value != ''").distinct().orderBy("value")
    return found if most is None else found.limit(most)


def audit_search(audit: DataFrame, users: DataFrame, text: str | None = None, action: str | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Audit rows with user names; text is looked for in action, resource, details and name."""
    df = audit.join(users.select(F.col("id").alias("user_id"), "username"), "user_id", "left")
    if text:
        from ..functions.regexes import escape_like

        like = f"%{escape_like(text)}%"
        hit = F.lit(False)
        for c in ("action", "resource", "details", "username"):
            hit |= F.coalesce(F.col(c).ilike(like), F.lit(False))
        df = df.filter(hit)
    if action:
        df = df.filter(F.col("action") == action)
    if since is not None:
        df = df.filter(F.col("created_at") >= since)
    if until is not None:
        df = df.filter(F.col("created_at") <= until)
    return df


def permissions_by_role(roles: DataFrame, permissions: DataFrame) -> DataFrame:
    own = permissions.groupBy("role_id").agg(F.array_sort(F.collect_set("permission")).alias("permissions"))
    return roles.join(own, roles["id"] == own["role_id"], "left").select("id", "name", F.coalesce("permissions", F.array().cast("array<string>")).alias("permissions"))
