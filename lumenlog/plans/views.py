"""The log-shaped views over the test tables, as DataFrames and as SQL of the same meaning."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

#: "Now" of the catalogue: the test events end before it.
NOW = "2024-01-31 00:00:00"
NOW_US = 1_706_659_200_000_000


class Views:
    """Views of one data folder. ``nation`` and ``region`` are fixed tables of 25 and 5 rows, so they are broadcast."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.now = F.lit(NOW).cast("timestamp")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def systems(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("long").alias("system_id"), F.col("r_name").alias("name"))

    @cached_property
    def log_events(self) -> DataFrame:
        n = F.broadcast(self.table("nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("system_id")))
        e = self.table("events")
        user, event = F.col("user_id").cast("string"), F.col("event_id")
        ip = F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."), (event % 256).cast("string"))
        kind = F.col("event_type")
        severity = F.when(kind == "error", "error").when(kind == "purchase", "notice").when(kind == "signup", "warning").when(kind == "view", "debug").otherwise("info")
        message = F.concat(kind, F.lit(" user "), user, F.lit(" from "), ip, F.lit(" props="), F.col("props"))
        ts = F.col("ts").cast("timestamp")
        return e.join(n, F.col("user_id") % 25 == F.col("n_nationkey")).select(
            event.alias("id"), "system_id", ts.alias("timestamp"), kind.alias("program"), F.concat(F.lit("host-"), (F.col("user_id") % 20).cast("string")).alias("host"), ip.alias("source_ip"), severity.alias("severity"), (event % 10 == 0).alias("acked"),
            F.concat(F.lit("tr-"), (event % 500).cast("string")).alias("trace_id"), message.alias("message"), F.lit(None).cast("string").alias("service"), F.lit(None).cast("string").alias("facility"), F.lit(None).cast("string").alias("span_id"),
            F.when(event % 3 == 0, F.concat(F.lit("t-"), (event % 40).cast("string"))).alias("template_id"), F.when(event % 10 == 0, ts).alias("acknowledged_at"), F.when(event % 4 == 0, ts).alias("scored_at"), "props",
        )

    @cached_property
    def scores(self) -> DataFrame:
        c = F.explode(F.sequence(F.lit(1), F.lit(6))).alias("criterion_id")
        e = self.table("events").select(F.col("event_id"), c)
        return e.withColumn("score", ((F.col("event_id") * (7 * F.col("criterion_id") + 3)) % 101) / 100.0).filter("score > 0").withColumn("score_type", F.lit("event"))

    @cached_property
    def scored_events(self) -> DataFrame:
        """Scores of unacknowledged events with system and time: a projection of the same scan, no join."""
        e = self.log_events.filter("not acked").select("id", "system_id", "timestamp", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("criterion_id"))
        return e.withColumn("score", ((F.col("id") * (7 * F.col("criterion_id") + 3)) % 101) / 100.0).filter("score > 0").select("system_id", "timestamp", "criterion_id", "score")

    @cached_property
    def windows(self) -> DataFrame:
        hour = F.floor(F.unix_micros("timestamp") / 3_600_000_000)
        w = self.log_events.select("system_id", hour.alias("wno")).distinct()
        at = lambda k: F.timestamp_micros((F.col("wno") + k) * 3_600_000_000)
        return w.select((F.col("wno") * 10 + F.col("system_id")).alias("window_id"), "system_id", "wno", at(0).alias("from_ts"), at(1).alias("to_ts"))

    @cached_property
    def meta(self) -> DataFrame:
        w = self.windows.select("window_id", "wno", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("criterion_id"))
        return w.select("window_id", "criterion_id", (((F.col("wno") * (F.col("criterion_id") + 1)) % 11) / 10.0).alias("meta_score"))

    @cached_property
    def effective(self) -> DataFrame:
        from ..operators import windows as wi

        return wi.effective(self.windows, self.meta, self.scored_events)

    @cached_property
    def normal_templates(self) -> DataFrame:
        rows = [(1, None, "^view user [0-9]+ from", None, None, True), (2, 1, "^click user", None, "^click$", True), (3, None, "^purchase", "^host-1[0-9]$", None, True), (4, None, ".*", None, None, False)]
        return self.spark.createDataFrame(rows, "id long, system_id long, pattern_regex string, host_pattern string, program_pattern string, enabled boolean")

    @cached_property
    def findings(self) -> DataFrame:
        """Findings with the first 300 characters of their texts, as the SQL of this view has them."""
        return self.whole_findings.withColumn("text", F.substring("text", 1, 300))

    @cached_property
    def whole_findings(self) -> DataFrame:
        d, i = self.table("documents"), F.col("doc_id")
        at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + i * 60_000_000)
        severity = F.when(i % 5 == 0, "critical").when(i % 5 == 1, "high").when(i % 5 == 2, "medium").when(i % 5 == 3, "low").otherwise("info")
        return d.select(
            i.alias("id"), (i % 5).alias("system_id"), "text", severity.alias("severity"), F.concat(F.lit("c"), (i % 3).cast("string")).alias("criterion_slug"),
            F.when(i % 3 == 0, "resolved").when(i % 7 == 1, "acknowledged").otherwise("open").alias("status"), at.alias("created_at"), F.when(i % 7 != 0, at).alias("last_seen_at"), (i % 4 + 1).alias("occurrence_count"),
        )

    @cached_property
    def usage(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").select(
            k.alias("id"), F.when(k % 3 == 0, "per_event").when(k % 3 == 1, "meta").otherwise("rag").alias("run_type"), F.col("o_orderdate").cast("timestamp").alias("created_at"), (k % 1000).alias("token_input"), (k % 300).alias("token_output"),
            F.when(k % 2 == 0, "gpt-4o-mini").when(k % 5 == 0, "unknown").otherwise("gpt-4o").alias("model"),
        )

    @cached_property
    def buffer(self) -> DataFrame:
        e = self.log_events
        return e.select("id", F.when(F.col("id") % 6 != 0, F.col("host")).alias("host"), "source_ip", "program", F.col("timestamp").alias("received_at"), F.substring("message", 1, 512).alias("sample"))


PRICES = {"gpt-4o": (2.5, 10.0), "gpt-4o-mini": (0.15, 0.6)}

#: The same views in SQL; a query names those it needs.
SQL = {
    "systems": "SELECT CAST(r_regionkey AS BIGINT) AS system_id, r_name AS name FROM region",
    "log_events": """SELECT e.event_id AS id, CAST(n.n_regionkey AS BIGINT) AS system_id, e.ts AS ts, epoch_us(e.ts) AS us, e.event_type AS program, 'host-' || (e.user_id % 20) AS host,
        '10.0.' || (e.user_id % 256) || '.' || (e.event_id % 256) AS source_ip,
        CASE e.event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'notice' WHEN 'signup' THEN 'warning' WHEN 'view' THEN 'debug' ELSE 'info' END AS severity, e.event_id % 10 = 0 AS acked,
        'tr-' || (e.event_id % 500) AS trace_id, e.event_type || ' user ' || e.user_id || ' from 10.0.' || (e.user_id % 256) || '.' || (e.event_id % 256) || ' props=' || e.props AS message,
        CASE WHEN e.event_id % 3 = 0 THEN 't-' || (e.event_id % 40) END AS template_id, e.event_id % 4 = 0 AS is_scored, e.props AS props
        FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 25""",
    "criteria": "SELECT CAST(range AS INTEGER) AS criterion_id FROM range(1, 7)",
    "scores": "SELECT event_id, criterion_id, ((event_id * (7 * criterion_id + 3)) % 101) / 100.0 AS score FROM events, criteria WHERE (event_id * (7 * criterion_id + 3)) % 101 > 0",
    "scored_events": "SELECT l.system_id, l.us, l.id, s.criterion_id, s.score FROM log_events l JOIN scores s ON s.event_id = l.id WHERE NOT l.acked",
    "windows_h": "SELECT DISTINCT (us // 3600000000) * 10 + system_id AS window_id, system_id, us // 3600000000 AS wno FROM log_events",
    "meta": "SELECT window_id, system_id, wno, criterion_id, ((wno * (criterion_id + 1)) % 11) / 10.0 AS meta_score FROM windows_h, criteria",
    "hourly": "SELECT system_id, us // 3600000000 AS wno, criterion_id, max(score) AS highest FROM scored_events GROUP BY 1, 2, 3",
    "effective": """SELECT m.window_id, m.system_id, m.wno, m.criterion_id, m.meta_score, coalesce(h.highest, 0) AS highest, 0.7 * m.meta_score + 0.3 * coalesce(h.highest, 0) AS effective
        FROM meta m LEFT JOIN hourly h ON h.system_id = m.system_id AND h.wno = m.wno AND h.criterion_id = m.criterion_id""",
    "normal_templates": """SELECT * FROM (VALUES (1, NULL, '^view user [0-9]+ from', NULL, NULL), (2, 1, '^click user', NULL, '^click$'), (3, NULL, '^purchase', '^host-1[0-9]$', NULL)) t(id, system_id, pattern_regex, host_pattern, program_pattern)""",
    "findings": """SELECT doc_id AS id, doc_id % 5 AS system_id, substring(text, 1, 300) AS text, CASE doc_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
        'c' || (doc_id % 3) AS criterion_slug, CASE WHEN doc_id % 3 = 0 THEN 'resolved' WHEN doc_id % 7 = 1 THEN 'acknowledged' ELSE 'open' END AS status, 1704067200000000 + doc_id * 60000000 AS created_us,
        CASE WHEN doc_id % 7 <> 0 THEN 1704067200000000 + doc_id * 60000000 END AS last_seen_us, doc_id % 4 + 1 AS occurrence_count FROM documents""",
    "usage": """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'per_event' WHEN 1 THEN 'meta' ELSE 'rag' END AS run_type, o_orderdate AS created_at, o_orderkey % 1000 AS token_input, o_orderkey % 300 AS token_output,
        CASE WHEN o_orderkey % 2 = 0 THEN 'gpt-4o-mini' WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE 'gpt-4o' END AS model FROM orders""",
    "priced": """SELECT *, CASE model WHEN 'gpt-4o' THEN (token_input * 2.5 + token_output * 10.0) / 1e6 WHEN 'gpt-4o-mini' THEN (token_input * 0.15 + token_output * 0.6) / 1e6 END AS cost FROM usage""",
    "buffer": "SELECT id, CASE WHEN id % 6 <> 0 THEN host END AS host, source_ip, program, us, substring(message, 1, 512) AS sample FROM log_events",
}
NEEDS = {
    "scores": ("criteria",), "scored_events": ("log_events", "scores"), "windows_h": ("log_events",), "meta": ("windows_h", "criteria"), "hourly": ("scored_events",), "effective": ("meta", "hourly"), "priced": ("usage",), "buffer": ("log_events",),
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the views it names, and those they need, put before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    return f"WITH {head}\n{sql}" if head else sql
