"""Keyed tables, retention by month, ranks by range, masks in linear time."""

import random
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenlog.functions import masking
from lumenlog.operators import events as ev, maintenance, reports, scoring
from lumenlog.storage import Folder, KeyedTable

NOW = datetime(2024, 6, 15)


def batch(spark, rows):
    return spark.createDataFrame(rows, "pattern_hash string, system_id long, template_text string, n long")


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    table = scoring.template_table(spark, f"{tmp_path}/t", buckets=16)
    at = lambda d: F.lit(NOW + timedelta(days=d)).cast("timestamp")
    first = [(f"h{i}", i % 3, f"text {i}", i) for i in range(200)]
    assert len(scoring.accumulate_into(table, batch(spark, first), at(0))) == 16
    files = table.folder.files()
    touched = scoring.accumulate_into(table, batch(spark, [("h7", 1, "other", 5), ("new", 2, "x", 1)]), at(1))
    after = table.folder.files()
    assert 1 <= len(touched) <= 2
    kept = {f for f in files if f in after and f.endswith(".parquet") and "_bucket=" in f}
    assert len({f.split("_bucket=")[1].split("/")[0] for f in kept}) == 16 - len(touched) and all(files[f] == after[f] for f in kept)
    rows = {r["pattern_hash"]: r for r in table.read().collect()}
    assert len(rows) == 201 and (rows["h7"]["occurrence_count"], rows["h7"]["template_text"], rows["new"]["occurrence_count"]) == (12, "text 7", 1)
    assert rows["h7"]["last_seen"] - rows["h7"]["first_seen"] == timedelta(days=1) and rows["h8"]["last_seen"] == rows["h8"]["first_seen"]
    # The same as the operator over whole tables.
    old = spark.createDataFrame([(h, s, t, NOW, NOW, n) for h, s, t, n in first], "pattern_hash string, system_id long, template_text string, first_seen timestamp, last_seen timestamp, occurrence_count long")
    whole = scoring.accumulated(old, batch(spark, [("h7", 1, "text 7", 5), ("new", 2, "x", 1)]), at(1))
    key = lambda df: sorted((r["pattern_hash"], r["occurrence_count"], r["first_seen"], r["last_seen"]) for r in df.collect())
    assert key(table.read()) == key(whole)
    fresh = spark.createDataFrame([("h7", *([0.5] * 6)), ("none", *([0.1] * 6))], ["pattern_hash", *scoring.NAMES])
    assert len(scoring.refresh_cache_in(table, fresh, at(2))) == 1
    row = table.read().filter("pattern_hash = 'h7'").head()
    assert (row["avg_max_score"], row["score_count"], row["occurrence_count"]) == (0.5, 1, 12)


def test_a_write_that_fails_leaves_the_table_as_it_was(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "k string, v long", ["k"], 4)
    assert table.read().count() == 0 and table.upsert(table.read()) == []
    table.upsert(spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v long"))
    bad = spark.createDataFrame([("a", 9)], "k string, v long").withColumn("v", F.when(F.col("k") == "a", F.raise_error(F.lit("no"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no"):
        table.upsert(bad)
    table.upsert(spark.createDataFrame([(None, 4)], "k string, v long"))
    assert sorted((str(r["k"]), r["v"]) for r in table.read().collect()) == [("None", 4), ("a", 1), ("b", 2)]


def test_months_are_dropped_whole_and_only_edge_months_rewritten(spark, tmp_path):
    path = f"{tmp_path}/events"
    systems = spark.createDataFrame([(1, 30), (2, 75), (3, None)], "system_id long, retention_days int")
    rows = [(i, 1 + i % 3, NOW - timedelta(days=i % 150, hours=1)) for i in range(900)]
    spark.createDataFrame(rows, "id long, system_id long, timestamp timestamp").withColumn("event_month", F.date_format("timestamp", "yyyy-MM")).write.partitionBy("event_month").parquet(path)
    before = Folder(spark, path).files()
    expected = sorted(r["id"] for r in ev.retained(spark.read.parquet(path), systems, F.lit(NOW).cast("timestamp"), 90).collect())
    dropped, rewritten = maintenance.apply_retention(spark, path, systems, NOW, 90)
    assert dropped == ["2024-01", "2024-02"] and rewritten == ["2024-03", "2024-04", "2024-05"]
    after = Folder(spark, path).files()
    assert sorted({f.split("/")[0] for f in after if "/" in f}) == [f"event_month=2024-0{m}" for m in (3, 4, 5, 6)]
    untouched = {f: t for f, t in after.items() if "2024-06" in f}
    assert untouched and all(before.get(f) == t for f, t in untouched.items())
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == expected
    assert maintenance.apply_retention(spark, path, systems, NOW, 90) == ([], [])


@pytest.mark.parametrize("n", [61, 1000, 5])
def test_uniform_places(spark, n):
    r = random.Random(n)
    rows = [(r.choice((None, 1, 2, 2, 2, 3)), i, "x") for i in range(n)]
    df = spark.createDataFrame(rows, "a int, id long, other string").repartition(5)
    ranked = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    places = range(n) if n <= 60 else sorted({i * (n - 1) // 59 for i in range(60)})
    assert sorted(x["id"] for x in reports.uniform(df, ["a", "id"]).collect()) == sorted(ranked[p][1] for p in places)


TEXTS = ["a@b.com", "see a.b+c@x-y.org, or %foo@bar.de.", "-a-b@c.co", "a@b.com.x@y.org", "a@b@c.com", "é.f@g.hi ünï@codé.com", "x..y@z.ab_", "no at", "a.a.a@", "@b.com", "_u@v.ww z", "a@b.c1 q@r.st", "....t@u.vw", "a@b.com-c@d.ef", None, ""]


def test_email_mask_is_the_plain_pattern_in_linear_time(spark):
    plain = re.compile(r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", re.A)
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", masking.mask_private(F.col("t"), ["email"]).alias("m")).collect():
        assert r["m"] == (None if r["t"] is None else plain.sub("<EMAIL>", r["t"])), r["t"]
    long = spark.range(1).select(F.concat(F.repeat(F.lit("a."), 150_000), F.lit(" "), F.repeat(F.lit("://a:b "), 60_000)).alias("t"))
    began = time.perf_counter()
    got = long.select(F.length(masking.mask_private(F.col("t"), ["email"])).alias("n"), F.length(masking.redact(F.col("t"))).alias("m")).collect()
    assert got[0]["n"] == got[0]["m"] == 300_000 + 1 + 60_000 * 7 and time.perf_counter() - began < 40


def test_credentials(spark):
    rows = [("x postgres://u:pw@h/db and http://a http://b", "x postgres://u:***REDACTED***@h/db and http://a http://b"), ("http://a:b c@d ://q:r", "http://a:***REDACTED***@d ://q:r"), ("a@b ://u:v", "a@b ://u:v"), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r["got"] for r in df.select(masking.redact(F.col("t")).alias("got")).collect()] == [w for _, w in rows]


def test_chunks_give_the_scores_of_one_pass(spark, tmp_path, sf_dir):
    from lumenlog.plans.views import Views

    events = Views(spark, sf_dir).log_events.select("id", "system_id", "message", "severity", "timestamp", "host", "program")
    now = F.lit(NOW).cast("timestamp")
    table = scoring.template_table(spark, f"{tmp_path}/t", 8)
    one, _ = scoring.score_events(events, scoring.cache_of(table), scoring.RuleScorer(), now)
    chunks = [df.collect() for df in scoring.score_in_chunks(events, table, scoring.RuleScorer(), now, 400)]
    key = lambda rows: sorted((r["event_id"], r["criterion_id"], round(r["score"], 9)) for r in rows)
    assert len(chunks) == 3 and key(r for c in chunks for r in c) == key(one.collect())
    rows = table.read().collect()
    # Every template was scored once, by the first chunk that held it, and counted by all.
    assert sum(r["occurrence_count"] for r in rows) == events.count() and {r["score_count"] for r in rows if r["score_count"]} == {1}
    assert list(scoring.score_in_chunks(events.limit(0), table, scoring.RuleScorer(), now)) == []
