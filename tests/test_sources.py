"""Discovery tables, OTLP bodies, container records, index filters and lists: golden rows."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenlog.operators import discovery as di, multiline
from lumenlog.sources import bodies, containers, dispatch

NOW = datetime(2024, 1, 10)
KNOWN = "group_key string, kind string, key string, suggested_name string, n long, first_seen timestamp, last_seen timestamp, programs array<string>, samples array<string>, status string, dismissed_until timestamp, merge_target_id long, updated_at timestamp"


def row(key, status, until=None, n=1, kind="host"):
    return (f"g-{key}", kind, key, key, n, NOW, NOW, ["p"], ["s"], status, until, 7 if status == "merged" else None, NOW)


def test_a_run_updates_suggestions_and_drops_what_a_source_covers(spark):
    later = NOW + timedelta(days=1)
    old = spark.createDataFrame([row("a", "pending"), row("b", "accepted"), row("c", "dismissed", later), row("d", "dismissed", NOW - timedelta(days=1)), row("e", "dismissed"), row("gone", "pending"), row("web-1", "pending"), row("web-2", "merged")], KNOWN)
    new = spark.createDataFrame([row(k, "x", n=9) for k in ("a", "b", "c", "d", "e", "new", "web-3")], KNOWN)
    sources = [{"selector": {"host": "^web-"}}, {"selector": {"host": ".*"}}, {"selector": [{"host": "bad("}]}]
    now = F.lit(later - timedelta(hours=1)).cast("timestamp")
    got = {r["key"]: (r["status"], r["n"]) for r in di.refreshed(old, new, sources, now).collect()}
    assert got == {"a": ("pending", 9), "b": ("accepted", 1), "c": ("dismissed", 1), "d": ("pending", 9), "e": ("dismissed", 1), "gone": ("pending", 1), "new": ("pending", 9), "web-2": ("merged", 1)}
    table, source = di.merged(old, "g-a", 3, now)
    assert [(r["system_id"], r["label"], json.loads(r["selector"]), r["priority"]) for r in source.collect()] == [(3, "a (auto-discovered)", {"host": "^a$"}, 50)]
    assert {r["key"]: (r["status"], r["merge_target_id"]) for r in table.filter("key in ('a', 'b')").collect()} == {"a": ("merged", 3), "b": ("accepted", None)}
    assert di.merged(old, "g-b", 3, now)[1].count() == 0


def test_otlp_attributes_and_nanoseconds(spark):
    say = lambda k, **v: {"key": k, "value": v}
    body = {"resourceLogs": [{"resource": {"attributes": [say("service.name", stringValue="api"), say("zone", stringValue="eu"), say("n", intValue="1")]}, "scopeLogs": [{"logRecords": [
        {"timeUnixNano": "1700000000123456789", "severityNumber": 17, "body": {"stringValue": 'a "b"'}, "traceId": "t", "attributes": [say("n", intValue="5"), say("ok", boolValue=True), say("n", intValue="6")]},
        {"observedTimeUnixNano": "1700000000000000001", "timeUnixNano": "0", "body": {"intValue": "7"}},
    ]}]}]}
    got = [json.loads(r["record"]) for r in bodies.otlp_records(spark.createDataFrame([(json.dumps(body),), ("{}",)], "value string")).collect()]
    assert got == [{"message": 'a "b"', "severity_number": 17, "timestamp": 1700000000123456789, "service": "api", "trace_id": "t", "n": "5", "ok": "true", "zone": "eu"}, {"message": "7", "timestamp": 1700000000000000001, "service": "api", "zone": "eu", "n": "1"}]


CONTAINERS = [
    # log, stream -> severity, message
    ("[warn] low", "stdout", "warning", "[warn] low"), ("[main] [error] x", "stdout", None, "[main] [error] x"), ("x lvl=crit y", "stdout", "critical", "x lvl=crit y"), ("plain", "stderr", "error", "plain"), ("2024/01/05 10:00:00 ready \n", "stdout", None, "ready"),
    ("2024-01-05T10:00:00.5+02:00  go", "stdout", None, "go"), ('{"level":35,"text":"t"}', "stderr", "info", "t"), ('{"lvl":"FATAL","message":"m","msg":""}', "stdout", "emerg", "m"), ('{"a":1}', "stderr", "error", '{"a":1}'), ("\x1b[1;31mred\x1b[0m", "stdout", None, "red"), ("   ", "stdout", "gone", None),
]


def test_container_rows(spark):
    rows = [(i, "/var/lib/docker/containers/ABCdef0123456789/x.log", stream, log, None) for i, (log, stream, _, _) in enumerate(CONTAINERS)]
    rows += [(50, None, "stderr", None, "as it is"), (51, "/var/log/syslog", "stderr", None, " other "), (52, "/x/containers/ffff/x.log", "stdout", "own", None), (53, "/x/containers/eeee/x.log", "stdout", "bad name", None)]
    names = spark.createDataFrame([("ffff", "/stack-Fluent-Bit-1"), ("eeee", "/not a name"), ("zzzz", None)], "container_id string, name string")
    got = {r["id"]: (r["program"], r["severity"], r["message"]) for r in containers.enriched(spark.createDataFrame(rows, "id long, log_path string, stream string, log string, message string"), names).collect()}
    expected = {i: ("ABCdef012345", severity, message) for i, (_, _, severity, message) in enumerate(CONTAINERS) if severity != "gone"}
    assert got == expected | {50: (None, None, "as it is"), 51: (None, None, " other "), 53: ("eeee", None, "bad name")}
    empty = spark.createDataFrame([], "log_path string, stream string, log string")
    assert containers.enriched(empty).count() == 0


def test_entries_of_containers(spark):
    t = lambda ms: NOW + timedelta(milliseconds=ms)
    rows = [("c", t(0), 1, "Error: x"), ("c", t(10), 2, "  at y"), ("c", t(2010), 3, "  late but in time"), ("c", t(4011), 4, "  too late"), ("d", t(0), 5, "} first"), ("d", t(1), 6, None), ("d", t(2), 7, "[I] next"), (None, None, 8, "x")]
    got = {(r["container"], r["seq"], r["message"]) for r in containers.container_entries(spark.createDataFrame(rows, "container string, timestamp timestamp, seq long, message string")).collect()}
    assert got == {("c", 1, "Error: x\n  at y\n  late but in time"), ("c", 4, "  too late"), ("d", 5, "} first\n"), ("d", 7, "[I] next"), (None, 8, "x")}


def test_numbered_lines_of_another_time_stay_apart(spark):
    t = lambda s: NOW + timedelta(seconds=s)
    rows = [(1, "a", "p", t(0), "[5-1] one"), (2, "a", "p", t(1), "[5-2] two"), (3, "a", "p", t(2_600_000), "[5-1] three"), (4, "a", "p", t(2_600_030), "[5-2] four"), (5, "a", "p", t(9_000_000), "[5-1] alone")]
    got = sorted(r["message"] for r in multiline.by_header(spark.createDataFrame(rows, "seq long, host string, program string, timestamp timestamp, message string"))[0].collect())
    assert got == ["alone", "one\ntwo", "three\nfour"]


LITERAL = "seq long, host string, program string, message string"


def test_lines_of_one_batch(spark):
    df = lambda rows: spark.createDataFrame(rows, LITERAL)
    nm = [(0, "a", "pg", "[5-1] first"), (1, "b", "pg", "[5-1] other"), (2, "a", "pg", "[5-3] #011third"), (3, "a", "pg", "[5-2] #011second"), (4, "a", "pg", "[5-6] late"), (5, "c", "pg", "[7-2] two"), (6, "c", "pg", "[7-3] three")]
    assert sorted((r["host"], r["message"]) for r in multiline.by_header(df(nm))[0].collect()) == [("a", "first\n\tsecond\n\tthird"), ("a", "late"), ("b", "other"), ("c", "two\nthree")]
    p = "2026-02-16 13:45:58.351 EET [116965] u@d "
    pg = [(0, "a", "pg", f"{p}STATEMENT: select"), (1, "a", "pg", f"{p}ERROR: bad"), (2, "a", "pg", f"{p}DETAIL: why"), (3, "a", "pg", f"{p}LOG: next"), (4, "b", "pg", f"{p}HINT: lone")]
    done, rest = multiline.by_prefix(df(pg))
    assert sorted((r["host"], r["message"]) for r in done.unionByName(rest).collect()) == [("a", f"{p}ERROR: bad\n{p}DETAIL: why\n{p}STATEMENT: select"), ("a", f"{p}LOG: next"), ("b", f"{p}HINT: lone")]
    generic = [(0, "a", "x", "  early"), (1, "a", "x", "start of it"), (2, "a", "x", "  at x.y"), (3, "a", "x", "}"), (4, "a", "x", "second head"), (5, "a", "x", "\ttail"), (6, "b", "x", "  no head"), (7, "b", "x", "} neither")]
    same = df(generic).withColumn("timestamp", F.lit(NOW).cast("timestamp"))
    assert sorted((r["host"], r["message"]) for r in multiline.by_second(same).select("host", "message").collect()) == [("a", "  early\nstart of it\n  at x.y\n}"), ("a", "second head\n\ttail"), ("b", "  no head"), ("b", "} neither")]


def test_base_filters(spark):
    hits = [(1, json.dumps({"_id": str(i), "_source": s})) for i, s in enumerate([{"level": "error", "n": 5}, {"level": "info", "n": 9.5, "k8s": {"pod": "a"}}, {"k8s.pod": "b", "n": 1}, {}])]
    df = spark.createDataFrame([*hits, (1, "no json"), (9, hits[0][1])], "system_id long, hit string")
    ids = lambda q: sorted(r["id"] or "-" for r in dispatch.external_events(df, {1: {"query_filter": q}}).collect())
    assert ids({}) == ["-", "0", "1", "2", "3"] and ids({"term": {"level": {"value": "error"}}}) == ["0"] and ids({"match": {"k8s.pod": "b"}}) == ["2"] and ids({"range": {"n": {"gte": 5, "lt": 9.6}}}) == ["0", "1"] and ids({"exists": {"field": "k8s.pod"}}) == ["1", "2"]
    assert ids({"bool": {"should": [{"term": {"level": "info"}}, {"term": {"k8s.pod": "b"}}]}}) == ["1", "2"] and ids({"bool": {"filter": {"exists": {"field": "n"}}, "must_not": [{"term": {"level": "error"}}]}}) == ["1", "2"]
    with pytest.raises(ValueError, match="unknown query"):
        ids({"fuzzy": {"a": "b"}})
    assert dispatch.preview(df, {}, 1, 2).count() == 2


def test_index_list(spark):
    df = spark.createDataFrame([(n,) for n in ("logs-1", "logs-2", "app_x", "appyx", ".hidden")], "index string")
    names = lambda p: [r["index"] for r in dispatch.index_list(df, p).collect()]
    assert names("*") == ["app_x", "appyx", "logs-1", "logs-2"] and names("logs-*, app_x") == ["app_x", "logs-1", "logs-2"] and names(".h*") == [".hidden"] and names("") == []


def test_settings(spark):
    rows = [('{"scoring_limit_per_run":50}',), ('{"scoring_limit_per_run":50,"scoring_chunk_size":70}',), (None,), ("[]",), ('{"normalize_sql_statements":true}',)]
    got = [(r["scoring_chunk_size"], r["normalize_sql_statements"]) for r in dispatch.settings(spark.createDataFrame(rows, "value string")).collect()]
    assert got == [(1000, False), (70, False), (5000, False), (5000, False), (5000, True)]


def test_fetchers_and_registry():
    from datetime import UTC

    from lumenlog.sources import connectors as co

    now = lambda: datetime(2024, 1, 1, 0, 10, tzinfo=UTC)
    asked = []

    def index(url, query):
        asked.append((url, query["query"]["range"]["@timestamp"]))
        return {"hits": {"hits": [{"_id": "1", "_source": {"@timestamp": "t1", "log": {"level": "warn"}, "host": {"name": "h"}, "process": {"name": "p"}, "message": "m"}}, {"_id": "2", "_source": {"@timestamp": "t2", "host": "g", "level": "info", "log": "raw line"}}, {"_id": "3", "_source": {"@timestamp": "t3", "a": 1}}]}}

    rows, cursor = co.from_index({"url": "http://es/", "index": "logs-*"}, None, index, now)
    assert asked == [("http://es/logs-*/_search", {"gt": "2024-01-01T00:05:00.000Z", "lte": "2024-01-01T00:10:00.000Z"})] and cursor == "t3"
    assert [(r["message"], r["severity"], r["host"], r["program"], r["external_id"]) for r in rows] == [("m", "warn", "h", "p", "1"), ("raw line", "info", "g", None, "2"), ('{"@timestamp": "t3", "a": 1}', None, None, None, "3")]
    assert co.from_index({"url": "u"}, "c", lambda *_: {"hits": {"hits": []}}, now) == ([], "2024-01-01T00:10:00.000Z")
    for answer in ([{"time": "t", "msg": "x", "level": "e", "hostname": "h", "_id": 5}], {"logs": [{"time": "t", "msg": "x", "level": "e", "hostname": "h", "_id": 5}]}, {"data": [{"time": "t", "msg": "x", "level": "e", "hostname": "h", "_id": 5}]}):
        rows, cursor = co.from_http({"url": "u"}, "c", lambda _, a=answer: a, now)
        assert (rows[0]["message"], rows[0]["severity"], rows[0]["host"], rows[0]["external_id"], cursor) == ("x", "e", "h", 5, "t")
    assert co.fetcher({"kind": "loki"}) is co.from_streams and co.fetcher({"fetcher": "json:dumps"}) is json.dumps
    with pytest.raises(ValueError, match="unknown connector"):
        co.fetcher({"kind": "other"})


def test_snapshots_and_feed(spark, tmp_path):
    from lumenlog.operators import maintenance
    from lumenlog.streaming import ingest

    table = spark.createDataFrame([(1, NOW), (2, NOW - timedelta(seconds=40))], "window_id long, created_at timestamp")
    maintenance.snapshot({"a": table, "b": table.limit(0)}, f"{tmp_path}", "2024-01-10")
    assert spark.read.parquet(f"{tmp_path}/2024-01-10/a").count() == 2 and spark.read.parquet(f"{tmp_path}/2024-01-10/b").count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        maintenance.snapshot({"a": table}, f"{tmp_path}", "2024-01-10")
    assert maintenance.kept_labels([f"2024-01-{i:02d}" for i in range(1, 12)], 3) == ["2024-01-11", "2024-01-10", "2024-01-09"]
    feed = lambda s: [(r["kind"], r["window_id"]) for r in ingest.score_feed(table, F.lit(NOW + timedelta(seconds=s)).cast("timestamp")).collect()]
    assert feed(10) == [("scores", 1)] and feed(31) == [("heartbeat", None)]
    assert [ingest.next_interval(*x) for x in ((15, True), (15, False), (100, False))] == [15, 30, 120]


def test_nested_redaction(spark):
    from lumenlog.functions import masking

    mark = "***REDACTED***"
    rows = [({"Password": "x", "a": {"token": [1], "note": "password=abc d"}, "l": ["secret: y", {"z": 1}]}, {"Password": mark, "a": {"token": mark, "note": f"password={mark} d"}, "l": [f"secret: {mark}", {"z": 1}]})]
    df = spark.createDataFrame([(json.dumps(a),) for a, _ in rows] + [("[1]",), ("no json",), (None,)], "v string")
    got = [r["v"] for r in df.select(masking.redact_json(F.col("v")).alias("v")).collect()]
    assert [json.loads(got[0])] == [b for _, b in rows] and got[1:] == ["[1]", "no json", None]
