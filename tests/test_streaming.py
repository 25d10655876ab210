"""Streams run batch by batch: fragments across batches, alert states, ingest that is killed and run again."""

import glob
import random
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenlog.operators import alerting
from lumenlog.streaming import alerts, fragments
from lumenlog.streaming.fragments import HOLD_MS, MOST_HELD, Buffer

LINES = "host string, program string, timestamp timestamp, seq long, message string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


class Feed:
    """A folder of JSON files as a stream, one micro-batch a file."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.at, self.schema, self.n = spark, tmp_path, schema, 0
        (tmp_path / "in").mkdir()

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.json(f"{self.at}/part{self.n}")
        for f in glob.glob(f"{self.at}/part{self.n}/*.json"):
            open(f"{self.at}/in/{self.n}.json", "w").write(open(f).read())  # noqa: SIM115
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(f"{self.at}/in")

    def start(self, df, mode="append", **trigger):
        return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{self.at}/checkpoint").option("path", f"{self.at}/out").trigger(**(trigger or {"availableNow": True})).start()

    def rows(self):
        """What is written so far, read past the sink's log."""
        done = [f for f in glob.glob(f"{self.at}/out/*.parquet") if open(f, "rb").read()[-4:] == b"PAR1"]  # noqa: SIM115
        return [r for f in done for r in pq.ParquetFile(f).read().to_pylist()]

    def out(self):
        return self.spark.read.parquet(f"{self.at}/out")


def at(s, ms=0):
    from datetime import UTC, datetime, timedelta

    return datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=s, milliseconds=ms)


def test_a_head_in_the_next_batch(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, LINES)
    feed.put([("h", "p", at(0), 1, "  at frame one"), ("h", "p", at(1), 2, "  at frame two"), ("other", "p", at(0), 3, "Plain line"), (None, None, at(0), 4, None), ("h", "q", None, 5, "  no time")])
    feed.put([("h", "p", at(2), 6, "Error: boom"), ("h", "p", at(2, 500), 7, "  at frame three"), ("h", "p", at(3), 8, "  of another second")])
    feed.start(fragments.reassembled_stream(feed.stream(), shards=2, hold_ms=600_000)).awaitTermination(120)
    got = sorted((r["host"], r["program"], r["message"]) for r in feed.out().collect())
    assert got == [("", "", ""), ("h", "p", "Error: boom\n  at frame one\n  at frame two\n  at frame three"), ("h", "q", "  no time"), ("other", "p", "Plain line")]


def test_what_is_held_too_long_is_released_by_a_timer(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, LINES)
    feed.put([("h", "p", at(0), 1, "  orphan")])
    query = feed.start(fragments.reassembled_stream(feed.stream(), shards=1), processingTime="1 second")
    try:
        began = time.time()
        while not feed.rows():
            assert time.time() - began < 180
            time.sleep(1)
        assert time.time() - began > HOLD_MS / 1000
    finally:
        query.stop()
    assert [(r["message"], r["timestamp"] is not None) for r in feed.rows()] == [("  orphan", True)]


def test_bounds_of_the_buffer():
    b = Buffer(most_keys=3)
    b.add([(f"h{i}", "p", 1000, f"  f{i}", True) for i in range(5)], now=0)
    assert set(b.held) == {("h2", "p"), ("h3", "p"), ("h4", "p")} and [o[3] for o in b.out] == ["  f0", "  f1"]
    b = Buffer()
    b.add([("h", "p", 1000, f"  f{i}", True) for i in range(MOST_HELD + 2)], now=5)
    assert len(b.held["h", "p"][1]) == MOST_HELD and [o[3] for o in b.out] == [f"  f{MOST_HELD}", f"  f{MOST_HELD + 1}"]
    b.expire(5 + HOLD_MS)
    assert b.next_timer() == 5 + HOLD_MS + 1 and len(b.out) == 2
    b.expire(5 + HOLD_MS + 1)
    assert not b.held and len(b.out) == MOST_HELD + 2 and b.next_timer() is None
    b = Buffer()
    b.add([("h", "p", 9000, "  late", True), ("h", "p", 1000, "  early", True), ("h", "p", 20_000, "  far", True), ("h", "p", 5000, "Head", False)], now=0)
    assert [o[3] for o in b.out] == ["Head\n  early\n  late"] and [f[1] for f in b.held["h", "p"][1]] == ["  far"]


SCORES = "system_id long, criterion_id long, at timestamp, score double"
RULES = "id long, channel_id long, system_id long, criterion_id int, min_score double, throttle_seconds int, notify_recovery boolean, enabled boolean, trigger_type string"
SILENCES = "is_global boolean, system_ids array<long>, rule_ids array<long>, starts_at timestamp, ends_at timestamp"
HISTORY = "id long, rule_id long, channel_id long, system_id long, criterion_id long, state string, created_at timestamp"


def test_a_stream_of_scores_writes_what_runs_over_all_windows_write(rocks, tmp_path):
    r = random.Random(1)
    rules = [(1, 1, None, None, 0.75, 0, True, True, "threshold"), (2, 1, 1, None, 0.5, 4000, True, True, "threshold"), (3, 1, None, 2, None, None, None, True, "threshold"), (4, 2, None, None, 0.1, 0, True, True, "threshold"), (5, 1, None, None, 0.1, 0, True, True, "schedule"), (6, 1, 2, 1, 0.5, 0, False, True, "threshold")]
    channels = rocks.createDataFrame([(1, True), (2, False)], "id long, enabled boolean")
    quiet = rocks.createDataFrame([(False, [2], None, at(7200), at(14_400)), (False, None, [3], at(0), at(3600)), (True, None, None, at(36_000), at(36_001))], SILENCES)
    known = rocks.createDataFrame([(1, 1, 1, 1, 1, "firing", at(-100)), (2, 2, 1, 1, 2, "resolved", at(-100))], HISTORY)
    table = rocks.createDataFrame(rules, RULES)
    feed = Feed(rocks, tmp_path, SCORES)
    hours = [[(s, c, at(3600 * h), r.choice((0.2, 0.6, 0.8, 0.9))) for s in (1, 2) for c in (1, 2)] for h in range(6)]
    for rows in hours:
        feed.put(rows)
    feed.start(alerts.alert_stream(feed.stream(), table, channels, quiet, known)).awaitTermination(180)
    got = sorted((x["rule_id"], x["system_id"], x["criterion_id"], x["score"], x["state"]) for x in feed.out().collect())
    # The batch operator, run window by window with the alerts so far as its history.
    expected, past, n = [], known, 10
    for h, rows in enumerate(hours):
        now = F.lit(at(3600 * h)).cast("timestamp")
        effective = rocks.createDataFrame(rows, SCORES).withColumnRenamed("score", "effective")
        new = alerting.evaluate(effective, table, channels, past, quiet, now).collect()
        expected += [(x["rule_id"], x["system_id"], x["criterion_id"], x["score"], x["state"]) for x in new]
        if new:
            past = rocks.createDataFrame([tuple(x) for x in past.collect()] + [(n + i, x["rule_id"], x["channel_id"], x["system_id"], x["criterion_id"], x["state"], at(3600 * h)) for i, x in enumerate(new)], HISTORY)
            n += len(new)
    assert got == sorted(expected) and len(got) > 10


RECORDS = [f'{{"timestamp":"2024-01-0{1 + i % 2}T00:00:{i:02d}Z","host":"host-{i % 3}","message":"line {i} password=abc"}}' for i in range(20)] + ['{"host":"host-1","message":"no time"}', '{"message":""}', "no json"]
SOURCES = [{"id": 1, "system_id": 5, "priority": 1, "selector": {"host": "^host-1$"}}, {"id": 2, "system_id": 6, "priority": 9, "selector": {"host": "^host-2$", "program": ".*"}}]


def test_a_batch_killed_before_its_commit_runs_again_without_doubling(spark, tmp_path, monkeypatch):
    from lumenlog.operators import events as ev
    from lumenlog.streaming import ingest

    (tmp_path / "in").mkdir()
    systems = spark.createDataFrame([(5, None, None), (6, None, None)], "system_id long, tz_name string, tz_offset_minutes int")
    store, found, point = f"{tmp_path}/events", f"{tmp_path}/discovery", f"{tmp_path}/checkpoint"

    def run():
        lines = spark.readStream.text(f"{tmp_path}/in").withColumnRenamed("value", "record")
        query = ingest.start_ingest(lines, SOURCES, systems, store, found, point, redaction=True)
        query.awaitTermination(120)

    (tmp_path / "in/0.json").write_text("\n".join(RECORDS[:12]))
    run()
    first = sorted(tuple(map(str, r)) for r in spark.read.parquet(store).select("id", "normalized_hash", "received_at").collect())

    # The second batch writes its events and dies before its discovery rows and its commit.
    (tmp_path / "in/1.json").write_text("\n".join(RECORDS[8:]))
    real = ingest.append_events

    def append_and_die(events, path):
        real(events, path)
        raise RuntimeError("killed")

    monkeypatch.setattr(ingest, "append_events", append_and_die)
    with pytest.raises(Exception, match="killed"):
        run()
    written = sorted(tuple(map(str, r)) for r in spark.read.parquet(store).select("id", "normalized_hash", "received_at").collect())
    monkeypatch.setattr(ingest, "append_events", real)
    run()
    table = spark.read.parquet(store)
    again = sorted(tuple(map(str, r)) for r in table.select("id", "normalized_hash", "received_at").collect())
    assert again == written and len(first) < len(again) == len({r[0] for r in again}) == 14
    assert {r["message"] for r in table.filter("message like 'line 1 %'").collect()} == {"line 1 password=***REDACTED***"}
    seen = spark.read.parquet(found)
    assert sorted((r["sample"], r["unmatched"]) for r in seen.collect()) == sorted((f"line {i} password=abc", True) for k, rows in ((0, range(12)), (1, range(8, 20))) for i in rows if i % 3 == 0)
    assert {r["batch"] for r in seen.select("batch").distinct().collect()} == {0, 1}
    run()
    assert spark.read.parquet(store).count() == 14
    with_rows = spark.read.parquet(store)
    assert ev.append_new(with_rows, with_rows).count() == 0


SERVICE = [(f"2024-01-01T00:00:{i:02d}.000Z", f"event {i}") for i in range(30)]


def service(config, cursor, now=None):
    """A log service that gains records while it is asked: at most seven a call, from after the cursor up to now."""
    from datetime import datetime

    seen = [(t, m) for t, m in SERVICE if (cursor is None or t > cursor) and datetime.fromisoformat(t) <= (now() if now else datetime.max)][:7]
    return [{"timestamp": t, "message": m, "external_id": m} for t, m in seen], seen[-1][0] if seen else cursor or "2024"


def test_a_poll_is_read_again_as_it_was(monkeypatch):
    from datetime import UTC, datetime

    from lumenlog.sources import connectors

    stream = connectors.PollStream({"fetcher": "tests.test_streaming:service"})
    monkeypatch.setattr(connectors, "utc_now", lambda: datetime(2024, 1, 1, 0, 0, 5, tzinfo=UTC))
    rows, end = stream.read(stream.initialOffset())
    rows = list(rows)
    assert len(rows) == 6 and end["records"] == 6
    # Later the service has more of that range; the same offsets give the same rows.
    monkeypatch.setattr(connectors, "utc_now", lambda: datetime(2024, 1, 1, 0, 0, 29, tzinfo=UTC))
    assert list(stream.readBetweenOffsets(stream.initialOffset(), end)) == rows
    more, last = stream.read(end)
    assert [r[1] for r in more] == [f"event {i}" for i in range(6, 13)]
    for _ in range(10):
        got, after = stream.read(last)
        got = list(got)
        assert got == list(stream.readBetweenOffsets(last, after)) or not got
        last = after
    assert got == [] and last["cursor"] == SERVICE[-1][0]


def test_a_poll_streams_every_record_once(spark, tmp_path):
    import json
    import threading
    from datetime import UTC, datetime, timedelta
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    from lumenlog.sources import connectors

    first = datetime.now(UTC) - timedelta(seconds=60)
    records = [{"timestamp": connectors.iso(first + timedelta(seconds=i)), "message": f"event {i}", "id": str(i)} for i in range(30)]

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked = parse_qs(urlparse(self.path).query)
            body = json.dumps([r for r in records if asked["from"][0] < r["timestamp"] <= asked["to"][0]][:7]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    connectors.register(spark)
    stream = spark.readStream.format("log_poll").option("kind", "http").option("url", f"http://127.0.0.1:{server.server_port}/logs").load()
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(processingTime="0 seconds").start()
    written = lambda: [r["external_id"] for f in glob.glob(f"{tmp_path}/out/*.parquet") if open(f, "rb").read()[-4:] == b"PAR1" for r in pq.ParquetFile(f).read().to_pylist()]  # noqa: E731, SIM115
    try:
        began = time.time()
        while time.time() - began < 120 and query.isActive and len(written()) < len(records):
            time.sleep(1)
        time.sleep(3)
        assert query.exception() is None
    finally:
        query.stop()
        server.shutdown()
    assert sorted(written(), key=int) == [str(i) for i in range(30)]


def test_nanoseconds_stay_whole():
    from lumenlog.sources.connectors import from_nanos, from_streams

    assert from_nanos(1_700_000_000_123_456_789) == "2023-11-14T22:13:20.123456789Z"
    answer = {"data": {"result": [{"stream": {"app": "b"}, "values": [["1700000000123456790", "two"], ["x", "bad"]]}, {"stream": {"job": "a"}, "values": [["1700000000123456789", "one"]]}]}}
    rows, cursor = from_streams({"url": "u"}, "1600000000000000000", ask=lambda _: answer)
    assert [(r["message"], r["timestamp"][-10:]) for r in rows] == [("one", "123456789Z"), ("two", "123456790Z")] and cursor == "1700000000123456791"
