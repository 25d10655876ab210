"""Polled log services as Python data sources: the stream's offset is the service's cursor.

A fetcher turns (config, cursor, now) into (records, next cursor), oldest first. It is given by name, so
that executors and tests can supply their own transport; the default one reads JSON over HTTP.

An offset names the cursor, the time at which the service was asked and the number of records, so that a
batch that is read again asks for the same range and takes the same records.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

LIMIT = 1000
SCHEMA = "record string, external_id string"


def http_json(url: str, body: dict | None = None, headers: dict | None = None) -> dict:
    from urllib.request import Request, urlopen

    data = json.dumps(body).encode() if body is not None else None
    with urlopen(Request(url, data, {"Content-Type": "application/json"} | (headers or {})), timeout=30) as answer:  # noqa: S310
        return json.load(answer)


def utc_now() -> datetime:
    return datetime.now(UTC)


def iso(t: datetime) -> str:
    return t.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def nanos(t: datetime) -> int:
    whole = t.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)
    return ((whole.days * 86_400 + whole.seconds) * 1_000_000 + whole.microseconds) * 1_000


def from_nanos(n: int) -> str:
    """A time with all nine digits of its second."""
    return datetime.fromtimestamp(n // 1_000_000_000, UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{n % 1_000_000_000:09d}Z"


def from_index(config: dict, cursor: str | None, ask: Callable = http_json, now: Callable = utc_now) -> tuple[list[dict], str]:
    """Documents after the cursor (five minutes ago without one), oldest first; the next cursor is the last one's time, else now."""
    end = iso(now())
    start = cursor or iso(now() - timedelta(minutes=5))
    query = {"size": LIMIT, "sort": [{"@timestamp": "asc"}], "query": {"range": {"@timestamp": {"gt": start, "lte": end}}}}
    hits = ask(f"{config['url'].rstrip('/')}/{config.get('index', '_all')}/_search", query)["hits"]["hits"]
    out = []
    for h in hits:
        s = h.get("_source", {})
        nested = lambda k, s=s: s.get(k, {}).get("name") if isinstance(s.get(k), dict) else s.get(k)
        level = s.get("level") or (s.get("log") or {}).get("level") if isinstance(s.get("log"), dict) else s.get("level")
        text = s.get("message") or (s["log"] if isinstance(s.get("log"), str) else json.dumps(s))
        out.append({"timestamp": s.get("@timestamp"), "message": text, "severity": level, "host": nested("host"), "service": nested("service"), "program": nested("process"), "external_id": h.get("_id")})
    return out, (out[-1]["timestamp"] or end) if out else end


def from_streams(config: dict, cursor: str | None, ask: Callable = http_json, now: Callable = utc_now) -> tuple[list[dict], str]:
    """Label streams with nanosecond times, kept as whole numbers; the next cursor is one after the greatest."""
    from urllib.parse import urlencode

    end = nanos(now())
    start = int(cursor) if cursor else end - 300_000_000_000
    asked = urlencode({"query": config.get("query", '{job=~".+"}'), "start": start, "end": end, "limit": LIMIT, "direction": "forward"})
    out, last = [], start
    for stream in ask(f"{config['url'].rstrip('/')}/loki/api/v1/query_range?{asked}")["data"]["result"]:
        labels = stream.get("stream", {})
        for at, line in stream.get("values", []):
            if not str(at).isdigit():
                continue
            last = max(last, int(at) + 1)
            out.append({"timestamp": from_nanos(int(at)), "message": line, "host": labels.get("host") or labels.get("hostname"), "program": labels.get("app") or labels.get("job"), "service": labels.get("service"), "severity": labels.get("level"), "external_id": f"{at}"})
    out.sort(key=lambda r: int(r["external_id"]))  # streams of labels come one after the other
    return out, str(last)


def from_http(config: dict, cursor: str | None, ask: Callable = http_json, now: Callable = utc_now) -> tuple[list[dict], str]:
    """A JSON list, or one under ``logs`` or ``data``."""
    from urllib.parse import urlencode

    end = iso(now())
    got = ask(f"{config['url']}?{urlencode({'from': cursor or iso(now() - timedelta(minutes=5)), 'to': end, 'limit': LIMIT})}")
    rows = got if isinstance(got, list) else got.get("logs") or got.get("data") or []
    pick = lambda r, *keys: next((r[k] for k in keys if r.get(k) not in (None, "")), None)
    out = [{"timestamp": pick(r, "timestamp", "time", "@timestamp"), "message": pick(r, "message", "msg", "body") or json.dumps(r), "severity": pick(r, "severity", "level"), "host": pick(r, "host", "hostname"), "service": pick(r, "service", "service_name"), "program": pick(r, "program", "app"), "external_id": pick(r, "id", "_id")} for r in rows]
    return out, (out[-1]["timestamp"] or end) if out else end


#: Connector kinds by name.
CONNECTORS: dict[str, Callable] = {"elasticsearch": from_index, "loki": from_streams, "http": from_http}


def fetcher(options: dict) -> Callable:
    """The connector's function, or ``module:function`` from the option ``fetcher``."""
    if named := options.get("fetcher"):
        module, name = named.split(":")
        return getattr(importlib.import_module(module), name)
    if (kind := options.get("kind", "")) not in CONNECTORS:
        raise ValueError(f"unknown connector: {kind}")
    return CONNECTORS[kind]


def rows_of(records: list[dict]) -> Iterator[tuple[str, str | None]]:
    for r in records:
        yield json.dumps({k: v for k, v in r.items() if v is not None}, ensure_ascii=False), r.get("external_id")


class PollSource(DataSource):
    """``spark.readStream.format("log_poll").option("kind", "loki").option("url", ...)``; also readable as a batch from the option ``cursor``."""

    @classmethod
    def name(cls) -> str:
        return "log_poll"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PollReader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return PollStream(dict(self.options))


class PollReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        yield from rows_of(fetcher(self.options)(self.options, self.options.get("cursor"))[0])


class PollStream(SimpleDataSourceStreamReader):
    """A failed poll raises, so its cursor isn't committed and the same range is asked for again."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": self.options.get("cursor"), "asked": None, "records": 0}

    def ask(self, cursor: str | None, at: datetime) -> tuple[list[dict], str]:
        return fetcher(self.options)(self.options, cursor, now=lambda: at)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = utc_now()
        records, cursor = self.ask(start["cursor"], at)
        if not records:
            # Nothing new: the offset stands, so that no empty batch is written; its range is asked for again.
            return iter(()), start if start["asked"] else start | {"cursor": start["cursor"] or cursor}
        return iter(list(rows_of(records))), {"cursor": cursor, "asked": at.isoformat(), "records": len(records)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        if not end["asked"]:
            return iter(())
        records, _ = self.ask(start["cursor"], datetime.fromisoformat(end["asked"]))
        return iter(list(rows_of(records[: end["records"]])))


def register(spark) -> None:
    spark.dataSource.register(PollSource)
