"""From open records to normalised, routed and redacted events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import addresses, masking, severity as sev, templates, timefix
from ..functions.regexes import bound, strip
from . import events as ev, routing

#: Nested paths and the flat field that each fills, in order.
NESTED = (
    ("host.name", "host"), ("host.hostname", "host"), ("source.ip", "source_ip"), ("source.address", "source_ip"), ("service.name", "service"), ("process.name", "program"), ("log.level", "severity"),
    ("log.syslog.facility.name", "facility"), ("log.syslog.severity.name", "severity"), ("trace.id", "trace_id"), ("span.id", "span_id"), ("event.original", "message"), ("@timestamp", "timestamp"),
    ("resource.service.name", "service"), ("resource.host.name", "host"), ("attributes.severity_text", "severity"), ("attributes.trace_id", "trace_id"), ("attributes.span_id", "span_id"),
)
#: The keys that are consumed; any other goes to ``raw``.
KNOWN = (
    "timestamp", "time", "@timestamp", "message", "short_message", "msg", "body", "severity", "level", "syslog_severity", "severity_text", "severity_number", "host", "hostname", "source",
    "source_ip", "fromhost_ip", "fromhost-ip", "ip", "client_ip", "src_ip", "service", "service_name", "application", "facility", "syslog_facility", "program", "app_name", "appname",
    "trace_id", "traceId", "span_id", "spanId", "external_id", "connector_id", "pri", "msgid", "extradata", "ident", "pid", "mnemonic", "seq", "collector", "collector_host", "raw",
)


def at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, "$" + "".join(f'["{p}"]' for p in path.split(".")) if path != "@timestamp" else '$["@timestamp"]', kind)


def kind_of(v: Column, path: str) -> Column:
    """STRING, BIGINT, DOUBLE, OBJECT<...> and so on; null where there is nothing."""
    return F.schema_of_variant(at(v, path, "variant"))


def text_field(v: Column, *keys: str) -> Column:
    """The first of the keys that holds a non-empty string. Most keys are absent, so their kind is asked for last."""
    return F.coalesce(*[F.when(at(v, k).isNotNull() & (at(v, k) != "") & (kind_of(v, k) == "STRING"), at(v, k)) for k in keys])


def number_field(v: Column, key: str, kind: str = "double") -> Column:
    return F.when(at(v, key).isNotNull() & kind_of(v, key).rlike(r"^(BIGINT|DOUBLE|DECIMAL)"), at(v, key, kind))


#: What a record's text must hold for one of its keys to hold an object, wherever that is.
OBJECT_INSIDE = r"\"\s*:\s*\{"


def flat_field(v: Column, name: str, objects_count: bool = False, nested_any: Column | None = None) -> Column:
    """A flat field, or the first nested path for it that holds something; explicit values win.

    ``objects_count``: an object under the flat key counts as set, so that nothing is flattened into it.
    ``nested_any``: whether the record may hold objects at all; where not, no path is walked.
    """
    if nested_any is not None:
        return F.when(nested_any, flat_field(v, name, objects_count)).otherwise(F.nullif(at(v, name), F.lit("")))
    kind = kind_of(v, name)
    own = F.when(kind.startswith("OBJECT"), F.lit(None)).otherwise(F.nullif(at(v, name), F.lit("")))
    nested = [F.nullif(F.coalesce(at(v, p), F.to_json(at(v, p, "variant"))), F.lit("")) for p, flat in NESTED if flat == name and p != name]
    found = F.coalesce(own, *nested) if nested else own
    return F.when(kind.startswith("OBJECT"), F.lit(None)).otherwise(found) if objects_count else found


def parsed(records: DataFrame, column: str = "record") -> DataFrame:
    """Open JSON records as VARIANT ``v``; what is no JSON object is dropped by :func:`normalized`."""
    # These ids are never below 0. They keep Catalyst from moving later filters under this column with a copy of the parse for each field.
    return records.withColumn("v", F.when(F.monotonically_increasing_id() >= 0, F.try_parse_json(column)))


def message_of(v: Column, nested_any: Column | None = None) -> Column:
    """message, short_message, msg or body: the first that is there; it must be a non-blank string."""
    first = F.coalesce(flat_field(v, "message", nested_any=nested_any), *[F.when(kind_of(v, key) == "STRING", at(v, key)) for key in ("short_message", "msg", "body")])
    return bound(strip(first), lambda text: F.when(text != "", text))


def severity_of(v: Column, inner: Column, nested_any: Column | None = None) -> Column:
    """Text fields, then syslog numbers, OpenTelemetry numbers, PRI, and the level in ``inner``, a JSON message as VARIANT."""
    text = F.coalesce(F.nullif(strip(flat_field(v, "severity", nested_any=nested_any)), F.lit("")), *[F.when(kind_of(v, k) == "STRING", F.nullif(strip(at(v, k)), F.lit(""))) for k in ("level", "syslog_severity", "severity_text")])
    number = F.coalesce(number_field(v, "severity"), number_field(v, "level"))
    otel = at(v, "severity_number", "double")
    pri = at(v, "pri", "double")
    keys = ("level", "severity", "loglevel", "lvl")
    logger = F.coalesce(*[F.when(kind_of(inner, k).rlike(r"^(BIGINT|DOUBLE|DECIMAL)"), sev.logger_severity(at(inner, k, "double"))).when(kind_of(inner, k) == "STRING", sev.canonical(at(inner, k))) for k in keys])
    return F.coalesce(sev.canonical(text), F.when(number.isNotNull(), sev.severity_name(number)), F.when(otel >= 1, sev.otel_severity(otel)), F.when(pri >= 0, sev.pri_severity(pri)), logger)


def extras(v: Column) -> Column:
    """Keys outside KNOWN as a JSON object, over an incoming ``raw`` object; null without any."""
    as_map = F.try_variant_get(v, "$", "map<string,variant>")
    own = F.map_filter(as_map, lambda k, _: ~k.isin(*KNOWN))
    raw = F.coalesce(F.try_variant_get(v, "$.raw", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    kept = F.map_filter(raw, lambda k, _: ~F.array_contains(F.map_keys(own), k))
    both = F.map_concat(kept, F.coalesce(own, F.create_map().cast("map<string,variant>")))
    return F.when(F.size(both) > 0, F.to_json(both))


def normalized(records: DataFrame, now: Column, column: str = "record", enrich: bool = True, objects_count: bool = False) -> DataFrame:
    """Events of open records: timestamp, message, severity, host, source_ip, service, facility, program, trace and span ids, raw.

    Records without a message are dropped. Other columns of ``records`` stay.
    """
    v, message, some = F.col("v"), F.col("_full"), F.col("_nested")
    flat = lambda name, objects=False: flat_field(v, name, objects, some)
    # Columns of their own are worked out once, though many fields read them.
    df = parsed(records, column).withColumn("_nested", F.coalesce(F.col(column).rlike(OBJECT_INSIDE), F.lit(True))).withColumn("_full", message_of(v, some)).filter("_full is not null").withColumn("_json", bound(message, templates.json_object))
    inner = templates.text_at(F.col("_json"), "msg", "message", "text")
    when = F.coalesce(flat("timestamp"), at(v, "time"))
    number = F.coalesce(*[number_field(v, k, "decimal(38,9)") for k in ("timestamp", "time", "@timestamp")])
    pri = at(v, "pri", "double")
    address = addresses.clean_transport_address(F.coalesce(flat("source_ip"), text_field(v, "fromhost_ip", "fromhost-ip", "client_ip", "src_ip", "ip")))
    host = F.coalesce(flat("host", objects_count), text_field(v, "hostname", "source"))
    df = df.select(
        *[c for c in records.columns if c != column],
        timefix.resolved(F.when(number.isNull(), when), number, now).alias("timestamp"),
        message.alias("_full"), F.coalesce(inner, message).alias("message"), severity_of(v, F.col("_json"), some).alias("_header"),
        host.alias("_host"), address.alias("source_ip"), F.coalesce(flat("service", objects_count), text_field(v, "service_name", "application")).alias("service"),
        F.coalesce(flat("facility"), text_field(v, "syslog_facility"), F.when(pri >= 0, sev.pri_facility(pri))).alias("facility"),
        F.coalesce(flat("program"), text_field(v, "app_name", "appname", "ident", "mnemonic")).alias("program"),
        F.coalesce(flat("trace_id"), text_field(v, "traceId")).alias("trace_id"), F.coalesce(flat("span_id"), text_field(v, "spanId")).alias("span_id"),
        text_field(v, "external_id").alias("external_id"), extras(v).alias("raw"),
    )
    header = F.col("_header")
    if enrich:
        df = df.withColumn("_content", sev.content_severity(F.col("_full")))
    level = sev.worse(F.col("_content"), header) if enrich else header
    shown = F.when(addresses.is_plausible_host(F.col("_host")), F.col("_host")).otherwise(F.col("source_ip"))
    return df.withColumns({"severity": level, "host": shown}).drop("_full", "_header", "_host", "_content")


def id_of(digest: Column) -> Column:
    """A digest's first 128 bits written as a UUID: one event has one id, however often its batch is worked out."""
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def ingest(records: DataFrame, sources: Sequence[Mapping], systems: DataFrame, now: Column, column: str = "record", redaction: bool = False, drift_seconds: int = 300, message_chars: int = 8192) -> tuple[DataFrame, DataFrame]:
    """(events, discovery rows): normalise, truncate, repair addresses, route, correct times, clamp, redact, hash.

    ``systems``: system_id, tz_name, tz_offset_minutes. The order of steps is part of the contract: hashes
    are taken from redacted messages and corrected times. Events without an id, and their
    discovery rows, get one from a hash of their fields before routing.
    """
    df = normalized(records, now, column)
    df = df.withColumns({"message": templates.truncated(F.col("message"), message_chars), "source_ip": addresses.nat_source_ip(F.col("source_ip"), F.col("host"))})
    if "id" not in df.columns:
        # From the fields before routing, so that an event and its discovery row have one id.
        df = df.withColumn("id", id_of(ev.normalized_hash()))
    df = routing.routed(df, sources)
    zones = systems.select("system_id", "tz_name", "tz_offset_minutes")
    seen = routing.discovery_rows(df)
    df = df.filter("system_id is not null").join(zones, "system_id", "left")
    df = df.withColumn("timestamp", timefix.clamped(timefix.corrected(F.col("timestamp"), F.col("tz_name"), F.col("tz_offset_minutes")), now, drift_seconds)).drop("tz_name", "tz_offset_minutes")
    if redaction:
        df = df.withColumns({"message": masking.redact(F.col("message")), "raw": masking.redact_json(F.col("raw"))})
    df = df.withColumn("normalized_hash", ev.normalized_hash())
    df = df.withColumns({"received_at": now, "acknowledged_at": F.lit(None).cast("timestamp"), "scored_at": F.lit(None).cast("timestamp"), "template_id": F.lit(None).cast("string")})
    return df, seen
