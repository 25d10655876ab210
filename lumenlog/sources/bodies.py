"""Pushed request bodies and landed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.regexes import strip

#: Line formats; groups in order give the named fields.
RFC5424 = r"^<([0-9]{1,5})>1 ([^ ]+) ([^ ]+) ([^ ]+) ([-0-9]+) ([^ ]+) ((?:\[.*?\]|-)+) (.+)$"
RFC3164 = r"^<([0-9]+)>([^ ]* {1,2}[^ ]* (?:\d{4} )?[^ ]*) ([^ ]*) ([a-zA-Z0-9_/.\-,]*)(?:\[([0-9]+)\])?(?::)? *(.+)$"
RFC3164_BARE = r"^([^ ]* {1,2}[^ ]* (?:\d{4} )?[^ ]*) ([^ ]*) ([a-zA-Z0-9_/.\-,]*)(?:\[([0-9]+)\])?(?::)? *(.+)$"
CISCO = r"^<([0-9]+)>(?:([0-9]+): )?(?:\*?([A-Z][a-z]{2} {1,2}[0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?):? )?(?:%([A-Z0-9_]+)-([0-7])-([A-Z0-9_]+): )?(.+)$"
FORMATS = {
    "rfc5424": (RFC5424, ("pri", "time", "host", "ident", "pid", "msgid", "extradata", "message")), "cisco": (CISCO, ("pri", "seq", "time", "facility", "severity", "mnemonic", "message")),
    "rfc3164": (RFC3164, ("pri", "time", "host", "ident", "pid", "message")), "rfc3164_bare": (RFC3164_BARE, ("time", "host", "ident", "pid", "message")),
}


def entries(bodies: DataFrame, column: str = "body", most: int = 1000) -> DataFrame:
    """Records of request bodies: ``{"events": [...]}``, a bare array, or one object with a message.

    Adds record (JSON text), seq (place in the body) and error; a body with nothing in it or more than
    ``most`` records is one row with an error.
    """
    v = F.try_parse_json(column)
    kind = F.schema_of_variant(v)
    listed = F.try_variant_get(v, "$.events", "array<variant>")
    one = F.when(F.coalesce(F.try_variant_get(v, "$.message", "string"), F.try_variant_get(v, "$.msg", "string")).isNotNull(), F.array(v))
    found = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.coalesce(listed, one))
    n = F.coalesce(F.size(found), F.lit(0))
    error = F.when(n < 1, "no events").when(n > most, "too many events")
    rows = bodies.withColumn("error", error).withColumn("_found", F.when(error.isNull(), found))
    out = rows.select(*[c for c in bodies.columns if c != column], "error", F.posexplode_outer("_found").alias("seq", "_r"))
    return out.withColumn("record", F.to_json("_r")).drop("_r")


def parsed_lines(lines: DataFrame, fmt: str, column: str = "value") -> DataFrame:
    """A syslog line's fields by one format; lines that don't fit have nulls only."""
    pattern, names = FORMATS[fmt]
    fits = F.col(column).rlike(pattern)
    return lines.withColumns({n: F.when(fits, F.nullif(F.regexp_extract(column, pattern, i + 1), F.lit(""))) for i, n in enumerate(names)})


def syslog_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines as open records by the first format that fits, else as a message of its own."""
    out = F.to_json(F.struct(F.col(column).alias("message")))
    for fmt in ("rfc3164_bare", "rfc3164", "cisco", "rfc5424"):
        pattern, names = FORMATS[fmt]
        more = F.col(column).rlike(r"%[A-Z0-9_]+-[0-7]-[A-Z0-9_]+: ") if fmt == "cisco" else F.lit(True)
        fields = [F.nullif(F.regexp_extract(column, pattern, i + 1), F.lit("")).alias("program" if n == "ident" else n) for i, n in enumerate(names)]
        out = F.when(F.col(column).rlike(pattern) & more, F.to_json(F.struct(*fields))).otherwise(out)
    return lines.withColumn("record", out)


def otlp_records(rows: DataFrame, column: str = "value") -> DataFrame:
    """OTLP log bodies (resourceLogs, scopeLogs, logRecords) as records.

    Times stay whole nanoseconds; attributes of resource and record become keys of their own, the
    record's before the resource's, beside those that fill a field.
    """
    any_value = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
    attr = f"array<struct<key:string,value:{any_value}>>"
    shape = f"struct<resourceLogs:array<struct<resource:struct<attributes:{attr}>,scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{any_value},traceId:string,spanId:string,attributes:{attr}>>>>>>>"
    r = rows.select(F.explode(F.from_json(column, shape)["resourceLogs"]).alias("r")).select("r.resource", F.explode("r.scopeLogs").alias("s")).select("resource", F.explode("s.logRecords").alias("l"))
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    none = F.array().cast(attr)
    pairs = lambda c: F.transform(F.filter(F.coalesce(c, none), lambda a: a["key"].isNotNull()), lambda a: F.struct(a["key"].alias("key"), text(a["value"]).alias("value")))
    first = lambda c: F.map_from_entries(F.aggregate(c, F.array().cast("array<struct<key:string,value:string>>"), lambda out, a: F.when(F.exists(out, lambda x: x["key"] == a["key"]), out).otherwise(F.array_append(out, a))))
    df = r.withColumn("attributes", first(F.concat(pairs(F.col("l.attributes")), pairs(F.col("resource.attributes")))))
    nanos = F.coalesce(*[F.nullif(F.col(f"l.{c}").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")) for c in ("timeUnixNano", "observedTimeUnixNano")])
    of = lambda k: F.try_element_at("attributes", F.lit(k))
    fixed = F.struct(
        text(F.col("l.body")).alias("message"), F.col("l.severityNumber").cast("string").alias("severity_number"), F.col("l.severityText").alias("severity_text"), nanos.cast("string").alias("timestamp"),
        of("service.name").alias("service"), of("host.name").alias("host"), F.col("l.traceId").alias("trace_id"), F.col("l.spanId").alias("span_id"),
    )
    more = F.map_filter("attributes", lambda k, _: ~k.isin("service.name", "host.name"))
    # Both are JSON objects: the second's opening brace becomes a comma. Numbers were text only to keep their digits.
    whole = F.regexp_replace(F.to_json(fixed), r'"(severity_number|timestamp)":"(\d+)"', '"$1":$2')
    return df.select(F.when(F.size(more) == 0, whole).otherwise(F.concat(F.substring(whole, F.lit(1), F.length(whole) - 1), F.lit(","), F.substring(F.to_json(more), 2, 1 << 30))).alias("record"))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Landed bodies, a file each."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of landed JSON lines as records."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).withColumnRenamed("value", "record")


def mapping_fields(mapping: DataFrame, column: str = "mapping") -> DataFrame:
    """Dotted field paths and types of an index mapping, nested ones included, as rows.

    The walk is over one JSON document a row; ``properties`` and ``fields`` open a level.
    """
    import json

    import pandas as pd

    def walk(node: dict, path: str):
        for key in ("properties", "fields"):
            for name, child in (node.get(key) or {}).items():
                full = f"{path}.{name}" if path else name
                if "type" in child or "properties" not in child:
                    yield full, child.get("type", "object")
                yield from walk(child, full)

    def run(batches):
        for b in batches:
            rows = [(i, p, t) for i, text in zip(b["index"], b[column], strict=True) for p, t in walk(json.loads(text), "")]
            yield pd.DataFrame(rows, columns=["index", "path", "type"])

    return mapping.select("index", column).mapInPandas(run, "index string, path string, type string")


def hit_events(hits: DataFrame, fields: dict[str, str], system_id: int, column: str = "hit") -> DataFrame:
    """Documents of an external index (JSON hits with _id and _source) as events, by a map of event field to dotted path."""
    v = F.try_parse_json(column)
    path = lambda p: "$._source" + "".join(f'["{x}"]' for x in p.split("."))
    columns = {n: F.try_variant_get(v, path(p), "string") for n, p in fields.items()}
    when = F.coalesce(columns.pop("timestamp", F.lit(None)), F.try_variant_get(v, '$._source["@timestamp"]', "string"))
    return hits.select(F.try_variant_get(v, "$._id", "string").alias("id"), F.lit(system_id).cast("long").alias("system_id"), F.try_to_timestamp(when).alias("timestamp"), *[c.alias(n) for n, c in columns.items()])


