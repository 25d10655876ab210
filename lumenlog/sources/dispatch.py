"""Where a system's events are, settings over defaults, and external indexes as events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import events as ev

#: Defaults of the pipeline's settings, and the least chunk that an old setting may give.
PIPELINE = {"pipeline_min_interval_minutes": 15, "pipeline_max_interval_minutes": 120, "window_minutes": 5, "scoring_chunk_size": 5000, "effective_score_meta_weight": 0.7, "normalize_sql_statements": False}
LEAST_CHUNK = 1000
#: An event's fields and the paths they have in an index where no map says otherwise.
FIELDS = {"timestamp": "@timestamp", "message": "message", "severity": "severity", "host": "host", "source_ip": "source_ip", "service": "service", "facility": "facility", "program": "program", "trace_id": "trace_id", "span_id": "span_id"}
FETCHED, MOST_FETCHED = 3, 1000


def backends(systems: DataFrame) -> DataFrame:
    """systems (id, event_source, es_connection_id, es_config as JSON) with backend: external where all that an index needs is there, else stored."""
    pattern = F.try_variant_get(F.try_parse_json("es_config"), "$.index_pattern", "string")
    ready = (F.col("event_source") == "elasticsearch") & F.col("id").isNotNull() & F.col("es_connection_id").isNotNull() & (pattern != "")
    return systems.withColumn("backend", F.when(F.coalesce(ready, F.lit(False)), "external").otherwise("stored"))


def scanned(systems: DataFrame, stored: DataFrame, external: DataFrame) -> DataFrame:
    """Events of all systems, each from its backend. Systems are a table, so both sides join by key."""
    of = backends(systems).select(F.col("id").alias("system_id"), "backend")
    own = stored.join(of.filter("backend = 'external'"), "system_id", "left_anti")
    other = external.join(of.filter("backend = 'external'").select("system_id"), "system_id", "left_semi")
    return own.unionByName(other, allowMissingColumns=True)


def settings(rows: DataFrame, defaults: Mapping[str, object] = PIPELINE, column: str = "value") -> DataFrame:
    """Adds a column for each setting: what the JSON object in ``column`` says, else the default.

    What is no object, or no JSON, says nothing. An old limit of rows a run becomes the chunk size, of
    LEAST_CHUNK at least, where none is given.
    """
    v = F.try_parse_json(column)
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    out = {}
    for name, default in defaults.items():
        kind = kinds[type(default)]
        found = F.try_variant_get(v, f"$.{name}", kind)
        if name == "scoring_chunk_size":
            old = F.try_variant_get(v, "$.scoring_limit_per_run", kind)
            found = F.coalesce(F.when(found != 0, found), F.when(old != 0, F.greatest(F.lit(LEAST_CHUNK).cast(kind), old)), found)
        out[name] = F.coalesce(found, F.lit(default).cast(kind))
    return rows.withColumns(out)


def path_value(v: Column, path: str, kind: str = "string") -> Column:
    """A dotted path inside a document; a key that holds dots itself is found too."""
    nested = F.try_variant_get(v, "$._source" + "".join(f'["{p}"]' for p in path.split(".")), kind)
    return F.coalesce(nested, F.try_variant_get(v, f'$._source["{path}"]', kind)) if "." in path else nested


def filter_condition(v: Column, query: Mapping) -> Column:
    """An index query as a condition: bool (must, filter, should, must_not), term, terms, match, exists and range. Others are an error."""
    (kind, body), *more = query.items()
    if more:
        raise ValueError("a query has one kind")
    if kind == "bool":
        out = F.lit(True)
        for key in ("must", "filter", "must_not"):
            for q in [body[key]] if isinstance(body.get(key), Mapping) else body.get(key, []):
                found = F.coalesce(filter_condition(v, q), F.lit(False))
                out &= ~found if key == "must_not" else found
        if some := body.get("should"):
            any_of = F.lit(False)
            for q in [some] if isinstance(some, Mapping) else some:
                any_of |= F.coalesce(filter_condition(v, q), F.lit(False))
            out &= any_of if not (body.get("must") or body.get("filter")) else F.lit(True)
        return out
    if kind == "match_all":
        return F.lit(True)
    if kind == "exists":
        return path_value(v, body["field"], "variant").isNotNull()
    ((field, value),) = body.items()
    if kind == "terms":
        return path_value(v, field).isin([str(x) for x in value])
    if kind in ("term", "match"):
        return path_value(v, field) == str(value["value" if kind == "term" else "query"] if isinstance(value, Mapping) else value)
    if kind == "range":
        number = all(isinstance(x, (int, float)) for x in value.values())
        c = path_value(v, field, "double" if number else "string")
        tests = {"gt": c.__gt__, "gte": c.__ge__, "lt": c.__lt__, "lte": c.__le__}
        out = F.lit(True)
        for op, x in value.items():
            out &= tests[op](F.lit(x))
        return out
    raise ValueError(f"unknown query: {kind}")


def external_events(hits: DataFrame, configs: Mapping[int, Mapping], metadata: DataFrame | None = None) -> DataFrame:
    """Documents (system_id, hit: JSON with _id and _source) as events of their systems.

    ``configs``: a system's index settings, which are configuration: query_filter (a base query) and
    field_mapping (event field to dotted path). Documents of other systems go. With ``metadata``, the side
    table, events have their acknowledgement and template; without a text they are empty, with no time they
    have none.
    """
    v = F.col("_v")
    base, columns = F.lit(False), {n: F.lit(None).cast("string") for n in FIELDS}
    for system, config in configs.items():
        own = F.col("system_id") == system
        query = config.get("query_filter") or {}
        base |= own & (F.coalesce(filter_condition(v, query), F.lit(False)) if query else F.lit(True))
        mapped = FIELDS | dict(config.get("field_mapping") or {})
        columns = {n: F.when(own, path_value(v, mapped[n])).otherwise(c) for n, c in columns.items()}
    df = hits.withColumn("_v", F.try_parse_json("hit")).filter(base)
    columns["timestamp"] = F.try_to_timestamp(columns["timestamp"])
    columns["message"] = F.coalesce(columns["message"], F.lit(""))
    out = df.select("system_id", F.try_variant_get(v, "$._id", "string").alias("id"), *[c.alias(n) for n, c in columns.items()])
    return out if metadata is None else ev.with_metadata(out, metadata)


def external_unscored(hits: DataFrame, metadata: DataFrame, scored: DataFrame, system_id: int, limit: int = 100) -> DataFrame:
    """A system's newest external events without a score or mark: of the newest FETCHED times as many as asked for, no more than MOST_FETCHED."""
    newest = hits.filter(F.col("system_id") == system_id).orderBy(F.desc("timestamp"), "id").limit(min(limit * FETCHED, MOST_FETCHED))
    return ev.without_metadata(newest, metadata, scored).orderBy(F.desc("timestamp"), "id").limit(limit)


def preview(hits: DataFrame, config: Mapping, system_id: int, most: int = 10) -> DataFrame:
    """The newest documents of an index as events, to look at a field map before it is used."""
    return external_events(hits, {system_id: config}).orderBy(F.desc("timestamp"), "id").limit(most)


def index_list(indices: DataFrame, pattern: str = "*") -> DataFrame:
    """Indexes (index, docs, bytes) that a pattern with stars and commas names; hidden ones, which begin with a dot, only if it does."""
    hit = F.lit(False)
    for p in filter(None, (x.strip() for x in pattern.split(","))):
        like = F.col("index").like(p.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%"))
        hit |= like & (~F.col("index").startswith(".") if not p.startswith(".") else F.lit(True))
    return indices.filter(hit).orderBy("index")

