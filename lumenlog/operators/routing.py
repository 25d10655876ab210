"""Routing of events to systems by source selectors."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.regexes import is_valid

#: Patterns that match anything.
WILDCARDS = (".*", "^.*$", ".+", "^.+$")


def groups_of(selector) -> list[dict[str, str]]:
    """A selector (JSON text, object or list of objects) as groups without empty entries."""
    if isinstance(selector, str):
        selector = json.loads(selector)
    groups = selector if isinstance(selector, Sequence) else [selector]
    return [{k: str(v) for k, v in g.items() if v not in (None, "")} if isinstance(g, Mapping) else {} for g in groups]


def is_catch_all(selector) -> bool:
    """Whether every pattern is a wildcard."""
    return all(all(p in WILDCARDS for p in g.values()) for g in groups_of(selector))


def group_condition(events: DataFrame, group: Mapping[str, str]) -> Column:
    """All of a group's patterns match, in either case. Fields the table lacks are read from ``raw``; an empty group matches nothing."""
    if not group:
        return F.lit(False)

    def test(key: str, pattern: str) -> Column:
        value = F.col(key).cast("string") if key in events.columns else F.try_variant_get(F.try_parse_json("raw"), f'$["{key}"]', "string") if "raw" in events.columns else F.lit(None).cast("string")
        hit = value.rlike(f"(?i){pattern}") if is_valid(pattern) else F.lower(value) == pattern.lower()
        return F.coalesce(hit, F.lit(pattern in WILDCARDS))

    return reduce(lambda a, b: a & b, [test(k, p) for k, p in group.items()])


def routed(events: DataFrame, sources: Sequence[Mapping]) -> DataFrame:
    """Adds system_id, log_source_id and is_catch_all of the first source (by priority, then id) whose selector matches, else nulls.

    Sources are configuration: one CASE expression tests them in order, without a join or a shuffle.
    """
    system, source, catch = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("boolean")
    for s in sorted(sources, key=lambda s: (s["priority"], s["id"]), reverse=True):
        hit = reduce(lambda a, b: a | b, [group_condition(events, g) for g in groups_of(s["selector"])], F.lit(False))
        system = F.when(hit, F.lit(s["system_id"]).cast("long")).otherwise(system)
        source = F.when(hit, F.lit(s["id"]).cast("long")).otherwise(source)
        catch = F.when(hit, F.lit(is_catch_all(s["selector"]))).otherwise(catch)
    return events.withColumns({"system_id": system, "log_source_id": source, "is_catch_all": catch})


def discovery_rows(routed_events: DataFrame, sample_chars: int = 512) -> DataFrame:
    """What the discovery buffer takes: events without a source, and those of a catch-all."""
    found = routed_events.filter(F.col("system_id").isNull() | F.col("is_catch_all"))
    return found.select("id", "host", "source_ip", "program", F.col("timestamp").alias("received_at"), F.substring("message", 1, sample_chars).alias("sample"), F.col("system_id").isNull().alias("unmatched"))
