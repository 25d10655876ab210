"""Normal behaviour: patterns of expected messages, and which events they match."""

from __future__ import annotations

import re
from collections.abc import Callable
from re import _parser as regex_parser

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from ..functions.regexes import is_valid

LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

#: What is variable in a message and the pattern for it, in order; dashes of a MAC address must agree.
VARIABLE = (
    (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "[^ ]+"),
    (r"(?i)\b[0-9a-f]{2}([:-])[0-9a-f]{2}(?:\1[0-9a-f]{2}){4}\b", "[^ ]+"),
    (r"(?i)\b[0-9a-f]{4}\.[0-9a-f]{4}\.[0-9a-f]{4}\b", "[^ ]+"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}/\d{1,2}\b", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+/[0-9]+"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    (r"(?i)\b[0-9a-f]{1,4}(:[0-9a-f]{1,4}){2,7}\b", "[^ ]+"),
    (r"(?i)\b(?:(?:Ten)?(?:Hundred)?(?:Gigabit)?(?:Fast)?Ethernet|Gi|Fa|Te|Hu|Eth|eth|ens|em|enp\d+s)\d+(?:/\d+)*", "[^ ]+"),
    (r"(?i)\b(?:Port-channel|Po|po|Vlan|vlan|Loopback|Lo|Tunnel|Tu|BVI|bvi|mgmt|Mgmt)\d+\b", "[^ ]+"),
    (r"(?i)\b(?:Switch|Stack|Unit|Slot|Module|Member|Node)\s+\d+\b", "[^ ]+ [0-9]+"),
    (r"(?i)\b(?:MST|MSTI|STP)\d+\b", "[^ ]+"),
    (r"(?i)\b0x[0-9a-f]{4,}\b", "0x[0-9a-f]+"),
    (r"(?i)\b[0-9a-f]{16,}\b", "[0-9a-f]+"),
    (r"(?:/[\w.+-]+){2,}", "/[^ ]+"),
    (r'"[^"]*"', '"[^"]*"'),
    (r"'[^']*'", "'[^']*'"),
    (r"_\d+\b", "_[0-9]+"),
    (r"\b\d+\b", "[0-9]+"),
)
ESCAPED = re.compile(r"[.*+?^${}()|\[\]\\]")


def escape(text: str) -> str:
    return ESCAPED.sub(r"\\\g<0>", text)


@F.pandas_udf(StringType())
def normal_pattern(messages: pd.Series) -> pd.Series:
    """An anchored pattern for messages like this one: variable parts by character classes, the rest literally."""
    rules = [(re.compile(p, re.A), by) for p, by in VARIABLE]

    def one(message: str) -> str:
        pieces: list[tuple[bool, str]] = [(False, message)]
        for pattern, by in rules:
            after = []
            for fixed, text in pieces:
                if fixed:
                    after.append((fixed, text))
                    continue
                at = 0
                for m in pattern.finditer(text):
                    after += [(False, text[at : m.start()]), (True, by)]
                    at = m.end()
                after.append((False, text[at:]))
            pieces = [p for p in after if p[1]]
        return "^" + "".join(text if fixed else escape(text) for fixed, text in pieces) + "$"

    return messages.map(one, na_action="ignore")


def literal_pattern(c: Column) -> Column:
    """An anchored pattern for exactly this host or program; null and empty give null."""
    return F.when(c != "", F.concat(F.lit("^"), F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit("$")))


def usable(templates: DataFrame) -> DataFrame:
    """Enabled templates whose patterns all compile. Templates are few and written by people, so the driver checks them."""
    rows = templates.filter("enabled").select("id", "pattern_regex", "host_pattern", "program_pattern").collect()
    good = [r["id"] for r in rows if all(is_valid(p) for p in (r["pattern_regex"], r["host_pattern"], r["program_pattern"]) if p)]
    return templates.filter(F.col("id").isin(good))


#: Templates up to which every event is tried against all of them; beyond it a literal index names those to try.
FEW = 32


def required_literal(pattern: str) -> str:
    """The longest text that every match of a pattern holds, letters A-Z in lower case; empty where none is sure.

    Patterns are taken by Java; what the parser here does not take, or might read otherwise, has no literal.
    """
    if re.search(r"\\[0-9QEx]|\(\?[a-z]*x", pattern):
        return ""
    try:
        tree = regex_parser.parse(pattern, re.ASCII)
    except (re.error, OverflowError, RecursionError):
        return ""
    found, run = [""], []

    def close() -> None:
        found.append("".join(run))
        run.clear()

    def walk(items) -> None:
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                run.append(chr(arg))
            elif name == "SUBPATTERN":
                walk(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
                close()
                walk(arg[2])
                close()
            elif name == "ATOMIC_GROUP":
                walk(arg)
            elif name != "AT":
                close()

    walk(tree)
    close()
    return max(found, key=len).translate(LOWER)


TRIED = "array<struct<id:bigint,system_id:bigint,pattern_regex:string,host_pattern:string,program_pattern:string>>"


def candidates(rows: list) -> Callable[[Column], Column]:
    """A function from messages to the templates, in the order of ``rows``, whose literal they hold.

    One automaton of all literals reads a message once, whatever their number.
    """
    index = ahocorasick.Automaton()
    always, held = [], {}
    for k, r in enumerate(rows):
        if literal := required_literal(r["pattern_regex"]):
            held.setdefault(literal, []).append(k)
        else:
            always.append(k)
    for literal, places in held.items():
        index.add_word(literal, places)
    if held:
        index.make_automaton()
    told = [{key: r[key] for key in ("id", "system_id", "pattern_regex", "host_pattern", "program_pattern")} for r in rows]

    @F.pandas_udf(TRIED)
    def found(messages: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            if text is None:
                return []
            hits = set(always)
            if held:
                for _, places in index.iter(text.lower() if text.isascii() else text.translate(LOWER)):
                    hits.update(places)
            return [told[k] for k in sorted(hits)]

        return messages.map(one)

    return found


def matched(events: DataFrame, templates: DataFrame, mode: str = "pipeline", few: int = FEW) -> Column:
    """The ids of the enabled templates that match an event, ascending, as an array column of ``events``.

    ``pipeline``: a missing host or program is an empty string; ``sql``: it matches no pattern. Templates are
    written by people and read to the driver. Nothing is joined or shuffled: a few of them become
    conditions of their own; of many, those that the literal index names are tried.
    """
    rows = templates.filter("enabled").orderBy("id").collect()
    some = (lambda c: F.coalesce(F.col(c), F.lit(""))) if mode == "pipeline" else F.col
    like = lambda value, pattern: F.coalesce(F.rlike(value, pattern), F.lit(False))
    if len(rows) <= few:
        out = []
        for r in rows:
            fits = like(F.col("message"), F.lit(f"(?i){r['pattern_regex']}"))
            if r["system_id"] is not None:
                fits = (F.col("system_id") == r["system_id"]) & fits
            for c, key in (("host", "host_pattern"), ("program", "program_pattern")):
                if r[key]:
                    fits &= like(some(c), F.lit(f"(?i){r[key]}"))
            out.append(F.when(fits, F.lit(r["id"]).cast("long")))
        return F.filter(F.array(*out), lambda x: x.isNotNull()) if out else F.array().cast("array<bigint>")
    where = lambda value, pattern: F.coalesce(pattern, F.lit("")).isin("") | like(value, F.concat(F.lit("(?i)"), pattern))

    def fits(t: Column) -> Column:
        system = t["system_id"].isNull() | F.coalesce(t["system_id"] == F.col("system_id"), F.lit(False))
        return system & like(F.col("message"), F.concat(F.lit("(?i)"), t["pattern_regex"])) & where(some("host"), t["host_pattern"]) & where(some("program"), t["program_pattern"])

    return F.transform(F.filter(candidates(rows)(F.col("message")), fits), lambda t: t["id"])


def excluded(events: DataFrame, templates: DataFrame, mode: str = "pipeline") -> DataFrame:
    """Events that some enabled template matches."""
    return events.filter(F.size(matched(events, templates, mode)) > 0)


def kept(events: DataFrame, templates: DataFrame, mode: str = "pipeline") -> DataFrame:
    return events.filter(F.size(matched(events, templates, mode)) == 0)


def first_match(events: DataFrame, templates: DataFrame, mode: str = "pipeline") -> DataFrame:
    """event id and the first template (by id) that matches it."""
    return events.select("id", F.get(matched(events, templates, mode), F.lit(0)).alias("template")).filter("template is not null")


def retroactively_zeroed(scores: DataFrame, matched: DataFrame) -> DataFrame:
    """Scores with those of matched events set to 0."""
    hit = matched.select(F.col("id").alias("event_id"), F.lit(True).alias("_hit")).distinct()
    return scores.join(hit, "event_id", "left").withColumn("score", F.when(F.col("_hit"), 0.0).otherwise(F.col("score"))).drop("_hit")


def applied_retroactively(scores: DataFrame, events: DataFrame, templates: DataFrame, windows: DataFrame, effective: DataFrame, now: Column, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(scores, effective scores) after new templates: matched events score 0, and the last days' windows are worked out anew.

    ``events`` carry acknowledged_at: acknowledged ones count for no window, as before.
    """
    from . import windows as wi

    zeroed = retroactively_zeroed(scores, excluded(events, templates))
    open_events = events.filter("acknowledged_at is null").select(F.col("id").alias("event_id"), "system_id", "timestamp")
    scored = zeroed.filter("score > 0").join(open_events, "event_id").select("system_id", "timestamp", "criterion_id", "score")
    return zeroed, wi.recalculated(windows, effective, scored, now, days)


def ignored(rows: DataFrame, patterns: list[str], columns: tuple[str, ...] = ("host", "source_ip")) -> Column:
    """Whether a pattern matches one of the columns, in either case; invalid patterns are passed over."""
    out = F.lit(False)
    for p in patterns:
        if is_valid(p):
            for c in columns:
                out |= F.coalesce(F.col(c).rlike(f"(?i){p}"), F.lit(False))
    return out


