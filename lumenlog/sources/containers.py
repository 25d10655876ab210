"""Container logs: lines to entries, and entries to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.regexes import strip

#: How an entry's first line begins, and how long its next line may take.
START = r"^(?:\[[A-Za-z0-9]|[A-Z]|[0-9]|\{)"
FLUSH_MS = 2_000
#: What names the collector's own containers.
OWN = ("-backend", "-dashboard", "-log-collector", "fluent-bit", "fluent_bit", "fluentbit")
#: Level words of container logs and the severities they stand for.
LEVELS = {
    "emerg": "emerg", "alert": "alert", "crit": "critical", "critical": "critical", "err": "error", "error": "error", "warning": "warning", "warn": "warning", "notice": "notice", "info": "info", "informational": "info", "debug": "debug", "trace": "debug",
    "0": "emerg", "1": "alert", "2": "critical", "3": "error", "4": "warning", "5": "notice", "6": "info", "7": "debug", "fatal": "emerg", "panic": "emerg", "severe": "critical", "information": "info",
}
#: Numbers of JSON loggers, from which on a severity holds.
NUMBERS = ((60, "emerg"), (50, "error"), (40, "warning"), (30, "info"), (0, "debug"))
LEVEL_KEYS, TEXT_KEYS = ("level", "severity", "loglevel", "lvl"), ("msg", "message", "text")
TIME = r"^\d{4}[/-]\d{2}[/-]\d{2}[T ]\d{2}:\d{2}:\d{2}[.\d]*[+\-Z]?[\d:]*\s*"
ANSI = r"\x1B\[\d*;?\d*;?\d*m"


def container_entries(lines: DataFrame, key: str = "container", time: str = "timestamp", order: str = "seq", flush_ms: int = FLUSH_MS) -> DataFrame:
    """Lines (key, time, seq, message and others) as entries: a line that does not begin one joins the entry before it.

    An entry ends at a line that begins one, or where the next line comes later than ``flush_ms``. It has
    the columns of its first line, whatever that is; null messages are empty lines; lines of one time are
    in the order of seq, a null time comes first. Windows read a container's lines in order, one at a time.
    """
    w = W.partitionBy(key).orderBy(time, order)
    text = F.coalesce("message", F.lit(""))
    late = F.unix_millis(time) - F.unix_millis(F.lag(time).over(w)) > flush_ms
    begins = text.rlike(START) | F.coalesce(late, F.lit(False))
    df = lines.withColumns({"_entry": F.sum(begins.cast("int")).over(w), "_line": F.row_number().over(w), "_text": text})
    kept = [c for c in lines.columns if c not in (key, "message")]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "_text"))), lambda x: x["_text"]), "\n")
    out = df.groupBy(key, "_entry").agg(F.min_by(F.struct(*kept), "_line").alias("_first"), joined.alias("message"))
    return out.select(key, "_first.*", "message")


def level_of(word: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), word)


def first_of(text: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that occurs in a text."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def json_level(text: Column) -> Column:
    low = F.lower(text)
    number = F.regexp_extract(text, r'"level"\s*:\s*(\d{1,9})', 1)
    value = F.nullif(number, F.lit("")).cast("long")
    by_number = F.coalesce(*[F.when(value >= n, F.lit(name)) for n, name in NUMBERS])
    return F.coalesce(level_of(first_of(low, [rf'"{k}"\s*:\s*"([^"]+)"' for k in LEVEL_KEYS])), by_number)


def text_level(text: Column) -> Column:
    """The first bracketed word if it is a level, else level=, lvl= or severity=."""
    low = F.lower(text)
    return F.coalesce(level_of(F.regexp_extract(low, r"\[([a-z]+)\]", 1)), level_of(first_of(low, [rf"{k}=([a-z]+)" for k in ("level", "lvl", "severity")])))


def cleaned(text: Column) -> Column:
    """Without a leading time, colours, and white space at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(text, TIME, ""), ANSI, ""))


def enriched(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Container log rows (log_path, stream, log or message, and others) with program, facility, severity and message.

    Rows without a path pass as they are, those of another path lose only it. The program is the name that
    ``names`` (container_id, name) gives, if it is a plausible one, else the id's first 12 characters; rows of
    the collector's own containers and those without text go. A JSON text gives level and message; else the
    text itself gives the level, and standard error means error. Severities that nothing gives stay null.
    """
    have = rows.columns
    col = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    df = rows.withColumns({"_id": F.nullif(F.regexp_extract(col("log_path"), r"/containers/([0-9A-Fa-f]+)/", 1), F.lit("")), "_text": F.coalesce(col("log"), col("message"), F.lit(""))})
    if names is not None:
        plain = F.regexp_replace("name", "^/", "")
        one = names.groupBy(F.col("container_id").alias("_id")).agg(F.min(F.when(plain.rlike(r"^[A-Za-z0-9._/-]+\z") & (F.length(plain) < 200), plain)).alias("_name"))
        df = df.join(one, "_id", "left")
    else:
        df = df.withColumn("_name", F.lit(None).cast("string"))
    own = F.col("_id").isNotNull()
    program = F.coalesce("_name", F.substring("_id", 1, 12))
    df = df.withColumn("_program", program)
    ours = F.lit(False)
    for part in OWN:
        ours |= F.lower("_program").contains(part)
    text = F.col("_text")
    json = text.rlike(r"(?s)^\s*\{.*\}")
    inner = F.when(json, first_of(text, [rf'"{k}"\s*:\s*"([^"]*)"' for k in TEXT_KEYS]))
    df = df.withColumn("_message", cleaned(F.coalesce(inner, text))).withColumn("_level", F.coalesce(F.when(json, json_level(text)), text_level(text), F.when(col("stream") == "stderr", "error")))
    df = df.filter(~own | (~ours & (F.col("_message") != "")))
    out = {
        "program": F.when(own, F.col("_program")).otherwise(col("program")), "facility": F.when(own, "daemon").otherwise(col("facility")), "severity": F.coalesce(F.when(own, F.col("_level")), col("severity")),
        "message": F.when(own, F.col("_message")).otherwise(F.coalesce(col("message"), col("log"))),
    }
    return df.withColumns(out).drop("_id", "_text", "_name", "_program", "_message", "_level", "log", "log_path", "stream")


def container_records(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``enriched`` rows with a column record, as ingest reads it."""
    df = enriched(rows, names)
    fields = [c for c in ("timestamp", "message", "severity", "program", "facility", "host") if c in df.columns]
    return df.withColumn("record", F.to_json(F.struct(*fields, F.lit("docker").alias("collector"))))
