"""Reassembly of messages that arrived line by line. Rows carry ``seq``, their order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.timefix import second_key

MOST_LINES = 20
#: Lines that one task sorts, on average.
TASK_LINES = 200_000
HEADER = r"^\[(\d+)-(\d+)\]\s*"
#: The prefix of a database log line, its levels, and the order in which details follow a head.
PREFIX = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\.\d+\s+\w+\s+\[(\d+)\]\s+\S+\s+(ERROR|WARNING|LOG|FATAL|PANIC|DETAIL|HINT|CONTEXT|STATEMENT|QUERY):\s"
HEADS = ("ERROR", "WARNING", "LOG", "FATAL", "PANIC")
#: How a line begins that stands for itself.
ALONE = r"(?i)^\s*(?:\[?(?:ERROR|WARN|WARNING|INFO|NOTICE|DEBUG|FATAL|PANIC|CRITICAL|TRACE|ALERT|EMERG)\]?\s*[:\-–—⚠❌ ]|(?:\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4})\s)"
DETAILS = ("DETAIL", "HINT", "CONTEXT", "STATEMENT", "QUERY")


def decoded(c: Column) -> Column:
    """Octal escapes of syslog for tab and line feed."""
    return F.replace(F.replace(c, F.lit("#011"), F.lit("\t")), F.lit("#012"), F.lit("\n"))


def some(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


#: How a line begins that continues another, whatever its length; those that do only when short, with the length below which they do; and the end of a quoted piece of data.
CONTINUES = (r"^\s+", r"^[{}),\]:]", r"^at\s+", r"^\.\.\.\s*\d+\s+", r"^['\"][^'\"]{1,60}['\"]\s*:")
CONTINUES_SHORT = ((r"^[a-zA-Z_]+:\s", 80), (r"^[-+~|*#]\s", 200))
QUOTED, QUOTED_END, COMMA_BELOW = r"^['\"]", r"[,\]})]\z", 60


def is_fragment(message: Column) -> Column:
    """Whether a line continues another: indented or bracketed lines, stack frames, short ``key: value`` lines, pieces of data structures, list items."""
    end = F.regexp_replace(message, r"\s+\z", "")
    head = message.rlike(ALONE)
    yes = (message.rlike(QUOTED) & end.rlike(QUOTED_END)) | ((F.length(end) < COMMA_BELOW) & end.endswith(","))
    for pattern in CONTINUES:
        yes |= message.rlike(pattern)
    for pattern, below in CONTINUES_SHORT:
        yes |= message.rlike(pattern) & (F.length(message) < below)
    return ~head & yes


def merged(df: DataFrame, keys: list[str], head: Column, order: str) -> DataFrame:
    """One row for each key: the head's columns with the lines of all rows joined in order. Rows of a key share a second or a session line."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), "seq", "line"))), lambda x: x["line"]), "\n")
    kept = [c for c in df.columns if c not in (*(k for k in keys if k.startswith("_")), "line", "message", "seq")]
    first = F.min_by(F.struct("seq", *kept), F.struct(F.when(head, 0).otherwise(1), F.col(order), "seq"))
    return df.groupBy(*keys).agg(first.alias("_h"), lines.alias("message")).select("_h.*", "message")


def dealt(df: DataFrame, group: list[str]) -> DataFrame:
    """Rows shuffled once by their group, into more tasks where there are more rows: the windows and sums by group after it need no other shuffle, and what a task sorts does not grow with the table."""
    n = -(-df.count() // TASK_LINES)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *group)


def by_header(rows: DataFrame, time: str = "timestamp", reach_s: int = 60) -> tuple[DataFrame, DataFrame]:
    """(merged, other rows): lines headed ``[N-M]`` of one host, program and N, that came together.

    Lines came together in one ``batch``, where rows have that column, and with no more than ``reach_s``
    between one and the next, where they have a time: senders count N from 1 again.
    The head M=1 takes 2, 3 and so on up to the first gap; later lines stay alone without their header.
    Without a head all lines of the group become one.
    """
    own = rows.filter(F.coalesce(F.col("message").rlike(HEADER), F.lit(False)))
    rest = rows.filter(~F.coalesce(F.col("message").rlike(HEADER), F.lit(False)))
    names = rows.columns
    group = ["_host", "_program", "_n", *(["batch"] if "batch" in names else [])]
    df = own.withColumns({"_host": some("host"), "_program": some("program"), "_n": F.regexp_extract("message", HEADER, 1), "_m": F.regexp_extract("message", HEADER, 2).cast("int"), "line": decoded(F.regexp_replace("message", HEADER, ""))})
    df = dealt(df, group)
    if dict(rows.dtypes).get(time, "").startswith("timestamp"):
        came = W.partitionBy(*group).orderBy(time, "seq")
        late = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(came).cast("timestamp")) > reach_s * 1_000_000
        df = df.withColumn("_run", F.sum(F.coalesce(late, F.lit(False)).cast("int")).over(came))
        group = [*group, "_run"]
    order = W.partitionBy(*group).orderBy("_m", "seq")
    df = df.withColumns({"_has_head": F.max((F.col("_m") == 1).cast("int")).over(W.partitionBy(*group)) == 1, "_same": F.row_number().over(W.partitionBy(*group, "_m").orderBy("seq"))})
    # The first line of each M counts; as long as M equals its place among those, nothing is missing.
    place = F.sum((F.col("_same") == 1).cast("int")).over(order)
    joins = ~F.col("_has_head") | ((F.col("_same") == 1) & (F.col("_m") == F.col("_place")) & (F.col("_m") >= 1))
    df = df.withColumn("_place", place - F.max((F.col("_m") == 0).cast("int")).over(W.partitionBy(*group))).withColumn("_joins", joins)
    df = df.withColumn("_part", F.when(F.col("_joins"), F.lit(-1).cast("long")).otherwise(F.col("seq").cast("long")))
    out = merged(df.drop("_has_head", "_same", "_place", "_joins"), [*group, "_part"], F.col("_m") == 1, "_m")
    return out.select(*names), rest


def by_prefix(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, other rows): database lines of one host, program, process and second; details follow the first head. Further heads pass."""
    names = rows.columns
    has = F.coalesce(F.col("message").rlike(PREFIX), F.lit(False))
    group = ["_host", "_program", "_pid", "_second"]
    df = rows.filter(has).withColumns({"_host": some("host"), "_program": some("program"), "_pid": F.regexp_extract("message", PREFIX, 2), "_second": F.regexp_extract("message", PREFIX, 1), "_level": F.regexp_extract("message", PREFIX, 3)})
    df = dealt(df, group)
    rank = F.array_position(F.array(*[F.lit(d) for d in DETAILS]), F.col("_level")).cast("int")
    first = F.min(F.when(F.col("_level").isin(*HEADS), F.col("seq"))).over(W.partitionBy(*group))
    df = df.withColumns({"_first": first, "_rank": rank})
    part_of = F.col("_first").isNotNull() & ((F.col("seq") == F.col("_first")) | (F.col("_rank") > 0))
    df = df.withColumn("_in", part_of).withColumn("line", F.col("message"))
    touched = merged(df.filter("_in").drop("_in", "_first", "_level"), group, F.col("_rank") == 0, "_rank")
    alone = df.filter("not _in").select(*names)
    return touched.select(*names), rows.filter(~has).select(*names).unionByName(alone)


def by_second(rows: DataFrame, time: str = "timestamp") -> DataFrame:
    """Fragments of one host, program and second join the head before them, up to 20 lines; those before the first head go before it.

    Where a second has no head, lines stay alone.
    """
    names = rows.columns
    group = ["_host", "_program", "_second"]
    df = rows.withColumns({"_host": some("host"), "_program": some("program"), "_second": second_key(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss") if dict(rows.dtypes)[time].startswith("timestamp") else F.col(time)), "_head": ~is_fragment(F.col("message"))})
    df = dealt(df, group)
    df = df.withColumn("_segment", F.sum(F.col("_head").cast("int")).over(W.partitionBy(*group).orderBy("seq")))
    df = df.withColumn("_heads", F.max("_segment").over(W.partitionBy(*group)))
    inside = F.row_number().over(W.partitionBy(*group, "_segment").orderBy("seq"))
    df = df.withColumn("_at", inside)
    # In a segment with its head the head is line 1; before the first head all lines are fragments.
    fits = (F.col("_heads") > 0) & F.when(F.col("_segment") == 0, F.col("_at") < MOST_LINES).otherwise(F.col("_at") <= MOST_LINES)
    df = df.withColumns({"_part": F.when(fits, F.greatest("_segment", F.lit(1)).cast("long")).otherwise(-1 - F.col("seq").cast("long")), "line": F.col("message")})
    out = merged(df.drop("_segment", "_heads", "_at"), [*group, "_part"], F.col("_head"), "seq")
    return out.select(*names)


def reassembled(rows: DataFrame, time: str = "timestamp") -> DataFrame:
    """All three ways in turn. Rows need seq, host, program, message and a time; rows without a message pass unchanged."""
    empty = rows.filter(F.coalesce(F.col("message") == "", F.lit(True)))
    headed, rest = by_header(rows.filter("message != ''"))
    prefixed, rest = by_prefix(rest)
    # Lines of the second way that passed alone are no fragments, so the third way leaves them whole.
    return headed.unionByName(prefixed).unionByName(by_second(rest, time)).unionByName(empty)
