"""Partitions, orphans, snapshots and compaction."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import Folder, stored
from . import events as ev


def months_ahead(today: date, n: int = 3) -> list[str]:
    """This month and the next n, as partition values."""
    first = today.year * 12 + today.month - 1
    return [f"{(first + i) // 12:04d}-{(first + i) % 12 + 1:02d}" for i in range(n + 1)]


def expired_months(months: list[str], cutoff: date) -> list[str]:
    """Partitions that end before or at the cutoff and can be dropped whole."""
    return [m for m in months if months_ahead(date(int(m[:4]), int(m[5:7]), 1), 1)[1] + "-01" <= cutoff.isoformat()]


def apply_retention(spark: SparkSession, path: str, systems: DataFrame, now: datetime, days: int = 90) -> tuple[list[str], list[str]]:
    """Deletes from a table by event_month what ``events.retained`` would not keep: (months dropped, months rewritten).

    Months older than the longest retention of all systems go as folders, unread. Months that some
    system's limit lies in or behind are rewritten where they lose rows, by dynamic partition overwrite;
    newer ones are not touched. Events of unknown systems go with the months that are rewritten.
    """
    folder = Folder(spark, path)
    months = [n.split("=", 1)[1] for n in folder.names() if n.startswith("event_month=")]
    least, most = systems.agg(F.min(F.coalesce("retention_days", F.lit(days))), F.max(F.coalesce("retention_days", F.lit(days)))).head()
    if most is None:
        return [], []
    gone = expired_months(months, (now - timedelta(days=most)).date())
    for m in gone:
        folder.drop(f"event_month={m}")
    edge = [m for m in months if m not in gone and m <= (now - timedelta(days=least)).strftime("%Y-%m")]
    if not edge:
        return gone, []
    old = spark.read.parquet(path).filter(F.col("event_month").isin(edge))
    kept = stored(ev.retained(old, systems, F.lit(now).cast("timestamp"), days), "retained")
    before = {r["event_month"]: r["count"] for r in old.groupBy("event_month").count().collect()}
    after = {r["event_month"]: r["count"] for r in kept.groupBy("event_month").count().collect()}
    changed = [m for m in edge if after.get(m, 0) < before.get(m, 0)]
    if some := [m for m in changed if after.get(m)]:
        kept.filter(F.col("event_month").isin(some)).repartition("event_month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_month").parquet(path)
    for m in changed:
        if not after.get(m):
            folder.drop(f"event_month={m}")
    return sorted({*gone, *(m for m in changed if not after.get(m))}), some


def orphan_templates(templates: DataFrame, events: DataFrame) -> DataFrame:
    """Templates no event refers to."""
    used = events.select(F.col("template_id").alias("pattern_hash")).distinct()
    return templates.join(used, "pattern_hash", "left_anti")


def compact(spark: SparkSession, source: str, target: str, rows_per_file: int = 2_000_000) -> None:
    """Rewrites a table of small files, sorted so that row groups can be skipped by system and time."""
    df = spark.read.parquet(source)
    df.repartition("event_month").sortWithinPartitions("system_id", "timestamp").write.option("maxRecordsPerFile", rows_per_file).partitionBy("event_month").parquet(target)


def snapshot(tables: dict[str, DataFrame], path: str, label: str) -> None:
    """A copy of every table under one label."""
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{path}/{label}/{name}")


def kept_labels(labels: list[str], n: int = 7) -> list[str]:
    """The newest n snapshot labels; labels sort by time."""
    return sorted(labels, reverse=True)[:n]
