"""Session settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: AQE joins small partitions and splits skewed ones at run time; session times are UTC.
CONF = {
    "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf) -> SparkSession:
    """A session with CONF; shuffle partitions and memory are left to the cluster."""
    b = SparkSession.builder.config(map=CONF | {k.replace("__", "."): v for k, v in conf.items()})
    return (b.master(master) if master else b).getOrCreate()
