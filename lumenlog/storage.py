"""Tables in the shared folder: intermediate results, and keyed tables whose batches rewrite only what they touch."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

#: Spark's setting that shuffle files of a query are removed when it ends, not when the driver next collects garbage.
FORGET = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without one gets a temporary folder, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lumenlog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: worked out once, without lineage; its shuffle files are removed."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FORGET, "false")
    spark.conf.set(FORGET, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FORGET, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes what ``stored`` has written; nothing may read it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        above, name = path.rsplit("/", 1)
        Folder(df.sparkSession, above).drop(name)


def numbered(rows: DataFrame, order: Sequence[str], name: str = "place") -> DataFrame:
    """Stored rows with their place (from 0) in an order of all of them: dealt into ranges, ranked range by range, moved on by the ranges before."""
    ranged = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    offsets, start = [], 0
    for r in sorted(ranged.groupBy("_range").count().collect()):  # a row a partition
        offsets.append((r["_range"], start))
        start += r["count"]
    before = rows.sparkSession.createDataFrame(offsets, "_range int, _before long")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn(name, rank.cast("long")).join(before, "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


class Folder:
    """A folder of whichever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path)) if self.fs.exists(self.path) else []

    def drop(self, name: str) -> None:
        self.fs.delete(self._path(self.path, name), True)

    def files(self) -> dict[str, int]:
        """All files below, by relative path, with their modification times."""
        out, top = {}, self.path.toUri().getPath().rstrip("/") + "/"
        if self.fs.exists(self.path):
            each = self.fs.listFiles(self.path, True)
            while each.hasNext():
                f = each.next()
                out[f.getPath().toUri().getPath().removeprefix(top)] = f.getModificationTime()
        return out

    def read(self, name: str) -> str | None:
        at = self._path(self.path, name)
        if not self.fs.exists(at):
            return None
        with_stream = self.fs.open(at)
        try:
            return bytes(with_stream.readAllBytes()).decode()
        finally:
            with_stream.close()

    def swap(self, name: str, text: str) -> None:
        """Writes a small file whole under another name and moves it into place."""
        self.fs.mkdirs(self.path)
        new = self._path(self.path, f".{name}.{uuid.uuid4().hex}")
        out = self.fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        old = self._path(self.path, name)
        if not self.fs.rename(new, old):
            self.fs.delete(old, False)
            self.fs.rename(new, old)


class KeyedTable:
    """Rows by key, in a fixed number of buckets; a batch rewrites only the buckets that its keys fall into.

    Each write puts whole new bucket folders beside the old ones and then swaps a manifest (bucket, folder)
    in one move: readers see a batch whole or not at all, and a batch that failed leaves only folders that
    no manifest names. One writer at a time, as with one stream or one scheduled job.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.folder = Folder(spark, path)

    def manifest(self) -> dict[int, str]:
        text = self.folder.read("manifest") or ""
        return {int(b): f for b, f in (line.split("\t") for line in text.splitlines())}

    def _read(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._read(sorted(self.manifest().values()))

    def upsert(self, rows: DataFrame, combine: dict | None = None) -> list[int]:
        """Puts rows (one for each key) into the table and gives the buckets rewritten.

        A row replaces that of its key; ``combine`` says otherwise by column: a function of the old and the
        new column, both of which may be null where there is no such row.
        """
        combine = combine or {}
        names = self.schema.names
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = stored(rows.select(*names).withColumn("_bucket", bucket), "upsert")
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return []
        now = self.manifest()
        old = self._read([now[b] for b in touched if b in now]).alias("old")
        same = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in self.keys]
        on = same[0]
        for c in same[1:]:
            on &= c
        marked, fresh = old.withColumn("_old", F.lit(True)).alias("old"), new.withColumn("_new", F.lit(True)).alias("new")
        both = marked.join(fresh, on, "full_outer")

        def value(c: str):
            a, b = F.col(f"old.{c}"), F.col(f"new.{c}")
            if c in combine:
                return combine[c](a, b)
            return F.when(F.col("_new"), b).otherwise(a)

        out = both.select(*[value(c).cast(self.schema[c].dataType).alias(c) for c in names]).withColumn("_bucket", bucket)
        version = uuid.uuid4().hex
        out.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{version}")
        written = {int(f.split("=")[1]): f"{version}/{f}" for f in Folder(self.spark, f"{self.path}/{version}").names() if f.startswith("_bucket=")}
        gone = [now[b] for b in written if b in now]
        self.folder.swap("manifest", "".join(f"{b}\t{f}\n" for b, f in sorted((now | written).items())))
        for f in gone:
            self.folder.drop(f)
        return touched
