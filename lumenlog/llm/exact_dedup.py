"""Exact duplicates of texts, with the frequent ones split off.

A Misra-Gries summary finds the digests that may make up more than 1 / (COUNTERS + 1) of all rows; a
second pass counts them exactly and names their winners. Those few rows are broadcast, so that copies of
frequent texts are told, or removed, where they stand. The rest, of which no group is larger than that
share, is shuffled by digest as usual, texts left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: Counters of a summary: at most so many digests are ever broadcast.
COUNTERS = 1_000
#: Tasks that merge the summaries of all partitions before the last one merges theirs.
MERGERS = 64


def digest_of(text: Column) -> Column:
    """The 32 bytes of the sha256 of a text's UTF-8; null is empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def summary(counts: dict[bytes, int], more: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """Misra-Gries: adds counts, then takes the first count beyond the counters off all and drops what is used up."""
    for digest, n in more.items():
        counts[digest] = counts.get(digest, 0) + n
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {digest: n - cut for digest, n in counts.items() if n > cut}


def summarised(digests: DataFrame, counters: int) -> DataFrame:
    """One summary (digest, n) a partition of rows (digest, n). Each task holds its counters and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by("digest").aggregate([("n", "sum")])
            counts = summary(counts, dict(zip(sums["digest"].to_pylist(), sums["n_sum"].to_pylist(), strict=True)), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "n"])

    return digests.select("digest", "n").mapInArrow(run, "digest binary, n long")


def frequent_candidates(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests, among them all that make up more than 1 / (counters + 1) of the rows.

    Summaries may be merged in any order with the same guarantee, so partitions merge into MERGERS
    tasks, and those, of a fixed number of rows, into one.
    """
    own = summarised(digests.select("digest", F.lit(1).cast("long").alias("n")), counters)
    merged = summarised(own.repartition(MERGERS), counters)
    return summarised(merged.repartition(1), counters).select("digest")


def winners(rows: DataFrame) -> DataFrame:
    """digest, winner (doc_id and row of the copy that stays) and group_size of rows (doc_id, digest, row)."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("winner"), F.count(F.lit(1)).alias("group_size"))


def frequent(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The winners of all digests that make up more than 1 / (counters + 1) of the rows, exactly counted: at most ``counters`` rows."""
    n = rows.count()
    near = F.broadcast(frequent_candidates(rows, counters))  # at most ``counters`` rows
    return winners(rows.join(near, "digest", "left_semi")).filter((F.col("group_size") > 1) & (F.col("group_size") > n // (counters + 1)))


def copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row a document: doc_id, keep_id (the largest doc_id with its text), group_size, kept, text_sha256.

    A null text is empty and equal to the empty one. Rows that repeat doc_id and text are copies of each
    other of which one is kept. A null doc_id is below all others, so such a row stays only where no copy
    has an id; its keep_id is then null. Texts of any length are hashed whole; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "digests")  # row numbers are fixed from here on
    often = stored(frequent(rows, counters), "frequent")
    few = F.broadcast(often)  # at most ``counters`` rows
    told = rows.join(few, "digest")
    rest = rows.join(F.broadcast(often.select("digest")), "digest", "left_anti")
    told = told.unionByName(rest.join(winners(rest), "digest"))
    kept = F.col("winner.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("winner.row") == F.col("row"))
    return told.select("doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The documents, with all their columns, of which the row with the largest doc_id of each text stays.

    Losing copies of frequent texts are removed map-side, before anything is shuffled; the rest meets by
    digest. Rows that repeat doc_id and text leave one, as ``copies`` says for nulls too.
    """
    own = F.col("doc_id").cast("long")
    rows = stored(docs.select(own.alias("doc_id"), digest_of(F.col("text")).alias("digest"), F.lit(0).cast("long").alias("row")), "digests")
    few = stored(frequent(rows, counters), "frequent").select("digest", F.col("winner.doc_id").alias("winner_id"), F.lit(True).alias("often"))
    # The document is one struct, so that no column of it can clash with those used here.
    whole = docs.select(own.alias("doc_id"), digest_of(F.col("text")).alias("digest"), F.struct("*").alias("doc"))
    left = whole.join(F.broadcast(few), "digest", "left").filter(F.col("often").isNull() | F.col("winner_id").eqNullSafe(F.col("doc_id")))  # at most ``counters`` rows
    # What is left has no group beyond 1 / (counters + 1) of the rows but rows repeated whole, which fold map-side.
    return left.groupBy("digest").agg(F.max_by("doc", F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("doc")).select("doc.*")
