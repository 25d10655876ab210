"""Discovery of systems in what no source claims."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import addresses
from ..functions.regexes import escape_regex
from . import normal


def empty_null(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def host_groups(buffer: DataFrame, least: int = 3) -> DataFrame:
    """Buffered rows by host: count, first and last time, distinct addresses and programs."""
    return _groups(buffer.filter("host != ''"), "host", least)


def address_groups(buffer: DataFrame, least: int = 3) -> DataFrame:
    """Buffered rows by address, without addresses that some host already has."""
    known = buffer.filter("host != '' and source_ip != ''").select("source_ip").distinct()
    return _groups(buffer.filter("(host is null or host = '') and source_ip != ''").join(known, "source_ip", "left_anti"), "source_ip", least)


def _groups(rows: DataFrame, key: str, least: int) -> DataFrame:
    kept = lambda c: F.array_sort(F.collect_set(empty_null(c)))
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("received_at").alias("first_seen"), F.max("received_at").alias("last_seen"), kept("source_ip").alias("ips"), kept("program").alias("programs"))
    return out.filter(F.col("n") >= least).withColumn("kind", F.lit(key)).withColumnRenamed(key, "key")


def detailed_groups(buffer: DataFrame, least: int = 3) -> DataFrame:
    """By host, address and program, with the group's key."""
    g = buffer.groupBy(*[F.coalesce(c, F.lit("")).alias(c) for c in ("host", "source_ip", "program")]).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return g.withColumn("group_key", addresses.group_key(F.col("host"), F.col("source_ip"), F.col("program")))


def rate(n: Column, first: Column, last: Column) -> Column:
    """Rows an hour, over an hour at least."""
    return n / F.greatest(F.lit(1.0), (F.unix_micros(last) - F.unix_micros(first)) / 3.6e9)


def samples(buffer: DataFrame, key: str = "host", most: int = 5) -> DataFrame:
    """The newest samples of each key: ranked inside the key, so no group is gathered whole."""
    order = W.partitionBy(key).orderBy(F.desc("received_at"), "id")
    top = buffer.filter(F.col(key) != "").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "sample"))), lambda x: x["sample"]).alias("samples"))


def suggestions(buffer: DataFrame, existing: DataFrame, now: Column, ignore: Sequence[str] = (), least: int = 3, least_rate: float = 0.0, ttl_hours: int = 72) -> DataFrame:
    """Suggested systems: buffered groups that are recent, frequent, not ignored and not dismissed, with a name and samples.

    ``existing``: group_key, status, dismissed_until. Accepted and merged groups and dismissals in force stay out.
    """
    recent = buffer.filter(F.unix_micros("received_at") >= F.unix_micros(now) - ttl_hours * 3_600_000_000)
    recent = recent.filter(~normal.ignored(recent, list(ignore)))
    hosts, ips = host_groups(recent, least), address_groups(recent, least)
    both = hosts.unionByName(ips).filter(rate(F.col("n"), F.col("first_seen"), F.col("last_seen")) >= least_rate)
    one = F.coalesce(addresses.common_prefix(F.col("programs")), F.when(F.size("programs") == 1, F.col("programs")[0]))
    host = F.when(F.col("kind") == "host", F.col("key"))
    ip = F.when(F.col("kind") == "source_ip", F.col("key")).otherwise(F.get(F.col("ips"), F.lit(0)))
    named = both.withColumns({"suggested_name": addresses.suggested_name(host, ip, one), "group_key": addresses.group_key(host, F.when(F.col("kind") == "source_ip", F.col("key")), F.lit(None).cast("string"))})
    closed = existing.filter(F.col("status").isin("accepted", "merged") | ((F.col("status") == "dismissed") & (F.col("dismissed_until").isNull() | (F.col("dismissed_until") > now))))
    named = named.join(closed.select("group_key"), "group_key", "left_anti")
    found = samples(recent, "host").withColumnRenamed("host", "key").withColumn("kind", F.lit("host")).unionByName(samples(recent.filter("host is null or host = ''"), "source_ip").withColumnRenamed("source_ip", "key").withColumn("kind", F.lit("source_ip")))
    return named.join(found, ["kind", "key"], "left")


def selector_for(suggestion: DataFrame) -> DataFrame:
    """An anchored selector for a suggestion's host or address."""
    pattern = F.concat(F.lit("^"), escape_regex(F.col("key")), F.lit("$"))
    return suggestion.withColumn("selector", F.to_json(F.when(F.col("kind") == "host", F.create_map(F.lit("host"), pattern)).otherwise(F.create_map(F.lit("source_ip"), pattern))))


def replayed(buffer: DataFrame, source: Mapping, stored: DataFrame, most: int = 10_000) -> DataFrame:
    """Buffered rows that a new source claims, as events the store has not got yet; the oldest ``most`` of them."""
    from . import events as ev, routing

    rows = buffer.withColumn("message", F.col("sample")).withColumn("timestamp", F.col("received_at"))
    for c in ("service", "facility"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    own = routing.routed(rows, [source]).filter("system_id is not null").orderBy("received_at", "id").limit(most)
    return ev.append_new(stored, own.withColumn("normalized_hash", ev.normalized_hash()))


def purged(buffer: DataFrame, now: Column, ttl_hours: int = 72) -> DataFrame:
    """The buffer without rows older than its time to live."""
    return buffer.filter(F.unix_micros("received_at") >= F.unix_micros(now) - ttl_hours * 3_600_000_000)


def covered(groups: DataFrame, sources: Sequence[Mapping]) -> Column:
    """Whether a source that is no catch-all already claims a group's host or address; invalid patterns claim nothing."""
    from . import routing

    out = F.lit(False)
    for s in sources:
        if not routing.is_catch_all(s["selector"]):
            for group in routing.groups_of(s["selector"]):
                for field, kind in (("host", "host"), ("source_ip", "source_ip")):
                    if (p := group.get(field)) and normal.is_valid(p):
                        out |= (F.col("kind") == kind) & F.coalesce(F.col("key").rlike(f"(?i){p}"), F.lit(False))
    return out


SUGGESTED = ("group_key", "kind", "key", "suggested_name", "n", "first_seen", "last_seen", "programs", "samples")


def refreshed(existing: DataFrame, found: DataFrame, sources: Sequence[Mapping], now: Column) -> DataFrame:
    """The table of suggestions after a run: ``existing`` (SUGGESTED, status, dismissed_until, merge_target_id, updated_at) with ``found`` put in.

    New groups are pending; known ones that are pending, or whose dismissal has ended, take the new counts,
    times and samples and are pending; accepted, merged and dismissed ones stay as they are. Groups that a
    source now covers go unless they were accepted or merged.
    """
    new = found.filter(~covered(found, sources)).select(*SUGGESTED).alias("n")
    old = existing.filter(F.col("status").isin("accepted", "merged") | ~covered(existing, sources)).alias("o")
    both = old.join(new, F.col("o.group_key") == F.col("n.group_key"), "full_outer")
    closed = F.col("o.status").isin("accepted", "merged") | ((F.col("o.status") == "dismissed") & (F.col("o.dismissed_until").isNull() | (F.col("o.dismissed_until") > now)))
    take = F.col("n.group_key").isNotNull() & ~F.coalesce(closed, F.lit(False))
    pick = [F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in SUGGESTED]
    return both.select(*pick, F.when(take, "pending").otherwise(F.col("o.status")).alias("status"), F.when(~take, F.col("o.dismissed_until")).alias("dismissed_until"), F.col("o.merge_target_id").alias("merge_target_id"), F.when(take, now).otherwise(F.col("o.updated_at")).alias("updated_at"))


def merged(suggestions: DataFrame, group_key: str, system_id: int, now: Column, priority: int = 50) -> tuple[DataFrame, DataFrame]:
    """(suggestions, new sources): a pending suggestion joins a system that is there, by a source with an anchored selector."""
    hit = (F.col("group_key") == group_key) & (F.col("status") == "pending")
    own = selector_for(suggestions.filter(hit))
    source = own.select(F.lit(system_id).cast("long").alias("system_id"), F.concat("suggested_name", F.lit(" (auto-discovered)")).alias("label"), "selector", F.lit(priority).alias("priority"), now.alias("created_at"))
    return suggestions.withColumns({"merge_target_id": F.when(hit, F.lit(system_id).cast("long")).otherwise(F.col("merge_target_id")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "status": F.when(hit, "merged").otherwise(F.col("status"))}), source
