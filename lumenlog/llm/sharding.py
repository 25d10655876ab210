"""Sharding by balanced label propagation, in DataFrame operations only.

Documents are vertices; documents with equal texts are linked. A group of copies is linked through
one hub rather than pair by pair, so a group of n copies has n edges. Labels (target shards) move
along the edges for a few rounds under capacity quotas: in a round each group picks the label that most of
its members have among the shards with room left, its members in smaller parts ask to move there, and a
shard admits requests up to its room. A group that fits no shard fills one and goes on with the next.

Labels then hold but for what stands above a shard's quota, which is levelled: linked documents
keep their shard first, so documents without a link make up the difference, and groups are parted only
where linked documents alone exceed a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import checkpointed

#: Rounds at most; they end when no document asks to move.
ROUNDS = 12
#: A shard with less room than this part of its quota counts as full.
LEAST_ROOM = 0.08
#: A group of copies is at most this many units for each first label, however large it is.
CHUNKS = 64
#: A shard may hold this share above its quota while labels move, so that groups can change places; levelling takes it off.
SLACK = 0.25
#: Priorities by which requests are admitted; the driver sees one sum for each priority and shard.
PRIORITIES = 1024
#: A group above this part of a shard asks unit by unit, a smaller one as a whole.
WHOLE_PART = 1 / 4
#: Rows that one task puts in order.
RANK_ROWS = 50_000


def vertices(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, the group of equal texts, and the first label and chunk of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("group"),
            F.pmod(key, F.lit(shards)).cast("int").alias("first"),
            F.pmod(F.shiftright(key, 20), F.lit(CHUNKS)).cast("int").alias("chunk"),
        )
        .withColumn("group", F.xxhash64("group", "size", "text_crc32"))
    )


def thresholds(asked: list, loads: dict[int, float], cap: float) -> dict[int, int]:
    """For each shard the priority below which it admits requests, so that no shard ends above ``cap`` because of them.

    What leaves a shard makes room in it. All requests are admitted at first; then shards above the
    cap lower their thresholds, which sends load back, until none need to.
    """
    below = dict.fromkeys(loads, PRIORITIES)
    for _ in range(64):
        now, arriving = dict(loads), dict.fromkeys(loads, 0.0)
        for r in asked:
            if r["priority"] < below[r["hub"]]:
                now[r["label"]] -= r["weight"]
                now[r["hub"]] += r["weight"]
                arriving[r["hub"]] += r["weight"]
        over = [s for s in loads if now[s] > cap and arriving[s] > 0]
        if not over:
            break
        for s in over:
            below[s] = int(below[s] * max(0.0, 1 - (now[s] - cap) / arriving[s]))
    return below


def by_shard(values: dict[int, int | float], shard: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), shard)


def sums_of(df: DataFrame, shards: int, key: str = "label", value: str = "weight") -> dict[int, int]:
    """One sum for each shard."""
    found = {r[key]: r["w"] for r in df.groupBy(key).agg(F.sum(value).alias("w")).collect()}
    return {s: found.get(s, 0) for s in range(shards)}


def cut_groups(moving: DataFrame) -> int:
    """Groups that stand in more than one shard."""
    return moving.groupBy("group").agg((F.min("label") != F.max("label")).alias("cut")).filter("cut").count()


def propagated(v: DataFrame, shards: int, weight: str, rounds: int = ROUNDS, report: list[int] | None = None) -> DataFrame:
    """group, first, chunk, members and the label they end with, of the documents that are linked.

    Copies with the same first label and chunk are one unit, so the largest group of copies is
    ``shards * CHUNKS`` rows here. The driver sees sums by shard and priority only. ``report`` gets the
    number of groups in more than one shard before the first round and after each.
    """
    total = F.sum("size") if weight == "bytes" else F.count(F.lit(1))
    units = checkpointed(v.groupBy("group", "first", "chunk").agg(total.alias("weight"), F.count(F.lit(1)).alias("n")))
    cap = (units.agg(F.sum("weight")).first()[0] or 0) / shards
    linked = units.groupBy("group").agg(F.sum("n").alias("members"), F.sum("weight").alias("whole")).filter("members > 1")
    # Documents without a link need no label of their own: they level what the others leave uneven.
    moving = checkpointed(units.join(linked, "group").withColumn("label", F.col("first")))
    asks_whole = F.col("whole") <= cap * WHOLE_PART
    for k in range(rounds):
        if report is not None:
            report.append(cut_groups(moving))
        loads = {s: float(w) for s, w in sums_of(moving, shards).items()}
        parts = moving.groupBy("group", "label").agg(F.sum("weight").alias("w"))
        order = lambda label: F.struct("w", F.xxhash64("group", label))
        # What may still leave a shard makes room in it: only a group's largest part, or one that fills half a shard, takes room for good.
        top = parts.groupBy("group").agg(F.max(F.struct("w", F.xxhash64("group", "label").alias("h"), "label")).alias("top"))
        settled = parts.join(top, "group").filter((F.col("label") == F.col("top.label")) | (F.col("w") > cap / 2))
        room = {s: cap - float(w) for s, w in sums_of(settled, shards, value="w").items()}
        hubs = parts.filter(by_shard(room, F.col("label")) > cap * LEAST_ROOM).groupBy("group").agg(F.max(F.struct("w", F.xxhash64("group", "label").alias("h"), "label")).alias("best"))
        # Members of the hub's part and of larger ones, whose shards are full, stay.
        smaller = parts.join(hubs, "group").filter(order("label") < F.struct("best.w", "best.h")).select("group", "label", F.col("best.label").alias("hub"))
        # Drawn anew in each round, so that what was refused has its turn.
        priority = F.pmod(F.when(asks_whole, F.xxhash64("group", F.lit(k))).otherwise(F.xxhash64("group", "first", "chunk", F.lit(k))), F.lit(PRIORITIES)).cast("int")
        ask = moving.join(smaller, ["group", "label"], "left").withColumn("priority", priority)
        asked = ask.filter("hub is not null").groupBy("label", "hub", "priority").agg(F.sum("weight").alias("weight")).collect()
        if not asked:
            break
        admitted = by_shard(thresholds(asked, loads, cap * (1 + SLACK)), F.col("hub"))
        moving = checkpointed(ask.withColumn("label", F.when(F.col("priority") < admitted, F.col("hub")).otherwise(F.col("label"))).select(*moving.columns))
    if report is not None:
        report.append(cut_groups(moving))
    return moving.select("group", "first", "chunk", "members", "label")


def ranked(labelled: DataFrame, rows: int) -> DataFrame:
    """Adds ``rank`` and ``before`` (bytes before) inside a label: linked documents by group, then those without a link.

    Rows are put in order inside buckets of about RANK_ROWS rows; a large group's units are buckets
    of their own. The buckets' sums, about one row for each RANK_ROWS rows, give the offsets.
    """
    ranges = max(1, -(-rows // RANK_ROWS))
    at = F.floor((F.col("group").cast("double") / F.lit(float(2**64)) + 0.5) * ranges).cast("int")
    large = F.col("members") > RANK_ROWS // 4
    dealt = labelled.withColumn("range", F.least(F.greatest(at, F.lit(0)), F.lit(ranges - 1))).withColumn("part", F.when(large, F.col("first") * CHUNKS + F.col("chunk") + 1).otherwise(0))
    keys = ["label", "alone", "range", "part"]
    sums = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    ahead = W.partitionBy("label").orderBy("alone", "range", "part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("b0"))
    inside = W.partitionBy(*keys).orderBy("group", "doc_id", "text_crc32")
    own = dealt.withColumn("i", F.row_number().over(inside) - 1).withColumn("own", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    return own.join(offsets, keys).select("doc_id", "size", "text_crc32", "label", (F.col("n0") + F.col("i")).alias("rank"), (F.col("b0") + F.col("own")).alias("before"))


def cumulated(values: dict[int, int]) -> dict[int, int]:
    """What stands before each key."""
    out, total = {}, 0
    for s in sorted(values):
        out[s], total = total, total + values[s]
    return out


def levelled(order: DataFrame, shards: int, total: int, at: str, weight: Column) -> DataFrame:
    """Adds ``shard``: the label while its quota lasts; what is above goes, in order, to the shards below theirs.

    ``at``: rows or bytes before a row inside its label, which ``weight`` adds up to. The driver sees one
    sum for each shard.
    """
    quota = {s: total * (s + 1) // shards - total * s // shards for s in range(shards)}
    stays = F.col(at) < by_shard(quota, F.col("label"))
    sums = {(r["label"], r["stays"]): r for r in order.groupBy("label", stays.alias("stays")).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"), F.min(at).alias("from")).collect()}
    part = lambda s, kind, what: sums[s, kind][what] if (s, kind) in sums else 0
    above = cumulated({s: part(s, False, "w") for s in range(shards)})
    lack = {s: max(0, quota[s] - part(s, True, "w")) for s in range(shards)}
    ends = cumulated(lack)
    place = F.col(at) - by_shard({s: part(s, False, "from") for s in range(shards)}, F.col("label")) + by_shard(above, F.col("label"))
    # The last shard that lacks something and begins at this place or before.
    given = F.lit(min((s for s in lack if lack[s]), default=0))
    for s in range(shards):
        if lack[s]:
            given = F.when(place >= ends[s], F.lit(s)).otherwise(given)
    return order.withColumn("stays", stays).withColumn("shard", F.when(F.col("stays"), F.col("label")).otherwise(given).cast("int"))


def slotted(placed: DataFrame, shards: int) -> DataFrame:
    """Adds ``slot``: a shard's own documents in their order, then those sent to it by label and order."""
    counts = {(r["shard"], r["stays"], r["label"]): r for r in placed.groupBy("shard", "stays", "label").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("from")).collect()}
    start = {}
    for s in range(shards):
        at = 0
        # A shard's own rows are a first piece of its label's order, each piece sent to it is one of another's.
        for stays, label in sorted(((k[1], k[2]) for k in counts if k[0] == s), key=lambda x: (not x[0], x[1])):
            r = counts[s, stays, label]
            start[s * shards + label] = at - r["from"]
            at += r["n"]
    if not start:
        return placed.withColumn("slot", F.lit(None).cast("long"))
    return placed.withColumn("slot", (F.col("rank") + by_shard(start, F.col("shard") * shards + F.col("label"))).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 8, law: str = "rows", rounds: int = ROUNDS, report: list[int] | None = None) -> DataFrame:
    """Puts every document into one of ``shards`` shards with sizes kept even; equal texts go together where the law lets them.

    ``law``: ``rows`` (counts differ by one at most) or ``bytes`` (a shard's bytes differ from the
    mean by a few documents at most). Returns doc_id, size, text_crc32, law, shard, slot (gapless from
    0 in each shard), grown_shard (null for these laws) and ``label``, the shard that propagation
    chose before levelling. Null texts count as empty; repeated rows are copies and keep a slot each; texts of any
    length are one row; ties are ordered by doc_id and checksum; an empty table gives no rows; other columns are ignored.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"no such law: {law}")
    v = checkpointed(vertices(docs, shards))
    totals = v.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).first()
    labels = propagated(v, shards, law, rounds, report)
    own = v.join(labels, ["group", "first", "chunk"], "left").withColumn("alone", F.col("label").isNull().cast("int"))
    own = own.withColumn("label", F.coalesce("label", "first")).fillna(0, ["members"])
    order = checkpointed(ranked(own, totals["n"]))
    placed = levelled(order, shards, totals["n"], "rank", F.lit(1)) if law == "rows" else levelled(order, shards, totals["b"] or 0, "before", F.col("size"))
    return slotted(placed, shards).select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "label")
