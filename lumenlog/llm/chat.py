"""Chat formatting of reply trees.

Messages form trees by parent. Iterative self-joins double each message's reach: after k rounds every
message knows its ancestor 2**k above and the score of the way there, so a tree of depth d takes
log2(d) joins. Leaves then stand for root-to-leaf paths and are ranked by their path's score; only
chosen leaves are expanded into paths, by the same joins, and each path becomes one conversation.

The template writes a turn as ``### role: text</turn>`` and a line feed. Inside roles and texts a
backslash goes before every backslash, ``#``, ``<`` and ``:`` of a role, so no text can hold a mark,
and dropping backslashes gives it back.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import checkpointed, chunks

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.S)
ESCAPE = re.compile(r"\\(.)", re.S)
LEARNT_ROLE = "assistant"


def escaped(text: Column, more: str = "") -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"([\\#<{more}])", r"\\$1")


def unescaped(text: str) -> str:
    return ESCAPE.sub(r"\1", text)


def branches(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every root-to-leaf path of every tree (tree, leaf, depth in messages, score, rank with 1 as the best), and the hops.

    ``messages``: tree, node, parent (null or unknown: a root), score (null: 0). A path's score is the
    mean of its messages' scores; ties go to the longer path, then to the smaller leaf.
    """
    m = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = m.select("tree", F.col("node").alias("parent"), F.lit(True).alias("is_known"))
    up = checkpointed(m.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("is_known"), F.col("parent")).alias("above"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("sum")))
    parents = up.filter("above is not null").select("tree", F.col("above").alias("node")).distinct()
    leaves = up.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"))
    # Only messages whose root is farther away take part in the next round.
    done, hops = up.filter("above is null"), [up.filter("above is not null")]
    while not (now := hops[-1]).isEmpty():
        top = done.unionByName(now).select("tree", F.col("node").alias("above"), F.col("above").alias("next"), F.col("depth").alias("more"), F.col("sum").alias("plus"))
        joined = checkpointed(now.join(top, ["tree", "above"]).select("tree", "node", F.col("next").alias("above"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("sum") + F.col("plus")).alias("sum")))
        done = done.unionByName(joined.filter("above is null"))
        hops.append(joined.filter("above is not null"))
        if len(hops) > 40:
            raise ValueError("the parents form a cycle")
    whole = done.select("tree", F.col("node").alias("leaf"), "depth", (F.col("sum") / F.col("depth")).alias("score"))
    best = W.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "leaf")
    return whole.join(leaves, ["tree", "leaf"]).withColumn("rank", F.row_number().over(best)), hops


def paths(chosen: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """tree, leaf, node, height (0: the leaf) of all messages on the chosen leaves' paths: each join with a longer hop doubles a path."""
    found = chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("height"))
    for k, hop in enumerate(hops[:-1]):
        step = hop.select("tree", "node", "above")
        more = found.join(step, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("height") + (1 << k)).alias("height"))
        found = checkpointed(found.unionByName(more))
    return found


def format_trees(messages: DataFrame, most_branches: int = 1) -> DataFrame:
    """One conversation for each of a tree's best branches: tree, branch (rank), leaf, formatted.

    ``messages``: tree, node, parent, role, text, score. Null roles and texts are empty; messages without
    a tree are one tree, those without a node are left out; a message whose parent is unknown begins a
    tree of its own path. Nodes of a tree must differ: of rows repeated under one node each takes its turn
    on every path through it. Other columns are ignored; an empty table gives no conversation. A
    conversation is one row, so its messages meet in one task, as its text must.
    """
    kind = dict(messages.dtypes)["tree"]
    # A null tree is a key of its own, so that joins keep it.
    messages = messages.filter("node is not null").withColumn("tree", F.concat(F.when(F.col("tree").isNull(), "-").otherwise("="), F.coalesce(F.col("tree").cast("string"), F.lit(""))))
    ranked, hops = branches(messages)
    chosen = checkpointed(ranked.filter(F.col("rank") <= most_branches))
    # Ranks join the narrow paths, so that texts move once to their place and once to their conversation.
    on_path = paths(chosen, hops).join(chosen.select("tree", "leaf", "rank"), ["tree", "leaf"])
    said = messages.select("tree", "node", F.concat(F.lit(OPEN), escaped(F.col("role"), ":"), F.lit(MIDDLE), escaped(F.col("text")), F.lit(CLOSE)).alias("turn"))
    turns = on_path.join(said, ["tree", "node"]).groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct((-F.col("height")).alias("at"), "turn"))).alias("turns"))
    tree = F.when(F.col("tree").startswith("="), F.substring("tree", 2, 1 << 30)).cast(kind)
    return turns.select(tree.alias("tree"), F.col("rank").alias("branch"), "leaf", F.array_join(F.col("turns.turn"), "").alias("formatted"))


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end are the text's place in the formatted string."""
    found, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        found.append((unescaped(m[1]), unescaped(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return found


def loss_spans(formatted: str, role: str = LEARNT_ROLE) -> list[tuple[int, int]]:
    """Where the formatted string is learnt from: the texts of ``role``, without marks."""
    return [(a, b) for r, _, a, b in read_back(formatted) if r == role]


READ = StructType(
    [StructField("tree", LongType()), StructField("n_turns", LongType()), StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())]
    + [StructField("loss_spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])))]
)


def digests(conversations: DataFrame) -> DataFrame:
    """What reading each formatted string back gives: turns, the text under the loss mask, and the mask."""

    def run(batches):
        for batch in (part for whole in batches for part in chunks(whole, "formatted")):
            rows = []
            for formatted in batch.column("formatted").to_pylist():
                turns = read_back(formatted)
                whole = "".join(f"{r}\n{t}\n" for r, t, _, _ in turns)
                spans = loss_spans(formatted)
                learnt = "".join(unescaped(formatted[a:b]) for a, b in spans)
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                rows.append((len(turns), sha(whole), len(learnt), sha(learnt), len(formatted), [{"start": a, "end": b} for a, b in spans]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), span)
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), *columns], names=READ.names)

    return conversations.select(F.col("tree").cast("long").alias("tree"), "formatted").mapInArrow(run, READ)


def as_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each row's parent is the row before it.

    Rows are in the order of turn, ties in that of role and text; a null turn comes first. Rows without a
    conv_id are one conversation.
    """
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    c = conversations.select(F.col("conv_id").cast("long").alias("tree"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return c.withColumn("node", F.row_number().over(order).cast("long")).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length("text").cast("double").alias("score"))


def planted(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Conversation -7, whose texts hold the template's own marks."""
    said = "\\### Assistant: </turn> ok"
    rows = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return own.unionByName(rows)


def format_digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    trees = checkpointed(as_trees(planted(spark, conversations)))
    found = digests(format_trees(trees))
    return found.select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
