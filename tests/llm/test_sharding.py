"""Sharding: the laws against plain counts, and what propagation gains over none."""

import random
import zlib
from collections import Counter

import pytest

from lumenlog.llm import sharding

DOCS = "doc_id long, text string, label int, rank int, group string"


def cut(rows, texts):
    shards = {}
    for r in rows:
        shards.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    return sum(len(s) > 1 for s in shards.values())


def table(spark, texts):
    return spark.createDataFrame([(i, t, 5, 5, "x") for i, t in enumerate(texts)], DOCS)


def even(rows, texts, shards, law):
    """Contract columns, gapless slots and even sizes."""
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), law, None)
    sizes = []
    for s in range(shards):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        sizes.append(len(own) if law == "rows" else sum(r["size"] for r in own))
    most = 1 if law == "rows" else shards * max(r["size"] for r in rows)
    assert max(sizes) - min(sizes) <= most


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_rounds_keep_groups_whole(spark, law):
    r = random.Random(2)
    texts = [f"single {i} " + "y" * r.randrange(60) for i in range(900)] + [f"copied {i % 60}" for i in range(480)] + ["", None, None]
    r.shuffle(texts)
    report = []
    with_rounds = sharding.shard_documents(table(spark, texts), 8, law, report=report).collect()
    without = sharding.shard_documents(table(spark, texts), 8, law, rounds=0).collect()
    even(with_rounds, texts, 8, law)
    even(without, texts, 8, law)
    key = dict(enumerate(t or "" for t in texts))
    assert cut(without, key) > 55 and cut(with_rounds, key) <= 2
    assert report[0] > 55 and report[-1] == 0 and report == sorted(report, reverse=True)


def test_quota_parts_a_group_above_a_shard(spark):
    """Half of all rows are copies of one text: four of eight shards hold most of them, and half without rounds."""
    share = lambda rows: sum(n for _, n in Counter(r["shard"] for r in rows if texts[r["doc_id"]] == "the same").most_common(4)) / 800
    texts = ["the same"] * 800 + [f"single {i}" for i in range(700)] + [f"copied {i % 10}" for i in range(100)]
    rows = sharding.shard_documents(table(spark, texts), 8).collect()
    even(rows, texts, 8, "rows")
    assert share(rows) > 0.8
    few = sharding.shard_documents(table(spark, texts), 8, rounds=0).collect()
    assert share(few) < 0.65


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_repeated_rows_ties_and_long_texts(spark, law):
    long = "z" * 2_000_000
    rows = [(1, "a", 0, 0, "x")] * 5 + [(None, "a", 0, 0, "x"), (None, None, 0, 0, "x"), (2, long, 0, 0, "x"), (3, long, 0, 0, "x")]
    out = sharding.shard_documents(spark.createDataFrame(rows, DOCS), 3, law).collect()
    assert len(out) == 9 and sum(r["doc_id"] == 1 for r in out) == 5
    for s in range(3):
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own)))
    assert {r["size"] for r in out if r["doc_id"] in (2, 3)} == {2_000_001}


def test_all_one_text_and_one_row(spark):
    rows = sharding.shard_documents(table(spark, ["same"] * 50), 8).collect()
    even(rows, ["same"] * 50, 8, "rows")
    assert [(r["shard"] in range(8), r["slot"]) for r in sharding.shard_documents(table(spark, ["x"]), 8).collect()] == [(True, 0)]
    with pytest.raises(ValueError):
        sharding.shard_documents(table(spark, ["x"]), 8, "none")
