"""Centroid clustering, conversation repair and exact duplicates against plain versions, with nulls, ties, repeats, empty tables and clashing columns."""

import glob
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lumenlog.llm import clustering, exact_dedup, queries as llm, repair
from tests.test_catalog import plain


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_conversation_repair", "op13_exact_dedup"])
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{f}')")
    found = con.execute(llm.SQL[name])
    columns = [d[0] for d in found.description]
    df = llm.queries()[name](spark, sf_dir)
    assert df.columns == columns
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in found.fetchall())


# Centroid clustering


def plain_clusters(rows, clusters, rounds, size):
    vectors = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(vectors, key=key)[:clusters]]
    for n in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids)) for _, v in vectors]
        if n < rounds:
            for k in range(len(centroids)):
                if own := [v for (_, v), (_, c) in zip(vectors, near, strict=True) if c == k]:
                    centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    parts = Counter()
    for d, k in near if vectors else ():
        parts[k] += d
    return sorted((str(i), k, d, parts[k], sum(parts.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(vectors, near if vectors else (), strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_clusters_are_those_of_a_plain_loop(spark, seed):
    r = random.Random(seed)
    rows = [(i, [r.choice((-1.0, -0.51, 0.0, 0.25, 1.5)) for _ in range(3)]) for i in range(200)]
    rows += [(7, rows[7][1]), (7, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (300, None), (301, [0.0, None, 0.0]), (302, [float("nan")] * 3), (303, [float("inf"), 0.0, 0.0]), (304, [0.0, 0.0]), (305, [])]
    df = spark.createDataFrame([(*x, 5, "c") for x in rows], "vec_id long, embedding array<double>, cluster int, distance string")
    got = clustering.cluster_vectors(df, 6, 3, 3).collect()
    assert sorted((str(x[0]), *x[1:]) for x in got) == plain_clusters(rows, 6, 3, 3)


def test_fewer_vectors_than_clusters_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert clustering.cluster_vectors(spark.createDataFrame([], schema)).collect() == []
    got = clustering.cluster_vectors(spark.createDataFrame([(1, [0.5] * 64, 0), (2, [2.5] * 64, 0)], schema)).collect()
    assert [(r["distance"], r["inertia"]) for r in got] == [(0, 0)] * 2 and len({r["cluster"] for r in got}) == 2


def test_sort_means_stops_early_and_keeps_ties():
    centroids = np.array([[0, 0], [4, 0], [100, 0], [-4, 0]], dtype=np.int64)
    vectors = np.array([[2, 0], [2, 0], [-2, 0], [60, 0]], dtype=np.int64)
    cluster, distance = clustering.nearest(vectors, np.array([1, 0, 3, 0]), centroids)
    assert cluster.tolist() == [0, 0, 0, 2] and distance.tolist() == [4, 4, 4, 1600]


# Conversation repair


def plain_faults(rows):
    """(turn, role, text, fault) of damaged rows in order."""
    seen, out = set(), []
    for turn, role, text in rows:
        last = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", text)
        out.append((turn, role, text, "blank" if not last else "duplicate" if (role, text) in seen else "" if last[1] in ".!?" else "truncated"))
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying every edit letter by letter: states '', s, u, a, and all audits of the least cost."""
    full, follows = {"u": "user", "a": "assistant"}, {"": "su", "s": "u", "u": "a", "a": "u"}
    level = {"": (0, "", ())}

    def inserted(level):
        for _ in range(3):
            for state, (cost, audit, said) in list(level.items()):
                for to in follows[state].replace("s", ""):
                    new = (cost + 5, audit + "I", (*said, f"{full[to]}:"))
                    if to not in level or new < level[to]:
                        level[to] = new
        return level

    for _, role, text, fault in rows:
        after = {}
        for state, (cost, audit, said) in inserted(level).items():
            ways = [(state, cost + 2, "D", said)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for to in follows[state]:
                    if role[:1] == to:
                        ways.append((to, cost + more, "K", (*said, f"{role}:{text}")))
                    if to != "s":
                        ways.append((to, cost + more + 1, "R", (*said, f"{full[to]}:{text}")))
            for to, c, edit, s in ways:
                if to not in after or (c, audit + edit, s) < after[to]:
                    after[to] = (c, audit + edit, s)
        level = after
    level = inserted(level)
    cost, audit, said = min(level[s] for s in ("", "a") if s in level)
    return cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def plain_repair(table):
    groups = {}
    for conv, turn, role, text in table:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, rows in groups.items():
        hurt = []
        for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            hurt += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        rows = plain_faults(hurt)
        turns = [r[0] for r in rows if r[0] is not None]
        n = Counter(r[3] for r in rows)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, *cheapest(rows)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_repairs_are_the_cheapest_of_all(spark, seed):
    r = random.Random(seed)
    texts = ["Ok.", "Ok.", "no end", "yes!", " \t\n", "", None, "Why? \n", "x" * 3000 + ".", "a.b"]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(r.choice((1, 2, 4, 9, 14))):
            rows.append((conv, r.choice((turn, turn, turn, turn + 2, None)), r.choice(("system", "user", "user", "assistant", "assistant", "tool", "", None)), r.choice(texts)))
    rows += rows[:5]
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], "conv_id long, turn long, role string, text string, fault string, gone_by int").repartition(5)
    damaged = repair.damaged(df)
    got = sorted((tuple(x) for x in repair.repaired(damaged).collect()), key=str)
    assert got == plain_repair(rows)
    # The repaired turns themselves give the same digests.
    said = {}
    for x in sorted(repair.repaired_turns(damaged).collect(), key=lambda x: x["step"]):
        said.setdefault(x["conv_id"], []).append(f"{x['role']}:{x['text']}")
    assert {x[0]: x[8] for x in got} == {x[0]: hashlib.sha256("\n".join(said.get(x[0], [])).encode()).hexdigest() for x in got}


def test_repair_of_an_empty_table_and_of_undamaged_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.repaired(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."), (2, 0, "assistant", "Alone.")]
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in repair.repaired(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (0, "KKK"), 2: (2, "D")}


def test_a_long_conversation_takes_linear_time(spark):
    rows = [(1, i, ("user", "assistant")[(i // 3) % 2], f"text {i}" + ("." if i % 7 else "")) for i in range(30_000)]
    got = repair.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()[0]
    assert len(got["audit"].replace("I", "")) == 30_000


# Exact duplicates

COPIES = [(1, "a"), (2, "a"), (2, "a"), (None, "a"), (3, None), (4, ""), (None, "b"), (None, "b"), (5, "A"), (6, "a "), (7, "x" * 200_000), (8, "x" * 200_000)] + [(100 + i, "hot") for i in range(500)] + [(1000 + i, f"t{i}") for i in range(300)]


def plain_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        flags = Counter((i, False) for i in ids)
        flags[(best, False)] -= 1
        flags[(best, True)] += 1
        out += [(i, best, len(ids), k, hashlib.sha256(t.encode()).hexdigest()) for (i, k), n in flags.items() for _ in range(n)]
    return sorted(out, key=str)


@pytest.mark.parametrize("counters", [2, 20, 1000])
def test_copies_whatever_the_number_of_counters(spark, counters):
    df = spark.createDataFrame([(i, t, "d", 1) for i, t in COPIES], "doc_id long, text string, digest string, row int").repartition(7)
    assert sorted((tuple(r) for r in exact_dedup.copies(df, counters).collect()), key=str) == plain_copies(COPIES)
    left = exact_dedup.deduplicated(df, counters)
    assert left.columns == df.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in left.filter("doc_id is not null").collect()) == sorted((r[0], t) for r, t in ((r, next(t or "" for _, t in COPIES if hashlib.sha256((t or "").encode()).hexdigest() == r[4])) for r in plain_copies(COPIES)) if r[3] and r[0] is not None)
    assert left.count() == len({t or "" for _, t in COPIES})


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.copies(empty).collect() == [] and exact_dedup.deduplicated(empty).collect() == []


def test_summaries_keep_every_frequent_digest():
    r = random.Random(5)
    items = [b"hot"] * 300 + [bytes([i % 256, i // 256]) for i in range(700)]
    r.shuffle(items)
    parts = [exact_dedup.summary({}, Counter(items[k : k + 100]), 9) for k in range(0, 1000, 100)]
    whole = {}
    for p in parts:
        whole = exact_dedup.summary(whole, p, 9)
    assert b"hot" in whole and len(whole) <= 9 and 300 - 1000 / 10 <= whole[b"hot"] <= 300


def test_frequent_texts_are_told_without_a_shuffle(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i}") for i in range(3000)], "doc_id long, text string")
    rows = df.select("doc_id", exact_dedup.digest_of(df.text).alias("digest"), df.doc_id.alias("row"))
    found = exact_dedup.frequent(rows, 50).collect()
    assert [(r["winner"]["doc_id"], r["group_size"]) for r in found] == [(2999, 2000)]
