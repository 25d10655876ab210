"""Deduplication of findings against a plain greedy loop, similar pairs and links against brute force, with copies and empty texts."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumenlog.functions import severity as sev
from lumenlog.operators import findings as fi, pairs

SCHEMA = "system_id long, seq long, id long, batch long, text string, severity string, criterion_slug string, status string"


def plain_jaccard(a, b):
    a, b = set(a), set(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def greedy(batch, opened, threshold, most_new):
    """One system's batch and open findings, rows as dicts with tokens and fingerprint."""
    rank = lambda s: sev.FINDING_RANKS.get(s, 1)
    fit = lambda x, y: not x or not y or x == y
    out, kept = [], []
    for r in batch:
        for i, k in enumerate(kept):
            if fit(r["criterion_slug"], k["criterion_slug"]) and plain_jaccard(r["tokens"], k["tokens"]) >= threshold:
                if rank(r["severity"]) > rank(k["severity"]):
                    out.append((k["seq"], "duplicate", None, None))
                    kept[i] = r
                else:
                    out.append((r["seq"], "duplicate", None, None))
                break
        else:
            kept.append(r)
    df = Counter(t for o in opened for t in set(o["tokens"]))

    def vector(tokens):
        return {t: n / len(tokens) * (math.log((len(opened) + 1) / (1 + df[t])) + 1 if t in df else 1.0) for t, n in Counter(tokens).items()}

    def cosine(x, y):
        size = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
        return round(sum(v * y.get(t, 0.0) for t, v in x.items()) / size, 12) if size else 0.0

    vectors, taken, fresh = [vector(o["tokens"]) for o in opened], set(), []
    for r in kept:
        match = next((o for o in opened if o["fingerprint"] == r["fingerprint"] and fit(r["criterion_slug"], o["criterion_slug"])), None)
        if match and match["id"] in taken:
            match = None
        if not match and len(opened) >= 3:
            own = vector(r["tokens"])
            score, _, best = max(((cosine(own, v), -o["id"], o) for o, v in zip(opened, vectors, strict=True)), key=lambda x: x[:2])
            if score >= threshold and fit(r["criterion_slug"], best["criterion_slug"]) and best["id"] not in taken:
                match = best
        match = match or next((o for o in opened if o["id"] not in taken and fit(r["criterion_slug"], o["criterion_slug"]) and plain_jaccard(r["tokens"], o["tokens"]) >= threshold), None)
        if match:
            taken.add(match["id"])
            out.append((r["seq"], "update", match["id"], r["severity"] if rank(r["severity"]) > rank(match["severity"]) else None))
        else:
            fresh.append(r)
    for i, r in enumerate(sorted(fresh, key=lambda r: -rank(r["severity"])) if len(fresh) > most_new else fresh):
        out.append((r["seq"], "insert" if i < most_new else "capped", None, None))
    return out


def random_rows(r, n, first):
    texts = [" ".join(r.choice("disk full on node alpha beta gamma delta login failed retry queue 17 lag".split()) for _ in range(r.choice((2, 3, 4, 6)))) for _ in range(n // 3 + 1)] + ["", None, "the of a", "disk full on node alpha"]
    return [(r.randrange(3), first + i, first + i, r.randrange(3), r.choice(texts), r.choice(["critical", "high", "medium", "low", "info", "odd", None]), r.choice(["c0", "c1", "", None]), r.choice(["open", "open", "resolved"])) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_decisions_are_those_of_the_greedy_loop(spark, seed):
    r = random.Random(seed)
    new, opened = random_rows(r, 90, 0), random_rows(r, 120, 1000)
    df = lambda rows: spark.createDataFrame(rows, SCHEMA).repartition(3)
    threshold, most_new = (0.5, 0.6, 0.3, 0.5)[seed], (5, 2, 3, 50)[seed]
    got = Counter(tuple(x) for x in fi.deduplicated(df(new), df(opened), threshold, most_new).collect())
    told = lambda rows: [x.asDict() for x in fi.fingerprinted(df(rows)).orderBy("seq").collect()]
    for rows in (a := told(new)), (b := [x for x in told(opened) if x["status"] == "open"]):
        for x in rows:
            x["tokens"] = x["tokens"] or []
    batches = defaultdict(list)
    for x in a:
        batches[x["system_id"], x["batch"]].append(x)
    expected = Counter((s, *d) for (s, _), rows in batches.items() for d in greedy(rows, [o for o in b if o["system_id"] == s], threshold, most_new))
    assert got == expected and {d[2] for d in got} >= {"insert", "update", "duplicate"}


def test_no_findings(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, 1, 1, 0, "disk full", "high", None, "open")], SCHEMA)
    assert fi.deduplicated(empty, some).collect() == []
    assert [tuple(r) for r in fi.deduplicated(some, empty).collect()] == [(1, 1, "insert", None, None)]


@pytest.mark.parametrize("block", [6000, 5])
def test_links_and_pairs_of_copies(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    r = random.Random(block)
    rows = [(i % 2, i, r.choice([[], None, ["a", "b", "c"], ["a", "b", "d"], ["x"], [r.choice("abcdefgh") for _ in range(5)]])) for i in range(80)]
    terms = pairs.token_terms(spark.createDataFrame(rows, "system_id long, id long, tokens array<string>"))
    expected = {}
    for s, i, x in rows:
        for t, j, y in rows:
            if s == t and i < j and x and y and plain_jaccard(x, y) >= 0.4:
                expected[s, i, j] = plain_jaccard(x, y)
    assert {(p["system_id"], p["a_id"], p["b_id"]): p["similarity"] for p in pairs.similar_members(terms, 0.4).collect()} == pytest.approx(expected)
    counts = Counter(x for s, i, j in expected for x in ((s, i), (s, j)))
    first = {}
    for s, i, x in rows:
        first.setdefault((s, frozenset(x or ())), i)
    sizes = Counter((s, frozenset(x or ())) for s, _, x in rows)
    got = {(p["system_id"], p["id"]): (p["class_id"], p["copies"], p["links"]) for p in pairs.similar_counts(terms, 0.4).collect()}
    assert got == {(s, i): (first[s, frozenset(x or ())], sizes[s, frozenset(x or ())], counts[s, i]) for s, i, x in rows}


def words_of(text, least=4):
    return {w for w in re.split("[^a-z0-9]+", (text or "").lower()) if len(w) >= least}


@pytest.mark.parametrize("least", [0.5, 0.3, 1.0])
def test_acknowledged_findings_against_brute_force(spark, least):
    r = random.Random(5)
    text = lambda: r.choice(["", None, "a b", *[" ".join(r.choice("disk full node alpha beta gamma delta login failed retry queue 1700 lag".split()) for _ in range(r.choice((1, 3, 5, 8)))) for _ in range(9)]])
    found, said = [(i % 2, i, text(), r.choice(["open", "open", "resolved"])) for i in range(80)], [(r.randrange(2), text()) for _ in range(12)]
    got = fi.acknowledged_by(spark.createDataFrame(found, "system_id long, id long, text string, status string"), spark.createDataFrame(said, "system_id long, message string"), least)
    expected = [i for s, i, t, status in found if status == "open" and (w := words_of(t)) and any(s == z and len(w & words_of(m)) / len(w) >= least for z, m in said)]
    assert sorted(x["id"] for x in got.collect()) == expected and 0 < len(expected) < 80


def shuffled(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_acknowledged_findings_do_not_meet_by_common_words(spark):
    common = " ".join(f"common{i}" for i in range(40))
    rows = [(1, i, f"{common} own{i:05}", "open") for i in range(600)]
    df = spark.createDataFrame(rows, "system_id long, id long, text string, status string")
    before = shuffled(spark)
    assert fi.acknowledged_by(df, df.select("system_id", F.col("text").alias("message"))).count() == 600
    # 600 x 600 pairs by 40 common words; a finding's own text is enough.
    assert shuffled(spark) - before < 10 * 600
