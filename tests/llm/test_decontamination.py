"""Decontamination against brute force over every window, with moved, inserted and deleted words."""

import random
import re
from collections import Counter

import pytest

from lumenlog.llm import decontaminate

DOCS = "doc_id long, text string, item_id int, start int, w string"


def words(text):
    return [w for w in re.split(r"[^a-z0-9]+", (text or "").lower()) if w]


def grams(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items):
    """The best similarity of each (doc, item) over all windows, where it reaches the threshold."""
    best = {}
    for doc, text in docs:
        w = words(text)
        for item, other in items:
            o = words(other)
            if not o:
                continue
            k = min(len(o), 5)
            own = grams(o, k)
            for start in range(max(len(w) - len(o), 0) + 1):
                window = grams(w[start : start + len(o)], k)
                shared = sum((own & window).values())
                s = shared / max(sum(own.values()) + sum(window.values()) - shared, 1)
                if s >= 0.8 and s > best.get((doc, item), 0):
                    best[doc, item] = s
    return best


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(4000)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, some(n)) for i, n in enumerate([100, 100, 64, 64, 40, 25, 16, 5, 3, 1])]
    items.append((10, ["again", "and"] * 12))  # the same shingles over and over
    docs = []
    for _, w in items:
        for _ in range(6):
            copy = list(w)
            change = r.randrange(5)
            if change == 0 and len(copy) > 3:
                cut = r.randrange(len(copy) // 3 + 1)
                copy = copy[cut:] + copy[:cut]
            elif change == 1:
                copy.insert(r.randrange(len(copy)), "new")
            elif change == 2 and len(copy) > 8:
                del copy[r.randrange(len(copy))]
            elif change == 3 and len(copy) > 8:
                copy[r.randrange(len(copy))] = "other"
            docs.append(" ".join(some(r.randrange(40)) + copy + some(r.randrange(40))))
    docs += [" ".join(some(200)) for _ in range(10)]
    return list(enumerate(docs)), [(i, " ".join(w)) for i, w in items]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_window(spark, seed):
    docs, items = corpus(seed)
    expected = brute(docs, items)
    table = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], DOCS)
    found = decontaminate.leaks(table, spark.createDataFrame(items, "item_id int, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found}
    assert set(got) <= set(expected)
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    assert len(got) >= 0.97 * len(expected) > 40


def test_rotated_item(spark):
    w = [f"q{i}" for i in range(100)]
    docs = [(k, " ".join(w[k:] + w[:k])) for k in (10, 15, 20, 30)]
    expected = brute(docs, [(1, " ".join(w))])
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(w))], "item_id int, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 4) for r in found} == {k: round(v, 4) for k, v in expected.items()}
    assert len(found) == 4 and all(r["similarity"] > 0.91 for r in found)


def test_edges(spark):
    item = " ".join(f"q{i}" for i in range(30))
    moved = "before it " + item + " after it"
    docs = [(1, moved), (1, moved), (1, "other text"), (None, item), (4, None), (5, ""), (6, "  ... "), (7, "x " * 30000 + item)]
    table = spark.createDataFrame([(i, t, 0, 0, "x") for i, t in docs], DOCS)
    items = spark.createDataFrame([(9, item), (9, item), (None, "no id here at all"), (11, None), (12, "...")], "item_id int, text string")
    found = sorted(((r["doc_id"] or 0), r["item_id"], r["start_word"], r["n_words"], r["similarity"]) for r in decontaminate.leaks(table, items).collect())
    assert found == [(0, 9, 0, 30, 1.0), (1, 9, 2, 30, 1.0), (7, 9, 30000, 30, 1.0)]
    kept = decontaminate.decontaminated(table, items)
    assert kept.columns == table.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, "other text"), (4, None), (5, ""), (6, "  ... ")], key=str)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id int, text string")
    full = spark.createDataFrame([(1, "a b c d e f", 0, 0, "x")], DOCS)
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id int, text string")
    assert decontaminate.leaks(docs, some).collect() == decontaminate.leaks(full, items).collect() == []
    assert decontaminate.decontaminated(full, items).count() == 1


def test_recall_of_the_radius(spark):
    """Of windows just above the threshold, the hardest, the radius loses few."""
    r = random.Random(8)
    item = [f"q{i}" for i in range(100)]
    docs = []
    for i in range(300):
        copy = list(item)
        for at in r.sample(range(5, 95), 2):
            copy[at] = f"n{i}x{at}"
        docs.append((i, " ".join(copy)))
    expected = brute(docs, [(1, " ".join(item))])
    assert 0.8 <= sorted(expected.values())[len(expected) // 2] < 0.84
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")).count()
    assert found >= 0.98 * len(expected) and len(expected) > 250
