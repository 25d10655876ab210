"""The tries of the Jaccard join find every link, whatever the leaders' rounds found before."""

import random

import pytest

from lumenlog.llm import jaccard_join


def found(spark, rows):
    return {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_tries_alone(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "x"])), (3, " ".join([*words, "y"])), (9, "other words that are not alike at all")]
    whole = found(spark, rows)
    monkeypatch.setattr(jaccard_join, "led", lambda met, sets, seed: met.selectExpr("vertex as a", "vertex as b").limit(0))
    assert found(spark, rows) == whole == {1: 1, 2: 1, 3: 1, 9: 9}


@pytest.mark.parametrize("leaders", [True, False])
def test_split_groups(spark, monkeypatch, leaders):
    """A chain of drifting copies and a large class, in blocks of four sets."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows, now = [], list(base)
    for i in range(40):
        rows.append((i, " ".join(now)))
        now[3 * i % 120] = f"x{i}"
    for i in range(40, 60):
        near = list(base)
        near[r.randrange(60)] = f"y{i}"
        rows.append((i, " ".join(near)))
    whole = found(spark, rows)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    if not leaders:
        monkeypatch.setattr(jaccard_join, "led", lambda met, sets, seed: met.selectExpr("vertex as a", "vertex as b").limit(0))
    assert found(spark, rows) == whole == dict.fromkeys(range(60), 0)


def test_repeated_and_null_ids(spark):
    words = [f"w{i}" for i in range(50)]
    other = [f"v{i}" for i in range(50)]
    near = [*other[:-1], "v"]
    rows = [(1, " ".join(words)), (1, " ".join(other)), (3, " ".join(near)), (None, " ".join(other)), (None, "alone here"), (4, None), (4, None)]
    out = [tuple(r) for r in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(out, key=str) == sorted([(1, 46, 1), (1, 46, 1), (3, 46, 1), (None, 46, 1), (None, 1, None), (4, 0, 4), (4, 0, 4)], key=str)


def test_hot_shingles_and_long_texts(spark):
    """A passage in every text, a third of the rows near copies, and one very long text."""
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{passage} " + " ".join(r.choice(["a", "b", "c"]) + str(r.randrange(500)) for _ in range(25))) for i in range(60)]
    base = [f"n{i}" for i in range(80)]
    for i in range(60, 90):
        copy = list(base)
        copy[i - 60] = f"e{i}"
        rows.append((i, " ".join(copy)))
    rows.append((90, " ".join(f"l{i % 7000}" for i in range(60000))))
    whole = found(spark, rows)
    assert whole == {i: 60 if 60 <= i < 90 else i for i in range(91)}
