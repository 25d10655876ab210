"""Packed ids against the plain tokenizers call, and the plan against best fit."""

import random
import zlib
from collections import Counter

from lumenlog.llm import packing


def test_ids_are_those_of_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "x  <|endoftext|>\n\n y", "<|endoftext", "<|ENDOFTEXT|>", "naïve 日本 🎉", "", None]
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, packing.END] for x in texts]
    assert ids[0] == [64, 220, 50256, 275, packing.END]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in rows} == {i: (len(x), zlib.crc32(b"".join(y.to_bytes(4, "little") for y in x))) for i, x in enumerate(ids)}


def test_plan_is_never_worse_than_best_fit():
    r = random.Random(9)
    for _ in range(60):
        capacity = r.choice([20, 64, 200])
        histogram = dict(Counter(r.randint(max(1, capacity // r.choice([3, 5, 20])), capacity) for _ in range(r.choice([10, 100, 1000]))))
        plan = packing.pack_histogram(histogram, capacity)
        assert plan.sequences <= sum(n for _, n in packing.best_fit(histogram, capacity))
        used, pieces = Counter(), Counter()
        for size, n in histogram.items():
            for rank in range(n):
                sequence, offset = plan.place(packing.np.array([size]), packing.np.array([rank]))
                assert 0 <= offset[0] and offset[0] + size <= capacity
                used[int(sequence[0])] += size
                pieces[size] += 1
        assert max(used.values()) <= capacity and len(used) == plan.sequences and pieces == histogram


def test_linear_program():
    """The fractional solution covers no size more often than it occurs, its bound holds, and rounding keeps most of it."""
    r = random.Random(4)
    histogram = dict(Counter(min(2048, max(1, int(r.lognormvariate(5.5, 1.1)))) for _ in range(20000)))
    solution = packing.solve(histogram, 2048)
    used = Counter()
    for pattern, x in solution.patterns:
        assert x > 0 and sum(s * k for s, k in pattern.items()) <= 2048
        for s, k in pattern.items():
            used[s] += k * x
    assert all(used[s] <= histogram[s] + 1e-6 for s in used) and solution.covered > 0.95
    area = sum(s * n for s, n in histogram.items()) / 2048
    plan = packing.pack_histogram(histogram)
    assert area - 1e-6 <= solution.bound <= plan.sequences <= solution.bound * 1.005 + 1
    assert sum(n for _, n in packing.rounded(solution)) > 0.5 * plan.sequences


def test_known_optimum():
    """Where every size fits with one other only, the bound is exact and the plan meets it."""
    histogram = {70: 40, 30: 40, 55: 20, 45: 20, 100: 5}
    solution = packing.solve(histogram, 100)
    assert abs(solution.bound - 65) < 1e-6 and packing.pack_histogram(histogram, 100).sequences == 65


def test_repeated_ids_and_long_texts(spark):
    rows = [(1, "a b c"), (1, "other text here"), (1, "a b c"), (2, "word " * 6000), (None, "x"), (3, None)]
    out = packing.pack_documents(spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, length int, bucket int")).collect()
    assert sum(r["doc_id"] == 1 for r in out) == 3 and sum(r["doc_id"] is None for r in out) == 1
    long = sorted((r["piece"], r["start"], r["length"]) for r in out if r["doc_id"] == 2)
    assert long[-1][1] + long[-1][2] >= 6000 and all(r[2] == 2048 for r in long[1:]) and [r[0] for r in long] == list(range(len(long)))
    used = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert used.get(r["sequence_id"], 0) == r["offset"]
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 2048 and len(used) == 3
