"""What a task of the Jaccard join holds at once does not grow with its input."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from lumenlog.llm import jaccard_join as jj


def peak_mb(run) -> float:
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_hashing_takes_pieces():
    r = random.Random(1)
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(300)) for _ in range(1200)]
    batch = pa.record_batch({"text": pa.array([*texts, None, ""])})
    sets = list(jj.sets_of(batch))
    alone = [next(jj.sets_of(batch.slice(i, 1))) for i in (0, 700, 1199, 1200, 1201)]
    assert [len(s) for s in sets[-2:]] == [0, 0] and all((sets[i] == s).all() for i, s in zip((0, 700, 1199, 1200, 1201), alone, strict=True))
    # Sets of 2 MB of text take 3 MB.
    assert sum(map(len, texts)) > 1 << 20 and peak_mb(lambda: sum(len(s) for s in jj.sets_of(batch))) < 25


def test_counting_a_range():
    # The shingles of one task, in rows such as tasks send.
    r = np.random.default_rng(1)
    n, pieces = jj.COUNT_ROWS, 8
    rows = []
    for k in range(pieces):
        tokens = np.sort(r.integers(0, n // 3, n // pieces, dtype=np.uint64))
        rows.append(jj.pack(0, tokens, r.integers(0, 2000, len(tokens)), np.arange(2000, dtype=np.uint64) + np.uint64(2000 * k)))
    group = pa.Table.from_batches([jj.packed_batch(rows)])
    assert peak_mb(lambda: jj.counted(0, group, 16)) < 180
