"""Best-fit packing by a configuration linear program.

Only the histogram of piece lengths is packed on the driver: its size is the sequence length, however
many pieces there are. Multiplicative weights solve the configuration LP, with a knapsack dynamic
program as pricing oracle; the fractional pattern counts are rounded down and what is left is packed
best-fit decreasing, again as counts. The plan says which ranks of which length go to which run of
sequences; tasks look their pieces up in it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import CHUNK_BYTES, chunks, documents, stored, texts

CAPACITY = 2048
END = 0
#: Rounds of the multiplicative weights, patterns used in each, and how near to the best price they must be.
ROUNDS, PATTERNS, NEAR_BEST = 400, 256, 0.02
#: The rate at which weights fall with the share covered.
RATE = 1.0
#: A pattern priced lower than this below the best dual's full price is not rounded, and this share of the others is left to best fit, which fills gaps with it.
TIGHT, RESERVE = 1e-9, 0.1
#: A size with fewer pieces left leaves the pricing.
LEAST_LEFT = 0.5
#: Rows of one length that a task puts in order.
RANK_ROWS = 50_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken: the same ids, several times faster.

    The file's vocabulary lists merged tokens in merge order, so its ids serve as ranks. Its added
    tokens are special tokens here: ``encode_ordinary`` splits their strings, ``ids_of`` does not.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocabulary, added = file["model"]["vocab"], {t["content"]: t["id"] for t in file["added_tokens"]}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in file["added_tokens"]):
        raise ValueError("added tokens that take more than their own string are not supported")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(shown[c] for c in token): i for token, i in vocabulary.items() if all(c in shown for c in token) and not token.startswith("<|")}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def ids_of(path: str):
    """Ids of a text as tokenizers gives them without add_special_tokens: an added token's string is its id."""
    own = encoder(path)
    marks = tuple(own.special_tokens_set)
    # Texts without a mark, nearly all, need no search for special tokens.
    return lambda text: own.encode(text, allowed_special="all") if any(m in text for m in marks) else own.encode_ordinary(text)


def pieces_of(ids: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else cut with a shorter first piece."""
    n = len(ids)
    first = n % capacity or capacity
    edges = [0, *range(first, n + 1, capacity)]
    return list(zip(edges, np.diff(edges).tolist(), strict=False))


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece: a narrow step over whole texts."""

    def run(batches):
        encode = ids_of(path)
        for batch in batches:
            for part in chunks(batch, most=CHUNK_BYTES // 4):
                rows: list[list] = [[], [], [], [], []]
                for doc, text in zip(part.column("doc_id").to_pylist(), texts(part), strict=True):
                    ids = encode(text)
                    ids.append(END)
                    raw = np.asarray(ids, dtype="<u4")
                    for k, (start, n) in enumerate(pieces_of(ids, capacity)):
                        for column, value in zip(rows, (doc, k, start, n, zlib.crc32(raw[start : start + n].tobytes())), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest price of a multiset of sizes within each space, and the size taken there (-1: none), by dynamic programming."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, dtype=int)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]), capacity + 1):
        k = fitting[c]
        gain = value[c - sizes[:k]] + prices[:k]
        j = k - 1 - int(gain[::-1].argmax())  # of equally dear sizes the largest, which leaves the small ones to fill gaps
        if gain[j] > value[c - 1]:
            value[c], choice[c] = gain[j], j
        else:
            value[c] = value[c - 1]
    return value, choice


def pattern_of(sizes: np.ndarray, choice: np.ndarray, first: int, capacity: int) -> Counter:
    """The best pattern that holds size number ``first``."""
    pattern, c = Counter([first]), capacity - int(sizes[first])
    while c >= sizes[0]:
        if (j := int(choice[c])) < 0:
            c -= 1
        else:
            pattern[j] += 1
            c -= int(sizes[j])
    return pattern


@dataclass(frozen=True)
class Fractional:
    """A fractional solution of the configuration LP: patterns (size: times) with how often each is used, the share of all tokens they cover, and the best dual found: a price for each size and the lower bound on sequences that it proves."""

    patterns: list[tuple[Counter, float]]
    covered: float
    bound: float
    dual: dict[int, float]


def solve(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> Fractional:
    """Multiplicative weights on the configuration LP: cover every size as often as it occurs with the fewest patterns.

    Each size has a weight. A round prices the sizes by weight over count and asks the knapsack for the patterns of
    greatest price. Prices divided by the best pattern's price are feasible for the dual, so their sum over all
    pieces is a lower bound. Patterns priced within NEAR_BEST of the best are used, each as often as its scarcest
    size allows, and the weights of what they cover are multiplied by exp(-RATE * share covered). No size is covered more
    often than it occurs; a covered one leaves the pricing.
    """
    sizes = np.array(sorted(histogram), dtype=int)
    if not len(sizes):
        return Fractional([], 1.0, 0.0, {})
    counts = np.array([histogram[s] for s in sizes], dtype=float)
    left = counts.copy()
    # Weights begin at the dual of the plain area bound.
    weights = counts * sizes / capacity
    used: dict[tuple, float] = {}
    bound, dual = 0.0, {}
    for _ in range(rounds):
        live = np.flatnonzero(left > LEAST_LEFT)
        if not len(live):
            break
        own, prices = sizes[live], weights[live] / counts[live]
        value, choice = knapsack(own, prices, capacity)
        if (proven := float((prices * counts[live]).sum() / value[capacity])) > bound:
            bound, dual = proven, dict(zip(own.tolist(), (prices / value[capacity]).tolist(), strict=True))
        with_size = prices + value[capacity - own]
        near = np.flatnonzero(with_size >= (1 - NEAR_BEST) * value[capacity])
        near = near[np.argsort(-(left[live] * own)[near], kind="stable")][:PATTERNS]
        for j in near.tolist():
            pattern = pattern_of(own, choice, j, capacity)
            at, times = live[list(pattern)], np.array(list(pattern.values()), dtype=float)
            step = float((left[at] / times).min())
            if step <= 0:
                continue
            key = tuple(sorted((int(sizes[i]), int(k)) for i, k in zip(at, times, strict=True)))
            used[key] = used.get(key, 0.0) + step
            left[at] = np.maximum(left[at] - step * times, 0.0)
            weights[at] *= np.exp(-RATE * step * times / counts[at])
    covered = 1 - float((left * sizes).sum() / (counts * sizes).sum())
    return Fractional([(Counter(dict(k)), x) for k, x in used.items()], covered, bound, dual)


def rounded(solution: Fractional) -> list[tuple[Counter, int]]:
    """Whole numbers of patterns, rounded down, so that no size is used more often than it occurs.

    By complementary slackness an optimum holds only patterns whose price under the best dual is full; the others are not kept.
    """
    price = lambda p: sum(solution.dual.get(s, 0.0) * k for s, k in p.items())
    return [(p, n) for p, x in solution.patterns if price(p) >= 1 - TIGHT and (n := int(x * (1 - RESERVE) + 1e-9))]


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over counts: equal bins are one entry, so a size takes few steps however often it occurs."""
    free: list[int] = []  # sorted, distinct
    bins: dict[int, list[list]] = {}  # free space -> [contents, count]
    done: list[tuple[list[int], int]] = []

    def put(contents: list[int], count: int) -> None:
        space = capacity - sum(contents)
        if space not in bins:
            insort(free, space)
            bins[space] = []
        bins[space].append([contents, count])

    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            k = bisect_left(free, size)
            if k == len(free):
                per = capacity // size
                if n >= per:
                    put([size] * per, n // per)
                    n %= per
                else:
                    put([size] * n, 1)
                    n = 0
                continue
            space = free[k]
            contents, count = bins[space].pop()
            if not bins[space]:
                del bins[space]
                free.pop(k)
            take = min(n, count)
            if count > take:
                put(contents, count - take)
            put([*contents, size], take)
            n -= take
    for entries in bins.values():
        done += [(contents, count) for contents, count in entries]
    return done


@dataclass(frozen=True)
class Plan:
    """Runs of ranks of each length: from rank ``first`` on, sequences from ``sequence`` on, at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = np.int64(1) << 40
        k = np.searchsorted(self.length * wide + self.first, length * wide + rank, side="right") - 1
        return self.sequence[k] + (rank - self.first[k]), self.offset[k]


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for a histogram of lengths from 1 to ``capacity``."""
    chosen = rounded(solve(histogram, capacity))
    rest = Counter(histogram)
    bins: list[tuple[list[int], int]] = []
    for pattern, n in chosen:
        bins.append(([s for s, k in sorted(pattern.items(), reverse=True) for _ in range(k)], n))
        for s, k in pattern.items():
            rest[s] -= k * n
    sequences = lambda plan: sum(n for _, n in plan)
    # The rounded LP with what it leaves packed best fit holds unless best fit alone needs fewer sequences.
    final = min((bins + best_fit({s: n for s, n in rest.items() if n}, capacity), best_fit(histogram, capacity)), key=sequences)
    next_rank: Counter = Counter()
    rows, sequence = [], 0
    for contents, n in final:
        offset = 0
        for s in contents:
            rows.append((s, next_rank[s], sequence, offset))
            next_rank[s] += n
            offset += s
        sequence += n
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
    return Plan(*columns, sequence)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty
    text is the end token alone; repeated rows are packed once each; an empty table gives no rows.
    Texts of any length are cut into pieces; rows that repeat a doc_id are packed by their own texts; pieces of one
    length are interchangeable and ties are ordered by doc_id, piece and checksum; other columns are ignored.
    The driver sees the counts of lengths, at most ``capacity`` numbers.
    """
    pieces = stored(tokenized(docs, path or vocabulary_path(), capacity), "pieces")
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    plan = pack_histogram({r["length"]: r["n"] for r in counted}, capacity)
    # Ranks inside a length: buckets by hash bound what one task orders; their counts give the offsets.
    buckets = max(1, -(-max((r["n"] for r in counted), default=0) // RANK_ROWS))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    keys = ["length", "bucket"]
    ahead = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).select(*keys, F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("rank0"))
    inside = W.partitionBy(*keys).orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("i", F.row_number().over(inside) - 1).join(offsets, keys).withColumn("rank", F.col("rank0") + F.col("i"))

    def place(batches):
        for b in batches:
            number = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
            sequence, offset = plan.place(number("length"), number("rank"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    wanted = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return wanted.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
