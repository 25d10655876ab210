"""N-gram Jaccard join by prefix trees over globally ordered shingle sets.

A document's set holds its distinct word shingles. Shingles are counted over all different sets, and every
set is put in one global order: rarest first. Two sets that reach the threshold share a shingle among the
first few of each (the prefix), and all but few of a set's shingles must occur in other sets, so a set
where they don't is put aside before sets meet.

Sets that share a prefix shingle meet in one group. The ordered sets of a group form a trie: in
lexicographic order, neighbours' common prefixes are its inner nodes. Each set walks the trie of its group
depth-first. A sequence that follows another shares the overlap counted up to their branch, and is left as
soon as the lengths that remain cannot reach the overlap needed. Pairs that are connected already are passed
over and a found link unites at once, so a group of n sets gives at most n - 1 links.

Before that, each set is compared with the one leader it meets most often, which merges most copies;
shingles whose sets are all in one class by then need no trie, and groups with the same smallest set share one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, chunks, documents, stored, text_key

WORDS = 5
#: Linked if PART * intersection >= SIMILAR * union.
SIMILAR, PART = 80, 100
#: Bits by which a shingle is known once sets are counted: a pair of sets of 1,000 shingles is misjudged with a chance below 1e-8.
ID_BITS = 48
#: Shingles that one task counts, and half of which it sends at once; more input makes more ranges.
COUNT_ROWS = 2_000_000
#: A shingle is common if it stands in this part of all documents. Common ones, at most MOST_COMMON, are broadcast, so that no task counts their places.
COMMON_PART, MOST_COMMON = 1024, 1 << 16
#: Counts above this are one level of the order.
MOST_LEVEL = (1 << 15) - 2
#: Sets that one trie holds at most, beside as many that walk it; larger groups are split into blocks.
BLOCK_SETS = 1024
#: Rows of ids up to which they are broadcast to the sets; more are joined by shuffling.
BROADCAST_ROWS = 1_000_000
STEP = 64
#: Text bytes of a piece in which common shingles are looked for, and of a piece hashed at once, which takes some fifty times as much.
CHUNK, HASHED = 2 << 20, 256 << 10

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_random = np.random.default_rng(20_240_229)
BYTE_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
PLACES = _random.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of several texts, and for each text where its words begin (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = LOWER[data]
    solid = ~SPACE[data]
    begins, stops = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    stops[offsets[1:]] = True
    begins[1:n] |= ~solid[:-1]
    stops[1:n] |= ~solid[1:]
    starts = np.flatnonzero(solid & begins[:n])
    ends = np.flatnonzero(solid & stops[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lengths = ends - starts
    powers = np.cumprod(np.full(int(lengths.max()), BASE, np.uint64))
    inside = np.flatnonzero(solid)
    place = inside - np.repeat(starts, lengths)
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    sums = np.add.reduceat(BYTE_VALUES[data[inside]] * powers[place], firsts)
    return mixed(sums ^ lengths.astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The set of each text: sorted distinct 63-bit hashes of 5-word shingles, or of the whole sequence if it is shorter."""
    words, first = word_hashes(data, offsets)
    if len(words) >= WORDS:
        total = np.zeros(len(words) - WORDS + 1, np.uint64)
        for k in range(WORDS):
            total += words[k : len(words) - WORDS + 1 + k] * PLACES[k]
        runs = mixed(total) >> np.uint64(1)
    else:
        runs = np.zeros(0, np.uint64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            yield np.unique(runs[a : b - WORDS + 1])
        elif b > a:
            short = (words[a:b] * PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.array([b - a], np.uint64) * BASE
            yield mixed(short) >> np.uint64(1)
        else:
            yield runs[:0]


def sets_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for part in chunks(batch, most=HASHED):
        column = pc.fill_null(part.column("text").cast(pa.large_binary()), b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        yield from shingle_sets(data, offsets - offsets[0])


def first_of_runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def needed(a: int, b: int) -> int:
    """The least intersection with which sets of a and b shingles are linked."""
    return -(-SIMILAR * (a + b) // (PART + SIMILAR))


def prefix_length(n):
    """How many shingles of a set, first in the order, a linked set must share one of."""
    return n - -(-SIMILAR * n // PART) + 1


def signature(s: np.ndarray) -> int:
    """63 bits that stand for a set: documents with one signature are one vertex."""
    return int(mixed(s).sum(dtype=np.uint64) >> np.uint64(1))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles and vertex (the set's signature) of every document: a narrow step.

    Rows with ``common`` set are no documents: they say that the shingle ``vertex`` stands in ``n_shingles``
    documents of one piece of the table, if that is many of the piece's.
    """

    def run(batches):
        for batch in batches:
            for part in chunks(batch, most=CHUNK):
                sets = list(sets_of(part))
                n = [len(s) for s in sets]
                yield rows_of(part.column("doc_id"), part.column("text_key"), n, [signature(s) for s in sets], [False] * len(sets))
                tokens = np.sort(np.concatenate(sets), kind="stable")
                first = first_of_runs(tokens)
                counts = np.diff(np.append(first, len(tokens)))
                many = np.flatnonzero(counts >= max(16, len(sets) // (COMMON_PART // 4)))
                if len(many):
                    yield rows_of(pa.nulls(len(many), pa.int64()), pa.nulls(len(many), pa.int64()), counts[many], tokens[first[many]].astype(np.int64), [True] * len(many))

    def rows_of(doc, text_key, n, vertex, common):
        return pa.RecordBatch.from_arrays([doc, text_key, pa.array(n, pa.int64()), pa.array(vertex, pa.int64()), pa.array(common, pa.bool_())], names=["doc_id", "text_key", "n_shingles", "vertex", "common"])

    return docs.mapInArrow(run, "doc_id long, text_key long, n_shingles long, vertex long, common boolean")


def planes(values: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bytes, compressed byte plane by byte plane."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def from_planes(data: bytes, width: int) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :width] = flat.T
    return out.view("<u8").ravel()


def pack(key: int, tokens: np.ndarray, who: np.ndarray, vertex: np.ndarray, n: np.ndarray | None = None) -> tuple:
    """A row of places of shingles, in the order of tokens; ``who`` points into vertex and n."""
    used, who = np.unique(who, return_inverse=True)
    return key, planes(np.diff(tokens, prepend=np.uint64(0)), 8), planes(who, 4), vertex[used].astype("<u8").tobytes(), b"" if n is None else n[used].astype("<u4").tobytes()


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, vertices and sizes (0 if not given) of all places in packed rows."""
    tokens, vertices, sizes = [], [], []
    for steps, who, vertex, n in zip(*(table.column(c) for c in PACKED[1:]), strict=True):
        at = from_planes(who.as_py(), 4).astype(np.int64)
        tokens.append(np.cumsum(from_planes(steps.as_py(), 8), dtype=np.uint64))
        vertices.append(np.frombuffer(vertex.as_py(), "<u8")[at])
        sizes.append(np.frombuffer(n.as_py(), "<u4")[at] if len(n.as_py()) else np.zeros(len(at), np.uint32))
    return np.concatenate(tokens), np.concatenate(vertices), np.concatenate(sizes)


PACKED = ("key", "steps", "who", "vertices", "sizes")
PACKED_SCHEMA = "key int, steps binary, who binary, vertices binary, sizes binary"
PACKED_TYPES = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(PACKED_TYPES)], names=PACKED)


def counted(key: int, group: pa.Table, ranges: int) -> pa.Table:
    """The places of one range (or, below 0, of one bucket's common shingles) as keys, packed by their sets' buckets; those of one set only go."""
    token, vertex, n = unpack(group)
    del group
    if key < 0:
        bucket = np.full(len(token), -1 - key, np.int32)
        ordered = (np.uint64(MOST_LEVEL + 1) << np.uint64(ID_BITS)) | token
    else:
        n = None
        order = np.lexsort((vertex, token))
        token, vertex = token[order], vertex[order]
        other = np.concatenate([[True], (token[1:] != token[:-1]) | (vertex[1:] != vertex[:-1])])
        token, vertex = token[other], vertex[other]
        first = first_of_runs(token)
        counts = np.diff(np.append(first, len(token)))
        counts = np.repeat(np.minimum(counts, MOST_LEVEL).astype(np.uint16), counts)
        token, vertex, counts = token[counts > 1], vertex[counts > 1], counts[counts > 1]
        ordered = (counts.astype(np.uint64) << np.uint64(ID_BITS)) | token
        bucket = (mixed(vertex) & np.uint64(ranges - 1)).astype(np.int32)
    del token
    order = np.lexsort((ordered, bucket))
    ordered, bucket = ordered[order], bucket[order]
    names, first_at, who = np.unique(vertex[order], return_index=True, return_inverse=True)
    n = None if n is None else n[order][first_at]
    first = first_of_runs(bucket)
    rows = [pack(int(bucket[a]), ordered[a:b], who[a:b], names, n) for a, b in zip(first, np.append(first[1:], len(bucket)), strict=True)] if len(first) else []
    return pa.Table.from_batches([packed_batch(rows)])


def ordered_sets(docs: DataFrame, total: int, common: np.ndarray) -> DataFrame:
    """vertex, n, keys: the sets that can link at all, with their shared shingles in the global order.

    ``common``: the most common shingles, sorted by how common they are. The others are sent by range to be
    counted, each set once for a piece of the table, and those in more than one set go on to their sets. A key is the
    count (15 bits) and the shingle (48 bits); common shingles come last. Keys are big-endian, so they sort
    as bytes do. Shingles of one set only take no part: they precede all others and match none.
    """
    ranges = max(1, -(-total // COUNT_ROWS))
    bits = max(0, (ranges - 1).bit_length())
    ranges = 1 << bits
    own_bits = np.uint64(ID_BITS - bits)
    sorted_common = np.argsort(common)
    place_of = np.arange(len(common), dtype=np.uint64)[sorted_common]
    tokens_of = common[sorted_common]

    def send(batches):
        held: list[tuple[np.ndarray, int]] = []
        seen: set[int] = set()
        size = 0

        def flush():
            vertex, n = np.array([v for _, v in held], np.uint64), np.array([len(s) for s, _ in held], np.uint32)
            tokens = np.concatenate([s for s, _ in held])
            held.clear()
            who = np.repeat(np.arange(len(n), dtype=np.int32), n)
            # Common shingles need no counting: they go to their sets' bucket, numbered from -1 down, and so does an end mark for each set.
            key, own = np.full(len(n), len(tokens_of), np.uint64), np.arange(len(n), dtype=np.int32)
            if len(tokens_of):
                at = np.minimum(np.searchsorted(tokens_of, tokens), len(tokens_of) - 1)
                hot = tokens_of[at] == tokens
                at = at[hot]
                key, own = np.concatenate([key, place_of[at]]), np.concatenate([own, who[hot]])
                tokens, who = tokens[~hot], who[~hot]
            bucket = (mixed(vertex)[own] & np.uint64(ranges - 1)).astype(np.int64)
            order = np.lexsort((own, key, bucket))
            key, own, bucket = key[order], own[order], bucket[order]
            first = first_of_runs(bucket)
            yield packed_batch([pack(-1 - int(bucket[a]), key[a:b], own[a:b], vertex, n) for a, b in zip(first, np.append(first[1:], len(bucket)), strict=True)])
            del key, own, bucket
            tokens = tokens >> np.uint64(63 - ID_BITS)
            order = np.argsort(tokens)
            tokens, who = tokens[order], who[order]
            edges = np.searchsorted(tokens, np.arange(ranges + 1, dtype=np.uint64) << own_bits)
            yield packed_batch([pack(r, tokens[a:b], who[a:b], vertex) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a])

        for batch in batches:
            for part in chunks(batch, most=CHUNK):
                for s in sets_of(part):
                    if len(s) and (own := signature(s)) not in seen:
                        seen.add(own)
                        held.append((s, own))
                        size += len(s)
                if size > COUNT_ROWS // 2:
                    yield from flush()
                    size, seen = 0, set()
        if held:
            yield from flush()

    def gather(key, group):
        ordered, vertex, n = unpack(group)
        order = np.lexsort((ordered, vertex))
        ordered, vertex, n = ordered[order], vertex[order], n[order]
        other = np.concatenate([[True], (ordered[1:] != ordered[:-1]) | (vertex[1:] != vertex[:-1])])
        ordered, vertex, n = ordered[other], vertex[other], n[other]
        first = first_of_runs(vertex)
        last = np.append(first[1:], len(vertex)) - 1  # the end mark, which carries the size
        n = n[last]
        able = (last - first) * PART >= SIMILAR * n.astype(np.int64)
        data = ordered.astype(">u8")
        keys = [data[a:b].tobytes() for a, b in zip(first[able], last[able], strict=True)]
        return pa.table({"vertex": pa.array(vertex[first[able]].astype(np.int64)), "n": pa.array(n[able].astype(np.int32)), "keys": pa.array(keys, pa.binary())})

    places = docs.mapInArrow(send, PACKED_SCHEMA).groupBy("key").applyInArrow(lambda key, group: counted(key[0].as_py(), group, ranges), PACKED_SCHEMA)
    return places.groupBy("key").applyInArrow(gather, "vertex long, n int, keys binary")


def postings(sets: DataFrame) -> DataFrame:
    """token, vertex, n, rest: the shared shingles in the prefix of each set, and how many of its shared ones follow, itself included."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                tokens, sizes, lengths, rest = [], [], [], []
                for n, data in zip(part.column("n").to_pylist(), part.column("keys").to_pylist(), strict=True):
                    keys = np.frombuffer(data, ">u8")
                    # The n - len(keys) shingles that are not shared come first.
                    keys = keys[: max(0, prefix_length(n) - (n - len(keys)))]
                    tokens.append(keys.astype(np.int64))
                    sizes.append(n)
                    lengths.append(len(keys))
                    rest.append(len(data) // 8 - np.arange(len(keys)))
                if tokens:
                    each = lambda x, t: pa.array(np.repeat(np.array(x), lengths), t)  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens), pa.int64()), each(part.column("vertex").to_pylist(), pa.int64()), each(sizes, pa.int32()), pa.array(np.concatenate(rest), pa.int32())], names=["token", "vertex", "n", "rest"])

    return sets.mapInArrow(run, "token long, vertex long, n int, rest int")


class Trie:
    """Ordered sets in lexicographic order, which is the depth-first order of their trie; ``common[j]`` is the depth of the branch between j - 1 and j."""

    def __init__(self, keys: list[bytes], sizes: list[int]):
        self.order = sorted(range(len(keys)), key=keys.__getitem__)
        self.keys = [np.frombuffer(keys[i], ">u8").astype(np.uint64) for i in self.order]
        self.sizes = np.array([sizes[i] for i in self.order], np.int64)
        self.rest = np.array([len(k) for k in self.keys], np.int64)
        self.common = np.zeros(len(keys), np.int64)
        for j in range(1, len(keys)):
            a, b = self.keys[j - 1], self.keys[j]
            m = min(len(a), len(b))
            differs = np.flatnonzero(a[:m] != b[:m])
            self.common[j] = differs[0] if len(differs) else m

    def walk(self, own: np.ndarray, n: int, among: np.ndarray) -> Iterator[int]:
        """Those of ``among`` (places in the trie, ascending) that are linked with the set ``own`` of n shingles."""
        overlaps = np.zeros(0, np.int64)  # along the path of the sequence walked last
        before = -1
        for j in among.tolist():
            shared = int(self.common[before + 1 : j + 1].min()) if before >= 0 else 0
            overlaps = overlaps[:shared]
            before, depth = j, len(overlaps)
            other, m = self.keys[j], int(self.rest[j])
            need = needed(n, int(self.sizes[j]))
            overlap = int(overlaps[-1]) if depth else 0
            parts = [overlaps]
            while depth < m:
                passed = int(np.searchsorted(own, other[depth - 1], side="right")) if depth else 0
                if overlap + min(m - depth, len(own) - passed) < need:
                    break
                block = other[depth : depth + STEP]
                at = np.minimum(np.searchsorted(own, block), len(own) - 1)
                sums = overlap + np.cumsum(own[at] == block)
                parts.append(sums)
                overlap, depth = int(sums[-1]), depth + len(block)
            overlaps = np.concatenate(parts)
            if overlap >= need:
                yield j


def links_of(table: pa.Table, leader: int | None = None) -> pa.Table:
    """a, b: links between sets of one group that connect classes, at most one for each set.

    ``table``: vertex, n, keys, class and side. Sets of one class are not compared, nor are sets of one side above 0.
    With a ``leader`` only that set walks the trie.
    """
    vertex = table.column("vertex").to_numpy()
    trie = Trie(table.column("keys").to_pylist(), table.column("n").to_pylist())
    vertex, label, side = (x[trie.order] for x in (vertex, table.column("class").to_numpy(), table.column("side").to_numpy()))
    label = label.copy()
    a, b = [], []
    probes = range(len(vertex)) if leader is None else np.flatnonzero(vertex == leader).tolist()
    for i in probes:
        n, rest = int(trie.sizes[i]), int(trie.rest[i])
        near = (PART * np.minimum(trie.sizes, n) >= SIMILAR * np.maximum(trie.sizes, n)) & (label != label[i]) & ((side == 0) | (side != side[i]))
        near &= np.minimum(trie.rest, rest) >= -(-SIMILAR * (trie.sizes + n) // (PART + SIMILAR))
        if leader is None:
            near[: i + 1] = False
        done: set[int] = set()
        for j in trie.walk(trie.keys[i], n, np.flatnonzero(near)):
            if (other := int(label[j])) not in done or leader is not None:
                a.append(vertex[i])
                b.append(vertex[j])
                done.add(other)
        for other in done:
            label[label == other] = label[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def of_sets(members: DataFrame, rows: int, sets: DataFrame) -> DataFrame:
    """``members`` with their sets' sizes and keys; ``rows`` bounds how many there are."""
    return sets.join(F.broadcast(members) if rows <= BROADCAST_ROWS else members, "vertex")


def led(met: DataFrame, sets: DataFrame, seed: int) -> DataFrame:
    """a, b: the links of each set with the leader that it meets on most shingles.

    A shingle has a leader for each range of sizes: the smallest set, or in later rounds a random one. Sets
    follow a leader in another class. A leader with many followers walks their tries in several tasks.
    """
    size = F.floor(F.log("n") / float(np.log(PART / SIMILAR))).cast("int")
    rank = F.col("n").cast("long") if not seed else F.xxhash64("vertex", F.lit(seed))
    own = met.withColumn("size", size)
    leaders = own.groupBy("token", "size").agg(F.min(F.struct(rank.alias("rank"), "vertex", "class")).alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("token", "size", F.col("first.vertex").alias("leader"), F.col("first.class").alias("over"))
    follow = own.join(leaders, ["token", "size"]).filter(F.col("class") != F.col("over")).groupBy("vertex", "leader").agg(F.count(F.lit(1)).alias("m"))
    pairs = stored(follow.groupBy("vertex").agg(F.max_by("leader", F.struct("m", F.xxhash64("leader", F.lit(seed)))).alias("leader")), "followers")
    many = pairs.groupBy("leader").agg(F.expr(f"cast((count(1) - 1) div {BLOCK_SETS} + 1 as int)").alias("blocks"))
    dealt = pairs.join(many, "leader").select("leader", "vertex", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int").alias("block"))
    rows = pairs.count()
    heads = many.select("leader", F.col("leader").alias("vertex"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # For the walk followers are sets of classes of their own, whatever they follow.
    group = of_sets(dealt.unionByName(heads), 2 * rows, sets).select("leader", "block", "vertex", "n", "keys", F.col("vertex").alias("class"), F.lit(0).alias("side"))
    return group.groupBy("leader", "block").applyInArrow(lambda key, table: links_of(table, key[0].as_py()), "a long, b long")


def joined(met: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links that connect all classes whose sets are linked and meet on a shingle.

    Shingles with sets of one class only need nothing. The others are bundled by their smallest vertex, and
    a bundle's sets form one trie, so a set is sent once however many shingles it meets the same sets on.
    A bundle of more than BLOCK_SETS sets is split: members of its largest class into blocks, the others into
    blocks, and each block of the one meets each of the other, as do the blocks of the others among themselves.
    """
    # A partner of a set has 0.8 times its size at least, and at this place a set reaches partners up to 2.25 * rest - n.
    most = (F.col("rest") * (PART + SIMILAR) / SIMILAR - F.col("n")).cast("double")
    least = met.groupBy("token").agg(F.min("n").alias("least"))
    able = met.join(least, "token").filter(most >= F.col("least")).select("token", "vertex", "class")
    by_class = able.groupBy("token", "class").agg(F.min("vertex").alias("v"))
    open_tokens = by_class.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("bundle")).filter("k > 1").select("token", "bundle")
    members = stored(able.join(open_tokens, "token").select("bundle", "vertex", "class").distinct(), "bundles")
    by_bundle = members.groupBy("bundle", "class").agg(F.count(F.lit(1)).alias("c")).groupBy("bundle").agg(F.sum("c").alias("m"), F.max(F.struct("c", "class")).alias("most"))
    blocks = lambda e: F.expr(f"cast((({e}) - 1) div {BLOCK_SETS} + 1 as int)")
    sizes = by_bundle.select("bundle", "m", F.col("most.class").alias("major"), blocks("most.c").alias("b1"), blocks("m - most.c").alias("b2"))
    deal = F.expr(
        f"""case when m <= {BLOCK_SETS} then array(named_struct('i', 0, 'j', 0, 'side', 0))
        when class = major then transform(sequence(0, b2 - 1), q -> named_struct('i', cast(pmod(xxhash64(vertex), b1) as int), 'j', q, 'side', 1))
        else concat(
            transform(sequence(0, b1 - 1), p -> named_struct('i', p, 'j', cast(pmod(xxhash64(vertex), b2) as int), 'side', 2)),
            transform(sequence(0, b2 - 1), q -> named_struct('i', -1 - least(q, cast(pmod(xxhash64(vertex), b2) as int)), 'j', greatest(q, cast(pmod(xxhash64(vertex), b2) as int)), 'side', 0))) end"""
    )
    dealt = stored(members.join(sizes, "bundle").select("bundle", "vertex", "class", F.explode(deal).alias("to")).select("bundle", "to.i", "to.j", "vertex", "class", "to.side"), "dealt")
    group = of_sets(dealt, dealt.count(), sets).select("bundle", "i", "j", "vertex", "n", "keys", "class", "side")
    return group.groupBy("bundle", "i", "j").applyInArrow(lambda _, table: links_of(table), "a long, b long")


def classes(links: DataFrame) -> DataFrame:
    """vertex and class (the smallest vertex it is connected with) of all vertices in ``links`` (a, b).

    Rounds of taking the smallest label among neighbours, then the label's own label. Each round
    aggregates before it shuffles, and is checkpointed.
    """
    both = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.min("b"), F.first("a")).alias("class")))
    while True:
        near = both.join(labels.withColumnRenamed("vertex", "b"), "b").groupBy(F.col("a").alias("vertex")).agg(F.min("class").alias("near"))
        lower = labels.join(near, "vertex").select("vertex", "class", F.least("class", "near").alias("next"))
        jump = labels.select(F.col("vertex").alias("next"), F.col("class").alias("far"))
        moved = checkpointed(lower.join(jump, "next", "left").select("vertex", F.least("next", "far").alias("next"), "class"))
        changed = not moved.filter("next < class").isEmpty()
        labels = moved.select("vertex", F.col("next").alias("class"))
        if not changed:
            return labels


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Two documents are linked if 100 * intersection >= 80 * union of their 5-word shingle sets
    (ASCII letters lower-cased; words are runs of anything but ASCII white space). component_id is the
    smallest doc_id a document reaches by links, itself included. Null, empty and blank texts have empty
    sets and stand alone with their own doc_id. Equal sets are one vertex, so copies are never paired. Rows that
    repeat a doc_id keep a row each and link by their own texts. A null doc_id is never the smallest: the component is null
    only where all its ids are. An empty table gives no rows. Texts of any length are read whole; other columns are ignored.
    """
    known, in_class = classified(docs)
    least = in_class.groupBy("class").agg(F.min("doc_id").alias("component"))
    named = in_class.join(least, "class").select("vertex", "component")
    return known.join(named, "vertex", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near copies: that of the smallest doc_id, then of the smallest hash of its text.

    All columns stay. Texts without words are in no class, so all their rows stay. A null doc_id comes last. Of rows
    that repeat a doc_id with other texts each goes with its own class; of rows that repeat both one stays.
    """
    known, in_class = classified(docs)
    rows = known.filter("n_shingles > 0").join(in_class.select("vertex", "class"), "vertex")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    first = rows.groupBy("class").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("class", "first")
    crowded = stored(rows.join(first, "class").select("doc_id", "text_key", (order == F.col("first")).alias("stays")), "copies")
    gone = crowded.filter("not stays").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    gone = stored(gone, "gone")
    again = crowded.filter("stays").groupBy("doc_id", "text_key").count().filter("count > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    again = stored(again, "repeated")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (text_key() == F.col("_key"))
    # Texts are shuffled only where there are more copies than may be broadcast.
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, same, "left_anti")
    if again.isEmpty():
        return kept
    # Rows repeated whole are rare: only they are shuffled.
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").unionByName(once)


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_key, n_shingles and vertex of every row; vertex, its smallest doc_id and its class of all sets that are not empty."""
    own = documents(docs, text_key().alias("text_key"))
    rows = stored(signatures(own), "signatures")
    known = rows.filter("not common").drop("common")
    totals = known.agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("shingles")).first()
    often = rows.filter("common").groupBy("vertex").agg(F.sum("n_shingles").alias("c")).filter(F.col("c") >= max(16, totals["rows"] // COMMON_PART))
    common = [r["vertex"] for r in often.orderBy(F.desc("c"), "vertex").limit(MOST_COMMON).collect()][::-1]  # MOST_COMMON at most
    sets = stored(ordered_sets(own, totals["shingles"] or 0, np.array(common, np.uint64)), "sets")
    met = stored(postings(sets), "postings")

    links, labels = None, None
    for found_by in (lambda m: led(m, sets, 0), lambda m: led(m, sets, 1), lambda m: joined(m, sets)):
        in_class = met.withColumn("class", F.col("vertex")) if labels is None else met.join(labels, "vertex", "left").withColumn("class", F.coalesce("class", "vertex"))
        found = stored(found_by(in_class), "links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = stored(classes(links), "classes")
    if labels is None:
        labels = known.select("vertex", F.col("vertex").alias("class")).limit(0)

    # One row for each vertex, whatever the copies; a set's smallest id, then its class's.
    smallest = known.filter("n_shingles > 0").groupBy("vertex").agg(F.min("doc_id").alias("doc_id"))
    in_class = smallest.join(labels, "vertex", "left").select("vertex", "doc_id", F.coalesce("class", "vertex").alias("class"))
    return known, in_class
