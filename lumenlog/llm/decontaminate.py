"""Benchmark decontamination in DataFrame operations only.

Windows with the words of an item slide over every document. A window that reaches the similarity holds a
least number of shingles that occur in the benchmark, and moving a window right up to the next such
shingle never lowers its similarity, so the windows looked at are those that begin with such a shingle and
hold enough of them, and a document's last one. No window that could be the best of an item is left out.

Each window gets a 63-bit SimHash of its shingles. The fingerprint is cut into blocks so that two
fingerprints within the radius differ by one bit at most in one block (pigeonhole): items enter
the index with each block's value and its one-bit neighbours, windows meet them on equal values, pairs beyond
the radius go, and the exact weighted similarity of the shingles decides the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import documents, stored, text_key

WORDS = 5
SIMILARITY = 0.8
BITS = 63
#: At a similarity of 0.8 fingerprints of 63 bits differ by 9.6 on average with a deviation of 2.9; the radius is 3.2 deviations above.
RADIUS = 19
#: Bits added up at once: three counts of 21 bits in one number, for windows of up to 2 million shingles.
LANES, LANE = 3, 21
#: Rows up to which a side is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(w: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, in order."""
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(k))))
    return F.when(F.size(w) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def simhash(grams: Column) -> Column:
    """63 bits, each set if it is set in most of the shingles; a shingle that occurs n times weighs n."""
    mask = F.lit(sum(1 << (LANE * i) for i in range(LANES))).cast("long")
    bits = lambda j: lambda total, h: total + F.shiftrightunsigned(h, j).bitwiseAND(mask)
    sums = [F.aggregate(grams, F.lit(0).cast("long"), bits(j)) for j in range(LANE)]
    lane = F.lit((1 << LANE) - 1).cast("long")
    found = F.lit(0).cast("long")
    for j, s in enumerate(sums):
        for i in range(LANES):
            count = F.shiftright(s, LANE * i).bitwiseAND(lane)
            found = found + F.when(count * 2 > F.size(grams), F.lit(1 << (LANE * i + j)).cast("long")).otherwise(F.lit(0).cast("long"))
    return found


def cuts(radius: int = RADIUS) -> list[tuple[int, int]]:
    """(first bit, bits) of the blocks: half as many as the radius, so that one of them differs by one bit at most."""
    n = (radius + 2) // 2
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def cut(fingerprint: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """(block, value) for each block."""
    return F.array(*[F.struct(F.lit(i).alias("block"), cut(fingerprint, a, n).alias("value")) for i, (a, n) in enumerate(cuts(radius))])


def neighbours(fingerprint: Column, radius: int = RADIUS) -> Column:
    """(block, value) for each block, and for each value that differs by one bit."""
    near = [(i, a, n, flip) for i, (a, n) in enumerate(cuts(radius)) for flip in [0, *(1 << b for b in range(n))]]
    return F.array(*[F.struct(F.lit(i).alias("block"), cut(fingerprint, a, n).bitwiseXOR(F.lit(flip).cast("long")).alias("value")) for i, a, n, flip in near])


def first_block(differing: Column, radius: int = RADIUS) -> Column:
    """The first block with one differing bit at most; a pair meets once, there."""
    found = F.lit(None).cast("int")
    for i, (a, n) in reversed(list(enumerate(cuts(radius)))):
        found = F.when(F.bit_count(cut(differing, a, n)) <= 1, F.lit(i)).otherwise(found)
    return found


def numbered(grams: Column) -> Column:
    """The shingles, those that occur again told apart by their number, as a set."""
    ordered = F.array_sort(grams)
    apart = F.transform(ordered, lambda g, i: F.xxhash64(g, i + 1 - F.call_function("array_position", ordered, g)))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.transform(grams, lambda g: F.xxhash64(g, F.lit(0).cast("long")))).otherwise(apart)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two numbered lists of shingles: shared occurrences over all occurrences."""
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, variant (the shingles' hash), n_words, k, numbered shingles and fingerprint; shorter items are one shingle of all their words."""
    item = benchmark.select(F.col("item_id").alias("item_id"), words(F.col("text")).alias("w")).filter("item_id is not null and size(w) > 0")
    item = item.withColumn("k", F.least(F.size("w"), F.lit(WORDS)))
    grams = reduce(lambda rest, k: F.when(F.col("k") == k, shingles(F.col("w"), k)).otherwise(rest), range(WORDS - 1, 0, -1), shingles(F.col("w"), WORDS))
    own = item.select("item_id", "k", F.size("w").alias("n_words"), grams.alias("grams")).withColumn("variant", F.xxhash64("grams", "n_words"))
    return own.dropDuplicates(["item_id", "variant"]).withColumn("print", simhash(F.col("grams"))).withColumn("own", numbered(F.col("grams")))


def found_leaks(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, item_id, start_word, n_words, distance and similarity of the best window of each item in each text."""
    items = stored(benchmark_items(benchmark), "items")
    n_items = items.count()
    marks = items.select("k", "n_words", F.explode("grams").alias("gram")).distinct()
    marks = stored(marks, "marks")
    n_marks = marks.count()
    sizes = [r["k"] for r in items.select("k").distinct().collect()] or [WORDS]  # 1 to WORDS

    text = documents(docs).select("doc_id", text_key().alias("text_hash"), words(F.col("text")).alias("w"))
    key = ["doc_id", "text_hash"]
    hits = []
    for k in sizes:
        grams = text.select(*key, F.size("w").alias("size"), F.posexplode(shingles(F.col("w"), k)).alias("at", "gram"))
        hits.append(grams.join(small(marks.filter(F.col("k") == k), n_marks), "gram").select(*key, "size", "k", "n_words", "at"))
    places = reduce(DataFrame.unionByName, hits).groupBy(*key, "size", "k", "n_words").agg(F.array_sort(F.collect_set("at")).alias("at"))
    # Shingles in an item and in a window, the shared ones that the similarity takes, and where the last window begins.
    own, window = F.expr("n_words - k + 1"), F.expr("least(n_words, size) - k + 1")
    need = F.greatest(F.ceil(F.lit(similar / (1 + similar)) * (own + window) - F.lit(1e-6)).cast("int"), F.lit(1))
    held = places.select("*", window.alias("m"), need.alias("need"), F.expr("greatest(0, size - n_words)").alias("last")).filter("size(at) >= need")
    starts = F.expr("transform(filter(sequence(0, size(at) - need), i -> at[i] <= last and at[i + need - 1] - at[i] < m), i -> at[i])")
    end = F.when(F.expr("at[size(at) - need] >= last"), F.array("last")).otherwise(F.array().cast("array<int>"))
    starts = F.array_distinct(F.concat(starts, end))
    wanted = stored(held.select(*key, "k", "n_words", "m", F.explode(starts).alias("start")), "windows")

    ids = wanted.select(*key).distinct()
    n_ids = ids.count()
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    again = text.join(small(ids, n_ids), same(text, ids), "left_semi").dropDuplicates(key)
    per_doc = wanted.groupBy(*key).agg(F.collect_list(F.struct("k", "n_words", "m", "start")).alias("at"))
    grams = again.select("*", *[shingles(F.col("w"), k).alias(f"g{k}") for k in sizes])
    met = grams.join(per_doc, same(grams, per_doc)).select(grams["doc_id"], grams["text_hash"], *[f"g{k}" for k in sizes], F.explode("at").alias("at"))
    of_size = reduce(lambda rest, k: F.when(F.col("at.k") == k, F.col(f"g{k}")).otherwise(rest), sizes[1:], F.col(f"g{sizes[0]}"))
    windows = met.select(*key, "at.k", "at.n_words", "at.m", "at.start", F.slice(of_size, F.col("at.start") + 1, F.col("at.m")).alias("grams"))
    prints = windows.withColumn("print", simhash(F.col("grams")))

    left = prints.select("*", F.explode(blocks(F.col("print"), radius)).alias("cut")).select("*", "cut.block", "cut.value").drop("cut")
    index = items.select("item_id", "variant", "k", "n_words", F.col("print").alias("item_print"), F.explode(neighbours(F.col("print"), radius)).alias("cut"))
    index = index.select("item_id", "variant", "k", "n_words", "item_print", "cut.block", "cut.value")
    near = left.join(small(index, n_items * len(cuts(radius)) * 9), ["k", "n_words", "block", "value"])
    differing = F.col("print").bitwiseXOR(F.col("item_print"))
    near = near.withColumn("distance", F.bit_count(differing)).filter((F.col("distance") <= radius) & (first_block(differing, radius) == F.col("block")))
    pairs = near.drop("block", "value", "print", "item_print").join(small(items.select("item_id", "variant", "own"), n_items), ["item_id", "variant"])
    judged = pairs.withColumn("similarity", similarity(F.col("own"), numbered(F.col("grams")))).filter(F.col("similarity") >= similar)
    best = F.max_by(F.struct(F.col("start").alias("start_word"), F.expr("m + k - 1").alias("n_words"), "distance", "similarity"), F.struct("similarity", -F.col("start")))
    return judged.groupBy(*key, "item_id").agg(best.alias("best")).select(*key, "item_id", "best.*")


def leaks(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start_word, n_words, distance and similarity of the best window of each item in each document.

    Only pairs that reach the similarity are returned; of equally similar windows the first that begins
    with a shingle of the benchmark counts. A document shorter than an item is one window, and n_words is what
    the window holds. Items and documents without words (null, empty, signs only) and items without
    an id give nothing; a null doc_id is a document of its own; repeated rows count once, rows that
    repeat a doc_id with other texts are searched each, and the best window of them all is returned. Items of
    fewer than five words are compared by their whole sequence. Texts of any length are searched whole. An empty
    table on either side gives no rows. Other columns are ignored.

    A pair that reaches the similarity but whose fingerprints differ by more than the radius is lost. The
    tests measure the share found.
    """
    best = F.max_by(F.struct("start_word", "n_words", "distance", "similarity"), F.struct("similarity", -F.col("start_word"), "text_hash"))
    return found_leaks(docs, benchmark, similar, radius).groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns stay, and so do null and empty texts."""
    found = stored(found_leaks(docs, benchmark).select(F.col("text_hash").alias("_leak")).distinct(), "leaks")
    return docs.join(small(found, found.count()), text_key() == F.col("_leak"), "left_anti")
