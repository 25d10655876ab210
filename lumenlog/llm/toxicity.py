"""Toxicity: gradient-boosted trees over dense lexical features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import crc_remainder, documents, map_rows, raw_texts, stored

#: Words of insult, by language.
LEXICON = {
    "en": "idiot idiots moron morons stupid loser losers pathetic worthless disgusting trash scum clown clowns dumb dumbass imbecile fool foolish jerk creep freak garbage ugly filthy vermin retard bastard bitch asshole shit shitty crap fuck fucking hate shut kill die cretin dimwit halfwit parasite maggot coward",
    "fr": "idiot idiote crétin crétine imbécile débile connard connasse salaud salope merde ordure minable abruti abrutie stupide",
    "es": "idiota imbécil estúpido estúpida tonto tonta basura asqueroso asquerosa mierda patético patética cabrón inútil",
    "de": "idiot idiotisch trottel dummkopf blöd arschloch scheiße abschaum wertlos widerlich erbärmlich verlierer",
}
#: The second person.
SECOND = {"en": "you your you're youre yours yourself u ur", "fr": "tu toi te ton ta tes vous votre", "es": "tú tu te usted ti vosotros", "de": "du dich dir dein deine euch"}
#: Words that are insults only in company; they count in a feature of their own.
WEAK = frozenset(w.encode() for w in ("hate", "shut", "kill", "die", "fool", "foolish", "ugly", "garbage", "freak", "creep", "jerk", "crap", "dumb", "coward", "parasite"))
STRONG = frozenset(w.encode() for words in LEXICON.values() for w in words.split()) - WEAK
YOU = frozenset(w.encode() for words in SECOND.values() for w in words.split())
#: Signs that stand for letters.
LEET = bytes.maketrans(b"013457@$!", b"oieastasi")
SIGNS = b"0123456789@$!*.-_"
RUN = re.compile(rb"[a-z0-9@$!*.\-_]+")
SPACED = re.compile(rb"(?<![a-z])(?:[a-z][ .\-_]){3,}[a-z](?![a-z])")
WORD = re.compile(rb"[a-z\x80-\xff']+")
NEAR = 5
#: Words among which strong ones make a burst.
BURST = 40
NAMES = ("words", "strong", "strong_density", "weak", "weak_density", "you", "you_density", "near", "masked", "spaced", "capitals", "loud", "marks", "strong_kinds", "burst", "learned", "learned_density", "learned_kinds")
HITS = [NAMES.index(n) for n in ("strong", "weak", "masked", "spaced")]

#: Bytes of the beginnings of words that may enter the learned lexicon, beside whole words.
STEMS = (4, 5, 6, 7)
#: A learned entry needs this log-likelihood ratio against the base rate and this share of toxic rows.
LEAST_EVIDENCE, LEAST_SHARE = 10.0, 0.6
#: The most labelled rows that the lexicon, the trees and the calibration learn from; beyond it a hash of doc_id picks them.
MOST_ROWS = 40_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 40, 3, 0.2, 32, 3
#: Folds of the labelled rows: a row's learned hits come from the lexicon of the others, its raw score for calibration from their trees.
FOLDS = 4
PRIOR_ROWS, ORDERING = 5, 0.01
THRESHOLD = 0.3


def entries(words: set[bytes]) -> set[bytes]:
    """What a text's words can add to the learned lexicon: whole words and, marked by a star, beginnings."""
    return {w for w in words if len(w) > 2} | {w[:k] + b"*" for k in STEMS for w in words if len(w) >= k}


def evidence(toxic: int, clean: int, base: float) -> float:
    """Log-likelihood ratio of an entry's rows having their own toxic share instead of the base rate."""
    n = toxic + clean
    part = lambda x, p: x * math.log(x / (n * p)) if x else 0.0
    return part(toxic, base) + part(clean, 1 - base)


def statistics(data: bytes, learned: frozenset[bytes] = frozenset()) -> list[float]:
    """The features of one text, in the order of NAMES."""
    low = data.lower()
    words = WORD.findall(low)
    hits = 0
    kinds: set[bytes] = set()
    if learned:
        known: dict[bytes, bool] = {}
        for w in words:
            if (hit := known.get(w)) is None:
                hit = known[w] = w in learned or w[:4] + b"*" in learned or w[:5] + b"*" in learned or w[:6] + b"*" in learned or w[:7] + b"*" in learned
            if hit:
                hits += 1
                kinds.add(w)
    k = len(words)
    strong = [i for i, w in enumerate(words) if w in STRONG]
    weak = sum(w in WEAK for w in words)
    you = [i for i, w in enumerate(words) if w in YOU]
    near, j = 0, 0
    for i in strong:
        while j < len(you) and you[j] < i - NEAR:
            j += 1
        near += j < len(you) and you[j] <= i + NEAR
    masked = spaced = 0
    if low.translate(None, b"013457@$!*") != low:
        for m in RUN.findall(low):
            # Up to its last letter a run is looked at once, however long it is.
            m = m.rstrip(SIGNS)
            if len(m.lstrip(SIGNS).translate(None, SIGNS)) == len(m.lstrip(SIGNS)):
                continue
            bare = m.translate(LEET).translate(None, b".-_*")
            masked += (bare in STRONG or bare in WEAK) and m.translate(None, b".-_") != bare
    for m in SPACED.findall(low):
        bare = m.translate(None, b" .-_")
        spaced += any(w in bare for w in STRONG if len(w) > 3)
    n = max(len(data), 1)
    letters = max(n - len(data.translate(None, bytes(range(65, 91)) + bytes(range(97, 123)))), 1)
    capitals = n - len(data.translate(None, bytes(range(65, 91)))) if data else 0
    burst = j = 0
    for i, at in enumerate(strong):
        while strong[j] <= at - BURST:
            j += 1
        burst = max(burst, i - j + 1)
    return [
        math.log1p(k), float(len(strong)), len(strong) / max(k, 1), float(weak), weak / max(k, 1), float(len(you)), len(you) / max(k, 1), float(near), float(masked), float(spaced),
        capitals / letters, data.count(b"!") / n, (data.count(b"?") + data.count(b"!")) / n, float(len({words[i] for i in strong})), float(burst), float(hits), hits / max(k, 1), float(len(kinds)),
    ]


@dataclass(frozen=True)
class Boosted:
    """Trees as arrays (feature, cut, value) of a full binary tree each, a start value, and the calibration's steps."""

    features: np.ndarray
    cuts: np.ndarray
    values: np.ndarray
    start: float
    steps: tuple

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, v in zip(self.features, self.cuts, self.values, strict=True):
            at = np.zeros(len(x), dtype=int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2**DEPTH - 1)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores. What calibration or the trees put on one level keeps the order of raw scores and of hits of the fixed lexicon, by ORDERING."""
        raw = self.raw(x)
        plain = 1 / (1 + np.exp(-raw - np.log1p(x[:, HITS].sum(1))))
        return (1 - ORDERING) * np.interp(raw, *self.steps) + ORDERING * plain if len(self.steps[0]) else plain


def isotonic(x: np.ndarray, y: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over the mean label of each distinct x; steps are joined by straight lines.

    One pseudo-case of the base rate in each block keeps the ends off 0 and 1.
    """
    order = np.argsort(x, kind="stable")
    points, first = np.unique(x[order], return_index=True)
    weights = np.diff(np.append(first, len(x))).astype(float)
    means = np.add.reduceat(y[order].astype(float), first) / weights
    blocks: list[list[float]] = []  # mean, weight, points
    for m, w in zip(means, weights, strict=True):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    level = np.repeat([(b[0] * b[1] + base) / (b[1] + 1) for b in blocks], [int(b[2]) for b in blocks])
    return points, np.maximum.accumulate(level)


def grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree by histograms of gradients; a node that can't be split sends all rows left."""
    inner = 2**DEPTH - 1
    features, cuts = np.zeros(inner, dtype=int), np.full(inner, np.inf)
    at = np.zeros(len(x), dtype=int)
    d = binned.shape[1]
    for node in range(inner):
        own = np.flatnonzero(at == node)
        if len(own):
            g, h = gradient[own], hessian[own]
            best = 1e-9
            base = g.sum() ** 2 / (h.sum() + 1.0)
            for j in range(d):
                b = binned[own, j]
                gs, hs, ns = np.bincount(b, g, BINS).cumsum(), np.bincount(b, h, BINS).cumsum(), np.bincount(b, minlength=BINS).cumsum()
                gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - base
                gain[(ns < LEAST_LEAF) | (len(own) - ns < LEAST_LEAF)] = -1
                gain = gain[: len(edges[j])]
                if len(gain) and gain.max() > best:
                    best, k = gain.max(), int(gain.argmax())
                    features[node], cuts[node] = j, edges[j][k]
            right = x[own, features[node]] > cuts[node]
            at[own] = 2 * node + 1 + right
    leaf = at - inner
    values = np.zeros(inner + 1)
    for k in range(inner + 1):
        own = leaf == k
        values[k] = gradient[own].sum() / (hessian[own].sum() + 1.0)
    return features, cuts, values


def cut_points(column: np.ndarray) -> np.ndarray:
    """Where a feature may be cut: between all its values if they are few, else at quantiles; one value that most rows share is apart."""
    values = np.unique(column)
    if len(values) < 2:
        return np.zeros(0)
    if len(values) <= BINS:
        return (values[1:] + values[:-1]) / 2
    cuts = np.unique(np.quantile(column, np.linspace(0, 1, BINS)[1:-1]))
    if np.mean(column == values[0]) > 0.5:
        rest = column[column > values[0]]
        cuts = np.unique(np.concatenate([[(values[0] + values[1]) / 2], np.quantile(rest, np.linspace(0, 1, BINS - 1)[1:-1])]))
    return cuts


def boosted(x: np.ndarray, y: np.ndarray, start: float) -> Boosted:
    """Trees of all rows, without calibration."""
    none = np.zeros((0, 2**DEPTH - 1))
    if not len(y):
        return Boosted(none.astype(int), none, np.zeros((0, 2**DEPTH)), start, ((), ()))
    edges = [cut_points(x[:, j]) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    raw, rows = np.full(len(x), start), np.arange(len(x))
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        f, c, v = grow(x, binned, edges, y - p, p * (1 - p))
        v = RATE * v
        trees.append((f, c, v))
        at = np.zeros(len(x), dtype=int)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, f[at]] > c[at])
        raw += v[at - (2**DEPTH - 1)]
    return Boosted(*(np.array(z) for z in zip(*trees, strict=True)), start, ((), ()))


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Boosted:
    """Trees of all rows; the isotonic steps come from scores that the trees of the other folds give to each fold.

    Every row so serves both, and none is calibrated by trees that saw it. Whatever the number of rows, the
    start value and the steps shrink to a base rate, that of PRIOR_ROWS more rows of which one in ten is toxic.
    """
    base = (y.sum() + PRIOR_ROWS / 10) / (len(y) + PRIOR_ROWS)
    start = float(math.log(base / (1 - base)))
    model = boosted(x, y, start)
    unseen = np.full(len(y), start)
    for k in np.unique(fold):
        own = fold == k
        unseen[own] = boosted(x[~own], y[~own], start).raw(x[own])
    return Boosted(model.features, model.cuts, model.values, start, isotonic(unseen, y, base) if len(y) else ((), ()))


SCHEMA = StructType([StructField("doc_id", LongType()), StructField("x", ArrayType(DoubleType()))])


def featured(docs: DataFrame, learned: frozenset[bytes]) -> DataFrame:
    return map_rows(documents(docs), SCHEMA, lambda batch: {"doc_id": batch.column("doc_id"), "x": [statistics(t, learned) for t in raw_texts(batch)]})


def featured_unseen(rows: DataFrame, learned: list[frozenset[bytes]]) -> DataFrame:
    """fold, h, y and x of labelled rows (doc_id, text, fold, h, y): the learned hits are those of the other folds' lexicon."""
    schema = StructType([*(StructField(c, LongType()) for c in ("doc_id", "h", "fold", "y")), SCHEMA["x"]])
    one = lambda batch: [statistics(t, learned[k]) for t, k in zip(raw_texts(batch), batch.column("fold").to_pylist(), strict=True)]
    return map_rows(rows.select("doc_id", "text", "h", "fold", "y"), schema, lambda batch: {**{c: batch.column(c) for c in ("doc_id", "h", "fold", "y")}, "x": one(batch)})


def learn_lexicons(rows: DataFrame, folds: int = FOLDS) -> tuple[frozenset[bytes], list[frozenset[bytes]]]:
    """Entries over-represented in toxic rows (text, fold, y), counted by document: of all rows, and of all but each fold.

    ``rows`` is bounded by the caller, and so is what comes back.
    """
    names = [f"{kind}{k}" for k in range(folds) for kind in ("clean", "toxic")]

    def count(batches):
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for data, k, y in zip(raw_texts(batch), batch.column("fold").to_pylist(), batch.column("y").to_pylist(), strict=True):
                for e in entries(set(WORD.findall(data.lower()))):
                    held.setdefault(e, [0] * len(names))[2 * k + y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in range(len(names)))], names=["entry", *names])

    rows = rows.select("text", F.col("fold").cast("long").alias("fold"), F.col("y").cast("long").alias("y"))
    totals = np.zeros((folds, 2), dtype=int)
    for r in rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect():
        totals[r["fold"], r["y"]] = r["n"]
    counted = rows.mapInArrow(count, "entry binary, " + ", ".join(f"{n} long" for n in names)).groupBy("entry").agg(*[F.sum(n).alias(n) for n in names])
    frequent = counted.filter(sum(F.col(f"toxic{k}") for k in range(folds)) >= 3).collect()

    def chosen(without: int | None) -> frozenset[bytes]:
        own = [k for k in range(folds) if k != without]
        clean, toxic = totals[own].sum(0)
        if not clean or not toxic:
            return frozenset()
        out = set()
        for r in frequent:
            bad, good = sum(r[f"toxic{k}"] for k in own), sum(r[f"clean{k}"] for k in own)
            if bad >= 3 and bad >= LEAST_SHARE * (bad + good) and evidence(bad, good, toxic / (clean + toxic)) >= LEAST_EVIDENCE:
                out.add(bytes(r["entry"]))
        return frozenset(out)

    return chosen(None), [chosen(k) for k in range(folds)]


def score_toxicity(docs: DataFrame, labels: DataFrame, held: int = 2, folds: int = 4, threshold: float = THRESHOLD, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: more toxic) and predicted for every document.

    Learns from at most ``most_rows`` labelled rows outside the held-out fold, picked by a hash of
    doc_id. They extend the fixed lexicon by words and beginnings of words, grow the trees and calibrate
    them, each row in all three: in FOLDS folds, a row's learned hits come from the other folds' lexicon
    and its raw score from their trees, so that both are as honest as a new text's. With few labels the
    scores shrink to a base rate, without any they are those of that rate. Only the text gives a
    score's inputs. Null and empty texts get the score of an empty text; null labels and labels other
    than 0 and 1 are passed over. Repeated rows are scored each; an empty table gives no rows; texts of any length
    are read whole, in time that grows with their length; other columns are ignored.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(crc_remainder("doc_id", folds) != held)
    hashed = marks.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))).orderBy("h", "doc_id").limit(most_rows)
    picked = stored(hashed.withColumn("fold", F.col("h") % FOLDS), "toxicity-rows")
    marked = stored(documents(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "h", "fold", "y"), "toxicity-texts")  # most_rows rows at most
    learned, others = learn_lexicons(marked)
    features = stored(featured(docs, learned), "toxicity")
    rows = featured_unseen(marked, others).select("h", "doc_id", "x", "y", "fold").orderBy("h", "doc_id", "x").limit(most_rows).collect()
    x = np.array([r["x"] for r in rows], dtype=float).reshape(-1, len(NAMES))
    model = fit(x, np.array([r["y"] for r in rows], dtype=float), np.array([r["fold"] for r in rows], dtype=int))

    def score(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], names=["doc_id", "score"])

    scored = features.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (crc_remainder("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
