"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import chunks, crc_remainder, documents, map_rows, raw_texts, stored

UPPER, LOWER, DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
SPACE = b" \t\n\r\x0b\x0c"
SYMBOL = b"#$%&*+<=>@[\\]^_`{|}~/"
LOUD = b"!?"
ENDS = frozenset(b"#$%&*|!@^~")
NAMES = ("words", "upper", "digit", "symbol", "loud", "space", "other", "word_chars", "distinct", "most_common", "repeats", "symbol_words", "loud_words", "shout_words", "junk_stretch", "line_repeats", "sentence")
#: Words in a stretch; the worst stretch of a text is a statistic of its own.
STRETCH = 40
#: Shrinkage of a class's covariance towards the pooled one, and of that towards its diagonal.
TO_POOLED, TO_DIAGONAL = 0.3, 0.1
THRESHOLD = 0.3


def logit(share: float, n: float) -> float:
    """A share's log-odds, smoothed for the number of cases behind it."""
    return math.log((share * n + 0.5) / ((1 - share) * n + 0.5))


def statistics(data: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of NAMES."""
    n = len(data)
    less = lambda cut: n - len(data.translate(None, cut))
    upper, lower, digit, symbol, loud, space = (less(c) for c in (UPPER, LOWER, DIGIT, SYMBOL, LOUD, SPACE))
    words = data.split()
    k = len(words)
    letters = max(upper + lower, 1)
    common = Counter(words)
    top = max(common.values(), default=0)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    bad = [w[-1] in ENDS or (len(w) > 2 and w.isupper()) for w in words]
    same = [a == b for a, b in zip(words, words[1:], strict=False)]
    symbols = sum(w[-1] in b"#$%&*|@^~" for w in words)
    louds = sum(w[-1] in LOUD for w in words)
    shouts = sum(len(w) > 2 and w.isupper() for w in words)
    worst = 0.0
    for at in range(0, k, STRETCH):
        part = bad[at : at + STRETCH]
        worst = max(worst, (sum(part) + sum(same[at : at + STRETCH])) / max(len(part), 8))
    lines = [x for x in data.split(b"\n") if x]
    again = 1 - len(set(lines)) / len(lines) if lines else 0.0
    stops = data.count(b".") + data.count(b"!") + data.count(b"?")
    return [
        math.log1p(k), logit(upper / letters, letters), logit(digit / max(n, 1), n), logit(symbol / max(n, 1), n), logit(loud / max(n, 1), n), logit(space / max(n, 1), n),
        logit(max(0, n - upper - lower - digit - symbol - loud - space) / max(n, 1), n), math.log1p((n - space) / max(k, 1)), logit(len(common) / max(k, 1), k), logit(top / max(k, 1), k),
        logit(repeats / max(k, 1), k), logit(symbols / max(k, 1), k), logit(louds / max(k, 1), k), logit(shouts / max(k, 1), k), logit(min(worst, 1.0), 40), again, math.log1p(k / (stops + 1)),
    ]


SCHEMA = StructType([StructField("doc_id", LongType()), StructField("x", ArrayType(DoubleType()))])


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text: a narrow step."""
    return map_rows(documents(docs), SCHEMA, lambda batch: {"doc_id": batch.column("doc_id"), "x": [statistics(t) for t in raw_texts(batch)]})


@dataclass(frozen=True)
class Discriminant:
    """Class means, Cholesky factors of the class covariances, their log-determinants and log priors."""

    means: tuple
    factors: tuple
    offsets: tuple

    def scores(self, x: np.ndarray) -> np.ndarray:
        """P(label 1): the logistic of the difference of Mahalanobis log densities."""
        density = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(offset - 0.5 * np.einsum("ij,ij->j", z, z))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -60, 60)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant:
    """From each class's count, sum and sum of outer products; a class without rows takes the pooled values."""
    d = len(NAMES)
    n_all = sum(s[0] for s in sums.values())
    if n_all:
        mean_all = sum(s[1] for s in sums.values()) / n_all
        cov_all = sum(s[2] for s in sums.values()) / n_all - np.outer(mean_all, mean_all)
    else:
        mean_all, cov_all = np.zeros(d), np.eye(d)
    within, parts = np.zeros((d, d)), {}
    for c in (0, 1):
        n, s, q = sums.get(c, (0, None, None))
        mean = s / n if n else mean_all
        cov = q / n - np.outer(mean, mean) if n else cov_all
        parts[c] = n, mean, cov
        within += n * cov
    pooled = within / n_all if n_all else cov_all
    means, factors, offsets = [], [], []
    for c in (0, 1):
        n, mean, cov = parts[c]
        mixed = (1 - to_pooled) * cov + to_pooled * pooled
        mixed = (1 - to_diagonal) * mixed + to_diagonal * np.diag(np.diag(mixed)) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(mixed)
        means.append(mean)
        factors.append(factor)
        offsets.append(math.log((n + 1) / (n_all + 2)) - float(np.log(np.diag(factor)).sum()))
    return Discriminant(tuple(means), tuple(factors), tuple(offsets))


def class_sums(labelled: DataFrame, label: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of each class over all labelled rows: partial sums in tasks, one row a class to the driver."""
    d = len(NAMES)
    flat = StructType([StructField("c", LongType()), StructField("n", DoubleType()), StructField("s", ArrayType(DoubleType()))])

    def partial(batches):
        held = {}
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(-1, d)
            y = np.array(batch.column(label).to_pylist(), dtype=float)
            for c in (0, 1):
                own = x[y == c]
                if len(own):
                    n, s = held.get(c, (0.0, np.zeros(d + d * d)))
                    held[c] = n + len(own), s + np.concatenate([own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v[0] for v in held.values()], pa.float64()), pa.array([v[1].tolist() for v in held.values()], pa.list_(pa.float64()))], names=["c", "n", "s"])

    rows = labelled.select("x", F.col(label).cast("long").alias(label)).mapInArrow(partial, flat)
    n = rows.groupBy("c").agg(F.sum("n").alias("n"))
    s = rows.select("c", F.posexplode("s")).groupBy("c", "pos").agg(F.sum("col").alias("v")).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s"))
    found = {}
    for r in n.join(s, "c").collect():
        v = np.array([p["v"] for p in r["s"]])
        found[r["c"]] = r["n"], v[:d], v[d:].reshape(d, d)
    return found


def fitted(features: DataFrame, labels: DataFrame, held: int, folds: int) -> Discriminant:
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y")).filter("y in (0, 1)").filter(crc_remainder("doc_id", folds) != held)
    return fit(class_sums(features.join(marks, "doc_id"), "y"))


def score_quality(docs: DataFrame, labels: DataFrame, held: int = 0, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better) and predicted for every document.

    Learns from all labelled rows outside the held-out fold; their sums are all the driver sees. Only
    the text gives a score's inputs. Null and empty texts get the score of an empty text; labels of
    unknown documents, null labels and labels other than 0 and 1 are passed over; a document's
    repeated label rows all count, and so do repeated rows of documents. An empty table gives no rows;
    texts of any length are read whole; other columns, whatever their names, are ignored.
    """
    features = stored(featured(docs), "quality")
    model = fitted(features, labels, held, folds)

    def score(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], names=["doc_id", "score"])

    scored = features.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (crc_remainder("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, held: int = 0, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text the classifier rejects; all columns stay.

    A text is scored where it stands, so texts are never shuffled and any doc_id will do.
    """
    model = fitted(stored(featured(docs), "quality"), labels, held, folds)

    def keep(batches):
        for batch in (part for whole in batches for part in chunks(whole)):
            x = np.array([statistics(t) for t in raw_texts(batch)], dtype=float).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
