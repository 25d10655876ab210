"""English full text: stemmed words, stop words, "phrases", OR, and - before what must be absent.

A query's stems are known before the search; which words of a table have them is found once for each
distinct word, not for each event. The search itself is then one native condition a row, without Python
and without a shuffle. Where many searches meet one table, ``postings`` keeps the index of positions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stemming import ENGLISH_STOP_WORDS, stem
from ..storage import stored

#: A word is a run of letters and digits: an address or a hyphenated word is its parts.
BREAK = r"[^\p{L}\p{N}]+"
#: Words whose stems a task remembers.
KNOWN_WORDS = 100_000
WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Term:
    """Lexemes with their distance from the first; several make a phrase, in which stop words keep their places."""

    lexemes: tuple[tuple[str, int], ...]
    absent: bool = False


def lexemes_of(text: str) -> tuple[tuple[str, int], ...]:
    found = [(i, w) for i, w in enumerate(WORD.findall(text.lower())) if w not in ENGLISH_STOP_WORDS]
    return tuple((stem(w), i - found[0][0]) for i, w in found)


def parsed(query: str) -> list[list[Term]]:
    """Alternatives, each a list of terms that must all hold; what consists of stop words alone is left out."""
    alternatives: list[list[Term]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if word.lower() == "or" and not minus:
            alternatives.append([])
        elif lexemes := lexemes_of(phrase or word):
            alternatives[-1].append(Term(lexemes, bool(minus)))
    return [a for a in alternatives if a]


def words(message: Column) -> Column:
    """The lower-case words of a text in order; none of a null."""
    return F.filter(F.split(F.lower(F.coalesce(message, F.lit(""))), BREAK), lambda w: w != "")


def stemmed(vocabulary: DataFrame) -> DataFrame:
    """word and lexeme of distinct words, without stop words: a narrow step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [w for w in batch.column("word").to_pylist() if w not in ENGLISH_STOP_WORDS]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(list(map(stem, held)), pa.string())], names=["word", "lexeme"])

    return vocabulary.select("word").mapInArrow(run, "word string, lexeme string")


def forms(texts: DataFrame, message: Column, lexemes: Iterable[str]) -> dict[str, list[str]]:
    """The words of the texts that have one of the lexemes, by lexeme.

    A word keeps the first letter of its stem and differs from it by a chain of listed endings, so a
    query's words are few, however large the table.
    """
    lexemes = sorted(set(lexemes))
    vocabulary = texts.select(F.explode(words(message)).alias("word")).filter(F.substring("word", 1, 1).isin(sorted({x[0] for x in lexemes}))).distinct()
    out: dict[str, list[str]] = {x: [] for x in lexemes}
    for r in stemmed(vocabulary).filter(F.col("lexeme").isin(lexemes)).orderBy("word").collect():
        out[r["lexeme"]].append(r["word"])
    return out


def condition(held: Column, alternatives: list[list[Term]]) -> Column:
    """Whether a text's lexemes (an array by place, null where the query names none) satisfy a query."""

    def term(t: Term) -> Column:
        if len(t.lexemes) == 1:
            found = F.exists(held, lambda x: x.eqNullSafe(F.lit(t.lexemes[0][0])))
        else:
            here = lambda x, i: reduce(lambda a, b: a & b, [F.get(held, i + d).eqNullSafe(F.lit(lexeme)) for lexeme, d in t.lexemes[1:]], x.eqNullSafe(F.lit(t.lexemes[0][0])))
            found = F.exists(F.transform(held, here), lambda x: x)
        return ~found if t.absent else found

    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(term, a)) for a in alternatives])


def matching(texts: DataFrame, query: str, column: str = "message") -> DataFrame:
    """The rows whose text satisfies a query; none if the query names no word. A null text holds no word."""
    alternatives = parsed(query)
    if not alternatives:
        return texts.filter(F.lit(False))
    found = forms(texts, F.col(column), (x for a in alternatives for t in a for x, _ in t.lexemes))

    def lexeme(w: Column) -> Column:
        cases = [(w.isin(ws), x) for x, ws in found.items() if ws]
        return reduce(lambda c, case: c.when(*case), cases[1:], F.when(*cases[0])) if cases else F.lit(None).cast("string")

    return texts.filter(F.transform(F.array(F.transform(words(F.col(column)), lexeme)), lambda held: condition(held, alternatives))[0])


def postings(texts: DataFrame, key: str = "id", column: str = "message") -> DataFrame:
    """The index of a table: lexeme, key, positions (from 0, stop words counted), a narrow step; a task stems a word once while it is known."""
    kind = texts.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexeme = lru_cache(KNOWN_WORDS)(lambda w: None if w in ENGLISH_STOP_WORDS else stem(w))
        for batch in batches:
            found, row, positions = [], [], []
            for i, held in enumerate(batch.column("words").to_pylist()):
                places: dict[str, list[int]] = {}
                for at, w in enumerate(held):
                    if (x := lexeme(w)) is not None:
                        places.setdefault(x, []).append(at)
                found.extend(places)
                positions.extend(places.values())
                row.extend([i] * len(places))
            keys = batch.column(key).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), keys, pa.array(positions, pa.list_(pa.int32()))], names=["lexeme", key, "positions"])

    return texts.select(key, words(F.col(column)).alias("words")).mapInArrow(run, f"lexeme string, `{key}` {kind}, positions array<int>")


def indexed(index: DataFrame, query: str, key: str = "id") -> DataFrame:
    """The keys that satisfy a query by the index alone; an alternative of absent terms only needs ``matching``."""
    found = []
    alternatives = parsed(query)
    # The index is read once, for the query's lexemes.
    index = stored(index.filter(F.col("lexeme").isin(sorted({x for a in alternatives for t in a for x, _ in t.lexemes}))), "postings") if alternatives else index
    for a in alternatives:
        if all(t.absent for t in a):
            raise ValueError("an index has no rows for what is only absent")
        terms = sorted(a, key=lambda t: t.absent)
        part = hits(index, terms[0], key)
        for t in terms[1:]:
            part = part.join(hits(index, t, key), key, "left_anti" if t.absent else "left_semi")
        found.append(part)
    return reduce(DataFrame.unionByName, found).distinct() if found else index.select(key).limit(0)


def hits(index: DataFrame, term: Term, key: str) -> DataFrame:
    """The keys that hold a term: its lexemes at places that differ as the term says."""
    (first, _), *rest = term.lexemes
    at = index.filter(F.col("lexeme") == first).select(key, F.col("positions").alias("starts"))
    for lexeme, d in rest:
        other = index.filter(F.col("lexeme") == lexeme).select(key, moved(d).alias("more"))
        at = at.join(other, key).select(key, F.array_intersect("starts", "more").alias("starts")).filter(F.size("starts") > 0)
    return at.select(key)


def moved(distance: int) -> Column:
    return F.transform("positions", lambda p: p - distance)
