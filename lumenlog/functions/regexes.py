"""Regular expressions that mean in Java what they mean in a dialect with ASCII word boundaries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: ``\b`` between ASCII word characters only. Java's own is Unicode-aware.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: What an edge comes to where the pattern itself says which side holds the word: half the work at every place of a text.
BEGIN, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: One word character: itself, a digit class, or a class of word characters.
WORD = r"(?:[A-Za-z0-9_]|\\d|\[[A-Za-z0-9_-]+\])"
SPECIAL = r"([.*+?^${}()|\[\]\\])"


def ascii_edges(pattern: str) -> str:
    """Replaces ``\\b`` (unless its backslash is escaped) by an ASCII word edge."""

    def edge(m: re.Match) -> str:
        if m[1]:
            return m[1]
        before, after = pattern[: m.start()], pattern[m.end() :]
        opened = re.match(r"\((?:\?:)?([^()]*)\)", after)
        if re.match(WORD, after) or (opened and all(re.match(WORD, part) for part in opened[1].split("|"))):
            return BEGIN
        return END if re.search(rf"(?:^|[^\\]){WORD}(?:\+|\{{[1-9][0-9]*(?:,[0-9]*)?\}})?$", before) else EDGE

    return re.sub(r"(\\\\)|\\b", edge, pattern)


def sub(c: Column, pattern: str, by: str) -> Column:
    """All matches replaced; ``by`` may use $1 and so on."""
    return F.regexp_replace(c, F.lit(ascii_edges(pattern)), F.lit(by))


def like(c: Column, pattern: str) -> Column:
    return c.rlike(ascii_edges(pattern))


def strip(c: Column) -> Column:
    """Takes off all white space at both ends, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def escape_regex(c: Column, slash: bool = False) -> Column:
    """Escapes what is special in a pattern; ``slash`` escapes / as well."""
    return F.regexp_replace(c, SPECIAL.replace(r"\\])", r"\\/])") if slash else SPECIAL, r"\\$1")


def wildcard_to_regex(c: Column) -> Column:
    """``a*b.c`` to ``^a.*b\\.c$``: stars stand for anything, all else for itself."""
    parts = F.transform(F.split(c, r"\*"), lambda p: escape_regex(p))
    return F.concat(F.lit("^"), F.array_join(parts, ".*"), F.lit("$"))


def is_valid(pattern: str) -> bool:
    """Whether Java and Python both take the pattern; others must fall back before they reach a query."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    from pyspark.sql import SparkSession

    if (spark := SparkSession.getActiveSession()) is None:
        return True
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  py4j wraps Java's PatternSyntaxException
        return False
    return True


def escape_like(value: str) -> str:
    """A literal for LIKE with backslash as the escape character."""
    return re.sub(r"([%_\\])", r"\\\1", value)
