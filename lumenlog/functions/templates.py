"""Message templates: parameterised messages and their hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .regexes import bound, like, strip, sub

#: What is variable in a message, in the order of replacement.
STEPS = (
    (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
    (r"(?i)\b[0-9a-f]{1,4}(:[0-9a-f]{1,4}){7}\b", "<IPv6>"),
    (r"(?i)\b0x[0-9a-f]{8,}\b", "<HEX>"),
    (r"(?i)\b[0-9a-f]{16,}\b", "<HEX>"),
    (r"\b\d+\b", "<N>"),
    (r"\"[^\"]*\"", '"<STR>"'),
    (r"'[^']*'", "'<STR>'"),
)
#: Fixed value: the clauses of an SQL statement that vary.
SQL_CLAUSES = r"(?i)STATEMENT:\s+(select|insert|update|delete)\b(.*?)\b(?:where|order\s+by|limit|offset|group\s+by|having|returning|on\s+conflict)\b.*"
MOST_JSON, DEPTH = 32_768, 3


def json_object(c: Column) -> Column:
    """The text as a VARIANT if it is a JSON object, else null."""
    t = strip(c)
    return F.when(t.startswith("{") & t.endswith("}"), F.try_parse_json(t))


def text_at(v: Column, *keys: str) -> Column:
    """The first of the keys that is there and not null, if it is a non-blank string, trimmed."""
    found = [F.try_variant_get(v, f"$.{k}", "string") for k in keys]
    kinds = [F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) for k in keys]
    out = F.lit(None).cast("string")
    for value, kind in reversed(list(zip(found, kinds, strict=True))):
        out = F.when(kind.isNull() | (kind == "VOID"), out).when((kind == "STRING") & (strip(value) != ""), strip(value))
    return out


def unwrapped(c: Column) -> Column:
    """The message inside JSON log records, up to three levels deep."""

    def inner(text: Column) -> Column:
        record = F.when(F.length(text) <= MOST_JSON, json_object(text))
        return F.coalesce(bound(record, lambda v: text_at(v, "msg", "message", "text")), text)

    def opened(text: Column) -> Column:
        for _ in range(DEPTH):
            text = bound(text, inner)
        return text

    # Most messages are no records: they are left as they are.
    return F.when(c.rlike(r"^\s*\{"), bound(c, opened)).otherwise(c)


def parameterize(c: Column, normalize_sql: bool = False, unwrap: bool = True) -> Column:
    """A message with addresses, numbers, hex and quoted strings replaced by marks."""
    if unwrap:
        c = unwrapped(c)
    for pattern, by in STEPS:
        c = sub(c, pattern, by)
    return sub(c, SQL_CLAUSES, "STATEMENT: $1$2<SQL_CLAUSES>") if normalize_sql else c


def pattern_hash(template: Column, system: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(system.cast("string"), F.lit("global")), F.lit("\0"), template), 256)


#: Words that begin a line torn out of an SQL statement.
SQL_WORDS = r"SELECT|FROM|JOIN|LEFT\s+JOIN|INNER\s+JOIN|RIGHT\s+JOIN|CROSS\s+JOIN|WHERE|AND|OR|ON|ORDER\s+BY|GROUP\s+BY|HAVING|UNION|INSERT|UPDATE|DELETE|SET|VALUES|INTO|LIMIT|OFFSET|AS|CASE|WHEN|THEN|ELSE|END|WITH|RETURNING|LATERAL|COALESCE|EXISTS|NOT|IN|IS|NULL|LIKE|BETWEEN|DISTINCT|ALL|ANY|CREATE|ALTER|DROP|INDEX|TABLE|CONSTRAINT|PRIMARY|FOREIGN|REFERENCES|CASCADE|BEGIN|COMMIT|ROLLBACK|EXPLAIN|ANALYZE"


def is_orphan_fragment(c: Column) -> Column:
    """Whether a short message is a piece of a longer one; null and empty messages are not."""
    t = strip(c)
    yes = (F.length(t) < 5) | t.startswith("#011") | like(t, rf"(?i)^(?:{SQL_WORDS})\b") | like(t, r"^Process\s+\d+")
    return F.coalesce((c != "") & (F.length(c) <= 120) & yes, F.lit(False))


def truncated(c: Column, most: int) -> Column:
    if most <= 0:
        return c
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(" [...truncated]"))).otherwise(c)
