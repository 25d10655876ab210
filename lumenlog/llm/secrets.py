"""Secret scan with structural confirmation.

Three base kinds are plain patterns. The method proper then takes every base64 or hex run as a
candidate, decodes it and reports it only if the bytes parse as something that holds a key: nested
ASN.1 lengths that fit exactly, OpenSSH's length-prefixed private key, or a signed token whose
header and claims are JSON.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, documents, map_rows, texts

#: The kinds in the order in which ties at one start are listed.
KINDS = ("assign", "access", "hex", "pem", "openssh", "der", "token")
BASE = KINDS[:3]

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

ASSIGN_LEAST, ACCESS_LEAST = 8, 16

ARMOUR = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){20,}(?![0-9A-Fa-f])")
OPENSSH_MAGIC = b"openssh-key-v1\x00"
#: How often a decoded candidate may hold another encoding.
DEPTH = 2


def decode64(text: str) -> bytes | None:
    body = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def asn1_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, content start, content end) of the items that fill data[start:end] exactly, else None."""
    found, at = [], start
    while at < end:
        if at + 2 > end:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            if n < 0x80 or (k > 1 and not data[at]):
                return None
            at += k
        if at + n > end:
            return None
        found.append((tag, at, at + n))
        at += n
    return found


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that fills the bytes and has the shape of a private key.

    RSA and DSA: version 0 or 1, then large INTEGERs; EC: version 1 and an OCTET STRING; PKCS#8:
    version, an algorithm with an OBJECT IDENTIFIER, an OCTET STRING; encrypted PKCS#8: algorithm
    and OCTET STRING.
    """
    top = asn1_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = asn1_items(data, *top[0][1:])
    if not inner or len(inner) < 2:
        return False

    def algorithm(item: tuple[int, int, int]) -> bool:
        if item[0] != 0x30:
            return False
        parts = asn1_items(data, *item[1:])
        return bool(parts) and parts[0][0] == 0x06

    tag, a, b = inner[0]
    if tag == 0x02 and b - a == 1 and data[a] <= 1:
        rest = inner[1:]
        if len(rest) >= 5 and all(t == 0x02 for t, _, _ in rest):
            return max(e - s for _, s, e in rest) >= 16
        if rest[0][0] == 0x04:
            return rest[0][2] - rest[0][1] >= 16
        return len(rest) >= 2 and algorithm(rest[0]) and rest[1][0] == 0x04
    return len(inner) == 2 and algorithm(inner[0]) and inner[1][0] == 0x04


def is_openssh_key(data: bytes) -> bool:
    """The magic, then cipher, KDF and options as strings, a key count and as many public keys and one private block."""
    if not data.startswith(OPENSSH_MAGIC):
        return False
    at, strings = len(OPENSSH_MAGIC), 0
    count = None
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if strings == 3 and count is None:
            count = n
            if not 1 <= count <= 16:
                return False
            continue
        if at + n > len(data):
            return False
        at += n
        strings += 1
        if count is not None and strings == 3 + count + 1:
            return at == len(data)
    return False


def is_token(text: str) -> bool:
    """A signed token: a JSON header with an algorithm, JSON claims, and a signature unless the algorithm is none."""
    head, claims, signature = text.split(".")
    try:
        h, c = json.loads(decode64(head) or b""), json.loads(decode64(claims) or b"")
    except (ValueError, RecursionError):
        return False
    if not isinstance(h, dict) or not isinstance(c, dict) or not isinstance(h.get("alg"), str):
        return False
    return h["alg"].lower() == "none" or bool(signature and decode64(signature))


def confirm(data: bytes | None, depth: int = DEPTH) -> str | None:
    """The kind of secret that decoded bytes hold."""
    if not data:
        return None
    if is_openssh_key(data):
        return "openssh"
    if data[0] == 0x30 and is_der_key(data):
        return "der"
    if depth and data.isascii():
        inner = data.decode("ascii").strip()
        if TOKEN.fullmatch(inner):
            return "token" if is_token(inner) else None
        if ARMOUR.search(inner):
            return "pem"
        if HEX_ANY.fullmatch(inner):
            return confirm(bytes.fromhex(inner), depth - 1)
        if BASE64.fullmatch(inner):
            return confirm(decode64(inner), depth - 1)
    return None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []  # disjoint, by start

    def take(a: int, b: int) -> None:
        insort(taken, (a, b))

    def is_taken(a: int, b: int) -> bool:
        """Whether a found key overlaps: only the last that begins before ``b`` can."""
        i = bisect_left(taken, (b, b))
        return i > 0 and taken[i - 1][1] > a

    if "-----BEGIN" in text:
        for m in ARMOUR.finditer(text):
            data = decode64(m[2])
            if data and (is_der_key(data) or is_openssh_key(data)):
                found.append((m.start(), m.end(), "pem"))
                take(*m.span())
    if "eyJ" in text:
        for m in TOKEN.finditer(text):
            if is_token(m[0]):
                found.append((m.start(), m.end(), "token"))
                if not is_taken(*m.span()):
                    take(*m.span())
    for pattern, decode in ((BASE64, decode64), (HEX_ANY, bytes.fromhex)):
        for m in pattern.finditer(text):
            if is_taken(*m.span()):
                continue
            if pattern is BASE64 and HEX_ANY.fullmatch(m[0]):
                continue
            if kind := confirm(decode(m[0])):
                found.append((m.start(), m.end(), kind))
                take(*m.span())
    return found


def spans(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind), in code points, by start and then by kind as listed in KINDS."""
    found = base_spans(text) + confirmed_spans(text)
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, spans as array of (kind, start, end).

    A narrow step over whole texts. Null and empty texts have no spans; repeated rows each get
    their own result; other columns are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def per_chunk(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "found": pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in spans(t)] for t in texts(batch)], kind)}

    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    schema = StructType([StructField("doc_id", LongType()), StructField("found", ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])))])
    return map_rows(documents(docs), schema, per_chunk)


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret's span replaced by ``mark``; overlapping spans become one mark.

    All columns stay; a null text stays null; ``n_chars``, where there is such a column, follows the
    new text.
    """
    names = docs.columns

    def mask(text: str | None) -> str | None:
        if not text or not (found := spans(text)):
            return text
        out, at = [], 0
        for a, b, _ in found:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in (part for whole in batches for part in chunks(whole)):
            new = [mask(t) for t in batch.column("text").to_pylist()]
            columns = list(batch.columns)
            i = names.index("text")
            columns[i] = pa.array(new, columns[i].type)
            if "n_chars" in names:
                j = names.index("n_chars")
                was = columns[j].to_pylist()
                columns[j] = pa.array([n if t == o or t is None else len(t) for n, t, o in zip(was, new, batch.column("text").to_pylist(), strict=True)], columns[j].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def secret_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the query: counts of the base kinds, a hash of the base spans, all spans."""
    from pyspark.sql import functions as F

    of = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scan_secrets(docs).select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(text(F.filter("found", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"), text(F.col("found")).alias("spans"),
    )


def digest_of(text: str) -> tuple[int, int, int, str, str]:
    """The same digest for one text, for tests."""
    found = spans(text)
    base = [x for x in found if x[2] in BASE]
    return (*(sum(x[2] == k for x in base) for k in BASE), hashlib.sha256(listed(base).encode()).hexdigest(), listed(found))
