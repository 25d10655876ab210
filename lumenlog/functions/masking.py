"""Secrets and personal data: redaction and privacy masks."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .regexes import is_valid, sub

MARK = "***REDACTED***"
#: Keys whose values are secrets, quoted values before bare ones.
QUOTED_KEYS = ("password", "secret", r"api[_-]?key", "token")
BARE_KEYS = ("password", "passwd", "secret", r"api[_-]?key", "token", r"access[_-]?key", r"private[_-]?key", "credentials?")
#: JSON keys whose values are redacted whole.
SENSITIVE_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey", "api-key", "authorization", "access_key", "private_key", "credential", "credentials", "access_token", "refresh_token", "client_secret")

URL_CREDENTIALS = r"(?i)://([^:]+:)[^@]+(@)"


def redaction_steps() -> list[tuple[str, str]]:
    """(pattern, replacement) in order. The key is captured and put back: Java takes no unbounded look-behind."""
    steps = [(URL_CREDENTIALS, f"://$1{MARK}$2")]
    steps += [(rf"(?i)({k}\s*[=:]\s*)(?:\"[^\"]*\"|'[^']*')", f"$1{MARK}") for k in QUOTED_KEYS]
    steps += [(rf"(?i)({k}\s*[=:]\s*)\S+", f"$1{MARK}") for k in BARE_KEYS]
    return [*steps, (r"(?i)(Authorization\s*:\s*)\S+(?:\s+\S+)?", f"$1{MARK}")]


def redact(c: Column, extra: Iterable[str] = (), enabled: bool = True) -> Column:
    """Replaces secrets by a mark; ``extra`` patterns follow, invalid ones are passed over."""
    if not enabled:
        return c
    (credentials, by), *steps = redaction_steps()
    # A match ends with an @, so text after the last one is left out: else each :// would look through all of it.
    head = F.regexp_extract(c, r"(?s)^.*@", 0)
    c = F.when(F.contains(c, F.lit("@")), F.concat(sub(head, credentials, by), F.substr(c, F.length(head) + 1))).otherwise(c)
    for pattern, by in steps:
        c = sub(c, pattern, by)
    for pattern in extra:
        if (p := pattern.strip()) and is_valid(p):
            c = sub(c, f"(?i){p}", MARK)
    return c


@F.pandas_udf(StringType())
def _redact_tree(texts: pd.Series) -> pd.Series:
    import re

    steps = [(re.compile(p), re.sub(r"\$(\d)", r"\\\1", by)) for p, by in redaction_steps()]

    def text(v: str) -> str:
        for pattern, by in steps:
            v = pattern.sub(by, v)
        return v

    def walk(v, within_list: bool = False):
        if isinstance(v, dict):
            return {k: MARK if k.lower() in SENSITIVE_KEYS else walk(x) for k, x in v.items()}
        if isinstance(v, list):
            return v if within_list else [walk(x, True) for x in v]
        return text(v) if isinstance(v, str) else v

    def one(v: str | None) -> str | None:
        try:
            parsed = json.loads(v) if v else None
        except ValueError:
            return v
        return json.dumps(walk(parsed), ensure_ascii=False, separators=(",", ":")) if isinstance(parsed, dict) else v

    return texts.map(one, na_action="ignore")


def redact_json(c: Column) -> Column:
    """Redacts a JSON object at any depth: sensitive keys whole, strings by :func:`redact`'s rules.

    Anything but an object comes back as it is.
    """
    return _redact_tree(c)


#: Privacy categories in the order in which they are applied, with their marks.
PRIVACY = {
    "ipv4": (r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)(?:/\d{1,2})?\b", "<IPv4>"),
    "ipv6": (r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b", "<IPv6>"),
    "email": (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "<EMAIL>"),
    "phone": (r"(?:\+?\d{1,3}[\s.-]?)?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}\b", "<PHONE>"),
    "urls": (r"(?i)https?://[^\s\"'<>]+", "<URL>"),
    "user_paths": (r"(?i)(?:/home/|/Users/|C:\\Users\\)[^\s\"'<>:;|]+", "<USER_PATH>"),
    "mac_addresses": (r"\b(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}\b", "<MAC>"),
    "credit_cards": (r"\b(?:\d[ -]*?){13,19}\b", "<CARD>"),
    "passwords": (r"(?i)((?:password|passwd|pwd|secret|pass_?phrase)\s*[=:]\s*)(?:\"[^\"]*\"|'[^']*'|\S+)", "$1<PASSWORD>"),
    "api_keys": (r"(?i)((?:api[_-]?key|access[_-]?key|secret[_-]?key|auth[_-]?token|bearer)\s*[=:\s]\s*)(?:\"[^\"]*\"|'[^']*'|\S+)", "$1<API_KEY>"),
    "usernames": (r"(?i)((?:user(?:name)?|login|uid|account)\s*[=:]\s*)(?:\"[^\"]*\"|'[^']*'|\S+)", "$1<USERNAME>"),
}


#: The e-mail pattern begun only where a run of address characters begins, or where the last match ended: the
#: same matches, found in linear time. Signs before the first word character of a run are put back.
EMAIL = r"(?:\G(?<=[A-Za-z0-9_])|(?<![A-Za-z0-9._%+\-])([.%+\-]*)(?=[A-Za-z0-9_]))[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?![A-Za-z0-9_])"


def mask_private(c: Column, categories: Iterable[str] = tuple(PRIVACY), custom: Iterable[tuple[str, str]] = (), enabled: bool = True) -> Column:
    """Masks the chosen categories in their fixed order, then custom (pattern, replacement) pairs; invalid ones are passed over."""
    if not enabled:
        return c
    chosen = set(categories)
    for name, (pattern, by) in PRIVACY.items():
        if name in chosen:
            c = F.regexp_replace(c, EMAIL, f"$1{by}") if name == "email" else sub(c, pattern, by)
    for pattern, by in custom:
        if pattern and is_valid(pattern):
            c = sub(c, f"(?i){pattern}", by or "<FILTERED>")
    return c


def strip_fields(columns: Mapping[str, Column], drop: Iterable[str] = (), mask: Iterable[str] = ()) -> dict[str, Column]:
    """Event fields for a scorer: dropped ones are null, masked ones are marked where they hold a value."""
    drop, mask = set(drop), set(mask)
    return {n: F.lit(None).cast("string") if n in drop else F.when(c.isNotNull() & (c != ""), F.lit(f"<{n.upper()}>")).otherwise(c) if n in mask else c for n, c in columns.items()}
