"""Hosts and transport addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .regexes import bound, strip

PRIVATE_NAT = r"^(?:172\.(?:1[6-9]|2\d|3[01])\.|127\.)"
IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\z"


def clean_transport_address(raw: Column) -> Column:
    """``udp://1.2.3.4:514`` to ``1.2.3.4``, ``[::1]:514`` to ``::1``; socket paths and empty values are null.

    A bare IPv6 address is kept whole: only a value with a single colon loses a port.
    """

    def cleaned(t: Column) -> Column:
        bracket = F.regexp_extract(t, r"^\[([^\]]+)\]", 1)
        port = F.when(t.rlike(r"^[^:]+:\d{1,5}\z"), F.regexp_replace(t, r":\d{1,5}\z", "")).otherwise(t)
        return F.when(bracket != "", bracket).when(t.startswith("[") & ~t.contains("]"), t).when(port.contains("/"), F.lit(None)).otherwise(port)

    return bound(bound(F.regexp_replace(strip(raw), r"(?s)^.*?://", ""), cleaned), lambda out: F.nullif(out, F.lit("")))


def is_plausible_host(value: Column) -> Column:
    """False for times, dates, numbers, number sequences and bare punctuation."""
    v = strip(value)
    bad = v.rlike(r"^\d{1,2}:\d{2}:\d{2}") | v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]") | v.rlike(r"^\d+\z") | (v.rlike(r"^\d+:\d+:\d+:\d+") & ~v.contains(".")) | v.rlike(r"^[^a-zA-Z0-9]+\z") | (v == "")
    return F.coalesce(~bad, F.lit(False))


def nat_source_ip(source_ip: Column, host: Column) -> Column:
    """The host's address where the transport's is a container gateway or loopback and the host's is not."""
    inner = source_ip.rlike(PRIVATE_NAT) | (source_ip == "::1")
    return F.when(inner & host.rlike(IPV4) & ~host.rlike(PRIVATE_NAT), host).otherwise(source_ip)


def suggested_name(host: Column, ip: Column, program: Column) -> Column:
    """A system's name from what was seen: ``nas.local`` and ``smbd`` make ``nas / smbd``."""
    short = F.regexp_replace(host, r"(?i)\.(localdomain|local|internal|home)\z", "")
    base = F.coalesce(F.nullif(short, F.lit("")), F.concat(F.lit("Host "), F.nullif(ip, F.lit(""))))
    tail = F.nullif(program, F.lit(""))
    return F.coalesce(F.when(base.isNotNull() & tail.isNotNull(), F.concat(base, F.lit(" / "), tail)), base, tail, F.lit("Unknown"))


def common_prefix(programs: Column) -> Column:
    """The part before ``/`` that at least two programs share, if all have it; else null."""
    heads = F.transform(programs, lambda p: F.when(p.contains("/"), F.substring_index(p, "/", 1)))
    return F.when((F.size(programs) >= 2) & F.forall(heads, lambda h: h.isNotNull() & (h != "") & (h == heads[0])), heads[0])


def group_key(host: Column, ip: Column, program: Column) -> Column:
    some = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(F.sha2(F.lower(F.concat_ws("|", some(host), some(ip), some(program))), 256), 1, 32)
