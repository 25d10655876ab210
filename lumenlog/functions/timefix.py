"""Timestamps: units of epochs, zones, clamps and ages. ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .regexes import bound


def epoch_timestamp(n: Column) -> Column:
    """A number as seconds, milliseconds, microseconds or nanoseconds since 1970, by its size."""

    def scaled(n: Column) -> Column:
        d = n.cast("decimal(38,9)")
        return F.when(n > 1e18, d / 1000).when(n > 1e15, d).when(n > 1e12, d * 1000).otherwise(d * 1_000_000)

    return F.timestamp_micros(F.floor(bound(n, scaled)).cast("long"))


def resolved(text: Column, number: Column, now: Column) -> Column:
    """A record's time from its number or text; what is missing or can't be read is ``now``."""
    return F.coalesce(epoch_timestamp(number), F.try_to_timestamp(text), now)


def offset_corrected(ts: Column, minutes: Column) -> Column:
    return F.when(minutes.isNull() | (minutes == 0), ts).otherwise(F.timestamp_micros(F.unix_micros(ts) - minutes.cast("long") * 60_000_000))


def zone_corrected(ts: Column, zone: Column) -> Column:
    """Takes off the zone's offset at the instant ``ts``, not at the local time read from it. Unknown zones must be null."""
    offset = F.unix_micros(F.from_utc_timestamp(ts, zone)) - F.unix_micros(ts)
    return F.when(zone.isNull(), ts).otherwise(F.timestamp_micros(F.unix_micros(ts) - offset))


def corrected(ts: Column, zone: Column, minutes: Column) -> Column:
    """The named zone if there is one, else the fixed offset."""
    return F.when(zone.isNotNull() & (zone != ""), zone_corrected(ts, zone)).otherwise(offset_corrected(ts, minutes))


def clamped(ts: Column, now: Column, drift_seconds: int) -> Column:
    """``now`` for times further ahead than the drift; a drift of 0 or less turns this off."""
    if drift_seconds <= 0:
        return ts
    return F.when(F.unix_micros(ts) > F.unix_micros(now) + drift_seconds * 1_000_000, now).otherwise(ts)


def age(ts: Column, now: Column) -> Column:
    """``5m``, ``3h`` or ``2d``, rounded down."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 60_000_000)
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d")))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def second_key(text: Column) -> Column:
    """A raw time to its second: ISO, syslog's ``Jan  2 03:04:05``, else the first 19 characters."""
    iso = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", 1)
    bsd = F.regexp_extract(text, r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})", 1)
    return F.when(iso != "", iso).when(bsd != "", bsd).otherwise(F.substring(text, 1, 19))


def short(ts: Column) -> Column:
    return F.date_format(ts, "MM-dd HH:mm")
