"""Small documented cases of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenlog.functions import addresses, masking, severity as sev, similarity as sim, templates as tpl, timefix
from lumenlog.functions.regexes import wildcard_to_regex
from lumenlog.operators import ingest, normal


def values(spark, rows, *columns, schema="x string"):
    return [tuple(r) for r in spark.createDataFrame([(x,) for x in rows], schema).select(*columns).collect()]


def test_addresses(spark):
    rows = ["udp://192.168.30.14:52502", "[::1]:5140", "unix:///var/run/syslog.sock", "::1", "", None]
    assert values(spark, rows, addresses.clean_transport_address(F.col("x"))) == [("192.168.30.14",), ("::1",), (None,), ("::1",), (None,), (None,)]
    assert values(spark, ["13:28:05.323:", "52502", "pve", None], addresses.is_plausible_host(F.col("x"))) == [(False,), (False,), (True,), (False,)]


def test_severities(spark):
    assert values(spark, ["7", "err", "Fatal", " ", None], sev.canonical(F.col("x"))) == [("debug",), ("error",), ("critical",), (None,), (None,)]
    assert values(spark, ["error: permission denied", "all well", None], sev.enriched(F.col("x"), F.lit("info"))) == [("error",), ("info",), ("info",)]
    assert values(spark, [165], sev.pri_severity(F.col("x")), sev.pri_facility(F.col("x")), schema="x int") == [("notice", "local4")]
    assert values(spark, [0.75, 0.5, 0.25, 0.24], sev.score_band(F.col("x")), schema="x double") == [("CRITICAL",), ("HIGH",), ("MEDIUM",), ("LOW",)]


@pytest.mark.parametrize(
    ("message", "template"),
    [
        ("conn from 10.0.0.1 id 42 \"x\"", "conn from <IP> id <N> \"<STR>\""),
        ("é1 22", "é<N> <N>"),
        ('{"level":30,"msg":"job 7 done"}', "job <N> done"),
        ('{"msg":"{\\"message\\":\\"disk 3 full\\"}"}', "disk <N> full"),
        ('{"level":30}', '{"<STR>":<N>}'),
        ("", ""),
        (None, None),
    ],
)
def test_templates(spark, message, template):
    assert values(spark, [message], tpl.parameterize(F.col("x"))) == [(template,)]


def test_redaction(spark):
    rows = ["password = foo b", "postgres://u:pw@h/db", 'token="a b" c', None]
    assert values(spark, rows, masking.redact(F.col("x"))) == [("password = ***REDACTED*** b",), ("postgres://u:***REDACTED***@h/db",), ("token=***REDACTED*** c",), (None,)]


def test_short_texts(spark):
    assert values(spark, ["a" * 600], tpl.truncated(F.col("x"), 512)) == [("a" * 512 + " [...truncated]",)]
    assert values(spark, ["SELECT 1", "abc", None], tpl.is_orphan_fragment(F.col("x"))) == [(True,), (True,), (False,)]
    assert values(spark, ["a*b.c"], wildcard_to_regex(F.col("x"))) == [(r"^a.*b\.c$",)]
    assert values(spark, ["=1+1", "a,b"], sim.csv_field(F.col("x"))) == [("\t=1+1",), ('"a,b"',)]


def test_epochs(spark):
    rows = [1_700_000_000.0, 1_700_000_000_000.0]
    assert len(set(values(spark, rows, F.unix_micros(timefix.epoch_timestamp(F.col("x"))), schema="x double"))) == 1


def test_normal_pattern(spark):
    assert values(spark, ["user 5 from 10.0.0.1", None], normal.normal_pattern("x")) == [("^user [0-9]+ from [0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$",), (None,)]


def test_records(spark):
    rows = [('{"message":" hi ","level":"WARN","host":{"name":"h"},"k":1}',), ('{"msg":"{\\"level\\":50,\\"msg\\":\\"in\\"}"}',), ("no json",), ('{"message":" "}',), (None,)]
    now = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")
    found = ingest.normalized(spark.createDataFrame(rows, "record string"), now).select("message", "severity", "host", "raw").collect()
    assert sorted(tuple(r) for r in found) == [("hi", "warning", "h", '{"k":1}'), ("in", "error", None, None)]
