"""Many patterns against many events: the literal index gives the rows of trying every pattern."""

import time

import pytest
from pyspark.sql import functions as F

from lumenlog.operators import normal
from lumenlog.plans.views import Views

SCHEMA = "id long, system_id long, pattern_regex string, host_pattern string, program_pattern string, enabled boolean"


@pytest.mark.parametrize("pattern, literal", [
    ("^view user [0-9]+ from", "view user "), ("Error: (disk|net) failed", "error: "), ("(?:abc)?defg", "defg"), ("a|bcd", ""), (r"x\.y+zz", "x."), ("(Foo Bar){2,}", "foo bar"), ("(Foo Bar){0,2}q", "q"), ("[abc]def", "def"), (r"\Qa.b\E", ""), (r"\p{L}abc", ""), ("(?x) a b c", ""),
    ("", ""), (".*", ""), ("É ÀB", "É Àb"), (r"(ab)\1cdefg", ""), ("ab(?=cd)ef", "ab"), (r"\bword\b", "word"), ("a.b.cde", "cde"), ("(?i)ABC", "abc"),
])
def test_required_literal(pattern, literal):
    assert normal.required_literal(pattern) == literal


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    e = Views(spark, sf_dir).log_events
    # Hosts and messages may be missing.
    return e.withColumns({"host": F.when(F.col("id") % 5 != 0, F.col("host")), "message": F.when(F.col("id") % 11 != 0, F.col("message"))}).cache()


def templates(spark, n):
    rows = [(1, None, "^view user [0-9]+ from", None, None, True), (2, 1, "^CLICK user", None, "^click$", True), (3, None, "^purchase", "^host-1[0-9]$", "", True), (4, None, ".*", None, None, False), (5, None, "from 10|nothing", "^$", None, True)]
    rows += [(10 + i, i % 5 if i % 3 else None, f"user {i} from .*\\.{i % 7} props", None, None, True) for i in range(n - 5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("mode", ["pipeline", "sql"])
@pytest.mark.parametrize("n", [5, 60])
def test_same_rows_as_every_pattern_against_every_event(spark, events, n, mode):
    t = templates(spark, n)
    some = (lambda c: F.coalesce(F.col(c), F.lit(""))) if mode == "pipeline" else F.col
    fits = (F.col("t_system").isNull() | (F.col("t_system") == events.system_id)) & F.rlike(events.message, F.concat(F.lit("(?i)"), "pattern_regex"))
    for c, p in (("host", "host_pattern"), ("program", "program_pattern")):
        fits &= F.col(p).isNull() | (F.col(p) == "") | F.coalesce(F.rlike(some(c), F.concat(F.lit("(?i)"), p)), F.lit(False))
    joined = events.join(t.filter("enabled").withColumnsRenamed({"id": "t_id", "system_id": "t_system"}), fits)
    expected = {r["id"]: r["t"] for r in joined.groupBy("id").agg(F.array_sort(F.collect_list("t_id")).alias("t")).collect()}
    got = {r["id"]: r["t"] for r in events.select("id", normal.matched(events, t, mode).alias("t")).collect()}
    assert {i: x for i, x in got.items() if x} == expected and len(got) == events.count() and len(expected) > 100
    assert {r["id"] for r in normal.excluded(events, t, mode).collect()} == set(expected)
    assert {r["id"] for r in normal.kept(events, t, mode).collect()} == set(got) - set(expected)
    assert {r["id"]: r["template"] for r in normal.first_match(events, t, mode).collect()} == {i: x[0] for i, x in expected.items()}


def test_no_templates(spark, events):
    none = spark.createDataFrame([], SCHEMA)
    assert normal.excluded(events, none).count() == 0 and normal.kept(events, none).count() == events.count()


def test_a_thousand_templates_take_less_than_twice_the_time_of_four(spark):
    many = spark.range(200_000).select("id", (F.col("id") % 5).alias("system_id"), F.lit("h").alias("host"), F.lit("p").alias("program"), F.concat(F.lit("the quick message of user "), F.col("id") % 50_000, F.lit(" from 10.0.0."), F.col("id") % 7, F.lit(" took its time")).alias("message")).cache()
    many.count()

    def took(t):
        best = 1e9
        for _ in range(2):
            began = time.perf_counter()
            normal.kept(many, t).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        return best

    patterns = [(i, None, f"user {i} from .* took", None, None, True) for i in range(1000)]
    few, all_of_them = took(spark.createDataFrame(patterns[:40], SCHEMA)), took(spark.createDataFrame(patterns, SCHEMA))
    assert all_of_them < 2 * few + 2
