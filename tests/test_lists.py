"""External search, pages, lists and sums on small rows: nulls, wildcards, bounds and empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenlog.operators import events as ev, reports, windows as wi

AT = dt.datetime(2024, 1, 5)
SCHEMA = "id long, system_id long, timestamp timestamp, message string, severity string, host string, source_ip string, program string, service string, trace_id string"


@pytest.fixture(scope="module")
def hits(spark):
    rows = [(1, 0, AT, "Disk 50% full_", "error", "a", None, "p", None, None), (2, 0, AT, "disk 509 full!", "Error", "a,b", None, "p", None, None), (3, 0, AT, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(
    ("s", "found"),
    [
        (ev.Search(), [1, 2, 3]), (ev.Search(text="  "), [1, 2, 3]), (ev.Search(text="50% FULL"), [1]), (ev.Search(text="disk 5*full_"), [1]), (ev.Search(text="50? full"), [1, 2]), (ev.Search(severity="ERROR"), [1]),
        (ev.Search(host="a,b"), [2]), (ev.Search(text="FULL disk", mode="match"), [1, 2]), (ev.Search(text="disk fu", mode="match"), []), (ev.Search(since="no time"), [1, 2, 3]), (ev.Search(until="2024-01-04T00:00:00Z"), []),
    ],
)
def test_external_matching(hits, s, found):
    assert ids(ev.external_matching(hits, s)) == found


def test_page_info_knows_the_last_page(hits):
    assert ev.page_info(hits, ev.Search(limit=2)).first() == (3, 1, 2, True)
    assert ev.page_info(hits, ev.Search(limit=2, page=2)).first() == (3, 2, 2, False)
    assert ev.page_info(hits.limit(0), ev.Search(limit=0, page=-1)).first() == (0, 1, 1, False)


def test_newest_takes_lists_nulls_and_bounds(spark):
    rows = spark.range(600).select("id", (F.col("id") % 2).alias("kind"), F.timestamp_seconds(F.col("id")).alias("created_at"))
    assert reports.newest(rows, {"kind": None}, most=10**6).count() == 500
    assert [r.id for r in reports.newest(rows, {"kind": [0, 1]}, most=0).collect()] == [599]
    assert reports.newest(rows.limit(0), {"kind": 1}).count() == 0


def test_sums_leave_out_missing_costs_and_stand_for_no_rows(spark):
    usage = spark.createDataFrame([(1, 2, 0.5), (3, 4, None)], "token_input long, token_output long, cost double")
    assert reports.usage_sums(usage).first() == (4, 6, 0.5)
    assert reports.usage_sums(usage.limit(0)).first() == (0, 0, None)
    assert reports.table_counts(a=usage, b=usage.limit(0)).first() == (2, 0)


def test_backfill_keeps_marks_and_marks_scored_events(spark):
    meta = spark.createDataFrame([(1, None), (2, AT), (3, None)], "event_id long, scored_at timestamp")
    scores = spark.createDataFrame([(1,), (1,), (2,)], "event_id long")
    now = F.lit("2025-01-01").cast("timestamp")
    assert [(r.event_id, r.scored_at and r.scored_at.year) for r in ev.backfilled(meta, scores, now).orderBy("event_id").collect()] == [(1, 2025), (2, 2024), (3, None)]


def test_other_windows_of_the_system_alone_are_forgotten(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, 1.0, 0.65), (2, 1, 0.5, 1.0, 0.65), (3, 2, 0.5, 1.0, 0.65)], "window_id long, system_id long, meta_score double, highest double, effective double")
    kept = {r.window_id: (r.meta_score, round(r.effective, 9)) for r in wi.forgotten(rows, 1, 2).collect()}
    assert kept == {1: (0.0, 0.3), 2: (0.5, 0.65), 3: (0.5, 0.65)}


def test_whole_traces_by_system(spark, tmp_path):
    from lumenlog.plans import catalog
    from lumenlog.plans.views import Views

    # 1,500 events of one trace and system: more than a page.
    spark.range(1500).select((F.col("id") * 500 + 77).alias("event_id"), F.lit(AT).alias("ts"), F.lit(0).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit("{}").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(0, 2)], "n_nationkey long, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    (row,) = catalog.CATALOG["trace_by_system"].run(Views(spark, str(tmp_path))).collect()
    assert (row["system_id"], row["n"]) == (2, 1500) and row["ids"] == ",".join(str(i * 500 + 77) for i in range(1500))
