"""Event-time windows: streams against batches and against sums by hand, late rows, odd tables."""

from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from quarryline.streaming import windows
from quarryline.streaming.windows import Windows

START = datetime(2024, 3, 31)
KINDS = [
    Windows(("event_type",), size="10 minutes"), Windows(("event_type",), size="30 minutes", slide="10 minutes"), Windows(("user_id",), gap="5 minutes"),
]


def rows(*minutes, user=1, value=1.0):
    return [(START + timedelta(minutes=m), user, "click", value) for m in minutes]


def put(spark, at, batch, name):
    spark.createDataFrame(batch, windows.EVENTS).coalesce(1).write.parquet(f"{at}/in/{name}")


def follow(spark, at, w, **options):
    return windows.follow(spark, f"{at}/in/*", f"{at}/out", f"{at}/check", w, **options)


def found(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("w", KINDS, ids=["tumbling", "sliding", "session"])
def test_stream_gives_the_rows_of_the_batch(spark, tmp_path, w):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id", "event_type", "value").orderBy("ts").collect()
    before = {k: spark.conf.get(k, None) for k in windows.SETTINGS}
    for i, part in enumerate((events[:400], events[400:700], events[700:])):
        put(spark, tmp_path, [tuple(r) for r in part], i)
        assert follow(spark, tmp_path, w) == {"rows": len(part), "late": 0}
        want = windows.closed(spark.createDataFrame([tuple(r) for r in events[: (400, 700, 1000)[i]]], windows.EVENTS), w)
        rounded = lambda df: found(df.selectExpr("start", "end", w.by[0], "n", "round(total, 6)", "least", "most"))
        assert rounded(windows.read(spark, f"{tmp_path}/out", w)) == rounded(want) != []
    assert follow(spark, tmp_path, w)["rows"] == 0
    assert {k: spark.conf.get(k, None) for k in windows.SETTINGS} == before


def test_late_rows_within_the_delay_count_and_others_are_told(spark, tmp_path):
    w = Windows(("user_id",), size="10 minutes", delay="15 minutes")
    put(spark, tmp_path, rows(1, 2, 32), 0)
    assert follow(spark, tmp_path, w)["late"] == 0
    put(spark, tmp_path, rows(3) + rows(18, 19) + rows(50, user=2), 1)  # the watermark stands at minute 17
    assert follow(spark, tmp_path, w)["late"] == 1
    got = {((r["start"] - r["end"]), r["n"]) for r in windows.read(spark, f"{tmp_path}/out", w).collect()}
    assert got == {(timedelta(minutes=-10), 2)}  # [0, 10) without the late row and [10, 20); [30, 40) is open
    every = spark.read.schema(windows.EVENTS).parquet(f"{tmp_path}/in/*")
    assert sorted(r["n"] for r in windows.closed(every, w).collect()) == [2, 3]


def test_sessions_by_hand(spark):
    w = Windows(("user_id",), gap="5 minutes", delay="0 seconds")
    batch = rows(0, 4, 8.9, 14.1, 30) + rows(1, 1, 7, user=2, value=2.0) + rows(3, user=None, value=None) + rows(0, 5, 10.001, user=3)
    df = windows.closed(spark.createDataFrame(batch, windows.EVENTS), w)
    got = defaultdict(list)
    for r in df.orderBy("start").collect():
        got[r["user_id"]].append((r["n"], r["total"]))
    assert got == {1: [(3, 3.0), (1, 1.0)], 2: [(2, 4.0), (1, 2.0)], 3: [(2, 2.0), (1, 1.0)], None: [(1, None)]}  # the one at minute 30 is open


def test_windows_do_not_depend_on_the_zone(spark):
    w = Windows(("user_id",), size="1 day", delay="0 seconds")
    df = spark.createDataFrame(rows(0, 90, 150, 1439, 1440), windows.EVENTS)  # clocks change on that day
    with windows.settings(spark, {"spark.sql.session.timeZone": "Europe/Berlin"}):
        assert [r["n"] for r in windows.closed(df, w).collect()] == [4]


def test_odd_and_empty(spark, tmp_path):
    w = KINDS[0]
    batch = [(None, 1, "a", 1.0), (START, None, None, None), (START, None, None, None), (START + timedelta(days=1), 1, "a", 2.0)]
    df = spark.createDataFrame(batch, windows.EVENTS).selectExpr("*", "'x' AS start", "'y' AS w", "1 AS n")
    assert [(r["event_type"], r["n"], r["total"]) for r in windows.closed(df, w).collect()] == [(None, 2, None)]
    assert windows.closed(df.limit(0), w).count() == 0 and windows.closed(df.where("ts IS NULL"), w).count() == 0
    put(spark, tmp_path, [], 0)
    assert follow(spark, tmp_path, w) == {"rows": 0, "late": 0} and windows.read(spark, f"{tmp_path}/out", w).count() == 0
    for bad in ({}, {"size": "1 hour", "gap": "1 hour"}, {"gap": "1 hour", "slide": "1 hour"}):
        with pytest.raises(ValueError):
            Windows(("user_id",), **bad)
