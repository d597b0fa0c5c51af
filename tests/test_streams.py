"""Row windows on a stream, provisional bars."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantloom.functions import windows as w
from quantloom.sources.shared import new_path
from quantloom.streaming import bars as sb
from quantloom.streaming import provisional, tails

KIND = "symbol string, ts int, x double"


def looking_back(rows):
    s = w.by("symbol")
    return rows.withColumns({"m": w.prior("median", "x", s, 4, 2), "before": F.lag("x").over(s)})


def steps(spark, path, parts):
    for p in parts:
        spark.createDataFrame(p, KIND).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture()
def rows():
    r = random.Random(1)
    return [(s, t, float(r.randrange(20)) if r.random() < 0.8 else None) for t in range(40) for s in ("a", "b", "c") if not (s == "c" and 5 < t < 30)]


def check(spark, at, rows):
    want = looking_back(spark.createDataFrame(rows, KIND)).collect()
    got = spark.read.parquet(f"{at}/out").drop("batch").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_row_windows_over_batches(spark, rows):
    at = new_path(spark, "test-tails")
    steps(spark, f"{at}/in", [rows[:10], rows[10:11], rows[11:50]])
    run = lambda: tails.run_row_windows(sb.event_stream(spark, f"{at}/in", files_at_once=1), at, ["symbol"], "ts", 4, looking_back)
    run()
    check(spark, at, rows[:50])
    steps(spark, f"{at}/in", [rows[50:]])
    run()  # goes on with the tails of the last run
    check(spark, at, rows)
    assert tails._numbers(spark, f"{at}/tails") == [2, 3]


def test_a_batch_that_runs_twice(spark, rows):
    at = new_path(spark, "test-tails")
    step = tails.RowWindows(at, ["symbol"], "ts", 4, looking_back)
    parts = [rows[:20], rows[20:40], rows[40:]]
    for k, p in enumerate(parts):
        df = spark.createDataFrame(p, KIND)
        step(df, k)
        step(df, k)
    check(spark, at, rows)


def test_late_rows_are_put_aside(spark):
    at = new_path(spark, "test-tails")
    step = tails.RowWindows(at, ["symbol"], "ts", 4, looking_back)
    step(spark.createDataFrame([("a", 1, 1.0), ("a", 5, 5.0), (None, 5, 1.0)], KIND), 0)
    step(spark.createDataFrame([("a", 5, 0.0), ("a", 3, 0.0), ("a", 6, 6.0), (None, 6, 2.0)], KIND), 1)
    assert sorted((r["ts"], r["before"]) for r in spark.read.parquet(f"{at}/out/batch=1").collect()) == [(6, 1.0), (6, 5.0)]
    assert sorted(r["ts"] for r in spark.read.parquet(f"{at}/late/batch=1").collect()) == [3, 5]


def test_provisional_bars_are_revised_and_closed(spark):
    at = new_path(spark, "test-provisional")
    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    kind = "ts timestamp, event_id bigint, symbol string, value double, volume double"
    batches = [
        [(t(9, 1), 1, "a", 5.0, 1.0), (t(9, 31), 2, "a", 6.0, 2.0)],
        [(t(9, 40), 3, "a", 9.0, 4.0), (t(9, 29), 4, "a", 1.0, 8.0)],  # the second is late, within the watermark: 9:31 less ten minutes
        [(t(10, 45), 5, "a", 7.0, 16.0)],
        [(t(10, 46), 6, "b", 2.0, 64.0)],
        [(t(9, 50), 7, "a", 2.0, 32.0), (t(10, 47), 8, "b", 1.0, 128.0)],  # the first comes after its bar was closed
    ]
    for b in batches:
        spark.createDataFrame(b, kind).coalesce(1).write.mode("append").parquet(f"{at}/in")
    provisional.run_provisional(lambda: sb.event_stream(spark, f"{at}/in", files_at_once=1), at)
    found = provisional.provisional_bars(spark.read.parquet(f"{at}/updates"), spark.read.parquet(f"{at}/closed"))
    got = sorted((r["symbol"], r["start"].strftime("%H:%M"), r["n"], r["volume"], r["high"], r["low"], r["revisions"], r["provisional"]) for r in found.collect())
    assert got == [("a", "09:00", 2, 9.0, 5.0, 1.0, 1, False), ("a", "09:30", 2, 6.0, 9.0, 6.0, 1, False), ("a", "10:30", 1, 16.0, 7.0, 7.0, 0, True), ("b", "10:30", 2, 192.0, 2.0, 1.0, 1, True)]
    counts = provisional.session_counts(found, spark.createDataFrame([(8,)], "n bigint")).first()
    assert counts.asDict() == {"n_bars": 4, "n_provisional": 2, "n_revised": 3, "n_prints": 7, "n_dropped": 1}
