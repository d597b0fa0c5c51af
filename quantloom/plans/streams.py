"""Streaming jobs run to their end over the given events, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import windows as w
from quantloom.plans.base import Registry
from quantloom.sources.shared import new_path, removed, written
from quantloom.sources.tables import MONTH_BARS, month_bars, table
from quantloom.streaming import bars, provisional, tails

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _prints(spark, sf_dir):
    """The given table itself as a stream; as a pattern, so that it may be a file or a folder."""
    return bars.prints_of(bars.event_stream(spark, f"{sf_dir}/events[.]parquet"))


def _streamed(spark, stream, updates=False):
    """A stream run to its end, written and read back."""
    at = new_path(spark, "stream")
    if updates:
        bars.run_updates_to_end(stream, f"{at}/out", f"{at}/checkpoint")
        return spark.read.parquet(f"{at}/out")
    bars.run_to_end(stream, f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _in_steps(rows, step: str, steps: list[int], path: str) -> None:
    """Writes rows as one file for each step, in the order of the steps."""
    for k in steps:
        rows.where(F.col(step) == k).drop(step).coalesce(1).write.mode("append").parquet(path)


_BARS = """SELECT event_type AS symbol, strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, sum(floor(value * 100) % 500 + 1) AS volume, max(value) AS high, min(value) AS low FROM events GROUP BY 1, 2"""


def _start(df):
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("window_bars_batch", _BARS)
def window_bars_batch(spark, sf_dir):
    return _start(bars.window_bars(bars.prints_of(table(spark, sf_dir, "events")), deduplicate=True))


# in append mode the bars whose end the watermark has passed: the newest time less ten minutes
@query("window_bars_stream", f"SELECT * FROM ({_BARS}) b WHERE strptime(start, '%Y-%m-%d %H:%M') + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def window_bars_stream(spark, sf_dir):
    return _start(_streamed(spark, bars.window_bars(_prints(spark, sf_dir))))


@query("deduplicated_bars_stream", f"SELECT * FROM ({_BARS}) b WHERE strptime(start, '%Y-%m-%d %H:%M') + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def deduplicated_bars_stream(spark, sf_dir):
    """Every third event is sent twice and must count once."""
    once = _prints(spark, sf_dir)
    return _start(_streamed(spark, bars.window_bars(once.unionByName(_prints(spark, sf_dir).where("event_id % 3 = 0")), deduplicate=True)))


@query("sliding_bars_batch", """SELECT event_type AS symbol, strftime(time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k, '%Y-%m-%d %H:%M') AS start, count(*) AS n, sum(floor(value * 100) % 500 + 1) AS volume, max(value) AS high, min(value) AS low FROM events, range(0, 2) r(k) GROUP BY 1, 2""")
def sliding_bars_batch(spark, sf_dir):
    return _start(bars.window_bars(bars.prints_of(table(spark, sf_dir, "events")), "60 minutes", "30 minutes"))


_SLIDING = ORACLES["sliding_bars_batch"]


@query("sliding_bars_stream", f"SELECT * FROM ({_SLIDING}) b WHERE strptime(start, '%Y-%m-%d %H:%M') + INTERVAL 60 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def sliding_bars_stream(spark, sf_dir):
    return _start(_streamed(spark, bars.window_bars(_prints(spark, sf_dir), "60 minutes", "30 minutes")))


@query("running_totals_stream", "SELECT event_type AS symbol, count(*) AS n, sum(floor(value * 100) % 500 + 1) AS volume FROM events GROUP BY 1")
def running_totals_stream(spark, sf_dir):
    """State kept for each symbol across batches; its last word."""
    return bars.newest_totals(_streamed(spark, bars.running_totals(_prints(spark, sf_dir)), updates=True))


_SESSIONS = """WITH g AS (SELECT event_type AS symbol, ts, floor(value * 100) % 500 + 1 AS volume, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT symbol, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, sum(volume) AS volume FROM s GROUP BY symbol, k"""


@query("session_bars_stream", f"{_SESSIONS} HAVING max(ts) + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def session_bars_stream(spark, sf_dir):
    return _start(_streamed(spark, bars.session_bars(_prints(spark, sf_dir))))


@query("session_bars_batch", """WITH g AS (SELECT event_type AS symbol, ts, floor(value * 100) % 500 + 1 AS volume, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT symbol, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, sum(volume) AS volume FROM s GROUP BY symbol, k""")
def session_bars_batch(spark, sf_dir):
    return _start(bars.session_bars(bars.prints_of(table(spark, sf_dir, "events"))))


_MEDIANS = {"volume_base": ("median", "volume"), "high_before": ("max", "high")}


def _looking_back(rows):
    s = w.by("symbol")
    return rows.withColumns({k: w.prior(kind, c, s, 10, 5) for k, (kind, c) in _MEDIANS.items()})


@query(
    "prior_rows_stream",
    f"""WITH {MONTH_BARS} SELECT symbol, ts, CASE WHEN count(volume) OVER p >= 5 THEN median(volume) OVER p END AS volume_base, CASE WHEN count(high) OVER p >= 5 THEN max(high) OVER p END AS high_before
FROM b WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
    dates=("ts",),
)
def prior_rows_stream(spark, sf_dir):
    """Bars come two years at a time; the last ten of each symbol are carried from batch to batch."""
    at = new_path(spark, "rows")
    given = written(month_bars(spark, sf_dir).withColumn("step", F.floor(F.year("ts") / 2)), "month-bars")
    steps = [r["step"] for r in given.select("step").distinct().orderBy("step").collect()]
    _in_steps(given, "step", steps, f"{at}/in")
    tails.run_row_windows(bars.event_stream(spark, f"{at}/in", files_at_once=1), at, ["symbol"], "ts", 10, _looking_back)
    return spark.read.parquet(f"{at}/out").select("symbol", "ts", *_MEDIANS)


# events come week by week, each fiftieth a week late, each seventieth of the others half an hour after the week's end: some within the watermark, most beyond
_LATE = """x AS (SELECT *, floor(value * 100) % 500 + 1 AS volume, (day(ts) - 1) // 8 + CASE WHEN event_id % 50 = 0 OR event_id % 70 = 1 AND ts >= time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 20 HOUR AND day(ts) % 8 = 0 THEN 1 ELSE 0 END AS step FROM events),
wm AS (SELECT step, max(max(ts)) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 6 HOUR AS mark FROM x GROUP BY step),
ok AS (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) AS s FROM x JOIN wm USING (step) WHERE mark IS NULL OR time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE > mark),
pv AS (SELECT event_type AS symbol, s AS start, count(*) AS n, sum(volume) AS volume, count(DISTINCT step) - 1 AS revisions, s + INTERVAL 30 MINUTE > (SELECT max(ts) - INTERVAL 6 HOUR FROM x) AS provisional FROM ok GROUP BY 1, 2)"""


def _late_bars(spark, sf_dir):
    ev, at = table(spark, sf_dir, "events"), new_path(spark, "provisional")
    late = (F.col("event_id") % 50 == 0) | ((F.col("event_id") % 70 == 1) & (F.hour("ts") >= 20) & (F.day("ts") % 8 == 0))
    _in_steps(ev.withColumn("step", F.floor((F.day("ts") - 1) / 8) + late.cast("int")), "step", list(range(5)), f"{at}/in")
    provisional.run_provisional(lambda: bars.prints_of(bars.event_stream(spark, f"{at}/in", files_at_once=1)), at, late="6 hours")
    closed = spark.read.parquet(f"{at}/closed")
    return provisional.provisional_bars(spark.read.parquet(f"{at}/updates"), closed)


@query("provisional_bars_stream", f"WITH {_LATE} SELECT symbol, strftime(start, '%Y-%m-%d %H:%M') AS start, n, volume, revisions, provisional FROM pv")
def provisional_bars_stream(spark, sf_dir):
    return _start(_late_bars(spark, sf_dir)).select("symbol", "start", "n", "volume", "revisions", "provisional")


@query("provisional_counts_stream", f"WITH {_LATE} SELECT count(*) AS n_bars, count(*) FILTER (provisional) AS n_provisional, count(*) FILTER (revisions > 0) AS n_revised, sum(n)::BIGINT AS n_prints, (SELECT count(*) FROM events) - sum(n)::BIGINT AS n_dropped FROM pv")
def provisional_counts_stream(spark, sf_dir):
    """How many bars are still open, were revised, and how many prints came too late."""
    return provisional.session_counts(_late_bars(spark, sf_dir), table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n")))
