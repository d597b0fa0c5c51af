"""Window kernels and scalar expressions against pandas and hand-made cases."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import expr
from quantloom.functions import windows as w
from quantloom.operators import backtest, learning, order_flow, resample, technical, vsa


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, 90).astype(float)
    x[rng.random(90) < 0.15] = np.nan
    return pd.DataFrame({"symbol": np.repeat(["a", "b", "c"], 30), "ts": np.tile(np.arange(30), 3), "x": x})


def applied(spark, frame, column):
    df = spark.createDataFrame(frame.astype({"x": object}).where(frame.notna(), None), "symbol string, ts int, x double")
    return df.withColumn("y", column).orderBy("symbol", "ts").toPandas()["y"].astype(float).to_numpy()


def check(got, want):
    np.testing.assert_allclose(got, want.to_numpy(dtype=float), rtol=1e-9, atol=1e-12, equal_nan=True)


@pytest.mark.parametrize("kind, stat", [("median", "median"), ("mean", "mean"), ("max", "max"), ("min", "min")])
def test_prior(spark, frame, kind, stat):
    want = frame.groupby("symbol")["x"].transform(lambda s: getattr(s.shift(1).rolling(5, min_periods=3), stat)())
    check(applied(spark, frame, w.prior(kind, "x", w.by("symbol"), 5, 3)), want)


def test_trailing_deviation(spark, frame):
    want = frame.groupby("symbol")["x"].transform(lambda s: s.rolling(6, min_periods=2).std(ddof=1))
    check(applied(spark, frame, w.trailing("std1", "x", w.by("symbol"), 6, 2)), want)


def test_ewm_with_gaps(spark, frame):
    want = frame.groupby("symbol")["x"].transform(lambda s: s.ewm(span=3, adjust=False, min_periods=1).mean())
    df = spark.createDataFrame(frame.astype({"x": object}).where(frame.notna(), None), "symbol string, ts int, x double")
    for block in (2, 128):
        got = w.ewm(df, {"m": ("x", 3)}, ["symbol"], ["ts"], block).orderBy("symbol", "ts").toPandas()["m"]
        check(got, want)


def test_trailing_percentile(spark, frame):
    def rank(v):
        v = v.dropna() if isinstance(v, pd.Series) else v[~np.isnan(v)]
        return ((v < v[-1]).sum() + 0.5 * (v == v[-1]).sum()) / len(v) if len(v) >= 2 else np.nan

    want = frame.groupby("symbol")["x"].transform(lambda s: s.rolling(8, min_periods=1).apply(lambda v: np.nan if np.isnan(v[-1]) else rank(v), raw=True))
    want = want.where(frame["x"].notna())
    check(applied(spark, frame, w.trailing_percentile("x", w.by("symbol"), 8, 2)), want)


def test_average_rank(spark):
    df = spark.createDataFrame([(v,) for v in (3, 1, 3, 2)], "x int")
    r = df.withColumn("r", w.average_rank(w.Window.orderBy("x"), w.Window.partitionBy("x"))).orderBy("x").toPandas()["r"].tolist()
    assert r == [1.0, 2.0, 3.5, 3.5]


def test_symbols_dates_clocks(spark):
    raw = ["SH:688183", "300750.SZ", " 600000 ", "430047", "bj： 830799", "12345", None]
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(expr.parse_symbol("r").alias("s")).select("s.*").collect()
    assert [(r["code"], r["exchange"]) for r in got] == [("688183", "SH"), ("300750", "SZ"), ("600000", "SH"), ("430047", "BJ"), ("830799", "BJ"), (None, None), (None, None)]
    got = spark.createDataFrame([("20240229", "93000"), ("2024-02-30", "34200"), ("2024/01/05", "09:30"), (None, "25:00"), ("x", "14:59:59")], "d string, c string").select(expr.parse_date("d").alias("d"), expr.parse_clock("c").alias("c")).collect()
    assert [r["d"] for r in got] == [dt.date(2024, 2, 29), None, dt.date(2024, 1, 5), None, None]
    assert [r["c"] for r in got] == [34200, 34200, 34200, None, 53999]


def test_missing_is_not_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (3.0, None), (4.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(expr.ratio("a", "b")).collect()] == [None, None, None, 2.0]
    assert [r[0] for r in df.select(expr.clip("a", 2, 3)).collect()] == [2.0, None, 3.0, 3.0]
    assert [r[0] for r in df.select(expr.mean_of(["a", "b"], 2)).collect()] == [0.5, None, None, 3.0]
    given = spark.createDataFrame([("Yes",), ("off",), ("maybe",), (None,), (" 1.0 ",), ("",), ("T",)], "s string")
    read = lambda kind, default=False: [r[0] for r in given.select(expr.parse_boolean("s", kind, default, strict=False)).collect()]
    assert read("setting", None) == [True, False, None, None, None, None, None]
    assert read("flag") == [None, None, None, False, True, False, True] and read("feature", True) == [True, None, None, True, True, True, True]
    with pytest.raises(Exception, match="not a boolean: maybe"):
        given.where("s = 'maybe'").select(expr.parse_boolean("s", "setting")).collect()


def bars(spark, n=40, change=None, symbols=("x",)):
    rng = np.random.default_rng(5)
    rows = []
    for s in symbols:
        c = 100.0
        for i in range(n):
            o, c = c, c + float(rng.integers(-3, 4))
            row = [s, dt.date(2024, 1, 1) + dt.timedelta(i), o, max(o, c) + 1, min(o, c) - 1, c, float(rng.integers(50, 150)), 0.0]
            rows.append(row if change is None else change(i, row))
        rng = np.random.default_rng(5)
    return spark.createDataFrame([tuple(r) for r in rows], "symbol string, ts date, open double, high double, low double, close double, volume double, amount double")


def columns(df, *names):
    return [tuple(r[c] for c in names) for r in df.orderBy("symbol", "ts").collect()]


def test_features_do_not_look_ahead(spark):
    def late(i, row):
        return row if i < 30 else [*row[:6], row[6] * 50, row[7]]

    names = ("volume_ratio", "spread_ratio", "trend_return", "ready")
    cfg = vsa.Config(window=5)
    assert columns(vsa.features(bars(spark), cfg), *names)[:30] == columns(vsa.features(bars(spark, change=late), cfg), *names)[:30]


def test_symbols_do_not_mix(spark):
    cfg = vsa.Config(window=5)
    one, two = (columns(vsa.signals(vsa.features(bars(spark, symbols=s), cfg), cfg), "candidate", "status", "signal") for s in (("x",), ("x", "y")))
    assert two == one + one


def test_zero_range_and_missing_bars(spark):
    def flat(i, row):
        return [*row[:2], 50.0, 50.0, 50.0, 50.0, *row[6:]] if i == 10 else [*row[:5], None, *row[6:]] if i == 12 else row

    f = columns(vsa.features(bars(spark, change=flat), vsa.Config(window=5)), "clv", "valid", "reason")
    assert f[10][:2] == (None, True) and f[12][1:] == (False, "missing_required")


def test_rsi_of_rising_prices(spark):
    def rise(i, row):
        return [*row[:2], 10.0 + i, 11.5 + i, 9.5 + i, 11.0 + i, *row[6:]]

    out = columns(technical.outlook(bars(spark, change=rise), technical.Config(daily=(5, 10, 20), weekly=(2, 3, 4))), "rsi", "trend", "week_trend", "drawdown")
    assert out[-1] == (100.0, "uptrend", "uptrend", 0.0)


def test_as_of_previous(spark):
    d = dt.date
    b = spark.createDataFrame([("x", d(2024, 1, k)) for k in range(1, 9)], "symbol string, ts date")
    rec = spark.createDataFrame([("x", d(2024, 1, k), 14.0) for k in (2, 5, 8)], "symbol string, as_of date, trigger double")
    seen = technical.as_of_previous(rec, b).orderBy("ts").collect()
    assert [r["prev_as_of"] and r["prev_as_of"].day for r in seen] == [None, None, 2, 2, 2, 5, 5, 5]


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    x[rng.random((200, 3)) < 0.1] = np.nan
    y = np.nan_to_num(x) @ [1.0, -2.0, 0.5] + rng.normal(size=200)
    df = spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in r], None, float(t)) for r, t in zip(x, y)], "a double, b double, c double, none double, y double")
    m = learning.fit_ridge(df, ["a", "b", "c", "none"], "y", 2.0)
    med = np.nanmedian(x, axis=0)
    z = np.where(np.isnan(x), med, x)
    z = (z - z.mean(0)) / z.std(0)
    want = np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ (y - y.mean()))
    assert m.columns == ("a", "b", "c")
    np.testing.assert_allclose(m.weights, want, rtol=1e-9)
    np.testing.assert_allclose([r[0] for r in df.select(m.score()).collect()], z @ want + y.mean(), rtol=1e-9)


@pytest.mark.parametrize("n, q", [(4, 3), (7, 3), (10, 3), (13, 5), (20, 5), (3, 5)])
def test_event_study_buckets(spark, n, q):
    df = spark.createDataFrame([("g", i, float(i), 1.0) for i in range(n)], "group string, key int, factor double, outcome double")
    got = {r["bucket"]: r["n"] for r in learning.event_study(df, q, 0.0).collect()}
    edges = np.percentile(np.arange(1, n + 1), np.linspace(0, 1, q + 1) * 100)
    want = pd.Series(np.clip(np.searchsorted(edges, np.arange(1, n + 1), "left"), 1, q)).value_counts().to_dict()
    assert got == want


def test_walk_forward_never_sees_the_test_part(spark):
    rows = [(s, k, k + 1, float(s), float(k % 3)) for k in range(30) for s in range(6)]
    df = spark.createDataFrame(rows, "symbol int, session int, label_end int, f double, y double")
    out = learning.walk_forward(df, ["f"], "y", 10, 4, 5, [0.0, 1.0], least=5)
    assert sorted({r["fold"] for r in out.collect()}) == [14, 19, 24, 29]
    assert out.count() == 16 * 6


def test_simulation_fills_and_rules(spark):
    d = [dt.date(2024, 1, k) for k in range(1, 9)]
    rows = [("x", d[i], o, o + 0.2, o - 0.2, o, s) for i, (o, s) in enumerate([(10, 1), (10, 0), (10, 0), (12, 0), (12, 0), (12, 1), (12, 0), (12, 0)])]
    df = spark.createDataFrame([tuple(float(v) if isinstance(v, int) and k not in (6,) else v for k, v in enumerate(r)) for r in rows], "symbol string, ts date, open double, high double, low double, close double, signal int")
    (t,) = backtest.simulate(df, backtest.Rules(cash=100_000, cooldown=10)).collect()
    assert (t["entry_ts"], t["exit_ts"], t["reason"]) == (d[1], d[4], "take_profit")
    assert t["shares"] % 100 == 0 and t["entry_price"] == pytest.approx(10 * 1.0002) and t["pnl"] > 0


def test_running_totals_keep_state(spark, tmp_path):
    from quantloom.streaming import bars as sb

    for i in range(3):
        spark.createDataFrame([(i * 10 + k, "a" if k % 2 else "b", float(k)) for k in range(4)], "event_id long, symbol string, volume double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, symbol string, volume double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    q = sb.running_totals(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["symbol"], r["n"], r["volume"]) for r in got if r["n"] == 6) == [("a", 6, 12.0), ("b", 6, 6.0)]


def test_blended_windows_restart_with_segments(spark):
    # 09:30, 10:00, (10:30 missing), 11:00 | 13:00, 13:30, 14:00 invalid, 14:30 | 15:00 out of session | next date
    minutes = [(1, 570), (1, 600), (1, 660), (1, 780), (1, 810), (1, 840), (1, 870), (1, 900), (2, 570)]
    flow = [0.8, 0.4, -0.6, 0.2, -1.0, 1.0, 0.6, 0.2, -0.4]
    prints = [("x", d, m * 60 + k, 0.0 if m == 840 else 10.0 + k, 50 + side * 50 * f, side, 1, k) for (d, m), f in zip(minutes, flow) for k, side in enumerate((1, -1))]
    cfg = order_flow.Config()
    feat = order_flow.baseline_features(order_flow.flow_bars(spark.createDataFrame(prints, "symbol string, date_key int, second int, price double, volume double, direction int, trade_count int, event_id int"), cfg), cfg)
    out = order_flow.blended_features(feat, cfg)
    rows = out.orderBy("date_key", "minute").collect()
    assert [r["segment"] for r in rows] == [1, 1, 2, 3, 3, 4, 5, 6, 1]
    want = [0.8, 0.6, -0.6, 0.2, -0.4, None, 0.6, 0.2, -0.4]  # span 3: half old, half new; first bars carry nothing over
    assert [r["ema_fast"] for r in rows] == [x if x is None else pytest.approx(x) for x in want]
    assert [r["acceleration"] is None for r in rows] == [True, False, True, True, False, True, True, True, True]
    # a candidate on each bar is confirmed only where the bar before is of its segment
    sure = {"score": 1.0, "confidence": 1.0, "strength": 100.0, "direction_score": 100.0}
    sig = order_flow.blended_signals(out.withColumns({k: F.lit(v) for k, v in sure.items()}), cfg).orderBy("date_key", "minute").collect()
    assert [r["signal"] for r in sig] == [0, 1, 0, 0, 1, 0, 0, 0, 0]


def test_prediction_reasons_in_their_order(spark):
    bar = lambda minute, open_=10.0, f=1.0, valid=True, ready=True, s="x": (s, 1, minute, open_, f, valid, ready)
    rows = [bar(570), bar(600, f=None), bar(630, f=float("inf")), bar(660, open_=0.0), bar(690), bar(720, valid=False), bar(780, valid=False, ready=False), bar(810, ready=False, f=None), bar(840), bar(870, open_=11.0)]
    rows += [bar(570, s="y"), bar(600, s="y", open_=5.0), bar(660, s="y"), bar(780, s="y"), bar(810, s="y", open_=0.0), bar(840, s="y"), bar(870, s="y")]
    df = spark.createDataFrame(rows, "symbol string, date_key int, minute int, open double, factor double, valid boolean, ready boolean")
    out = order_flow.prediction_frame(df, "factor", 30, horizon=1, lags=(1,)).orderBy("symbol", "minute").collect()
    assert [r["invalid_reason"] for r in out] == [
        "", "factor_missing", "factor_non_finite", "current_open_invalid", "future_window_missing", "out_of_session", "invalid_order_flow_data", "history_not_ready", "future_window_missing", "future_window_missing",
        "bar_interval_or_gap", "future_window_missing", "future_window_missing", "future_price_invalid", "current_open_invalid", "future_window_missing", "future_window_missing",
    ]
    assert [r["minute"] for r in out if r["eligible"]] == [570] and out[0]["future_return"] == 0.0 and out[1]["factor_lag_1"] == 1.0
    assert out[6]["factor_lag_1"] is None  # lags end with the half session
    without = order_flow.prediction_frame(df.drop("valid", "ready"), "factor", 30, horizon=1).orderBy("symbol", "minute").collect()
    assert [r["invalid_reason"] for r in without[5:8]] == ["out_of_session", "", "invalid_order_flow_data"]
    assert not order_flow.prediction_frame(df, "factor", 30, horizon=1, require_ready=False).where("invalid_reason = 'history_not_ready'").count()


def vsa_trades(spark, bars, **rules):
    """Trades as (bar of the buy, bar of the sale, price of the sale, reason). bars: open, high, low, close, signal, stop, target; no slippage."""
    d = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(len(bars))]
    rows = [("x", d[i], *(None if v is None else float(v) for v in b[:4]), b[4], *(None if v is None else float(v) for v in b[5:])) for i, b in enumerate(bars)]
    df = spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, signal int, stop double, target double")
    got = backtest.simulate_vsa(df, backtest.VsaRules(slippage=0.0, **rules)).orderBy("entry_ts").collect()
    assert all(t["shares"] == 100 for t in got)
    return [(d.index(t["entry_ts"]), d.index(t["exit_ts"]), round(t["exit_price"], 6), t["reason"]) for t in got]


def test_vsa_strategy_by_hand(spark):
    quiet, buy = (10, 10.2, 9.8, 10, 0, None, None), (10, 10.2, 9.8, 10, 1, 9.509, 11)
    low = (10, 10.2, 9.4, 10, 0, None, None)
    # the stop rests from bar 3 on: the low of bars 1 and 2 passes, bar 3 fills at the stop, rounded down
    assert vsa_trades(spark, [buy, low, low, low, quiet]) == [(1, 3, 9.5, "stop")]
    # a bar that opens below the stop fills at its open
    assert vsa_trades(spark, [buy, quiet, quiet, (9, 9.1, 8.9, 9, 0, None, None), quiet]) == [(1, 3, 9.0, "stop")]
    # closes below the stop on bar 2: the stop goes to 0.997 of that close (8.973, down to 8.97)
    assert vsa_trades(spark, [buy, quiet, (9, 9.1, 8.9, 9, 0, None, None), (9, 9.1, 8.98, 9, 0, None, None), (9, 9.1, 8.96, 9, 0, None, None)]) == [(1, 4, 8.97, "stop")]
    # closes above the target on bar 2: anew at 12 + 2 x (12 - 9.5) = 17, which bar 4 reaches
    up = (12, 12.1, 11.9, 12, 0, None, None)
    assert vsa_trades(spark, [buy, quiet, up, up, (16, 17, 16, 16, 0, None, None), (15, 15, 15, 15, 0, None, None)]) == [(1, 5, 15.0, "take")]
    # a -1 on the day of the buy does nothing, one on the day after sells
    bear = (10, 10.2, 9.8, 10, -1, None, None)
    assert vsa_trades(spark, [buy, bear, quiet, bear, quiet]) == [(1, 4, 10.0, "exit_signal")]
    assert vsa_trades(spark, [buy] + [quiet] * 24) == [(1, 22, 10.0, "max_hold")]
    # no entry without a stop, without a target, or with a target not above the close; nor without cash
    for stop, target in ((None, 11), (9.5, None), (9.5, 10), (float("nan"), 11), (0, 11)):
        assert vsa_trades(spark, [(10, 10.2, 9.8, 10, 1, stop, target)] + [quiet] * 24) == []
    assert vsa_trades(spark, [buy] + [quiet] * 24, cash=999.0) == []


def _simulated(spark, bars, rules):
    """Closed trades of one symbol: (entry day, exit day, reason), days from 1. bars: (open, high, low, close, signal[, valid, session_last])."""
    rows = [("x", dt.date(2024, 1, k), *map(float, b[:4]), b[4], *(b[5:] or (True, False))) for k, b in enumerate(bars, 1)]
    df = spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, signal int, valid boolean, session_last boolean")
    return [(t["entry_ts"].day, t["exit_ts"].day, t["reason"]) for t in backtest.simulate(df, rules).orderBy("entry_ts").collect()]


def test_simulation_counts_from_the_signal_bar(spark):
    flat = (10, 10, 10, 10, 0)
    rules = backtest.Rules(cash=1e6, cooldown=2, stop=0.05, take=0.1, max_hold=4)
    # the fill at 12 is over the target of the signal's close, 11: reached on the first bar after the day of the buy
    assert _simulated(spark, [(10, 10, 10, 10, 1), (12, 12, 12, 12, 0), (12, 12, 12, 12, 0), flat, flat], rules) == [(2, 4, "take_profit")]
    # four bars from the signal, the fill is not counted
    assert _simulated(spark, [(10, 10, 10, 10, 1), *[flat] * 6], rules) == [(2, 6, "max_hold")]
    # stop before target in one bar, and no entry on an invalid bar or in the cooldown that runs from the exit's signal
    both = (10, 20, 1, 10, 1)
    assert _simulated(spark, [(10, 10, 10, 10, 1, False, False), (10, 10, 10, 10, 1), flat, both, (10, 10, 10, 10, 1), flat, (10, 10, 10, 10, 1), *[flat] * 6], rules)[:2] == [(3, 5, "stop_loss"), (8, 12, "max_hold")]
    end = backtest.Rules(cash=1e6, flat_at_session_end=True)
    assert _simulated(spark, [(10, 10, 10, 10, 1), (10, 10, 10, 10, 0, True, True), (10, 10, 10, 10, -1, True, True), flat, flat], end) == [(2, 4, "session_end")]


def test_review_looks_at_stop_and_target_before_the_trigger(spark):
    day = lambda k: dt.date(2024, 1, k)
    records = spark.createDataFrame([("a", day(1), 12.0, 9.0, 15.0), ("a", day(4), 12.0, 9.0, 15.0), ("a", day(7), 12.0, 9.0, 15.0), ("a", day(10), 0.0, 0.0, 0.0)], "symbol string, as_of date, trigger double, stop double, target double")
    rows = [(2, 10, 8), (4, 11, 10), (5, 16, 8), (7, 11, 10), (8, 12, 10)]
    bars = spark.createDataFrame([("a", day(k), float(h), float(lo), 10.0) for k, h, lo in rows], "symbol string, ts date, high double, low double, close double")
    got = {r["as_of"].day: (r["outcome"], r["thesis"], r["n_bars"]) for r in technical.review(records, bars).collect()}
    assert got == {1: ("not_applicable", "not_available", None), 4: ("stop_loss_touched", "invalidated", 2), 7: ("both_levels_touched_order_unknown", "ambiguous", 2), 10: ("trigger_touched_pending", "pending", 1)}


def test_label_convention_ties(spark):
    def convention(minutes):
        df = spark.createDataFrame([("s", 1, m) for m in minutes], "symbol string, day int, minute int")
        return resample.label_convention(df, 30).first()["convention"]

    assert convention([570, 600, 690]) == "floor" and convention([600, 630, 690]) == "ceil"
    assert convention([630, 660, 690]) == "ceil"  # no first label tells; the last one is on the end
    assert convention([630, 660]) == "floor" and convention([570, 660, 810, 900]) == "floor"  # firsts and lasts tie
    assert convention([500, 630, 950]) == "floor"  # labels outside the sessions don't count


def test_stream_of_files_in_any_order_loses_nothing(spark, tmp_path):
    from quantloom.streaming import bars as sb

    rows = [(k, dt.datetime(2024, 1, 1, 9, 0) + dt.timedelta(minutes=3 * k), "a" if k % 3 else "b", float(k)) for k in range(200)]
    for part in (rows[150:], rows[50:100], rows[100:150], rows[:50]):  # newest first
        spark.createDataFrame(part, "event_id long, ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = sb.window_bars(sb.prints_of(sb.event_stream(spark, str(tmp_path / "in"))))
    sb.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    newest = rows[-1][1] - dt.timedelta(minutes=10)
    floor = lambda t: t.replace(minute=t.minute // 30 * 30)
    closed = sum(floor(t) + dt.timedelta(minutes=30) <= newest for _, t, _, _ in rows)
    assert spark.read.parquet(str(tmp_path / "out")).agg({"n": "sum"}).first()[0] == closed


def test_input_checks(spark):
    from quantloom.operators import history, quality

    raw = spark.createDataFrame([("s", 1, "09:31", "10", "1", "1", "7"), ("s", 1, "9:99", "10", "1", "1", "0")], "symbol string, day int, time string, price string, raw_volume string, trade_count string, flag string")
    assert [(r["label"], r["direction"], r["reason"]) for r in quality.normalize_prints(raw).orderBy("time").collect()] == [("unknown", 0, ""), (None, None, "invalid_time")]
    assert quality.normalize_prints(raw, unknown="drop").count() == 1
    with pytest.raises(Exception, match="unknown flag 7"):
        quality.normalize_prints(raw, unknown="error").collect()
    with pytest.raises(ValueError):
        quality.normalize_prints(raw, unknown="guess")
    bars = spark.createDataFrame([("a", 1, 1.0, 2.0, 0.5, 1.5, 3.0), ("a", 1, 1.0, 2.0, 0.5, 1.5, 3.0)], "symbol string, ts int, open double, high double, low double, close double, volume double")
    with pytest.raises(ValueError, match="repeat"):
        quality.require(bars, ["symbol", "ts"], quality.bar_reason())
    with pytest.raises(ValueError, match="invalid_ohlc_order 1"):
        quality.require(bars.limit(1).withColumn("low", bars["high"] + 1), ["symbol", "ts"], quality.bar_reason())
    assert quality.require(bars.limit(1), ["symbol", "ts"], quality.bar_reason()).count() == 1
    with pytest.raises(ValueError, match="columns"):
        quality.resolve(spark.createDataFrame([(1, 2)], "Code int, CODE int"), {"symbol": ("code",)})
    day = spark.createDataFrame([("a", dt.date(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, None, None, None, 1.0, 1.0, 1.0, None)], "symbol string, ts date, open double, high double, low double, close double, prev_close double, change double, pct_change double, volume double, amount double, turnover double, factor double")
    with pytest.raises(Exception, match="no factor: a"):
        history.historical_bars(day, "2024-01-01", "2024-12-31", "daily", "hfq").collect()
    with pytest.raises(ValueError):
        history.historical_bars(day, "2024-02-01", "2024-01-31")
    assert tuple(history.historical_bars(day, "2025-01-01", "2025-12-31", "weekly").columns) == history.SHAPE


def test_walk_forward_equals_fold_by_fold(spark):
    rng = np.random.default_rng(6)
    rows = [(s, k, k + 1 + s % 2, float(rng.normal()) if rng.random() > 0.1 else None, float(rng.normal()), float(rng.normal())) for k in range(26) for s in range(8)]
    df = spark.createDataFrame(rows, "symbol int, session int, label_end int, f double, g double, y double").cache()
    got = {(r["symbol"], r["session"]): (r["fold"], round(r["score"], 9), r["threshold"], r["prediction"]) for r in learning.walk_forward(df, ["f", "g"], "y", 9, 4, 5, [-0.2, 0.0, 0.1], 0.01, least=20).collect()}
    want = {}
    for c in range(13, 26, 5):
        a, b = c - 13, c - 4
        model = learning.fit_ridge(df.where((F.col("session") >= a) & (F.col("session") < b) & (F.col("label_end") < b)), ["f", "g"], "y")
        valid = df.where((F.col("session") >= b) & (F.col("session") < c) & (F.col("label_end") < c))
        cut = learning.choose_threshold(valid.withColumn("score", model.score()), [-0.2, 0.0, 0.1], "y", 0.01)
        model = learning.fit_ridge(df.where((F.col("session") >= a) & (F.col("session") < c) & (F.col("label_end") < c)), ["f", "g"], "y")
        for r in df.where((F.col("session") >= c) & (F.col("session") < c + 5)).withColumn("score", model.score()).collect():
            want[(r["symbol"], r["session"])] = (c, round(r["score"], 9), cut, int(r["score"] >= cut))
    assert got == want


def test_factor_registry_and_bundle(spark, tmp_path):
    from quantloom.operators import factors as fa

    half = fa.Factor("half", "test", "half of x", ("x",), lambda: F.col("x") / 2, "ok", (0.0, 5.0))
    reg = fa.Factors(half)
    assert reg.register(half) is half and reg.definitions() == [("half", "test", "half of x", "x")]
    with pytest.raises(ValueError, match="another factor"):
        reg.register(fa.Factor("half", "test", "other", ("y",), lambda: F.col("y")))
    df = spark.createDataFrame([("a", 4.0, True), ("b", float("inf"), True), ("c", 2.0, False)], "k string, x double, ok boolean")
    made = reg.add(df, "half")
    assert {r["k"]: r["half"] for r in made.collect()} == {"a": 2.0, "b": None, "c": None}
    for bad, why in ((("third",), "no factor"), (("half",), "already")):
        with pytest.raises(ValueError, match=why):
            reg.add(made, *bad)
    with pytest.raises(ValueError, match=r"needs columns \['ok', 'x'\]"):
        reg.add(df.select("k"), "half")
    m = fa.bundle(made, half, str(tmp_path / "b"), ["k"], "here")
    assert (m["rows"], m["missing"]) == (3, 2) and spark.read.parquet(str(tmp_path / "b" / "data")).columns == ["k", "half"]
    assert spark.read.json(str(tmp_path / "b" / "manifest")).first()["bounds"] == [0.0, 5.0]
    with pytest.raises(ValueError, match="out_of_bounds 1"):
        fa.bundle(made.withColumn("half", F.col("half") * 4), half, str(tmp_path / "c"), ["k"], "here")
    with pytest.raises(ValueError, match="repeat"):
        fa.bundle(made.unionByName(made), half, str(tmp_path / "c"), ["k"], "here")
    assert not (tmp_path / "c").exists()


def numpy_ridge(pdf, columns, target, penalty=1.0):
    """A function from rows to scores."""
    med = pdf[columns].median()
    x = pdf[columns].fillna(med)
    mean, scale = x.mean(), x.std(ddof=0)
    z = ((x - mean) / scale).to_numpy()
    y = pdf[target].to_numpy()
    weight = np.linalg.solve(z.T @ z + penalty * np.eye(len(columns)), z.T @ (y - y.mean()))
    return lambda rows: ((rows[columns].fillna(med) - mean) / scale).to_numpy() @ weight + y.mean()


def test_walk_forward_against_numpy(spark):
    r = np.random.default_rng(6)
    pdf = pd.DataFrame([(s, k, k + 1 + (s == 3)) for k in range(40) for s in range(8)], columns=["symbol", "session", "label_end"])
    pdf["f"], pdf["g"] = r.normal(size=len(pdf)), r.normal(size=len(pdf))
    pdf["y"] = 0.5 * pdf["f"] - 0.2 * pdf["g"] + r.normal(size=len(pdf)) * 0.5
    pdf.loc[r.random(len(pdf)) < 0.1, "g"] = np.nan
    df = spark.createDataFrame(pdf.astype({"g": object}).where(pdf.notna(), None), "symbol int, session int, label_end int, f double, g double, y double").repartition(4)
    candidates, cost = [-0.2, 0.0, 0.1, 0.4], 0.01
    got = learning.walk_forward(df, ["f", "g"], "y", 12, 5, 6, candidates, cost, least=20).toPandas().sort_values(["session", "symbol"])
    want = []
    for c in range(17, 40, 6):
        b, a = c - 5, c - 17
        part = lambda lo, hi, end: pdf[(pdf["session"] >= lo) & (pdf["session"] < hi) & (pdf["label_end"] < end)]
        score = numpy_ridge(part(a, b, b), ["f", "g"], "y")
        valid = part(b, c, c)
        net = [(valid["y"] - cost)[score(valid) >= t] for t in candidates]
        able = [(n.mean(), -i) for i, n in enumerate(net) if len(n) >= 10]
        threshold = candidates[-max(able)[1]] if able else np.inf
        test = pdf[(pdf["session"] >= c) & (pdf["session"] < c + 6)].copy()
        test["score"] = numpy_ridge(part(a, c, c), ["f", "g"], "y")(test)
        want.append(test.assign(threshold=threshold, fold=c))
    want = pd.concat(want).sort_values(["session", "symbol"])
    np.testing.assert_allclose(got["score"], want["score"], rtol=1e-8)
    assert (got["threshold"].to_numpy() == want["threshold"].to_numpy()).all() and (got["fold"].to_numpy() == want["fold"].to_numpy()).all()
    assert (got["prediction"].to_numpy() == (want["score"] >= want["threshold"]).astype(int).to_numpy()).all()
    ic = {r["fold"]: r["ic"] for r in learning.summary(spark.createDataFrame(got), "y", cost).collect()}
    for fold, part in want.groupby("fold"):
        assert ic[fold] == pytest.approx(part["score"].rank().corr(part["y"].rank()))


def test_a_candidate_before_an_invalid_bar(spark):
    """A candidate whose next bar can't be used is counted as that, so that the counts add up to the candidates."""
    bars = [(10.0, 10.4, 9.6, 10.0, 100.0)] * 12
    test = (9.75, 9.76, 9.55, 9.72, 50.0)
    rows = [("x", dt.date(2024, 1, 1) + dt.timedelta(days=k), *b) for k, b in enumerate([*bars, test])]
    rows += [("x", dt.date(2024, 2, 1), 10.0, 9.0, 11.0, 10.0, 100.0)]  # high under low
    sig = vsa.signals(vsa.features(spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double"), vsa.Config(window=10)), vsa.Config(window=10))
    found = [(r["candidate"], r["status"]) for r in sig.where("candidate IS NOT NULL").collect()]
    assert ("test", "invalidated_data") in found
    counts = {(r["candidate"], r["status"]): r["n"] for r in vsa.event_counts(sig).collect()}
    assert counts["test", "invalidated_data"] == 1 and sum(counts.values()) == len(found)


def test_catalogues_must_be_sound(spark):
    from quantloom.operators import catalog

    kind = "code string, name string, exchange string, index_type string"
    good = [("885001.TI", " a ", "A", "concept"), ("886001.TI", "b", "A", "concept"), ("885002.TI", "c", "HK", "concept"), ("885003.TI", "c", "A", "industry"), ("884001.TI", "c", "A", "concept"), ("885004.SH", "c", "A", "concept"), (None, "c", "A", "concept")]
    assert [tuple(r) for r in catalog.checked_catalog(spark.createDataFrame(good, kind)).collect()] == [("885001.TI", "a"), ("886001.TI", "b")]
    for extra, said in (([("885001.TI", "z", "A", "concept")], "duplicate_code"), ([("885009.TI", "b", "A", "concept")], "duplicate_name"), ([("885009.TI", " ", "A", "concept")], "empty")):
        with pytest.raises(ValueError, match=said):
            catalog.checked_catalog(spark.createDataFrame(good + extra, kind))
    with pytest.raises(ValueError, match="no concepts"):
        catalog.checked_catalog(spark.createDataFrame(good[2:], kind))

