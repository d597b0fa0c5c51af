"""The order-flow state machine in batch and stream, lots, equity, global ranks, long exponential means: against plain Python, numpy and pandas."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict, deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import windows as w
from quantloom.operators import daily, flow_machine as fm, learning, order_flow, ranks, resample
from quantloom.sources.shared import new_path
from quantloom.streaming import bars as streams
from quantloom.streaming import trades


def random_bars(n_symbols=4, days=12, seed=1):
    r, out = random.Random(seed), []
    for k in range(n_symbols):
        price = 50.0
        for d in range(days):
            for i, minute in enumerate([570, 600, 630, 780, 810, 840, 870]):
                if r.random() < 0.1:
                    continue
                o = price * (1 + r.uniform(-0.02, 0.02))
                c = o * (1 + r.uniform(-0.03, 0.03))
                ts = dt.datetime(2024, 1, 1) + dt.timedelta(days=d, minutes=minute)
                out.append((f"S{k}", ts, 20240101 + d, o, max(o, c) * 1.01, min(o, c) * 0.99, c, r.random() < 0.95, r.random() < 0.3, r.random() < 0.25, minute == 870))
                price = c
    return out


def plain_fills(rows, rules):
    out, states = [], {}
    for symbol, *bar in sorted(rows, key=lambda x: (x[0], x[1])):
        state, fill = fm.advance(states.get(symbol, fm.State(rules.cash)), fm.Bar(*bar), rules)
        states[symbol] = state
        if fill:
            out.append((symbol, *fill))
    return out


RULES = [fm.FlowRules(stop=0.03, take=0.04), fm.FlowRules(mode="percent", fraction=0.4, execution="next_close", flat_at_session_end=True, max_hold=6), fm.FlowRules(mode="fixed", order_size=900, beyond_cash="skip", t_plus_one=False, min_hold=0, cooldown=0)]


@pytest.mark.parametrize("rules", RULES)
def test_batch_is_the_machine_symbol_by_symbol(spark, rules):
    rows = random_bars()
    df = spark.createDataFrame(rows, fm.BARS).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # states pass from batch to batch
    try:
        got = sorted(tuple(r) for r in fm.fills(df, rules).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(plain_fills(rows, rules)) and len(got) > 3


def test_hand_worked_fills():
    day = lambda d, m: dt.datetime(2024, 1, d, 10, m)
    bar = lambda d, m, o, h, lo, c, entry=False, exit_=False: fm.Bar(day(d, m), 20240100 + d, o, h, lo, c, True, entry, exit_, False)
    rules = fm.FlowRules(cash=10_000, stop=0.05, min_hold=1, cooldown=2)
    bars = [bar(1, 0, 10, 10, 10, 10, entry=True), bar(1, 1, 11, 11, 9, 10), bar(1, 2, 10, 10, 8, 9, exit_=True), bar(2, 0, 9, 10, 9, 10), bar(2, 1, 10, 10, 9.4, 9.6), bar(2, 2, 9.5, 10, 9, 10, entry=True), bar(2, 3, 10, 10, 9, 10, entry=True), bar(2, 4, 10, 10, 10, 10)]
    state, got = fm.State(rules.cash), []
    for b in bars:
        state, fill = fm.advance(state, b, rules)
        got.append(fill and fill[2:7])
    # bought at 11 for 9,900 plus 5; the low of 8 comes on the day of the purchase, the low of 9 on the next one is under 9.5: sold at the next open
    assert got[1] == ("buy", 11, 900, 5.0, "") and got[2] is None and got[3] is None
    assert got[4][:3] == ("sell", 10, 900) and got[4][4] == "stop_loss" and got[4][3] == pytest.approx(5 + 9)
    # the entry at 2:02 falls into the cooldown no more (two bars after the exit's), so it is bought at 2:03
    assert got[6][0] == "buy" and got[6][2] == 900 and got[7] is None


def test_orders_beyond_the_cash():
    order = fm.State(1000.0, pending="buy", index=0, signal_index=0)
    bar = fm.Bar(dt.datetime(2024, 1, 2), 20240102, 4.0, 4, 4, 4, True, False, False, False)
    for mode, beyond, want in (("full", "reduce", 200), ("fixed", "reduce", 200), ("fixed", "skip", None), ("percent", "reduce", 100)):
        _, fill = fm.advance(order, bar, fm.FlowRules(mode=mode, order_size=350, fraction=0.5, beyond_cash=beyond))
        assert (fill and fill[4]) == want
    with pytest.raises(ValueError, match="mode"):
        fm.FlowRules(mode="all")


def test_stream_in_ten_batches_equals_the_batch_run(spark):
    rows = random_bars(days=20)
    rules, at = RULES[0], new_path(spark, "test-flow-stream")
    r = random.Random(3)
    # bars of a symbol come out of order, up to a day late
    arrival = sorted(rows, key=lambda x: x[1] + dt.timedelta(minutes=r.randrange(0, 1400)))
    step = -(-len(arrival) // 10)
    for k in range(0, len(arrival), step):
        spark.createDataFrame(arrival[k : k + step], fm.BARS).coalesce(1).write.mode("append").parquet(f"{at}/in")
    trades.closing_bar(spark.createDataFrame(rows, fm.BARS)).coalesce(1).write.mode("append").parquet(f"{at}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with trades.rocksdb(spark):
        streams.run_to_end(trades.stream_fills(streams.event_stream(spark, f"{at}/in", files_at_once=1), rules, late="2 days"), f"{at}/out", f"{at}/checkpoint")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = sorted(tuple(x) for x in spark.read.parquet(f"{at}/out").collect())
    assert got == sorted(plain_fills(rows, rules)) and got


def test_no_bars(spark):
    none = spark.createDataFrame([], fm.BARS)
    assert fm.fills(none).count() == 0 and fm.matched_lots(fm.fills(none)).count() == 0 and trades.closing_bar(none).count() == 0


def brute_lots(rows):
    queue, out = defaultdict(deque), defaultdict(int)
    sold = defaultdict(list)
    for symbol, ts, side, price, shares, fees in sorted(rows, key=lambda x: (x[0], x[1], x[2], x[3])):
        (queue if side == "buy" else sold)[symbol].extend([(ts, price, fees / shares)] * shares)
    for symbol, bought in queue.items():
        for k, b in enumerate(bought):
            s = sold[symbol][k] if k < len(sold[symbol]) else None
            out[(symbol, b, s)] += 1
    return out


def test_lots_first_in_first_out(spark):
    r = random.Random(5)
    rows = [(f"S{r.randrange(3)}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * k), r.choice(["buy", "buy", "sell"]), float(r.randrange(10, 20)), r.randrange(1, 9), 0.5) for k in range(120)]
    rows += [("T", dt.datetime(2024, 1, 1), "sell", 3.0, 4, 0.1), ("U", dt.datetime(2024, 1, 1), "buy", 3.0, 4, 0.1)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, side string, price double, shares bigint, fees double").repartition(3)
    got = defaultdict(int)
    for x in fm.matched_lots(df).collect():
        got[(x["symbol"], x["buy_ts"], x["sell_ts"], x["buy_price"], x["sell_price"])] += x["shares"]
        if x["sell_ts"]:
            assert x["pnl"] == pytest.approx(x["proceeds"] - x["cost"]) and x["held_days"] == (x["sell_ts"].date() - x["buy_ts"].date()).days
    want = defaultdict(int)
    for (symbol, b, s), n in brute_lots(rows).items():
        want[(symbol, b[0], s and s[0], b[1], s and s[1])] += n
    assert got == want


def test_trade_report(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [("a", at(1), "buy", 10.0, 100, 0.0), ("a", at(2), "buy", 20.0, 100, 0.0), ("a", at(5), "sell", 16.0, 150, 0.0), ("a", at(9), "sell", 30.0, 10, 0.0), ("b", at(1), "buy", 1.0, 5, 0.0)]
    got = {r["symbol"]: r for r in fm.trade_report(fm.matched_lots(spark.createDataFrame(rows, "symbol string, ts timestamp, side string, price double, shares bigint, fees double"))).collect()}
    a, b = got["a"], got["b"]
    # 150 sold at 16: 100 bought at 10, 50 at 20; then 10 at 30 bought at 20
    assert (a["n_trades"], a["n_wins"], a["n_losses"], a["open_shares"], a["max_win"], a["mean_win"]) == (2, 2, 0, 40, 400.0, 250.0)
    assert a["profit_factor"] == 999.0 and a["mean_held_days"] == pytest.approx((4 + 3 + 7) / 3)
    assert (b["n_trades"], b["open_shares"], b["profit_factor"], b["win_rate"]) == (0, 5, 0.0, 0.0)


def test_equity_report_against_numpy(spark):
    rows = random_bars(3, 30, seed=9)
    rules = RULES[0]
    bars = spark.createDataFrame(rows, fm.BARS).repartition(3)
    got = {r["symbol"]: r for r in fm.equity_report(fm.daily_marks(bars, fm.fills(bars, rules), rules.cash), rules.cash).collect()}
    fills = defaultdict(dict)
    for symbol, ts, _, side, _, shares, *_, cash in plain_fills(rows, rules):
        fills[symbol][ts] = (cash, shares if side == "buy" else 0)
    for symbol in {x[0] for x in rows}:
        cash, shares, path = rules.cash, 0, {}
        for x in sorted(x for x in rows if x[0] == symbol):
            cash, shares = fills[symbol].get(x[1], (cash, shares))
            path[x[2]] = cash + shares * x[6]
        total = np.array([rules.cash, *path.values()])
        ret = np.diff(total) / total[:-1]
        peak = np.maximum.accumulate(total)
        below, longest, run = (peak - total) / peak, 0, 0
        for v in below:
            run = run + 1 if v > 0 else 0
            longest = max(longest, run)
        excess, r = ret - 0.03 / 252, got[symbol]
        assert (r["sessions"], r["max_drawdown_days"], r["open_shares"]) == (len(path), longest, shares)
        np.testing.assert_allclose([r["end_value"], r["total_return"], r["max_drawdown"], r["volatility"], r["sharpe"], r["sortino"]], [total[-1], total[-1] / rules.cash - 1, below.max(), ret.std() * 252**0.5, excess.mean() / ret.std() * 252**0.5, excess.mean() / excess[excess < 0].std() * 252**0.5], rtol=1e-9)


# prints


def test_totals_count_the_prints_own_trades(spark):
    """Two, one and one trades of 300, 200 and 500 shares: four trades of 250."""
    rows = [("s", 1, 10.0, 300.0, 1, 2), ("s", 1, 10.5, 200.0, -1, 1), ("s", 1, 10.25, 500.0, 0, 1)]
    p = spark.createDataFrame(rows, "symbol string, bar int, price double, volume double, direction int, trade_count bigint")
    bars = spark.createDataFrame([("s", 1, 1200.0), ("s", 2, 100.0)], "symbol string, bar int, volume double")
    one, none = resample.join_flow(bars, resample.flow(p, ["symbol", "bar"], 300), ["symbol", "bar"]).orderBy("bar").collect()
    assert (one["trade_count"], one["transaction_rows"], one["average_size"], one["average_amount"]) == (4, 3, 250.0, (3000 + 2100 + 5125) / 4)
    assert (one["buy_trades"], one["sell_trades"], one["neutral_trades"], one["buy_trade_share"], one["sell_trade_share"]) == (2, 1, 1, 0.5, 0.25)
    assert (one["buy_amount"], one["sell_amount"], one["neutral_amount"], one["volume_gap"]) == (3000.0, 2100.0, 5125.0, 200.0)
    assert (one["large_volume"], one["large_buy"], one["large_sell"], one["large_neutral"], one["large_rows"], one["large_delta"]) == (800.0, 300.0, 0.0, 500.0, 2, 300.0)
    assert not none["observed"] and none["trade_count"] is None and none["buy_amount"] is None


def test_session_last_needs_a_session(spark):
    df = spark.createDataFrame([(840,), (870,), (890,), (900,), (720,)], "minute int")
    assert [r["x"] for r in df.withColumn("x", order_flow.session_last()).collect()] == [False, True, True, False, False]


# ranks


@pytest.fixture(scope="module")
def scored(spark):
    r = np.random.default_rng(7)
    n = 600
    pdf = pd.DataFrame({"g": np.where(np.arange(n) < 450, "big", "small"), "k": np.arange(n), "score": np.round(r.normal(size=n), 1), "outcome": r.integers(0, 9, n).astype(float), "label": r.integers(0, 2, n)})
    pdf.loc[::17, "score"] = 0.3  # a value many share
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_ranks_over_range_partitions(spark, scored):
    pdf, df = scored
    got = ranks.average_ranks(df, ["g"], "score", "r").toPandas().sort_values("k")["r"].to_numpy()
    assert (got == pdf.groupby("g")["score"].rank().to_numpy()).all()
    got = ranks.numbered(df, [], ["score", "k"], size="n").toPandas().sort_values("k")
    assert (got["rank"].to_numpy() == pdf.sort_values(["score", "k"]).reset_index().reset_index().sort_values("index")["level_0"].to_numpy() + 1).all() and (got["n"] == len(pdf)).all()


def test_ranks_with_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), ("a", 2.0), ("a", 1.0), ("a", 1.0)], "g string, v double")
    assert sorted((str(r["g"]), str(r["v"]), r["r"]) for r in ranks.average_ranks(df, ["g"], "v", "r").collect()) == [("None", "1.0", 2.0), ("None", "None", 1.0), ("a", "1.0", 1.5), ("a", "1.0", 1.5), ("a", "2.0", 3.0)]
    assert ranks.numbered(df.limit(0), ["g"], ["v"]).count() == 0


def test_auc_and_spearman(spark, scored):
    pdf, df = scored
    for by in ("g", None):
        for r in daily.auc(df, by).collect():
            part = pdf if by is None else pdf[pdf["g"] == r["g"]]
            place = part["score"].rank()
            pos = part["label"] == 1
            want = (place[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
            assert r["auc"] == pytest.approx(want)
    for r in learning.spearman(df, "g").collect():
        part = pdf[pdf["g"] == r["g"]]
        assert r["ic"] == pytest.approx(part["score"].rank().corr(part["outcome"].rank())) and r["n"] == len(part)


def test_a_large_group_is_ranked_in_many_tasks(spark, scored):
    _, df = scored
    out = ranks.running_before(df.select("g", "score", "k").withColumn("one", F.lit(1)), ["g"], ["score", "k"], {"before": "one"})
    assert out.count() == 600
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "partitionBy" not in plan and "windowspecdefinition(_part#" in plan


# exponential means


def test_long_exponential_means(spark):
    r = np.random.default_rng(4)
    n = 3000
    x = r.normal(size=n)
    x[r.random(n) < 0.2] = np.nan
    x[1000:1400] = np.nan
    x[:3] = np.nan
    df = spark.createDataFrame([("s", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)] + [("t", 0, None)], "symbol string, ts int, x double").repartition(3)
    got = w.ewm(df, {"a": ("x", 3), "b": ("x", 48)}, ["symbol"], ["ts"], block=8).orderBy("symbol", "ts").toPandas()
    assert list(got.columns) == ["symbol", "ts", "x", "a", "b"] and got["a"].isna().iloc[-1]
    for c, span in (("a", 3), ("b", 48)):
        np.testing.assert_allclose(got[c].to_numpy()[:-1], pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy(), rtol=1e-9, atol=1e-12)
