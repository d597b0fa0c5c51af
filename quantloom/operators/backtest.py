"""Long-only simulation of signals, symbol by symbol, and metrics of the result.

Each symbol is a state machine over its bars in order.  Symbols are dealt over the cluster; a symbol's bars are one group, in order of ts.
Fills: a signal at a bar's close fills at the next bar's open, with slippage; lots of 100; sells not on the day of the buy.
A resting stop fills in the first later bar that reaches it: at the open if that is not above the stop, else at the stop.
Numbers of shares are doubles: cash that compounds buys more than a long holds.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import floor, inf, isfinite

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import windows as w
from quantloom.functions.expr import ratio


@dataclass(frozen=True)
class Rules:
    cash: float = 1_000_000.0
    commission: float = 0.0003
    stamp: float = 0.001
    transfer: float = 0.00001
    slippage: float = 0.0002
    lot: int = 100
    min_hold: int = 1
    max_hold: int = 48
    stop: float = 0.05
    take: float = 0.10
    cooldown: int = 3
    flat_at_session_end: bool = False


TRADE = "symbol string, entry_ts date, exit_ts date, entry_price double, exit_price double, shares double, pnl double, reason string, held int"


def _trades(pdf: pd.DataFrame, rules: Rules) -> list[tuple]:
    pdf = pdf.sort_values("ts", kind="mergesort")
    ts, op, hi, lo, cl, sig, valid, last = (pdf[c].tolist() for c in ("ts", "open", "high", "low", "close", "signal", "valid", "session_last"))
    bought, sold = 1 + rules.commission + rules.transfer, 1 - rules.commission - rules.transfer - rules.stamp
    out, cash, shares, entry, entry_at, pending, free_from, signal_at, reference = [], rules.cash, 0.0, 0.0, -1, "", 0, -1, 0.0
    for i in range(len(ts)):
        if pending == "buy" and shares == 0:
            price = op[i] * (1 + rules.slippage)
            lots = cash / (price * bought * rules.lot) if price else inf
            shares = (floor(lots) if isfinite(lots) else lots) * float(rules.lot)
            if shares:
                cash -= shares * price * bought  # in this order, as in the SQL: sums of 1e20 show the last bit
                entry, entry_at = price, i
        elif pending and shares and pending != "buy":
            price = op[i] * (1 - rules.slippage)
            got, paid = shares * price * sold, shares * entry * bought
            out.append((str(pdf["symbol"].iloc[0]), ts[entry_at], ts[i], entry, price, shares, got - paid, pending, i - entry_at))
            cash += got
            shares = 0.0
        pending = ""
        if shares == 0:
            if i >= free_from and valid[i] and sig[i] == 1:
                pending, signal_at, reference = "buy", i, cl[i]
        elif shares > 0 and ts[i] > ts[entry_at] and i - signal_at >= rules.min_hold:  # bought at an open that is missing: held for good
            if lo[i] <= reference * (1 - rules.stop):
                pending = "stop_loss"
            elif hi[i] >= reference * (1 + rules.take):
                pending = "take_profit"
            elif i - signal_at >= rules.max_hold:
                pending = "max_hold"
            elif rules.flat_at_session_end and last[i]:
                pending = "session_end"
            elif sig[i] == -1:
                pending = "exit_signal"
            if pending:
                free_from = i + rules.cooldown
    return out


def simulate(signals: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Closed trades of each symbol. signals: symbol, ts (date), open, high, low, close, signal (1 entry, -1 exit, 0), and if they are there valid (else true) and session_last (else
    false); a symbol's bars are one group.

    Entries need a valid bar. Stop and target are shares of the close of the entry's signal bar, and the hold is counted from it; exits wait for a bar after the day of the buy, in the
    order stop_loss, take_profit, max_hold, session_end (if flat_at_session_end), exit_signal. The cooldown runs from the exit's signal bar.
    """
    for c, value in (("valid", True), ("session_last", False)):
        if c not in signals.columns:
            signals = signals.withColumn(c, F.lit(value))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_trades(pdf, rules), columns=[c.split()[0] for c in TRADE.split(", ")])

    return signals.select(F.col("symbol").cast("string").alias("symbol"), "ts", "open", "high", "low", "close", "signal", F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("session_last", F.lit(False)).alias("session_last")).groupBy("symbol").applyInPandas(run, TRADE)


def table_signals(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Bars with the signal of their symbol and day from a table (symbol, ts, signal), 0 where it has none: 1 is held, anything else is left."""
    found = bars.join(signals.select("symbol", "ts", F.col("signal").alias("_s")), ["symbol", "ts"], "left")
    return found.withColumn("signal", F.when(F.coalesce("_s", F.lit(0)) == 1, 1).otherwise(-1)).drop("_s")


def trade_list(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Trades with the closes of the bars they were filled in, found by symbol and day."""
    at = bars.select(F.col("symbol").cast("string").alias("symbol"), "ts", "close")
    entry = at.select("symbol", F.col("ts").alias("entry_ts"), F.col("close").alias("entry_close"))
    return trades.join(entry, ["symbol", "entry_ts"], "left").join(at.select("symbol", F.col("ts").alias("exit_ts"), F.col("close").alias("exit_close")), ["symbol", "exit_ts"], "left")


@dataclass(frozen=True)
class VsaRules:
    cash: float = 1_000_000.0
    commission: float = 0.0003
    stamp: float = 0.001
    transfer: float = 0.00001
    slippage: float = 0.0002
    size: int = 100
    max_hold: int = 20
    gap_stop: float = 0.997
    reward: float = 2.0
    tick: float = 0.01


def _vsa_trades(pdf: pd.DataFrame, rules: VsaRules) -> list[tuple]:
    pdf = pdf.sort_values("ts", kind="mergesort")
    ts, op, hi, lo, cl, sig, stops, targets = (pdf[c].tolist() for c in ("ts", "open", "high", "low", "close", "signal", "stop", "target"))
    fees = rules.commission + rules.transfer
    down = lambda x: floor(x / rules.tick + 1e-9) * rules.tick
    out, cash, shares, entry, entry_at, pending = [], rules.cash, 0, 0.0, -1, ""
    levels = stop = target = None
    for i in range(len(ts)):
        if pending == "buy":
            price = op[i] * (1 + rules.slippage)
            if rules.size * price * (1 + fees) <= cash:
                shares, entry, entry_at = rules.size, price, i
                cash -= shares * price * (1 + fees)
        elif shares:
            reason, price = pending, op[i]
            if not reason and stop is not None and lo[i] <= stop:
                reason, price = "stop", min(op[i], stop)
            if reason:
                price *= 1 - rules.slippage
                got, paid = shares * price * (1 - fees - rules.stamp), shares * entry * (1 + fees)
                out.append((str(pdf["symbol"].iloc[0]), ts[entry_at], ts[i], entry, price, shares, got - paid, reason, i - entry_at))
                cash += got
                shares = 0
        pending = ""
        if shares == 0:
            levels = stop = target = None
            if sig[i] == 1 and stops[i] is not None and targets[i] is not None and isfinite(stops[i]) and isfinite(targets[i]) and 0 < stops[i] < targets[i] and targets[i] > cl[i]:
                pending, levels = "buy", (stops[i], targets[i])
        elif ts[i] > ts[entry_at]:
            if levels:
                stop, target = down(levels[0]), levels[1]
                if stop >= cl[i]:
                    stop = down(cl[i] * rules.gap_stop)
                if target <= cl[i]:
                    target = cl[i] + rules.reward * (cl[i] - stop)
                levels = None
            if sig[i] == -1:
                pending = "exit_signal"
            elif hi[i] >= target:
                pending = "take"
            elif i - entry_at >= rules.max_hold:
                pending = "max_hold"
    return out


def simulate_vsa(signals: DataFrame, rules: VsaRules = VsaRules()) -> DataFrame:
    """Closed trades of each symbol under the rules of the VSA strategy. signals: as for simulate(), with stop and target of the confirming bar.

    Enters `size` shares on a 1 with a finite stop above zero and a target above stop and close. On the first bar after the day of the buy the stop,
    rounded down to the tick, is set to rest from the next bar; a stop not below the close is set to gap_stop of it, and a target not above the close
    anew at `reward` times the risk. Exits at the next open after a -1, a high at the target, or max_hold bars (the bar of the buy is bar 0). Each
    position gets its stop, also one entered on the very bar in which the last stop filled (the reference sets none then).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_vsa_trades(pdf, rules), columns=[c.split()[0] for c in TRADE.split(", ")])

    return signals.select(F.col("symbol").cast("string").alias("symbol"), "ts", "open", "high", "low", "close", "signal", "stop", "target").groupBy("symbol").applyInPandas(run, TRADE)


def trade_metrics(trades: DataFrame, cash: float = Rules.cash) -> DataFrame:
    """For each symbol: trades, wins, profit factor, mean bars held, total return on its cash."""
    gain, loss = F.sum(F.greatest("pnl", F.lit(0.0))), F.sum(F.greatest(-F.col("pnl"), F.lit(0.0)))
    return trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_trades"), ratio(F.count_if(F.col("pnl") > 0), F.count(F.lit(1))).alias("win_rate"), ratio(gain, loss).alias("profit_factor"), F.avg("held").alias("mean_held"), (F.sum("pnl") / cash).alias("total_return"))


def equity_metrics(equity: DataFrame, periods: int = 252, risk_free: float = 0.03) -> DataFrame:
    """For each symbol from its equity path (symbol, ts, equity): total and annual return, population volatility, Sharpe, Sortino, deepest drawdown, Calmar (at most 999)."""
    s = w.by("symbol")
    rf = risk_free / periods
    r = ratio(F.col("equity") - F.lag("equity").over(s), F.lag("equity").over(s))
    path = equity.withColumns({"r": F.when(F.abs(r) < 1e-12, 0.0).otherwise(r), "dd": w.drawdown("equity", s)}).withColumn("excess", F.col("r") - rf)
    total = ratio(F.max_by("equity", "ts") - F.min_by("equity", "ts"), F.min_by("equity", "ts"))
    out = path.groupBy("symbol").agg(F.count("r").alias("n"), total.alias("total_return"), F.avg("excess").alias("mean_excess"), F.stddev_pop("excess").alias("deviation"), F.stddev_pop(F.when(F.col("excess") < 0, F.col("excess"))).alias("downside"), F.max("dd").alias("max_drawdown"))
    annual = F.when((F.col("n") > 0) & (F.col("total_return") > -1), F.pow(1 + F.col("total_return"), periods / F.col("n")) - 1)
    out = out.withColumn("annual_return", annual)
    return out.select("symbol", "n", "total_return", "annual_return", (F.col("deviation") * np.sqrt(periods)).alias("volatility"), (ratio("mean_excess", "deviation") * np.sqrt(periods)).alias("sharpe"), (ratio("mean_excess", "downside") * np.sqrt(periods)).alias("sortino"), "max_drawdown", F.least(ratio("annual_return", "max_drawdown"), F.lit(999.0)).alias("calmar"))


def daily_equity(marks: DataFrame) -> DataFrame:
    """The last mark of each symbol and day. marks: symbol, ts, equity."""
    return marks.groupBy("symbol", F.col("ts").cast("date").alias("day")).agg(F.max_by("equity", "ts").alias("equity"))


def momentum_signals(bars: DataFrame, n: int = 3) -> DataFrame:
    """1 when a close rises above the mean of the last n, -1 when it falls below."""
    mean = w.trailing("mean", "close", w.by("symbol"), n)
    out = bars.withColumn("_above", F.col("close") > mean)
    was = F.lag("_above").over(w.by("symbol"))
    return out.withColumn("signal", F.when(F.col("_above") & ~was, 1).when(~F.col("_above") & was, -1).otherwise(0)).drop("_above")


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """First open to last close of symbols with two bars or more."""
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), ratio(F.max_by("close", "ts") - F.min_by("open", "ts"), F.min_by("open", "ts")).alias("hold_return")).where("n >= 2")


def newest_signal(signals: DataFrame) -> DataFrame:
    """Each symbol's newest row."""
    s = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    return signals.withColumn("_n", F.row_number().over(s)).where("_n = 1").drop("_n")
