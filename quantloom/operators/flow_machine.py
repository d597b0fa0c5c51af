"""The order-flow strategy as a state machine over intraday bars: long only, T+1, one position a symbol.

A bar first fills the order that the bar before has left, then decides.  advance() is that step, from a state and a bar to a state and the bar's fill; it is all that
the batch run (here) and the stream (streaming/trades.py) know of the rules.  The batch run sorts bars within partitions and passes a symbol's state from Arrow batch to
Arrow batch, so a symbol's history, however long, is never held.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import floor, isfinite
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FlowRules:
    """Shares: `full` as many as the cash buys, `fixed` order_size, `percent` for `fraction` of the cash, in lots. An order beyond the cash is reduced or skipped."""

    cash: float = 100_000.0
    commission: float = 0.0003
    least_commission: float = 5.0
    stamp: float = 0.001
    slippage: float = 0.0  # money a share
    lot: int = 100
    mode: str = "full"
    order_size: int = 0
    fraction: float = 1.0
    beyond_cash: str = "reduce"
    execution: str = "next_open"
    stop: float = 0.0
    take: float = 0.0
    min_hold: int = 3
    max_hold: int | None = 48
    cooldown: int = 3
    t_plus_one: bool = True
    flat_at_session_end: bool = False

    def __post_init__(self):
        for name, allowed in (("mode", ("full", "fixed", "percent")), ("beyond_cash", ("reduce", "skip")), ("execution", ("next_open", "next_close"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")


class Bar(NamedTuple):
    ts: object
    date_key: int
    open: float
    high: float
    low: float
    close: float
    valid: bool
    entry: bool
    exit: bool
    session_last: bool


class State(NamedTuple):
    cash: float
    shares: int = 0
    pending: str = ""  # `buy`, or why the position is to be sold
    index: int = -1  # of the last bar
    signal_index: int = -1
    reference: float = 0.0  # close of the bar that gave the entry
    bought_on: int = 0
    free_from: int = 0


BARS = "symbol string, ts timestamp, date_key int, open double, high double, low double, close double, valid boolean, entry boolean, exit boolean, session_last boolean"
STATE = "cash double, shares bigint, pending string, index bigint, signal_index bigint, reference double, bought_on int, free_from bigint"
FILLS = "symbol string, ts timestamp, date_key int, side string, price double, shares bigint, fees double, reason string, cash double"


def _wanted(cash: float, price: float, r: FlowRules) -> int:
    """Shares to buy at a price, in lots."""

    def lots(money: float) -> int:
        # commission is a rate, but not under its least: both bounds must hold
        return max(0, floor(min(money / (1 + r.commission), money - r.least_commission) / (price * r.lot))) * r.lot

    able = lots(cash)
    if r.mode == "full":
        return able
    want = r.order_size // r.lot * r.lot if r.mode == "fixed" else lots(cash * r.fraction)
    return want if want <= able else able if r.beyond_cash == "reduce" else 0


def advance(s: State, b: Bar, r: FlowRules) -> tuple[State, tuple | None]:
    """The state after a bar, and its fill: (ts, date_key, side, price, shares, fees, reason, cash), if there is one."""
    cash, shares, pending, i, at, reference, bought_on, free_from = s
    i, fill = i + 1, None
    price = b.open if r.execution == "next_open" else b.close
    if pending == "buy":
        price += r.slippage
        n = _wanted(cash, price, r) if isfinite(price) and price > 0 else 0
        if n:
            fees = max(r.commission * n * price, r.least_commission)
            cash, shares, bought_on = cash - (n * price + fees), n, b.date_key
            fill = (b.ts, b.date_key, "buy", price, n, fees, "", cash)
    elif pending:
        price -= r.slippage
        fees = max(r.commission * shares * price, r.least_commission) + r.stamp * shares * price
        cash += shares * price - fees
        fill = (b.ts, b.date_key, "sell", price, shares, fees, pending, cash)
        shares = 0
    pending = ""
    if not shares:
        if i >= free_from and b.valid and b.entry:
            pending, at, reference = "buy", i, b.close
    elif i - at >= r.min_hold and (not r.t_plus_one or b.date_key > bought_on):
        if r.stop > 0 and b.low <= reference * (1 - r.stop):
            pending = "stop_loss"
        elif r.take > 0 and b.high >= reference * (1 + r.take):
            pending = "take_profit"
        elif r.max_hold is not None and i - at >= r.max_hold:
            pending = "max_hold"
        elif r.flat_at_session_end and b.session_last:
            pending = "session_end"
        elif b.exit:
            pending = "supply_or_divergence"
        if pending:
            free_from = i + r.cooldown
    return State(cash, shares, pending, i, at, reference, bought_on, free_from), fill


def machine_bars(signals: DataFrame) -> DataFrame:
    """Bars with flow signals (symbol, date_key, minute, open, high, low, close, valid, entry_signal, exit_signal, and session_last if they have it) as the machine reads them."""
    last = F.col("session_last") if "session_last" in signals.columns else F.lit(False)
    ts = F.to_timestamp(F.concat(F.col("date_key").cast("string"), F.lpad(F.floor(F.col("minute") / 60).cast("string"), 2, "0"), F.lpad((F.col("minute") % 60).cast("string"), 2, "0")), "yyyyMMddHHmm")
    flag = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))
    return signals.select(F.col("symbol").cast("string").alias("symbol"), ts.alias("ts"), F.col("date_key").cast("int").alias("date_key"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], flag("valid").alias("valid"), flag("entry_signal").alias("entry"), flag("exit_signal").alias("exit"), flag(last).alias("session_last"))


def bars_of(pdf: pd.DataFrame):
    """(symbol, Bar) of each row, in the rows' order."""
    names = ["symbol", *Bar._fields]
    for symbol, *bar in zip(*[pdf[c] for c in names]):
        yield symbol, Bar(*bar)


def fills_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FILLS.split(", ")])


def fills(bars: DataFrame, rules: FlowRules = FlowRules()) -> DataFrame:
    """All fills of each symbol. bars: as machine_bars() gives them, one for each symbol and ts; a bar without prices for an order leaves it unfilled."""

    def run(batches):
        symbol, state = None, State(rules.cash)
        for pdf in batches:
            out = []
            for name, bar in bars_of(pdf):
                if name != symbol:
                    symbol, state = name, State(rules.cash)
                state, fill = advance(state, bar, rules)
                if fill:
                    out.append((name, *fill))
            yield fills_frame(out)

    names = [c.split()[0] for c in BARS.split(", ")]
    return bars.select(*names).repartition("symbol").sortWithinPartitions("symbol", "ts").mapInPandas(run, FILLS)


def matched_lots(fills: DataFrame) -> DataFrame:
    """First in, first out: the k-th share sold of a symbol is the k-th bought. symbol, buy_ts, sell_ts (NULL: still open), shares, buy_price, sell_price, cost, proceeds, pnl, held_days.

    Bought and sold shares are counted up, and the two counts cut the line of shares into pieces with one purchase and at most one sale each, found by windows over both sides in one order: a
    row for each fill and no pairs. Costs and proceeds carry their share of the fees. Shares sold beyond what was bought are left out.
    fills: symbol, ts, side, price, shares, fees; fills of one symbol, ts and side come in the order of price.
    """
    side = lambda k: F.when(F.col("side") == k, F.col("shares")).otherwise(0)
    before = "PARTITION BY symbol ORDER BY ts, side, price ROWS UNBOUNDED PRECEDING"
    f = fills.where("shares > 0").withColumns({"_b": side("buy"), "_s": side("sell")})
    f = f.withColumns({"_bought": F.expr(f"sum(_b) OVER ({before})"), "_sold": F.expr(f"sum(_s) OVER ({before})")})
    f = f.withColumn("_end", F.when(F.col("side") == "buy", F.col("_bought")).otherwise(F.col("_sold")))
    each = F.struct("ts", "price", (F.col("fees") / F.col("shares")).alias("fee"))
    f = f.withColumns({"buy": F.when(F.col("side") == "buy", each), "sell": F.when(F.col("side") == "sell", each)})
    # at each end of a fill a piece ends; its purchase and its sale are the first to reach that far
    line = "PARTITION BY symbol ORDER BY _end, side"
    ahead = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    f = f.withColumns({"_from": F.expr(f"coalesce(lag(_end) OVER ({line}), 0)"), "_buy": F.expr(f"first_value(buy, true) OVER ({line} {ahead})"), "_sell": F.expr(f"first_value(sell, true) OVER ({line} {ahead})")})
    out = f.withColumn("n", F.col("_end") - F.col("_from")).where("n > 0 AND _buy IS NOT NULL")
    cost, proceeds = F.col("n") * (F.col("_buy.price") + F.col("_buy.fee")), F.col("n") * (F.col("_sell.price") - F.col("_sell.fee"))
    return out.select(
        "symbol", F.col("_buy.ts").alias("buy_ts"), F.col("_sell.ts").alias("sell_ts"), F.col("n").alias("shares"), F.col("_buy.price").alias("buy_price"), F.col("_sell.price").alias("sell_price"),
        cost.alias("cost"), proceeds.alias("proceeds"), (proceeds - cost).alias("pnl"), F.date_diff(F.col("_sell.ts").cast("date"), F.col("_buy.ts").cast("date")).alias("held_days"),
    )


def daily_marks(bars: DataFrame, fills: DataFrame, cash: float) -> DataFrame:
    """symbol, day, shares, equity at each day's last bar: cash and shares after the fills so far, at its close. Bars and fills are one order of each symbol, no pairs."""
    marks = bars.groupBy("symbol", F.col("date_key").alias("day")).agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))
    held = F.when(F.col("side") == "buy", F.col("shares")).otherwise(0)
    rows = marks.select("symbol", "ts", F.lit(1).alias("kind"), "day", "close", F.lit(None).cast("struct<cash:double,shares:bigint>").alias("after"))
    rows = rows.unionByName(fills.select("symbol", "ts", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("day"), F.lit(None).cast("double").alias("close"), F.struct("cash", held.cast("bigint").alias("shares")).alias("after")))
    rows = rows.withColumn("after", F.expr("last_value(after, true) OVER (PARTITION BY symbol ORDER BY ts, kind ROWS UNBOUNDED PRECEDING)")).where("kind = 1")
    shares = F.coalesce(F.col("after.shares"), F.lit(0))
    return rows.select("symbol", "day", shares.alias("shares"), (F.coalesce(F.col("after.cash"), F.lit(cash)) + shares * F.col("close")).alias("equity"))


def equity_report(marks: DataFrame, cash: float, periods: int = 252, risk_free: float = 0.03) -> DataFrame:
    """For each symbol, from its daily marks with the starting cash as the point before them: sessions, end value, total and annual return, volatility, Sharpe, Sortino (0 without spread), deepest drawdown and the longest
    run of days below a peak, Calmar (999 for a gain without drawdown), the open position. Changes under 1e-12 are none."""
    s = "PARTITION BY symbol ORDER BY day"
    r = F.when(F.col("_was") != 0, (F.col("equity") - F.col("_was")) / F.col("_was"))
    m = marks.withColumns({"_was": F.expr(f"coalesce(lag(equity) OVER ({s}), {cash!r}D)"), "_peak": F.expr(f"greatest(max(equity) OVER ({s} ROWS UNBOUNDED PRECEDING), {cash!r}D)")})
    m = m.withColumns({"_r": F.when(F.abs(r) < 1e-12, 0.0).otherwise(r), "_dd": F.when(F.col("_peak") != 0, (F.col("_peak") - F.col("equity")) / F.col("_peak")).otherwise(0.0)})
    m = m.withColumns({"_x": F.col("_r") - risk_free / periods, "_run": F.expr(f"count_if(_dd <= 0) OVER ({s} ROWS UNBOUNDED PRECEDING)")})
    m = m.withColumn("_length", F.expr(f"count_if(_dd > 0) OVER (PARTITION BY symbol, _run ORDER BY day ROWS UNBOUNDED PRECEDING)"))
    out = m.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("sessions"), F.max_by("equity", "day").alias("end_value"), F.stddev_pop("_r").alias("_sd"), F.avg("_x").alias("_mean"), F.stddev_pop(F.when(F.col("_x") < 0, F.col("_x"))).alias("_down"),
        F.max("_dd").alias("max_drawdown"), F.max("_length").alias("max_drawdown_days"), F.max_by("shares", "day").alias("open_shares"),
    )
    total = F.col("end_value") / cash - 1
    out = out.withColumn("total_return", total).withColumn("annual_return", F.when(total > -1, F.pow(1 + total, periods / F.col("sessions")) - 1).otherwise(-1.0))
    over = lambda d: F.when(F.col(d) > 0, F.col("_mean") / F.col(d) * periods**0.5).otherwise(0.0)
    calmar = F.when(F.col("max_drawdown") > 1e-12, F.col("annual_return") / F.col("max_drawdown")).when(F.col("annual_return") > 0, 999.0).otherwise(0.0)
    return out.select("symbol", "sessions", "end_value", "total_return", "annual_return", (F.coalesce("_sd", F.lit(0.0)) * periods**0.5).alias("volatility"), over("_sd").alias("sharpe"), over("_down").alias("sortino"), "max_drawdown", "max_drawdown_days", calmar.alias("calmar"), "open_shares")


def trade_report(lots: DataFrame) -> DataFrame:
    """For each symbol, by sale: number, wins, losses (no gain is a loss), win rate, profit factor (999 for gains without losses, 0 without either), mean and extreme wins and losses (0 where there are none), mean days held by lots, and the shares still open."""
    sales = lots.groupBy("symbol", "sell_ts").agg(F.sum("pnl").alias("pnl"), F.sum("held_days").alias("days"), F.count(F.lit(1)).alias("lots"), F.sum("shares").alias("shares"))
    closed, pnl = F.col("sell_ts").isNotNull(), F.col("pnl")
    win, loss = closed & (pnl > 0), closed & (pnl <= 0)
    none = lambda c: F.coalesce(c, F.lit(0.0))
    gain, lost = none(F.sum(F.when(win, pnl))), none(F.sum(F.when(loss, -pnl)))
    return sales.groupBy("symbol").agg(
        F.count_if(closed).alias("n_trades"), F.count_if(win).alias("n_wins"), F.count_if(loss).alias("n_losses"), none(F.count_if(win) / F.nullif(F.count_if(closed), F.lit(0))).alias("win_rate"),
        F.when(lost > 0, gain / F.nullif(lost, F.lit(0.0))).when(gain > 0, 999.0).otherwise(0.0).alias("profit_factor"),
        none(F.avg(F.when(win, pnl))).alias("mean_win"), none(F.avg(F.when(loss, pnl))).alias("mean_loss"), none(F.max(F.when(win, pnl))).alias("max_win"), none(F.min(F.when(loss, pnl))).alias("max_loss"),
        none(F.sum(F.when(closed, F.col("days"))) / F.nullif(F.sum(F.when(closed, F.col("lots"))), F.lit(0))).alias("mean_held_days"), F.coalesce(F.sum(F.when(~closed, F.col("shares"))), F.lit(0)).alias("open_shares"),
    )
