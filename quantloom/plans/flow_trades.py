"""Queries on the order-flow state machine: batch and stream, lots, performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import flow_machine as fm
from quantloom.operators import order_flow as of
from quantloom.plans import intraday
from quantloom.plans.base import Registry, plain_six, rounded, six
from quantloom.sources.shared import new_path, removed, written
from quantloom.sources.tables import DAILY_PRINTS, daily_prints
from quantloom.streaming import bars as streams
from quantloom.streaming import trades

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
RULES = fm.FlowRules(cash=1e7, stop=0.05, take=0.08)
#: Other sizing, fills at the close, out by the end of a session.
PERCENT = fm.FlowRules(cash=1e6, mode="percent", fraction=0.5, execution="next_close", max_hold=12, cooldown=1, flat_at_session_end=True, slippage=0.5)
FIXED = fm.FlowRules(cash=3e5, mode="fixed", order_size=250, beyond_cash="skip", stop=0.03, min_hold=1, t_plus_one=False)


def machine_sql(bars: str, r: fm.FlowRules) -> str:
    """The machine as a recursive query over s0(symbol, n from 1, ts, date_key, open, high, low, close, valid, entry, exit, last): its fills x(symbol, ts, date_key, side, price, shares, fees, reason, cash)."""
    price = "s0.open" if r.execution == "next_open" else "s0.close"
    lots = lambda money: f"greatest(floor(least({money} / (1 + {r.commission!r}::DOUBLE), {money} - {r.least_commission!r}::DOUBLE) / ((p + {r.slippage!r}::DOUBLE) * {r.lot})) * {r.lot}, 0)"
    able = lots("cash")
    want = {"full": able, "fixed": f"{r.order_size // r.lot * r.lot}::DOUBLE", "percent": lots(f"(cash * {r.fraction!r}::DOUBLE)")}[r.mode]
    held = f"shares > 0 AND n - sig >= {r.min_hold}" + (" AND date_key > bought_on" if r.t_plus_one else "")
    exits = [(r.stop > 0, f"low <= ref * (1 - {r.stop!r}::DOUBLE)", "stop_loss"), (r.take > 0, f"high >= ref * (1 + {r.take!r}::DOUBLE)", "take_profit"), (r.max_hold is not None, f"n - sig >= {r.max_hold}", "max_hold"), (r.flat_at_session_end, "last", "session_end"), (True, "exit", "supply_or_divergence")]
    why = f"CASE WHEN {held} THEN CASE {' '.join(f"WHEN {test} THEN '{name}'" for use, test, name in exits if use)} END END"
    return f"""{bars},
m(symbol, n, ts, date_key, cash, shares, pending, sig, ref, bought_on, free_from, side, price, filled, fees, reason) AS (
  SELECT symbol, 0, NULL::TIMESTAMP, 0, {r.cash!r}::DOUBLE, 0::DOUBLE, '', 0, 0::DOUBLE, 0, 0, NULL::VARCHAR, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR FROM (SELECT DISTINCT symbol FROM s0)
  UNION ALL
  SELECT symbol, n, ts, date_key, cash, shares, CASE WHEN goes THEN 'buy' ELSE coalesce(why, '') END, CASE WHEN goes THEN n ELSE sig END, CASE WHEN goes THEN close ELSE ref END, bought_on, CASE WHEN why IS NOT NULL THEN n + {r.cooldown} ELSE free_from END, side, price, filled, fees, reason
  FROM (SELECT *, shares = 0 AND n >= free_from AND valid AND entry AS goes, {why} AS why
    FROM (SELECT * REPLACE (CASE side WHEN 'buy' THEN cash - (filled * price + fees) WHEN 'sell' THEN cash + filled * price - fees ELSE cash END AS cash, CASE side WHEN 'buy' THEN filled WHEN 'sell' THEN 0 ELSE shares END AS shares, CASE side WHEN 'buy' THEN date_key ELSE bought_on END AS bought_on)
      FROM (SELECT *, CASE side WHEN 'buy' THEN greatest({r.commission!r}::DOUBLE * filled * price, {r.least_commission!r}::DOUBLE) WHEN 'sell' THEN greatest({r.commission!r}::DOUBLE * filled * price, {r.least_commission!r}::DOUBLE) + {r.stamp!r}::DOUBLE * filled * price END AS fees, CASE side WHEN 'buy' THEN '' WHEN 'sell' THEN pending END AS reason
        FROM (SELECT *, CASE WHEN pending = 'buy' AND got > 0 THEN 'buy' WHEN pending NOT IN ('', 'buy') THEN 'sell' END AS side, CASE WHEN pending = 'buy' AND got > 0 THEN p + {r.slippage!r}::DOUBLE WHEN pending NOT IN ('', 'buy') THEN p - {r.slippage!r}::DOUBLE END AS price, CASE WHEN pending = 'buy' THEN got WHEN pending <> '' THEN shares END AS filled
          FROM (SELECT *, CASE WHEN p > 0 THEN CASE WHEN {want} <= {able} THEN {want} ELSE {able if r.beyond_cash == 'reduce' else '0'} END ELSE 0 END AS got
            FROM (SELECT s0.symbol, s0.n, s0.ts, s0.date_key, s0.low, s0.high, s0.close, s0.valid, s0.entry, s0.exit, s0.last, {price} AS p, z.cash, z.shares, z.pending, z.sig, z.ref, z.bought_on, z.free_from FROM m z JOIN s0 ON s0.symbol = z.symbol AND s0.n = z.n + 1) x0) x1) x2) x3) x4) x5),
x AS (SELECT symbol, ts, date_key, side, price, filled::BIGINT AS shares, fees, reason, cash FROM m WHERE side IS NOT NULL)"""


_S0 = f"""RECURSIVE {intraday.SIG_SQL},
s0 AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date_key, minute)::INTEGER AS n, strptime(date_key::VARCHAR || lpad((minute // 60)::VARCHAR, 2, '0') || lpad((minute % 60)::VARCHAR, 2, '0'), '%Y%m%d%H%M') AS ts, date_key, open, high, low, close, true AS valid,
  ready AND coalesce(delta_ratio >= 0.2 AND relative_volume >= 1.2 AND close_location >= 0.6 AND bar_return >= 0 AND vwap_distance >= 0, false) AS entry, ready AND (coalesce(delta_ratio <= -0.2 AND relative_volume >= 1.2 AND close_location <= 0.4, false) OR bearish_absorption OR divergence = 1) AS exit,
  minute + 30 >= 900 AND minute BETWEEN 780 AND 899 AS last FROM h)"""
_FILLS = "SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M') AS ts, date_key, side, shares, reason, round(price, 6) AS price, round(fees, 4) AS fees, round(cash, 2) AS cash FROM x"


def bars(spark, sf_dir):
    return fm.machine_bars(of.baseline_signals(intraday.features(spark, sf_dir), intraday.CFG))


def _shown(fills):
    return fills.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), "date_key", "side", "shares", "reason", plain_six("price").alias("price"), F.round("fees", 4).alias("fees"), F.round("cash", 2).alias("cash"))


@query("flow_fills", f"WITH {machine_sql(_S0, RULES)} {_FILLS}")
def flow_fills(spark, sf_dir):
    return _shown(fm.fills(bars(spark, sf_dir), RULES))


@query("flow_fills_percent", f"WITH {machine_sql(_S0, PERCENT)} {_FILLS}")
def flow_fills_percent(spark, sf_dir):
    """Half the cash, filled at the next close, flat by the session's end."""
    return _shown(fm.fills(bars(spark, sf_dir), PERCENT))


@query("flow_fills_fixed", f"WITH {machine_sql(_S0, FIXED)} {_FILLS}")
def flow_fills_fixed(spark, sf_dir):
    """Fixed orders, skipped where the cash does not reach, sold on any day."""
    return _shown(fm.fills(bars(spark, sf_dir), FIXED))


@query("flow_fills_stream", f"WITH {machine_sql(_S0, RULES)} {_FILLS}")
def flow_fills_stream(spark, sf_dir):
    """The same bars as a stream, week by week, through typed state and timers; then a bar that closes the stream."""
    at = new_path(spark, "flow-stream")
    given = written(bars(spark, sf_dir), "flow-bars")
    week = F.floor(F.day("ts") / 8)
    for k in range(4):
        given.where(week == k).coalesce(1).write.mode("append").parquet(f"{at}/in")
    trades.closing_bar(given).coalesce(1).write.mode("append").parquet(f"{at}/in")
    with trades.rocksdb(spark):
        streams.run_to_end(trades.stream_fills(streams.event_stream(spark, f"{at}/in", files_at_once=1), RULES), f"{at}/out", f"{at}/checkpoint")
    out = written(spark.read.parquet(f"{at}/out"), "flow-fills")
    removed(spark, at)
    return _shown(out)


_LOTS = """b AS (SELECT *, sum(shares) OVER w AS upto FROM f WHERE side = 'buy' WINDOW w AS (PARTITION BY symbol ORDER BY ts, price ROWS UNBOUNDED PRECEDING)), s AS (SELECT *, sum(shares) OVER w AS upto FROM f WHERE side = 'sell' WINDOW w AS (PARTITION BY symbol ORDER BY ts, price ROWS UNBOUNDED PRECEDING)),
c AS (SELECT b.symbol, b.ts AS buy_ts, s.ts AS sell_ts, least(b.upto, s.upto) - greatest(b.upto - b.shares, s.upto - s.shares) AS shares, b.price AS buy_price, s.price AS sell_price, b.fees / b.shares AS bf, s.fees / s.shares AS sf FROM b JOIN s ON s.symbol = b.symbol AND s.upto > b.upto - b.shares AND s.upto - s.shares < b.upto),
l AS (SELECT * FROM c UNION ALL SELECT b.symbol, b.ts, NULL, b.upto - greatest(b.upto - b.shares, coalesce(t.sold, 0)), b.price, NULL, b.fees / b.shares, NULL FROM b LEFT JOIN (SELECT symbol, max(upto) AS sold FROM s GROUP BY 1) t ON t.symbol = b.symbol WHERE b.upto > coalesce(t.sold, 0)),
lots AS (SELECT *, shares * (buy_price + bf) AS cost, shares * (sell_price - sf) - shares * (buy_price + bf) AS pnl, date_diff('day', buy_ts::DATE, sell_ts::DATE)::INTEGER AS held_days FROM l)"""
_PRINT_FILLS = DAILY_PRINTS + """,
f AS (SELECT symbol, day AS ts, CASE direction WHEN 1 THEN 'buy' ELSE 'sell' END AS side, price, sum(volume)::BIGINT AS shares, sum(volume) * price * 0.0003::DOUBLE AS fees FROM p WHERE direction <> 0 GROUP BY 1, 2, 3, 4)"""


def _print_fills(spark, sf_dir):
    """Directed prints as purchases and sales of any size, one for each day, side and price."""
    p = daily_prints(spark, sf_dir).where("direction <> 0")
    side = F.when(F.col("direction") == 1, "buy").otherwise("sell")
    return p.groupBy("symbol", F.col("day").alias("ts"), side.alias("side"), "price").agg(F.sum("volume").cast("bigint").alias("shares")).withColumn("fees", F.col("shares") * F.col("price") * 0.0003)


@query("fifo_lots", f"WITH {_PRINT_FILLS}, {_LOTS} SELECT symbol, buy_ts, sell_ts, buy_price, sell_price, held_days, sum(shares)::BIGINT AS shares, round(sum(cost), 2) AS cost, round(sum(pnl), 2) AS pnl FROM lots GROUP BY ALL", dates=("buy_ts", "sell_ts"))
def fifo_lots(spark, sf_dir):
    """Partial fills matched first in, first out; what is not sold stays open."""
    lots = fm.matched_lots(_print_fills(spark, sf_dir))
    return lots.groupBy("symbol", "buy_ts", "sell_ts", "buy_price", "sell_price", "held_days").agg(F.sum("shares").alias("shares"), F.round(F.sum("cost"), 2).alias("cost"), F.round(F.sum("pnl"), 2).alias("pnl"))


_TRADES = ("win_rate", "profit_factor", "mean_win", "mean_loss", "max_win", "max_loss", "mean_held_days")
TRADE_SQL = """sl AS (SELECT symbol, sell_ts, sum(pnl) AS pnl, sum(held_days) AS days, count(*) AS k, sum(shares) AS shares FROM lots GROUP BY 1, 2),
tr AS (SELECT symbol, count(sell_ts) AS n_trades, count(*) FILTER (pnl > 0) AS n_wins, count(*) FILTER (pnl <= 0) AS n_losses, coalesce(count(*) FILTER (pnl > 0) / nullif(count(sell_ts), 0), 0)::DOUBLE AS win_rate, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gain, coalesce(sum(-pnl) FILTER (pnl <= 0), 0) AS loss,
  coalesce(avg(pnl) FILTER (pnl > 0), 0) AS mean_win, coalesce(avg(pnl) FILTER (pnl <= 0), 0) AS mean_loss, coalesce(max(pnl) FILTER (pnl > 0), 0) AS max_win, coalesce(min(pnl) FILTER (pnl <= 0), 0) AS max_loss, coalesce(sum(days) FILTER (sell_ts IS NOT NULL) / nullif(sum(k) FILTER (sell_ts IS NOT NULL), 0), 0)::DOUBLE AS mean_held_days, coalesce(sum(shares) FILTER (sell_ts IS NULL), 0)::BIGINT AS open_shares FROM sl GROUP BY 1),
tt AS (SELECT *, CASE WHEN loss > 0 THEN gain / loss WHEN gain > 0 THEN 999 ELSE 0 END::DOUBLE AS profit_factor FROM tr)"""


@query("fifo_performance", f"WITH {_PRINT_FILLS}, {_LOTS}, {TRADE_SQL} SELECT symbol, n_trades, n_wins, n_losses, open_shares, {six(*_TRADES)} FROM tt")
def fifo_performance(spark, sf_dir):
    return rounded(fm.trade_report(fm.matched_lots(_print_fills(spark, sf_dir))), "symbol", "n_trades", "n_wins", "n_losses", "open_shares", six=_TRADES)


@query("flow_trade_report", f"WITH {machine_sql(_S0, RULES)}, f AS (SELECT * FROM x), {_LOTS}, {TRADE_SQL} SELECT symbol, n_trades, n_wins, n_losses, open_shares, {six(*_TRADES)} FROM tt")
def flow_trade_report(spark, sf_dir):
    return rounded(fm.trade_report(fm.matched_lots(fm.fills(bars(spark, sf_dir), RULES))), "symbol", "n_trades", "n_wins", "n_losses", "open_shares", six=_TRADES)


_EQUITY = ("end_value", "total_return", "annual_return", "volatility", "sharpe", "sortino", "max_drawdown", "calmar")
EQUITY_SQL = f"""mk AS (SELECT symbol, date_key AS day, arg_max(close, ts) AS close, max(ts) AS ts FROM s0 GROUP BY 1, 2),
eq AS (SELECT mk.symbol, day, CASE WHEN x.side = 'buy' THEN x.shares ELSE 0 END AS shares, coalesce(x.cash, {RULES.cash!r}::DOUBLE) + CASE WHEN x.side = 'buy' THEN x.shares * close ELSE 0 END AS equity FROM mk ASOF LEFT JOIN x ON x.symbol = mk.symbol AND mk.ts >= x.ts),
e1 AS (SELECT *, coalesce(lag(equity) OVER w, {RULES.cash!r}::DOUBLE) AS was, greatest(max(equity) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING), {RULES.cash!r}::DOUBLE) AS peak FROM eq WINDOW w AS (PARTITION BY symbol ORDER BY day)),
e2 AS (SELECT *, CASE WHEN abs((equity - was) / was) < 1e-12 THEN 0 ELSE (equity - was) / was END AS r, (peak - equity) / peak AS dd FROM e1),
e3 AS (SELECT *, r - 0.03::DOUBLE / 252 AS ex, sum((dd <= 0)::INTEGER) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM e2),
e4 AS (SELECT *, sum((dd > 0)::INTEGER) OVER (PARTITION BY symbol, run) AS days FROM e3),
e5 AS (SELECT symbol, count(*) AS sessions, arg_max(equity, day) AS end_value, stddev_pop(r) AS sd, avg(ex) AS me, stddev_pop(ex) FILTER (ex < 0) AS dn, max(dd) AS max_drawdown, max(days)::BIGINT AS max_drawdown_days, arg_max(shares, day)::BIGINT AS open_shares FROM e4 GROUP BY 1),
e6 AS (SELECT *, end_value / {RULES.cash!r}::DOUBLE - 1 AS total_return, pow(end_value / {RULES.cash!r}::DOUBLE, 252.0::DOUBLE / sessions) - 1 AS annual_return, sd * sqrt(252) AS volatility, CASE WHEN sd > 0 THEN me / sd * sqrt(252) ELSE 0 END AS sharpe, CASE WHEN dn > 0 THEN me / dn * sqrt(252) ELSE 0 END AS sortino FROM e5),
e7 AS (SELECT *, CASE WHEN max_drawdown > 1e-12 THEN annual_return / max_drawdown WHEN annual_return > 0 THEN 999 ELSE 0 END AS calmar FROM e6)"""


@query("flow_equity_report", f"WITH {machine_sql(_S0, RULES)}, {EQUITY_SQL} SELECT symbol, sessions, max_drawdown_days, open_shares, {six(*_EQUITY)} FROM e7")
def flow_equity_report(spark, sf_dir):
    """Daily risk of each symbol's run, its starting cash included."""
    given = written(bars(spark, sf_dir), "flow-bars")
    return rounded(fm.equity_report(fm.daily_marks(given, fm.fills(given, RULES), RULES.cash), RULES.cash), "symbol", "sessions", "max_drawdown_days", "open_shares", six=_EQUITY)
