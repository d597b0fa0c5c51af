"""Queries on models and simulations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import backtest, boosting, learning, vsa
from quantloom.plans.base import Registry, plainly, rounded, whole
from quantloom.plans.market import CFG, SIGNAL_SQL
from quantloom.plans.panel import PANEL_SQL, panel
from quantloom.sources.shared import written
from quantloom.sources.tables import MONTH_BARS, month_bars, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
#: Prices are whole cents: cash is, too.
RULES = backtest.Rules(cash=1e10)
VSA_RULES = backtest.VsaRules(cash=1e10, tick=1.0)
FEATURES = ["ret_1", "ret_5", "dev_5", "dev_10", "volume_ratio"]


def model_rows(spark, sf_dir):
    """The panel with the session in which each label is known: the month after."""
    return panel(spark, sf_dir).where("eligible AND next_return IS NOT NULL").select("symbol", F.col("ts").alias("session"), F.add_months("ts", 1).alias("label_end"), *FEATURES, "next_return")


def _edge(k: int, q: int) -> str:
    at = f"((n - 1) * {(k * (1.0 / q)) * 100 / 100!r}::DOUBLE)"
    return f"(rank > CASE WHEN {at} - floor({at}) >= 0.5 THEN floor({at}) + 2 - (1 - ({at} - floor({at}))) ELSE floor({at}) + 1 + ({at} - floor({at})) END)::INTEGER"


EDGES = " + ".join(_edge(k, 5) for k in range(1, 5))


@query(
    "event_study",
    f"""WITH {PANEL_SQL}, x AS (SELECT year(ts) AS g, dev_5 AS factor, next_return AS outcome, row_number() OVER (PARTITION BY year(ts) ORDER BY dev_5, symbol, ts) AS rank, count(*) OVER (PARTITION BY year(ts)) AS n FROM d WHERE reason IS NULL AND dev_5 IS NOT NULL AND next_return IS NOT NULL)
SELECT g::BIGINT AS "group", (1 + {EDGES})::INTEGER AS bucket, count(*) AS n, round(min(factor), 6) AS low, round(max(factor), 6) AS high, round(avg(factor), 6) AS mean_factor, round(avg(outcome), 6) AS mean_outcome, round(avg(outcome) - 0.001::DOUBLE, 6) AS mean_net, round(avg((outcome > 0)::INTEGER), 6) AS hit_rate FROM x GROUP BY 1, 2""",
)
def event_study(spark, sf_dir):
    rows = panel(spark, sf_dir).where("eligible").select(F.year("ts").cast("bigint").alias("group"), F.struct("symbol", "ts").alias("key"), F.col("dev_5").alias("factor"), F.col("next_return").alias("outcome"))
    return rounded(learning.event_study(rows, 5, 0.001), "group", "bucket", "n", plain=("low", "high", "mean_factor", "mean_outcome", "mean_net", "hit_rate"))


@query("ridge_scores")
def ridge_scores(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    model = learning.fit_ridge(rows, FEATURES, "next_return", 10.0)
    return rounded(rows.withColumn("score", model.score()), "symbol", "session", six=("score", "next_return"))


BOOSTING = boosting.Rules(rounds=10, depth=3, rate=0.2, bins=32, patience=5)


@query("boosted_scores")
def boosted_scores(spark, sf_dir):
    """Trees on the months to 1996, stopped by those of 1997, all months scored."""
    rows = model_rows(spark, sf_dir).withColumn("label", (F.col("next_return") > 0).cast("int"))
    known = rows.where("session < '1998-01-01'")
    model = boosting.fit_boosted(known, FEATURES, "label", F.col("session") >= "1997-01-01", BOOSTING)
    return rounded(rows.withColumn("score", model.probability()), "symbol", "session", "label", six=("score",))


@query("walk_forward")
def walk_forward(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    out = learning.walk_forward(rows, FEATURES, "next_return", 24, 6, 12, [0.0, 0.1, 0.2, 0.5], 0.001)
    return rounded(learning.summary(out, "next_return", 0.001), "fold", "n", "n_predicted", six=("mean_net", "hit_rate"))


_LATEST = PANEL_SQL + """,
r AS (SELECT symbol, ts AS session, ts + INTERVAL 1 MONTH AS label_end, dev_5 AS x, next_return AS y, reason IS NULL AS eligible FROM d WHERE reason IS NULL AND next_return IS NOT NULL), nw AS (SELECT max(session) AS s FROM r),
tr AS (SELECT * FROM r, nw WHERE label_end < s), md AS (SELECT median(x) AS m FROM tr), f AS (SELECT coalesce(x, m) AS x, y FROM tr, md), st AS (SELECT count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) AS cxy FROM f),
w AS (SELECT *, (n * cxy / sx) / (n + 1.0::DOUBLE) AS weight FROM st), l AS (SELECT symbol, session, eligible, my + weight * (coalesce(x, m) - mx) / sx AS score FROM r, nw, md, w WHERE session = s)"""


@query("latest_scores", f"WITH {_LATEST} SELECT symbol, session, round(score, 6) AS score, CASE WHEN eligible AND score >= 0.5::DOUBLE THEN 1 WHEN eligible AND score <= 0.1::DOUBLE THEN -1 ELSE 0 END AS signal FROM l", dates=("session",))
def latest_scores(spark, sf_dir):
    """The newest session scored by what was known before it, and the signals to execute."""
    out = learning.score_latest(model_rows(spark, sf_dir).withColumn("eligible", F.lit(True)), ["dev_5"], "next_return", 1.0)
    return rounded(learning.execution_signals(out, 0.5, 0.1), "symbol", "session", "signal", plain=("score",))


def vsa_sql(r: backtest.VsaRules) -> str:
    """The VSA strategy as a recursive query over the signals: its trades vt(symbol, entry_ts, exit_ts, entry_price, exit_price, shares, pnl, reason, held)."""
    fees, down = f"{r.commission + r.transfer!r}::DOUBLE", lambda x: f"(floor({x} / {r.tick!r}::DOUBLE + 1e-9::DOUBLE) * {r.tick!r}::DOUBLE)"
    return f"""RECURSIVE {SIGNAL_SQL},
s0 AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n, ts, open, high, low, close, signal, stop AS s_stop, CASE WHEN close - stop > 0 THEN close + 2 * (close - stop) END AS s_target FROM g),
m(symbol, n, ts, cash, shares, entry, entry_n, entry_ts, pending, ls, lt, stop, target, reason, price, sold, pnl, held, bought_price, bought_ts) AS (
  SELECT symbol, 0, NULL::DATE, {r.cash!r}::DOUBLE, 0, 0::DOUBLE, 0, NULL::DATE, '', NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR, NULL::DOUBLE, NULL::INTEGER, NULL::DOUBLE, NULL::INTEGER, NULL::DOUBLE, NULL::DATE FROM (SELECT DISTINCT symbol FROM s0)
  UNION ALL
  SELECT symbol, n, ts, cash, shares, entry, entry_n, entry_ts,
    CASE WHEN goes THEN 'buy' WHEN shares = 0 OR NOT ts > entry_ts THEN '' WHEN signal = -1 THEN 'exit_signal' WHEN high >= target THEN 'take' WHEN n - entry_n >= {r.max_hold} THEN 'max_hold' ELSE '' END,
    CASE WHEN goes THEN s_stop WHEN shares > 0 AND NOT ts > entry_ts THEN ls END, CASE WHEN goes THEN s_target WHEN shares > 0 AND NOT ts > entry_ts THEN lt END, stop, target, reason, price, sold, pnl, held, bought_price, bought_ts
  FROM (SELECT * REPLACE (CASE WHEN shares = 0 THEN NULL WHEN sets AND lt <= close THEN close + {r.reward!r}::DOUBLE * (close - stop) WHEN sets THEN lt ELSE target END AS target)
    FROM (SELECT * REPLACE (CASE WHEN shares = 0 THEN NULL WHEN sets THEN CASE WHEN {down('ls')} >= close THEN {down(f'close * {r.gap_stop!r}::DOUBLE')} ELSE {down('ls')} END ELSE stop END AS stop)
      FROM (SELECT *, shares > 0 AND ts > entry_ts AND ls IS NOT NULL AS sets, shares = 0 AND signal = 1 AND coalesce(0 < s_stop AND s_stop < s_target AND s_target > close, false) AS goes
        FROM (SELECT s.symbol, s.n, s.ts, s.high, s.close, s.signal, s.s_stop, s.s_target, CASE WHEN buys THEN cash - {r.size} * bp * (1 + {fees}) WHEN why IS NOT NULL THEN cash + shares * xp * (1 - {fees} - {r.stamp!r}::DOUBLE) ELSE cash END AS cash,
            CASE WHEN buys THEN {r.size} WHEN why IS NOT NULL THEN 0 ELSE shares END AS shares, CASE WHEN buys THEN bp ELSE entry END AS entry, CASE WHEN buys THEN s.n ELSE entry_n END AS entry_n, CASE WHEN buys THEN s.ts ELSE entry_ts END AS entry_ts, ls, lt, stop, target,
            why AS reason, CASE WHEN why IS NOT NULL THEN xp END AS price, CASE WHEN why IS NOT NULL THEN shares END AS sold, CASE WHEN why IS NOT NULL THEN shares * xp * (1 - {fees} - {r.stamp!r}::DOUBLE) - shares * entry * (1 + {fees}) END AS pnl, CASE WHEN why IS NOT NULL THEN s.n - entry_n END AS held, CASE WHEN why IS NOT NULL THEN entry END AS bought_price, CASE WHEN why IS NOT NULL THEN entry_ts END AS bought_ts
          FROM (SELECT *, CASE WHEN why = 'stop' THEN least(open, stop) ELSE open END * (1 - {r.slippage!r}::DOUBLE) AS xp
            FROM (SELECT s0 AS s, s0.open AS open, s0.open * (1 + {r.slippage!r}::DOUBLE) AS bp, z.* EXCLUDE (symbol, n, ts, reason, price, sold, pnl, held, bought_price, bought_ts), z.pending = 'buy' AND {r.size} * s0.open * (1 + {r.slippage!r}::DOUBLE) * (1 + {fees}) <= z.cash AS buys,
                CASE WHEN z.pending = 'buy' OR z.shares = 0 THEN NULL WHEN z.pending <> '' THEN z.pending WHEN s0.low <= z.stop THEN 'stop' END AS why FROM m z JOIN s0 ON s0.symbol = z.symbol AND s0.n = z.n + 1) x0) x1) x2) x3) x4) x5),
vt AS (SELECT symbol, bought_ts AS entry_ts, ts AS exit_ts, bought_price AS entry_price, price AS exit_price, sold AS shares, pnl, reason, held FROM m WHERE reason IS NOT NULL)"""


def _listed(trades):
    """Trades with pnl to two places and shares as a long."""
    return trades.withColumns({"pnl": plainly("pnl", 2), "shares": whole("shares")})


@query("backtest_vsa", f"WITH {vsa_sql(VSA_RULES)} SELECT symbol::VARCHAR AS symbol, entry_ts, exit_ts, shares::BIGINT AS shares, reason, held, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, round(pnl, 2) AS pnl FROM vt", dates=("entry_ts", "exit_ts"))
def backtest_vsa(spark, sf_dir):
    trades = backtest.simulate_vsa(vsa.signals(vsa.features(month_bars(spark, sf_dir), CFG), CFG), VSA_RULES)
    return rounded(_listed(trades), "symbol", "entry_ts", "exit_ts", "shares", "reason", "held", "pnl", plain=("entry_price", "exit_price"))


def simulation_sql(bars: str, rules: backtest.Rules) -> str:
    """The simulation as a recursive query over bars s0(symbol, n from 1, ts, open, high, low, close, signal): its trades t(symbol, entry_ts, exit_ts, entry, price, shares, pnl, reason, held)."""
    r = rules
    buy, sell = f"(open * (1 + {r.slippage!r}::DOUBLE))", f"(s0.open * (1 - {r.slippage!r}::DOUBLE))"
    lots = f"(floor(z.cash / ({buy.replace('open', 's0.open')} * (1 + {r.commission!r}::DOUBLE + {r.transfer!r}::DOUBLE) * {r.lot})) * {r.lot})"
    return f"""{bars},
m(symbol, n, ts, cash, shares, entry, entry_ts, entry_n, pending, free_from, signal_n, ref, pnl, reason, price, sold, held, bought_ts) AS (
  SELECT symbol, 0, NULL::DATE, {r.cash!r}::DOUBLE, 0::DOUBLE, 0::DOUBLE, NULL::DATE, 0, '', 0, 0, 0::DOUBLE, NULL::DOUBLE, NULL::VARCHAR, NULL::DOUBLE, NULL::DOUBLE, NULL::INTEGER, NULL::DATE FROM (SELECT DISTINCT symbol FROM s0)
  UNION ALL
  SELECT y.symbol, y.n, y.ts, y.cash, y.shares, y.entry, y.entry_ts, y.entry_n,
    CASE WHEN y.shares = 0 THEN CASE WHEN y.n - 1 >= y.free_from AND y.signal = 1 THEN 'buy' ELSE '' END ELSE coalesce(y.exit, '') END,
    CASE WHEN y.shares > 0 AND y.exit IS NOT NULL THEN y.n - 1 + {r.cooldown} ELSE y.free_from END,
    CASE WHEN y.shares = 0 AND y.n - 1 >= y.free_from AND y.signal = 1 THEN y.n ELSE y.signal_n END, CASE WHEN y.shares = 0 AND y.n - 1 >= y.free_from AND y.signal = 1 THEN y.close ELSE y.ref END,
    y.pnl, y.reason, y.price, y.sold, y.held, y.bought_ts
  FROM (SELECT x.*, CASE WHEN x.shares > 0 AND x.ts > x.entry_ts AND x.n - x.signal_n >= {r.min_hold} THEN CASE WHEN x.low <= x.ref * (1 - {r.stop!r}::DOUBLE) THEN 'stop_loss' WHEN x.high >= x.ref * (1 + {r.take!r}::DOUBLE) THEN 'take_profit' WHEN x.n - x.signal_n >= {r.max_hold} THEN 'max_hold' WHEN x.signal = -1 THEN 'exit_signal' END END AS exit
    FROM (SELECT s0.symbol, s0.n, s0.ts, s0.low, s0.high, s0.close, s0.signal, z.free_from, z.signal_n, z.ref,
        CASE WHEN z.pending = 'buy' THEN z.cash - {lots} * {buy.replace('open', 's0.open')} * (1 + {r.commission!r}::DOUBLE + {r.transfer!r}::DOUBLE) WHEN z.pending <> '' THEN z.cash + z.shares * {sell} * (1 - {r.commission!r}::DOUBLE - {r.transfer!r}::DOUBLE - {r.stamp!r}::DOUBLE) ELSE z.cash END AS cash,
        CASE WHEN z.pending = 'buy' THEN {lots} WHEN z.pending <> '' THEN 0 ELSE z.shares END AS shares, CASE WHEN z.pending = 'buy' THEN {buy.replace('open', 's0.open')} ELSE z.entry END AS entry, CASE WHEN z.pending = 'buy' THEN s0.ts ELSE z.entry_ts END AS entry_ts, CASE WHEN z.pending = 'buy' THEN s0.n ELSE z.entry_n END AS entry_n,
        CASE WHEN z.pending NOT IN ('', 'buy') THEN z.shares * {sell} * (1 - {r.commission!r}::DOUBLE - {r.transfer!r}::DOUBLE - {r.stamp!r}::DOUBLE) - z.shares * z.entry * (1 + {r.commission!r}::DOUBLE + {r.transfer!r}::DOUBLE) END AS pnl, CASE WHEN z.pending NOT IN ('', 'buy') THEN z.pending END AS reason,
        CASE WHEN z.pending NOT IN ('', 'buy') THEN {sell} END AS price, CASE WHEN z.pending NOT IN ('', 'buy') THEN z.shares END AS sold, CASE WHEN z.pending NOT IN ('', 'buy') THEN s0.n - z.entry_n END AS held, CASE WHEN z.pending NOT IN ('', 'buy') THEN z.entry_ts END AS bought_ts
      FROM m z JOIN s0 ON s0.symbol = z.symbol AND s0.n = z.n + 1) x) y),
t AS (SELECT symbol, bought_ts AS entry_ts, ts AS exit_ts, entry AS entry_price, price AS exit_price, sold AS shares, pnl, reason, held FROM m WHERE reason IS NOT NULL)"""


_MOMENTUM = f"""RECURSIVE {MONTH_BARS}, m0 AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN close > avg(close) OVER w END AS a FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 2 PRECEDING)), k0 AS (SELECT *, lag(a) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM m0),
s0 AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n, ts, open, high, low, close, CASE WHEN a AND NOT p THEN 1 WHEN NOT a AND p THEN -1 ELSE 0 END AS signal FROM k0)"""
MOMENTUM_TRADES = simulation_sql(_MOMENTUM, RULES)


@query("momentum_trades", f"WITH {MOMENTUM_TRADES} SELECT symbol::VARCHAR AS symbol, entry_ts, exit_ts, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, shares::BIGINT AS shares, reason, held, round(pnl, 2) AS pnl FROM t", dates=("entry_ts", "exit_ts"))
def momentum_trades(spark, sf_dir):
    trades = backtest.simulate(backtest.momentum_signals(month_bars(spark, sf_dir)), RULES)
    return rounded(_listed(trades), "symbol", "entry_ts", "exit_ts", "shares", "reason", "held", "pnl", plain=("entry_price", "exit_price"))


_TABLE = f"""RECURSIVE {MONTH_BARS}, g0 AS (SELECT symbol, ts, close < lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS fell FROM b),
s0 AS (SELECT b.symbol, row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts) AS n, b.ts, open, high, low, close, CASE WHEN fell AND month(b.ts) % 5 > 0 THEN 1 ELSE -1 END AS signal FROM b JOIN g0 USING (symbol, ts))"""
#: A signal table is followed as it is: no stops, no target, no cooldown.
TABLE_RULES = backtest.Rules(cash=1e10, stop=10.0, take=1e6, cooldown=0, max_hold=100_000)


@query("signal_table_trades", f"WITH {simulation_sql(_TABLE, TABLE_RULES)} SELECT symbol::VARCHAR AS symbol, entry_ts, exit_ts, shares::BIGINT AS shares, reason, held, round(pnl, 2) AS pnl FROM t", dates=("entry_ts", "exit_ts"))
def signal_table_trades(spark, sf_dir):
    """A table of signals by symbol and day (some days have none) held and left as it says. Cash compounds: shares are null in a trade of more than a long holds, where the SQL raises."""
    from quantloom.functions import windows as w

    b = written(month_bars(spark, sf_dir, ties=True).where("ts IS NOT NULL"), "signal-bars")
    told = b.withColumn("fell", F.col("close") < F.lag("close").over(w.by("symbol"))).where("fell AND month(ts) % 5 > 0").select("symbol", "ts", F.lit(1).alias("signal"))
    trades = backtest.simulate(backtest.table_signals(b, told), TABLE_RULES)
    return _listed(trades).select("symbol", "entry_ts", "exit_ts", "shares", "reason", "held", "pnl")


@query("trade_listing", f"WITH {MOMENTUM_TRADES} SELECT t.symbol::VARCHAR AS symbol, entry_ts, exit_ts, e.close AS entry_close, x.close AS exit_close FROM t JOIN s0 e ON e.symbol = t.symbol AND e.ts = entry_ts JOIN s0 x ON x.symbol = t.symbol AND x.ts = exit_ts", dates=("entry_ts", "exit_ts"))
def trade_listing(spark, sf_dir):
    b = month_bars(spark, sf_dir)
    return backtest.trade_list(backtest.simulate(backtest.momentum_signals(b), RULES), b).select("symbol", "entry_ts", "exit_ts", "entry_close", "exit_close")


@query("backtest_momentum", f"WITH {MOMENTUM_TRADES} SELECT symbol::VARCHAR AS symbol, count(*) AS n_trades, round(count(*) FILTER (pnl > 0) / count(*)::DOUBLE, 6) AS win_rate, round(CASE WHEN sum(greatest(-pnl, 0)) > 0 THEN sum(greatest(pnl, 0)) / sum(greatest(-pnl, 0)) END, 6) AS profit_factor, round(avg(held), 6) AS mean_held, round(sum(pnl) / {RULES.cash!r}::DOUBLE, 6) AS total_return FROM t GROUP BY 1")
def backtest_momentum(spark, sf_dir):
    trades = backtest.simulate(backtest.momentum_signals(month_bars(spark, sf_dir)), RULES)
    return rounded(backtest.trade_metrics(trades, RULES.cash), "symbol", "n_trades", plain=("win_rate", "profit_factor", "mean_held", "total_return"))


@query("momentum_signals", f"WITH {MONTH_BARS}, m AS (SELECT symbol, ts, CASE WHEN count(*) OVER w >= 3 THEN close > avg(close) OVER w END AS a FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 2 PRECEDING)), k AS (SELECT *, lag(a) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM m) SELECT symbol, ts, CASE WHEN a AND NOT p THEN 1 ELSE -1 END AS signal FROM k WHERE a AND NOT p OR NOT a AND p", dates=("ts",))
def momentum_signals(spark, sf_dir):
    return backtest.momentum_signals(month_bars(spark, sf_dir)).where("signal <> 0").select("symbol", "ts", "signal")


@query(
    "equity_metrics",
    f"""WITH {MONTH_BARS}, r AS (SELECT symbol, ts, close, (close - lag(close) OVER s) / lag(close) OVER s AS r0, 1 - close / max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS dd FROM b WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
x AS (SELECT *, CASE WHEN abs(r0) < 1e-12 THEN 0 ELSE r0 END - 0.03::DOUBLE / 12 AS e FROM r),
m AS (SELECT symbol, count(r0) AS n, (arg_max(close, ts) - arg_min(close, ts)) / arg_min(close, ts) AS tr, avg(e) AS me, stddev_pop(e) AS sd, stddev_pop(e) FILTER (e < 0) AS sn, max(dd) AS md FROM x GROUP BY symbol)
SELECT symbol, n, round(tr, 6) AS total_return, round(sd * sqrt(12), 6) AS volatility, round(CASE WHEN sd > 0 THEN me / sd END * sqrt(12), 6) AS sharpe, round(CASE WHEN sn > 0 THEN me / sn END * sqrt(12), 6) AS sortino, round(md, 6) AS max_drawdown, round(CASE WHEN n > 0 AND tr > -1 THEN pow(1 + tr, 12.0::DOUBLE / n) - 1 END, 6) AS annual_return,
  round(CASE WHEN md > 0 THEN least((pow(1 + tr, 12.0::DOUBLE / n) - 1) / md, 999) END, 6) AS calmar FROM m""",
)
def equity_metrics(spark, sf_dir):
    eq = month_bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("equity"))
    return rounded(backtest.equity_metrics(eq, 12), "symbol", "n", plain=("total_return", "volatility", "sharpe", "sortino", "max_drawdown", "annual_return", "calmar"))


@query("daily_equity", "SELECT user_id AS symbol, ts::DATE::VARCHAR AS day, arg_max(value, ts) AS equity FROM events GROUP BY 1, 2")
def daily_equity(spark, sf_dir):
    """The last mark of each day."""
    return backtest.daily_equity(table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), "ts", F.col("value").alias("equity"))).withColumn("day", F.col("day").cast("string"))


@query("buy_and_hold", f"WITH {MONTH_BARS} SELECT symbol, count(*) AS n, round((arg_max(close, ts) - arg_min(open, ts)) / arg_min(open, ts), 6) AS hold_return FROM b GROUP BY symbol HAVING count(*) >= 2")
def buy_and_hold(spark, sf_dir):
    return rounded(backtest.buy_and_hold(month_bars(spark, sf_dir)), "symbol", "n", plain=("hold_return",))


@query("newest_signal", f"WITH {MONTH_BARS}, m AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM b) SELECT symbol, ts, close FROM m WHERE n = 1", dates=("ts",))
def newest_signal(spark, sf_dir):
    return backtest.newest_signal(month_bars(spark, sf_dir)).select("symbol", "ts", "close")
