"""The order-flow state machine on a stream of bars.

Bars of a symbol wait in a list state until the watermark has passed them: only then is their order known.  A timer at the earliest waiting bar brings them to the machine, whose
state is a typed value.  However the bars are cut into micro-batches, and in whatever order those bring them within the watermark, the fills are those of the batch run.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quantloom.operators.flow_machine import BARS, FILLS, STATE, Bar, FlowRules, State, advance, bars_of, fills_frame

_WAITING = BARS.removeprefix("symbol string, ")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class FlowTrader(StatefulProcessor):
    def __init__(self, rules: FlowRules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", STATE)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            bars = [tuple(_plain(b)) for _, b in bars_of(pdf)]
            self.waiting.appendList(bars)
            least = min(b[0] for b in bars)
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(_millis(first))
        yield fills_frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        bars = sorted((Bar(*b) for b in self.waiting.get()), key=lambda b: b.ts)
        ripe, rest = [b for b in bars if _millis(b.ts) <= mark], [b for b in bars if _millis(b.ts) > mark]
        if not ripe:  # an earlier timer of this watermark has taken them
            return
        state = State(*self.machine.get()) if self.machine.exists() else State(self.rules.cash)
        out = []
        for bar in ripe:
            state, fill = advance(state, bar, self.rules)
            if fill:
                out.append((key[0], *fill))
        self.machine.update(tuple(state))
        if rest:
            self.waiting.put([tuple(b) for b in rest])
            self.handle.registerTimer(_millis(rest[0].ts))
        else:
            self.waiting.clear()
        yield fills_frame(out)

    def close(self) -> None:
        pass


def _plain(b: Bar) -> list:
    """A bar in Python's own types, as states hold them."""
    return [pd.Timestamp(b.ts).to_pydatetime(), int(b.date_key), *[float(x) for x in b[2:6]], *[bool(x) for x in b[6:]]]


def _millis(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


def stream_fills(bars: DataFrame, rules: FlowRules = FlowRules(), late: str = "1 day") -> DataFrame:
    """Fills of a stream of bars (columns as machine_bars() gives them), in append mode; bars later than `late` behind the newest are dropped. Needs the RocksDB state store: see rocksdb()."""
    marked = bars.withWatermark("ts", late)
    # timers and states count in UTC
    return marked.groupBy("symbol").transformWithStateInPandas(FlowTrader(rules), outputStructType=FILLS, outputMode="append", timeMode="EventTime")


@contextmanager
def rocksdb(spark: SparkSession):
    """While streams with typed state are started, the session names RocksDB as their state store."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def closing_bar(bars: DataFrame, days: int = 30) -> DataFrame:
    """A bar of no symbol (`~`) `days` after the newest: once a stream has read it, all others have been to the machine."""
    one = bars.agg((F.max("ts") + F.make_dt_interval(F.lit(days))).alias("ts"))
    none = {"symbol": F.lit("~"), "ts": F.col("ts"), "date_key": F.lit(0)} | {c: F.lit(0.0) for c in ("open", "high", "low", "close")} | {c: F.lit(False) for c in ("valid", "entry", "exit", "session_last")}
    return one.where("ts IS NOT NULL").select(*[v.alias(k) for k, v in none.items()])
