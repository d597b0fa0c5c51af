"""Queries against their SQL to the last bit: no tolerance."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry

LINES = "l_suppkey bigint, l_shipdate timestamp, l_extendedprice double, l_quantity double, l_returnflag string, l_linenumber bigint, l_orderkey bigint, l_partkey bigint"


def both(spark, name, folder, duck, sql=None):
    """Rows of the query and of its SQL, sorted."""
    df = entry.queries()[name](spark, str(folder))
    want = duck.execute(sql or entry.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in df.columns]
    return sorted(map(tuple, df.collect()), key=str), sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=str)


def lines(spark, folder, rows):
    """A folder with line items, and a DuckDB that reads them."""
    spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/lineitem.parquet/*.parquet')")
    return c


def test_signal_table_trades_to_the_last_bit(spark, duck):
    got, want = both(spark, "signal_table_trades", SMALL, duck)
    assert got == want


@pytest.mark.parametrize("name", ["signal_table_trades", "archive_bars"])
def test_prints_equal_in_day_order_and_line(spark, tmp_path, name):
    """Their parts and prices order them, in whichever order they are read."""
    rows = []
    for s in range(4):
        for month, price in enumerate([1000.0, 900.0, 950.0, 990.0, 999.0], 1):
            two = [(s, dt.datetime(1996, month, 5), price + k, 1.0, "N", 1, 7, 9 + k) for k in (0, 50)]
            rows += two if s % 2 else two[::-1]
    got, want = both(spark, name, tmp_path, lines(spark, tmp_path, rows))
    assert len(want) >= 4 and got == want


def test_more_shares_than_a_long_holds(spark, tmp_path):
    """The SQL raises; where its cast gives null instead, all trades are the same."""
    prices = [1000.0, 1.0, 1.0, 1000.0, 1000.0] * 12
    rows = [(3, dt.datetime(1995 + k // 12, 1 + k % 12, 5), p, 1.0, "N", 1, k, 9) for k, p in enumerate(prices)]
    c, sql = lines(spark, tmp_path, rows), entry.oracle_sql()["signal_table_trades"]
    with pytest.raises(duckdb.ConversionException):
        c.execute(sql).fetchall()
    got, want = both(spark, "signal_table_trades", tmp_path, c, sql.replace("shares::BIGINT", "try_cast(shares AS BIGINT)"))
    assert got == want and {r[3] is None for r in got} == {True, False}


def test_prints_without_day_or_price(spark, tmp_path):
    prices = [1000.0, 900.0, None, 990.0, 999.0, 900.0, 950.0, 990.0]
    rows = [(s, dt.datetime(1996, 1 + k, 5), p if s else 900.0 + k % 3, 1.0, "N", 1, k, 9) for s in range(2) for k, p in enumerate(prices)] + [(0, None, 700.0, 1.0, "N", 1, 99, 9)]
    got, want = both(spark, "signal_table_trades", tmp_path, lines(spark, tmp_path, rows))
    assert got == want and got
