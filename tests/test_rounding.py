"""Ties in the sixth place: SQL that rounds plainly takes halves away from zero."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from conftest import same

import __spark_entry__ as entry


def _against_sql(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    out = entry.queries()[name](spark, str(folder))
    same(out, c, entry.oracle_sql()[name])
    return out.collect()


@pytest.mark.parametrize("name", ["bars_with_flow", "print_totals"])
def test_bars_with_flow_ties(spark, tmp_path, name):
    day = dt.date(1996, 3, 5)
    rows = [(s, day, 100.0, q, f, n, s, 1) for s in (1, 2) for n, (q, f) in enumerate([(175.0, "A" if s == 1 else "R"), (81.0, "R" if s == 1 else "A"), (9.0, "N")], 1)]
    out = _against_sql(spark, tmp_path, name, "lineitem", rows, "l_suppkey bigint, l_shipdate date, l_extendedprice double, l_quantity double, l_returnflag string, l_linenumber bigint, l_orderkey bigint, l_partkey bigint")
    if name == "bars_with_flow":
        assert {r["symbol"]: r["delta_ratio"] for r in out} == {1: -0.367188, 2: 0.367188}  # 94 of 256: 0.3671875


def test_forward_labels_ties(spark, tmp_path):
    opens = [0.0, 280.0, 100.0, 54.0]  # bars three hours apart; from 1280 to 1054 less costs: -0.1771625
    rows = [(n, 3, dt.datetime(2024, 1, 2, 3 * n), "view", v) for n, v in enumerate(opens)]
    out = _against_sql(spark, tmp_path, "forward_labels", "events", rows, "event_id bigint, user_id bigint, ts timestamp, event_type string, value double")
    assert [r["net_return"] for r in out if r["net_return"] is not None] == [-0.177163]
