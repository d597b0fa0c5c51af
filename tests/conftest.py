from __future__ import annotations

import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    if not os.path.isdir(SMALL):
        pytest.skip("the given tables are not here")
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SMALL}/{t}.parquet"
        path = f"{path}/*.parquet" if glob.glob(f"{path}/*.parquet") else path
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


def normal(rows, columns, order):
    """Rows as sorted tuples of strings, columns by name."""

    def cell(v):
        if v is None or v != v:
            return "-"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    at = [columns.index(c) for c in order]
    return sorted(tuple(cell(r[k]) for k in at) for r in rows)


def same(df, duck, sql):
    """Asserts that a DataFrame has the rows of a query."""
    got = df.collect()
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    assert normal(got, df.columns, order) == normal(want.fetchall(), names, order)
