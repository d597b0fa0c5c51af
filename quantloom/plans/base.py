"""Registration of queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


HAIR = 1e-11


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
        """Registers a function of (spark, sf_dir). Columns in `dates` are dates; both sides return them as YYYY-MM-DD."""

        def keep(f):
            def run(spark, sf_dir):
                return f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in dates})

            self.queries[name] = run if dates else f
            if sql:
                self.oracles[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DATE)::VARCHAR AS {c}' for c in dates)}) FROM ({sql}) z" if dates else sql
            return f

        return keep


def plainly(c: str, places: int) -> Column:
    """Places as the SQL's plain round(x, places) takes them: of the product with a power of ten, halves away from zero."""
    return F.round(F.col(c) * 10.0**places) / 10.0**places


def whole(c: str) -> Column:
    """A double without a fraction as a long; null beyond the range of longs, where the SQL's cast raises."""
    return F.when(F.abs(F.col(c)) < 2.0**63, F.col(c).cast("bigint"))


def plain_six(c: str) -> Column:
    return plainly(c, 6)


def rounded(df: DataFrame, *keep: str, six: tuple[str, ...] = (), plain: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` as they are, `six` and `plain` to six places; no negative zeros.

    To those in `six` a hair is added, so that what lies between two such numbers goes the same way in every engine; their SQL is six(). `plain` are for SQL that rounds without it.
    """
    return df.select(*keep, *[(F.round(F.col(c) + HAIR, 6) + 0.0).alias(c) for c in six], *[(plain_six(c) + 0.0).alias(c) for c in plain])


def six(*names: str) -> str:
    return ", ".join(f"round({n} + {HAIR!r}::DOUBLE, 6) + 0.0::DOUBLE AS {n}" for n in names)
