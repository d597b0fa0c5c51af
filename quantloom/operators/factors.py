"""Named factors: a registry of column expressions with what they need, and bundles of their values with a contract."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.expr import clip, mean_of, ratio
from quantloom.operators.order_flow import PARTS, SCORE
from quantloom.operators.quality import finite, require


@dataclass(frozen=True)
class Factor:
    """compute makes a column of the inputs; where the column `valid` (if named) is not true the factor is missing."""

    name: str
    category: str
    description: str
    inputs: tuple[str, ...]
    compute: Callable[[], Column]
    valid: str | None = None
    bounds: tuple[float | None, float | None] = (None, None)


class Factors:
    def __init__(self, *factors: Factor):
        self.found: dict[str, Factor] = {}
        for f in factors:
            self.register(f)

    def register(self, factor: Factor) -> Factor:
        """Adds a factor; the same one again changes nothing, another one of its name is an error."""
        old = self.found.setdefault(factor.name, factor)
        if old != factor:
            raise ValueError(f"another factor is called {factor.name}")
        return factor

    def definitions(self) -> list[tuple[str, str, str, str]]:
        """name, category, description, inputs of every factor, by name."""
        return [(f.name, f.category, f.description, ",".join(f.inputs)) for _, f in sorted(self.found.items())]

    def add(self, frame: DataFrame, *names: str) -> DataFrame:
        """frame with the named factors; columns that one needs and frame lacks are an error, and so are columns that a factor would replace."""
        out = {}
        for n in names:
            f = self.found.get(n)
            if f is None:
                raise ValueError(f"no factor {n}")
            lacking = sorted({*f.inputs, *([f.valid] if f.valid else [])} - set(frame.columns))
            if lacking:
                raise ValueError(f"{n} needs columns {lacking}")
            if n in frame.columns:
                raise ValueError(f"there is a column {n} already")
            value = f.compute().cast("double")
            value = F.when(finite(value), value)
            out[n] = F.when(F.col(f.valid), value) if f.valid else value
        return frame.withColumns(out)


ORDER_FLOW = Factors(
    Factor("flow_delta_ratio", "order_flow", "bought less sold volume over all printed volume", ("buy_volume", "sell_volume", "print_volume"), lambda: ratio(F.col("buy_volume") - F.col("sell_volume"), "print_volume"), "valid", (-1.0, 1.0)),
    Factor("flow_blended_score", "order_flow", "mean of the blended components that are there, three at least", SCORE, lambda: clip(mean_of(list(SCORE), 3), -1.0, 1.0), "valid", (-1.0, 1.0)),
    Factor("participation_evidence", "order_flow", "activity, size, imbalance and control in equal parts", PARTS, lambda: clip(25 * sum((F.col(c) for c in PARTS), F.lit(0.0)), 0.0, 100.0), "eligible", (0.0, 100.0)),
)


def bundle(frame: DataFrame, factor: Factor, path: str, keys: list[str], source: str) -> dict:
    """Writes keys and the factor as Parquet under path/data, one row for each key, and a manifest of one JSON line under path/manifest; returns the manifest.

    Repeated keys and values out of the factor's bounds are errors; nothing is written then. Counts come from one aggregate.
    """
    low, high = factor.bounds
    value = F.col(factor.name)
    outside = F.lit(False)
    if low is not None:
        outside = outside | F.coalesce(value < low, F.lit(False))
    if high is not None:
        outside = outside | F.coalesce(value > high, F.lit(False))
    data = require(frame.select(*keys, value), keys, F.when(outside, "out_of_bounds").otherwise(""))
    data.write.mode("overwrite").parquet(f"{path}/data")
    spark = frame.sparkSession
    n = spark.read.parquet(f"{path}/data").agg(F.count(F.lit(1)).alias("rows"), F.count_if(value.isNull()).alias("missing")).first()
    manifest = {"name": factor.name, "category": factor.category, "description": factor.description, "inputs": list(factor.inputs), "bounds": list(factor.bounds), "keys": keys, "rows": n["rows"], "missing": n["missing"], "source": source}
    kind = "name string, category string, description string, inputs array<string>, bounds array<double>, keys array<string>, rows long, missing long, source string"
    spark.createDataFrame([tuple(manifest.values())], kind).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest
