"""Sources by name: a function of (spark, path, ...) that returns a DataFrame, and a line on what it reads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Source:
    name: str
    description: str
    read: Callable[..., DataFrame]


_SOURCES: dict[str, Source] = {}


def source(name: str, description: str):
    """Registers a reader; a name that another reader has is an error."""

    def keep(read):
        if name in _SOURCES and _SOURCES[name].read is not read:
            raise ValueError(f"a source named {name} is there already")
        _SOURCES[name] = Source(name, description, read)
        return read

    return keep


def sources() -> list[Source]:
    return [_SOURCES[n] for n in sorted(_SOURCES)]


def read(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    if name not in _SOURCES:
        raise KeyError(f"no source named {name}; there are {', '.join(sorted(_SOURCES)) or 'none'}")
    return _SOURCES[name].read(spark, path, **options)
