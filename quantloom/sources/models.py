"""A store of fitted models.

A model is a JSON file named by its content; the manifest, written last and put in place by a rename, says which file is the model and what it was fitted with.  A reader
finds the old model or the new one, never half of one.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from quantloom.operators.boosting import Boosted, Tree
from quantloom.operators.learning import Ridge

MANIFEST = "manifest.json"


@dataclass(frozen=True)
class Loaded:
    """A model, or why there is none: missing, missing_metadata, invalid_metadata, fingerprint_mismatch, corrupt."""

    model: Ridge | Boosted | None
    reason: str | None = None
    fingerprint: str | None = None
    params: dict | None = None
    threshold: float | None = None


def fingerprint(rows: DataFrame, columns: list[str], config: dict) -> str:
    """SHA-256 of what a fit depends on: the columns with their types (their order does not matter) and a configuration that JSON can hold."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return hashlib.sha256(json.dumps({"columns": sorted((c, types[c]) for c in columns), "config": config}, sort_keys=True).encode()).hexdigest()


def _packed(model: Ridge | Boosted) -> bytes:
    return json.dumps({"kind": type(model).__name__, "model": asdict(model)}, sort_keys=True).encode()


def _unpacked(raw: bytes) -> Ridge | Boosted:
    value = json.loads(raw)
    tuples = lambda x: tuple(map(tuples, x)) if isinstance(x, list) else x
    fields = {k: v for k, v in value["model"].items()}
    if value["kind"] == "Ridge":
        return Ridge(**{k: tuples(v) for k, v in fields.items()})
    if value["kind"] == "Boosted":
        trees = tuple(Tree(**{k: tuples(v) for k, v in t.items()}) for t in fields.pop("trees"))
        return Boosted(**{k: tuples(v) for k, v in fields.items()}, trees=trees)
    raise ValueError(f"no kind of model: {value['kind']}")


class _Files:
    """Files of a folder in any store that Spark's Hadoop client reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.folder = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def read(self, name: str) -> bytes | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, raw: bytes) -> None:
        """The file is there whole or not at all."""
        temporary = self.at(f".{name}.writing")
        stream = self.fs.create(temporary, True)
        try:
            stream.write(raw)
        finally:
            stream.close()
        self.fs.delete(self.at(name), False)
        if not self.fs.rename(temporary, self.at(name)):
            raise OSError(f"{name} could not be put in place")


def save_model(spark: SparkSession, path: str, model: Ridge | Boosted, mark: str, params: dict, threshold: float | None = None) -> None:
    """Saves a model with its fingerprint, parameters and threshold in the folder `path`; it takes the place of what is there."""
    files, raw = _Files(spark, path), _packed(model)
    name = hashlib.sha256(raw).hexdigest()
    files.write(f"{name}.json", raw)
    files.write(MANIFEST, json.dumps({"model": name, "fingerprint": mark, "params": params, "threshold": threshold}, sort_keys=True).encode())


def load_model(spark: SparkSession, path: str, mark: str | None = None) -> Loaded:
    """The model in the folder `path`, if it was fitted as `mark` says; without `mark` any sound model, for scoring other rows is legitimate."""
    files = _Files(spark, path)
    raw = files.read(MANIFEST)
    if raw is None:
        return Loaded(None, "missing")
    try:
        meta = json.loads(raw)
        name = meta["model"]
    except (ValueError, TypeError, KeyError):
        return Loaded(None, "missing_metadata")
    if mark is not None and meta.get("fingerprint") != mark:
        return Loaded(None, "fingerprint_mismatch")
    if mark is not None and not isinstance(meta.get("params"), dict):
        return Loaded(None, "invalid_metadata")
    body = files.read(f"{name}.json")
    try:
        if body is None or hashlib.sha256(body).hexdigest() != name:
            return Loaded(None, "corrupt")
        model = _unpacked(body)
    except (ValueError, TypeError, KeyError):
        return Loaded(None, "corrupt")
    threshold, params = meta.get("threshold"), meta.get("params")
    return Loaded(model, None, meta.get("fingerprint"), params if isinstance(params, dict) else None, float(threshold) if isinstance(threshold, (int, float)) else None)
