"""The zipped source, the registry of sources, the model store and the response cache."""

from __future__ import annotations

import datetime as dt
import json
import zipfile
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quantloom.operators import boosting, learning
from quantloom.sources import archive, cache, files, models, registry  # noqa: F401
from quantloom.sources.shared import new_path

BARS = "code string, ts date, close double, volume double"


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(f"88500{k}", dt.date(2024, 1, d), 10.0 * k + d, None if d == 2 else 5.0) for k in range(5) for d in (3, 1, 2)]
    return spark.createDataFrame(rows, BARS)


@pytest.fixture()
def zipped(spark, bars, tmp_path):
    path = str(tmp_path / "quotes")
    archive.write_archive(bars.repartition(2, "code").sortWithinPartitions("code"), path)
    return path


def member(path, name, **columns):
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    pq.write_table(table, sink)
    with zipfile.ZipFile(path, "a") as z:
        z.writestr(name, sink.getvalue().to_pybytes())


# the zipped source


def test_archive_round_trip_by_name(spark, bars, zipped):
    assert len(list(Path(zipped).glob("part-*.zip"))) == 2 and not list(Path(zipped).glob(".part-*"))
    got = registry.read(spark, "zip_parquet", zipped)
    assert got.schema.simpleString() == bars.schema.simpleString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, bars.collect()), key=str)
    assert [r["ts"].day for r in got.where("code = '885003'").collect()] == [1, 2, 3]  # by date


@pytest.mark.parametrize("test, wanted", [("code = '885003'", 1), ("code IN ('885001', '885004', 'none')", 2), ("code = 'none'", 0), ("code = '885001' AND close > 11", 1), ("close > 11", 5), ("code IN ('885001', '885002') AND code = '885002'", 1)])
def test_only_wanted_members_are_opened(spark, bars, zipped, test, wanted):
    """Members that the filter rules out are damaged: opening one would fail."""
    named = [f"88500{k}" for k in range(5)]
    keep = {c for c in named if c in test} or (set(named) if "code" not in test else set())
    if wanted == 1 and "IN" in test:
        keep = {"885002"}
    for p in Path(zipped).glob("part-*.zip"):
        with zipfile.ZipFile(p) as z:
            parts = {i.filename: z.read(i) for i in z.infolist()}
        with zipfile.ZipFile(p, "w") as z:
            for name, raw in parts.items():
                z.writestr(name, raw if Path(name).stem in keep else b"damaged")
    df = registry.read(spark, "zip_parquet", zipped, schema=BARS).where(test)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, bars.where(test).collect()), key=str)
    assert df.rdd.getNumPartitions() == max(wanted, 1)


def test_bad_archives(spark, tmp_path):
    day = [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    cases = {
        "another code": dict(code=["1", "2"], ts=day, close=[1.0, 2.0], volume=[1.0, 1.0]), "a date twice": dict(code=["1", "1"], ts=day[:1] * 2, close=[1.0, 2.0], volume=[1.0, 1.0]),
        "without a date": dict(code=["1", "1"], ts=[day[0], None], close=[1.0, 2.0], volume=[1.0, 1.0]), "missing columns: volume": dict(code=["1", "1"], ts=day, close=[1.0, 2.0]),
        "1.parquet": dict(code=["1", "1"], ts=day, close=["1", "x"], volume=[1.0, 1.0]),
    }
    for k, (said, columns) in enumerate(cases.items()):
        path = str(tmp_path / f"{k}.zip")
        member(path, "1.parquet", **columns)
        with pytest.raises(Exception, match=said):
            registry.read(spark, "zip_parquet", path, schema=BARS).collect()
    path = str(tmp_path / "good.zip")
    member(path, "a/1.parquet", code=[" 1 "], ts=day[:1], close=["2.5"], volume=[None])  # text that is a number, a code with blanks
    assert [tuple(r) for r in registry.read(spark, "zip_parquet", path, schema=BARS).collect()] == [("1", day[0], 2.5, None)]
    member(path, "b/1.parquet", code=["1"], ts=day[:1], close=[1.0], volume=[1.0])
    with pytest.raises(Exception, match="more than one member"):
        registry.read(spark, "zip_parquet", path, schema=BARS).collect()
    (tmp_path / "no.zip").write_bytes(b"no zip")
    for path in ("no.zip", "none.zip"):
        with pytest.raises(Exception, match="no"):
            registry.read(spark, "zip_parquet", str(tmp_path / path), schema=BARS).collect()


def test_many_members_share_partitions(spark, tmp_path):
    """Each is read once, from few tasks; a task reads few archives and no more than a share of bytes unless one member has more."""
    n = archive.ALONE * 3
    rows = spark.range(n * 2).select(F.format_string("%06d", F.col("id") % n).alias("code"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") / n).cast("int")).alias("ts"), F.col("id").cast("double").alias("close"), F.lit(1.0).alias("volume"))
    path = str(tmp_path / "many")
    archive.write_archive(rows.repartition(3, "code").sortWithinPartitions("code"), path)
    got = registry.read(spark, "zip_parquet", path, schema=BARS)
    assert got.rdd.getNumPartitions() <= 2 * archive.ALONE < n
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    assert [len(r.members) for r in archive.runs(archive.members(path)[: archive.ALONE])] == [1] * archive.ALONE
    found = [archive.Member(f"{k % 7}.zip", f"{k}.parquet", f"{k}", archive.SHARE if k == 5 else k * 1_000_000 // n) for k in range(n * 20)]
    dealt = archive.runs(found)
    assert sorted(m for r in dealt for m in r.members) == sorted(found)
    assert all(len(r.members) == 1 or sum(m.size for m in r.members) <= archive.SHARE for r in dealt)
    assert sum(len({m.path for m in r.members}) for r in dealt) <= len(dealt) + 6


def test_registry_of_sources():
    assert "zip_parquet" in [s.name for s in registry.sources()]
    with pytest.raises(KeyError, match="no source named nothing"):
        registry.read(None, "nothing", "x")
    with pytest.raises(ValueError, match="there already"):
        registry.source("zip_parquet", "another")(lambda spark, path: None)


def test_archives_without_members(spark, bars, tmp_path):
    path = str(tmp_path / "sparse")
    one = bars.where("code = '885002'")
    archive.write_archive(one.repartition(6, "code"), path)
    assert sorted(map(tuple, registry.read(spark, "zip_parquet", path).collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
    archive.write_archive(one.where("false").repartition(2, "code"), str(tmp_path / "nothing"))
    if (tmp_path / "nothing").exists():
        assert registry.read(spark, "zip_parquet", str(tmp_path / "nothing"), schema=BARS).count() == 0


def test_symbol_lists_keep_the_first(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# all\n b \na # first\n\nb\n  # none\nc#x#y\na\n")
    got = registry.read(spark, "symbol_list", str(tmp_path / "s.txt")).orderBy("position").collect()
    assert [r["symbol"] for r in got] == ["b", "a", "c"]


def test_feature_frames(spark, tmp_path):
    (tmp_path / "f.csv").write_text("symbol,x\na,1.5\nb,\n")
    assert [tuple(r) for r in registry.read(spark, "feature_frame", str(tmp_path / "f.csv"), required=("x",)).collect()] == [("a", 1.5), ("b", None)]
    with pytest.raises(ValueError, match="missing columns: y"):
        registry.read(spark, "feature_frame", str(tmp_path / "f.csv"), required=("x", "y"), schema="symbol string, x double, y double")
    with pytest.raises(Exception):
        registry.read(spark, "feature_frame", str(tmp_path / "f.csv"), schema="symbol double, x double").collect()
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert registry.read(spark, "feature_frame", str(tmp_path / "p"), required=("id",)).count() == 3
    with pytest.raises(ValueError, match="missing columns: z"):
        registry.read(spark, "feature_frame", str(tmp_path / "p"), required=("z",))


# the model store


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(float(i % 7), float(i % 5) if i % 4 else None, i % 2, float(i)) for i in range(60)], "a double, b double, label int, y double")


def test_models_are_read_back_with_the_same_scores(spark, rows):
    for model, score in (
        (learning.fit_ridge(rows, ["a", "b"], "y", 2.0), lambda m: m.score()),
        (boosting.fit_boosted(rows, ["a", "b"], "label", rules=boosting.Rules(rounds=3, depth=2)), lambda m: m.probability()),
    ):
        path, mark = new_path(spark, "models"), models.fingerprint(rows, ["a", "b"], {"penalty": 2})
        assert models.load_model(spark, path, mark).reason == "missing"
        models.save_model(spark, path, model, mark, {"penalty": 2}, 0.25)
        got = models.load_model(spark.newSession(), path, mark)
        assert (got.model, got.reason, got.threshold, got.params, got.fingerprint) == (model, None, 0.25, {"penalty": 2}, mark)
        both = rows.select(score(model).alias("x"), score(got.model).alias("y"))
        assert both.where("x <> y").count() == 0 and both.where("x = y").count() == 60
        models.save_model(spark, path, model, "another", {})  # takes its place
        assert models.load_model(spark, path, mark).reason == "fingerprint_mismatch" and models.load_model(spark, path).model == model


def test_fingerprints(spark, rows):
    one = models.fingerprint(rows, ["a", "b"], {"x": 1})
    assert one == models.fingerprint(rows, ["b", "a"], {"x": 1})
    assert len({one, models.fingerprint(rows, ["a"], {"x": 1}), models.fingerprint(rows, ["a", "b"], {"x": 2}), models.fingerprint(rows.withColumn("a", F.col("a").cast("float")), ["a", "b"], {"x": 1})}) == 4


def test_reasons_for_no_model(spark, rows, tmp_path):
    model, path = learning.fit_ridge(rows, ["a"], "y"), f"file://{tmp_path}"
    models.save_model(spark, path, model, "m", {})
    manifest = tmp_path / models.MANIFEST
    meta = json.loads(manifest.read_text())
    for text, reason in (("{", "missing_metadata"), ("[1]", "missing_metadata"), (json.dumps(meta | {"params": 3}), "invalid_metadata"), (json.dumps(meta | {"fingerprint": None}), "fingerprint_mismatch"), (json.dumps(meta | {"model": "gone"}), "corrupt")):
        (tmp_path / f".{models.MANIFEST}.crc").unlink(missing_ok=True)
        manifest.write_text(text)
        assert models.load_model(spark, path, "m").reason == reason
    manifest.write_text(json.dumps(meta))
    body = tmp_path / f"{meta['model']}.json"
    (tmp_path / f".{meta['model']}.json.crc").unlink(missing_ok=True)
    body.write_text(body.read_text()[:-5])
    assert models.load_model(spark, path, "m").reason == "corrupt"


# the cache


def entries(spark, *rows):
    return spark.createDataFrame([(k, s, n, p, dt.datetime(2024, 1, d)) for k, s, n, p, d in rows], "key string, source string, row_count bigint, payload string, stored_at timestamp")


def state(c):
    return sorted((r["key"], r["source"], r["row_count"], r["payload"], r["stored_at"].day) for r in c.live().collect())


def test_cache_puts_hits_clears_and_compacts(spark):
    c = cache.ResponseCache(spark, new_path(spark, "cache"))
    assert state(c) == [] and c.stats().count() == 0
    c.compact()
    c.put(entries(spark, ("a", "x", 10, "old", 1), ("b", "x", 5, "b", 2), ("c", "y", 7, "c", 3)))
    c.put(entries(spark, ("a", "x", 20, "new", 4), ("b", "x", 50, "older", 1)))
    assert state(c) == [("a", "x", 20, "new", 4), ("b", "x", 5, "b", 2), ("c", "y", 7, "c", 3)]
    asked = spark.createDataFrame([("a", 5, 15), ("a", 6, 15), ("b", 0, 5), ("c", 0, 1), ("d", 0, 0)], "key string, start int, count int")
    got = {(r["key"], r["start"]): r["payload"] for r in c.get(asked, "2024-01-04 12:00:00", 2 * 86400).where("hit").collect()}
    assert got == {("a", 5): "new", ("c", 0): "c"}  # b is too old, a holds 20 rows
    assert c.get(asked, "2024-01-03 00:00:00", 9 * 86400).where("hit AND key = 'a'").count() == 0  # stored later
    assert [(r["source"], r["n"]) for r in c.clear("2024-01-05 00:00:00", source="x", before="2024-01-03 00:00:00").collect()] == [("x", 1)]
    live = [("a", "x", 20, "new", 4), ("c", "y", 7, "c", 3)]
    assert state(c) == live
    c.compact()
    assert state(c) == live and len(c._batches()) == 1
    c.put(entries(spark, ("b", "x", 1, "again", 6)))
    assert [r["n"] for r in c.clear("2024-01-05 12:00:00").orderBy("source").collect()] == [1, 1]
    assert state(c) == [("b", "x", 1, "again", 6)]  # stored after the clearing
    assert [tuple(r)[:3] for r in c.stats().collect()] == [("x", 1, 1)]
    assert c.clear("2024-01-05 12:00:00").count() == 0


def test_a_compaction_that_stops_half_way_loses_nothing(spark):
    path = new_path(spark, "cache")
    c = cache.ResponseCache(spark, path)
    c.put(entries(spark, ("a", "x", 1, "a", 1), ("b", "x", 1, "b", 1)))
    c.clear("2024-01-02 00:00:00", source="x")
    c.put(entries(spark, ("a", "x", 2, "a2", 3)))
    want, old = state(c), c._batches()
    c._append(c.live().withColumn("deleted", F.lit(False)))
    assert state(c) == want  # written, nothing deleted yet
    folder = Path(old[0].removeprefix("file:"))
    for f in folder.iterdir():
        f.unlink()
    assert state(c) == want  # the oldest is gone, its tombstones are not
    c.compact()
    assert state(c) == want


def test_rows_without_key_or_time_are_not_stored(spark):
    c = cache.ResponseCache(spark, new_path(spark, "cache"))
    c.put(spark.createDataFrame([(None, "x", 1, "p", dt.datetime(2024, 1, 1)), ("k", None, None, None, dt.datetime(2024, 1, 1)), ("l", "x", 1, "p", None)], "key string, source string, row_count bigint, payload string, stored_at timestamp"))
    assert state(c) == [("k", None, None, None, 1)]
