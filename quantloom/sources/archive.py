"""Zip archives of Parquet members as a Spark data source: one partition for each of few members, for runs of many; members that a filter on `code` rules out are not opened.

A member `885001.parquet` holds the bars of code 885001 and nothing else.  spark.read.format("zip_parquet").option("path", ...) reads one archive, or all of a folder or pattern.
"""

from __future__ import annotations

import fnmatch
import posixpath
import zipfile
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from quantloom.sources.registry import source


class ArchiveError(ValueError):
    """An archive or member that can't be used as it is."""


#: So many members have a partition each; more of them share partitions, of about so many bytes at most.
ALONE, SHARE = 256, 16 << 20


class Member(NamedTuple):
    path: str
    name: str
    code: str
    size: int


class Run(InputPartition):
    """Members that one task reads, one at a time."""

    def __init__(self, members: list[Member]):
        self.members = members


def runs(found: list[Member]) -> list[Run]:
    """All members, archive by archive: a task opens as few archives as it can, as opening one reads its whole directory."""
    if len(found) <= ALONE:
        return [Run([m]) for m in found]
    each = min(SHARE, sum(m.size for m in found) // ALONE)
    out, size = [], 0
    for m in sorted(found, key=lambda m: m.path):
        if not out or size + m.size > each:
            out.append(Run([]))
            size = 0
        out[-1].members.append(m)
        size += m.size
    return out


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _archives(path: str) -> list[str]:
    """The archives of a path: itself, all *.zip of a folder, or those that match a pattern in the last part of it."""
    fs, at = _file_system(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    folder, pattern = (posixpath.dirname(at), posixpath.basename(at)) if "*" in at else (at, "*.zip")
    info = fs.get_file_info(folder)
    if info.type == pafs.FileType.NotFound:
        raise ArchiveError(f"{path}: no such archive")
    if info.type == pafs.FileType.File:
        return [path]
    return sorted(prefix + f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if fnmatch.fnmatch(f.base_name, pattern))


class _Seekable:
    """A file as zipfile wants it: a place before the start is an OSError."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.read, self.tell, self.close = file, file.read, file.tell, file.close

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("a place before the start of the file")
        self.file.seek(at)
        return at


def _opened(path: str) -> zipfile.ZipFile:
    fs, at = _file_system(path)
    try:
        return zipfile.ZipFile(_Seekable(fs.open_input_file(at)))
    except (OSError, zipfile.BadZipFile) as e:
        raise ArchiveError(f"{path}: {e}") from e


def members(path: str, codes: set[str] | None = None) -> list[Member]:
    """The Parquet members of all archives, or those of some codes, from the archives' directories alone. Two members of one code are an error."""
    out: dict[str, Member] = {}
    for archive in _archives(path):
        with _opened(archive) as z:
            for info in z.infolist():
                base = posixpath.basename(info.filename)
                code = base.removesuffix(".parquet")
                if base == code or codes is not None and code not in codes:
                    continue
                if code in out:
                    raise ArchiveError(f"{archive}: more than one member {base}")
                out[code] = Member(archive, info.filename, code, info.file_size)
    return [out[c] for c in sorted(out)]


class ZipReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, options: dict):
        self.path, self.schema, self.options = path, schema, options
        self.codes: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            found = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if found is not None and f.attribute == ("code",):
                self.codes = found if self.codes is None else self.codes & found
            else:
                yield f

    def partitions(self) -> list[Run]:
        return runs(members(self.path, self.codes)) or [Run([])]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        for path, found in groupby(run.members, key=lambda m: m.path):
            with _opened(path) as z:
                for member in found:
                    with z.open(member.name) as f:
                        table = pq.ParquetFile(pa.BufferReader(f.read())).read(use_threads=False)
                    yield from checked(table, member, self.schema, self.options.get("date", "ts")).to_batches(max_chunksize=10_000)


def checked(table: pa.Table, member: Member, schema: StructType, date: str) -> pa.Table:
    """A member's rows as `schema`, by date. An error: a column is missing, a code is not the member's, a date is missing or twice there, a number can't be read."""
    where = f"{member.path}: {member.name}"
    missing = sorted({f.name for f in schema} - set(table.column_names))
    if missing:
        raise ArchiveError(f"{where} is missing columns: {', '.join(missing)}")
    from pyspark.sql.pandas.types import to_arrow_schema

    try:
        table = table.select(schema.names).cast(to_arrow_schema(schema))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ArchiveError(f"{where}: {e}") from e
    if not table.num_rows:
        return table
    codes = pc.utf8_upper(pc.utf8_trim_whitespace(table["code"]))
    if codes.null_count or pc.unique(codes).to_pylist() != [member.code]:
        raise ArchiveError(f"{where} has another code")
    table = table.set_column(table.column_names.index("code"), table.schema.field("code"), codes)
    if table[date].null_count:
        raise ArchiveError(f"{where} has a row without a date")
    if len(pc.unique(table[date])) < table.num_rows:
        raise ArchiveError(f"{where} has a date twice")
    return table.sort_by(date)


class ZipParquet(DataSource):
    """Options: path; date, the column that orders a member's rows (`ts`)."""

    @classmethod
    def name(cls) -> str:
        return "zip_parquet"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        first = next(iter(members(self.options["path"])), None)
        if first is None:
            raise ArchiveError(f"{self.options['path']}: no Parquet member to take columns from; give a schema")
        with _opened(first.path) as z, z.open(first.name) as f:
            return from_arrow_schema(pq.read_schema(pa.BufferReader(f.read())))

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(self.options["path"], schema, dict(self.options))


@source("zip_parquet", "bars of codes in zipped Parquet members")
def read_archive(spark: SparkSession, path: str, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """Bars of all codes of the archives at `path`; filter by `code` to open few members."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off by default; what it hands on are filters alone
    spark.dataSource.register(ZipParquet)
    reader = spark.read.format("zip_parquet").options(path=path, **options)
    return (reader.schema(schema) if schema is not None else reader).load()


def write_archive(rows: DataFrame, path: str) -> None:
    """Writes each partition's codes as a zip archive part-N.zip into the folder `path`; a code's rows must be in one partition, together. A task that runs again writes the same file anew."""
    kind = rows.schema

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, at = _file_system(path)
        fs.create_dir(at, recursive=True)
        wanted, part = to_arrow_schema(kind), TaskContext.get().partitionId()
        held, code, n = [], None, 0
        final, temporary = f"{at}/part-{part:05d}.zip", f"{at}/.part-{part:05d}-{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(temporary) as out, zipfile.ZipFile(out, "w") as z:

            def close():
                sink = pa.BufferOutputStream()
                pq.write_table(pa.Table.from_batches(held, wanted), sink)
                z.writestr(f"bars/{code}.parquet", sink.getvalue().to_pybytes())

            for batch in batches:
                batch = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, wanted)], schema=wanted)
                codes = batch.column(batch.schema.names.index("code")).to_pylist()
                start = 0
                for i in range(1, len(codes) + 1):
                    if i == len(codes) or codes[i] != codes[start]:
                        if code is not None and codes[start] != code:
                            close()
                            n, held = n + 1, []
                        code = codes[start]
                        held.append(batch.slice(start, i - start))
                        start = i
            if held:
                close()
                n += 1
        fs.move(temporary, final)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32())], names=["members"])

    rows.mapInArrow(run, "members int").agg({"members": "sum"}).collect()
