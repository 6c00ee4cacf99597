"""Archives of many files as a Spark data source.

What a file holds is told by its path: a pattern with named groups finds the key columns, such as tile
and day. Filters on key columns decide which files are opened at all; the others are never touched. The
kept files are put together, in the order of their keys, to partitions of bounded size. Files are Parquet
or CSV with a header; columns that a file lacks are missing. Both are read by Arrow, a batch at a time,
so the path must be one that Arrow's file systems open (file://, hdfs://, s3://, ...).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import csv, fs, parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of files that one partition reads at most, unless a single file has more.
TOGETHER = 64 << 20
CASTS = {T.IntegerType: int, T.LongType: int, T.StringType: str, T.DoubleType: float}
TESTS = {
    EqualTo: lambda a, b: a == b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    In: lambda a, b: a in b,
}


class Files(InputPartition):
    def __init__(self, found: list[tuple[str, dict]]):
        super().__init__(found)
        self.found = found


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, schema: T.StructType):
        self.path, self.pattern, self.schema = path, pattern, schema
        self.keys = {f.name: CASTS[type(f.dataType)] for f in schema if f.name in re.compile(pattern).groupindex}
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):  # noqa: N802
        """Filters on key columns are settled by the files' paths; the others are left to Spark."""
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in self.keys:
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def kept(self) -> list[tuple[str, int, dict]]:
        """Files (path, size, keys) that the filters leave, in the order of their keys."""
        system, root = fs.FileSystem.from_uri(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            told = re.search(self.pattern, info.path) if info.is_file else None
            if told and info.base_name[0] not in "._":
                keys = {k: cast(told[k]) for k, cast in self.keys.items()}
                if all(TESTS[test](keys[k], value) for k, test, value in self.tests):
                    found.append((info.path, info.size, keys))
        return sorted(found, key=lambda f: (*f[2].values(), f[0]))

    def partitions(self) -> list[Files]:
        parts, held = [], TOGETHER
        for path, size, keys in self.kept():
            if held + size > TOGETHER:
                parts.append([])
                held = 0
            parts[-1].append((path, keys))
            held += size
        return [Files(p) for p in parts]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        schema = to_arrow_schema(self.schema)
        for path, keys in partition.found:
            with system.open_input_file(path) as source:
                if path.endswith(".csv"):
                    batches = csv.open_csv(source)
                else:
                    file = parquet.ParquetFile(source)
                    own = [f.name for f in schema if f.name in file.schema_arrow.names and f.name not in keys]
                    batches = file.iter_batches(columns=own)
                for batch in batches:
                    yield pa.RecordBatch.from_arrays([_column(batch, f, keys) for f in schema], schema=schema)


def _column(batch: pa.RecordBatch, field: pa.Field, keys: dict) -> pa.Array:
    if field.name in keys:
        return pa.repeat(pa.scalar(keys[field.name], field.type), batch.num_rows)
    if field.name in batch.schema.names:
        return batch[field.name].cast(field.type)
    return pa.nulls(batch.num_rows, field.type)


class Archive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_archive"

    def schema(self) -> T.StructType:
        raise ValueError("an archive is read with a schema of its key columns and its files' columns")

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options["pattern"], schema)


def read_archive(spark: SparkSession, path: str, pattern: str, schema: str) -> DataFrame:
    """The files below path whose paths match the pattern, with a schema that names the pattern's groups
    and the files' columns."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Archive)
    return spark.read.format("file_archive").schema(schema).option("path", path).option("pattern", pattern).load()


#: Paths of scene files by tile and month, and of tower files by site and year.
SCENES = r"tile=(?P<tile>h\d\dv\d\d)/month=(?P<month>\d{6})/"
TOWERS = r"FLX_(?P<site>[A-Za-z0-9-]+)_(?P<year>\d{4})"


def read_scene_archive(spark: SparkSession, path: str, bands: list[str]) -> DataFrame:
    """Scenes of an archive by tile and month (yyyymm): a query for one tile and a season opens its files only."""
    columns = "tile string, month int, start timestamp, stop timestamp, x long, y long, " + ", ".join(f"{b} int" for b in bands)
    return read_archive(spark, path, SCENES, columns)


def read_tower_archive(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Half-hourly tower files by site and year; stamps are longs, all else doubles, as stored."""
    kinds = ", ".join(f"{c} {'long' if c.startswith('TIMESTAMP') else 'double'}" for c in columns)
    return read_archive(spark, path, TOWERS, f"site string, year int, {kinds}")
