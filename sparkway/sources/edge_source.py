"""An edge list as a data source of its own: tasks read byte ranges, and filters on names are applied while reading."""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from .files import EDGE_SCHEMA, POSITIVE

COLUMNS = ("source", "target", "edge_id", "time_s", "length_m")
#: Bytes of one partition, and rows that are handed over at once.
PARTITION_BYTES, BATCH_ROWS = 32 << 20, 10_000

#: Filters on the three names that are applied while reading; text is compared by code point, which is the order of its UTF-8 bytes.
TESTS: dict[type, Callable] = {
    EqualTo: lambda v: lambda x: x == v,
    In: lambda v: frozenset(v).__contains__,
    GreaterThan: lambda v: lambda x: x > v,
    GreaterThanOrEqual: lambda v: lambda x: x >= v,
    LessThan: lambda v: lambda x: x < v,
    LessThanOrEqual: lambda v: lambda x: x <= v,
    StringStartsWith: lambda v: lambda x: x.startswith(v),
}


@dataclass
class Range(InputPartition):
    """Lines that begin from start on and before end."""

    path: str
    start: int
    end: int


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    parsed = urlparse(path)
    return pafs.FileSystem.from_uri(path) if parsed.scheme else (pafs.LocalFileSystem(), path)


def lines_from(file, start: int, end: int) -> Iterator[bytes]:
    """Lines that begin in a range of a file: a line that began before it belongs to the range before."""
    file.seek(max(0, start - 1))
    at = max(0, start - 1)
    if start:
        at += len(file.readline())
    while at < end:
        line = file.readline()
        if not line:
            return
        at += len(line)
        yield line


class EdgeReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes = path, partition_bytes
        self.filters: list[tuple[int, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the filters on names; the others stay with Spark."""
        for f in filters:
            column = getattr(f, "attribute", ())
            value = getattr(f, "value", None)
            plain = all(isinstance(v, str) for v in value) if isinstance(value, (list, tuple)) else isinstance(value, str)
            if type(f) in TESTS and len(column) == 1 and column[0] in COLUMNS[:3] and plain:
                self.filters.append((COLUMNS.index(column[0]), type(f), value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        store, path = _opened(self.path)
        info = store.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == pafs.FileType.File else [f for f in store.get_file_info(pafs.FileSelector(path, recursive=True)) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        return [Range(prefix + f.path, start, min(start + self.partition_bytes, f.size)) for f in sorted(files, key=lambda f: f.path) for start in range(0, f.size, self.partition_bytes)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        tests = [(at, TESTS[kind](value)) for at, kind, value in self.filters]
        positive = re.compile(POSITIVE)
        store, path = _opened(partition.path)
        held: list[list[str]] = []
        with store.open_input_file(path) as raw:
            file = io.BufferedReader(raw, 1 << 20)
            for line in lines_from(file, partition.start, partition.end):
                fields = line.decode("utf-8").rstrip("\n").removesuffix("\r").split("\t")
                if len(fields) != len(COLUMNS) or not positive.match(fields[3]) or not positive.match(fields[4]):
                    raise ValueError(f"not an edge with positive weights: {line[:200]!r}")
                if all(test(fields[at]) for at, test in tests):
                    held.append(fields)
                    if len(held) == BATCH_ROWS:
                        yield self._batch(held)
                        held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[list[str]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=list(COLUMNS))


class EdgeSource(DataSource):
    """``spark.read.format("edge_list").option("partition_bytes", n).load(path)``: rows of an edge list, with malformed ones as errors."""

    @classmethod
    def name(cls) -> str:
        return "edge_list"

    def schema(self) -> str:
        return EDGE_SCHEMA

    def reader(self, schema) -> EdgeReader:
        if "path" not in self.options:
            raise ValueError("an edge list takes a path")
        size = int(self.options.get("partition_bytes", PARTITION_BYTES))
        if size < 1:
            raise ValueError("partition_bytes must be positive")
        return EdgeReader(self.options["path"], size)


def edge_list(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The edges of a file or folder, filters on their names being applied while reading."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EdgeSource)
    return spark.read.format("edge_list").option("partition_bytes", partition_bytes).load(path)
