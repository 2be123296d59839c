"""Page trees as a data source: ``spark.read.format("pagetrees").load(path)`` gives positioned units of JSON page trees.

Files are dealt to tasks by size.  Filters on page and label go into the reader, which then gives no other rows (with
``spark.sql.python.filterPushdown.enabled``); files that can't be parsed give one row with an error, unless such a filter is pushed.
Paths are those that pyarrow's file systems read (local, s3, gs, hdfs); for others ``parsers.parsed`` reads through Spark.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from pageloom.sources.documents import tree_rows

SCHEMA = "path string, ord int, page int, label string, left double, bottom double, right double, top double, text string, font_size double, font_name string, error string"
#: Bytes of files that a task reads; the option ``bytesPerTask``.
BYTES = 32 << 20
#: Filters the reader applies itself: column and kind -> test of a value.
TESTS = {EqualTo: lambda x, v: x == v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, In: lambda x, v: x in v, IsNotNull: lambda x, v: x is not None}
ON = ("page", "label")


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def _listed(path: str) -> list[tuple[str, int]]:
    """Files under a path (or the file), with sizes, by name; hidden ones are left out."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
    prefix = path[: path.index(":") + 1] + "//" if re.match(r"\w+:", path) else ""
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def _read(path: str) -> bytes:
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)
    with system.open_input_stream(at) as f:
        return f.read()


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("bytespertask", options.get("bytesPerTask", BYTES)))
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute in [(c,) for c in ON]:
                self.filters.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        out, size = [], self.bytes
        for path, n in _listed(self.path):
            if size + n > self.bytes:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [Files(tuple(p)) for p in out]

    def _wanted(self, page: int, label: str) -> bool:
        values = {"page": page, "label": label}
        return all(TESTS[kind](values[c], v) for c, kind, v in self.filters)

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                tree = json.loads(_read(path))
            except ValueError as e:  # (also bytes that are no text)
                if not self.filters:
                    yield (path, *[None] * 10, f"{type(e).__name__}: {e}")
                continue
            for n, (page, label, *rest) in enumerate(tree_rows(tree)):
                text, label = rest[4], "text" if label is None else label
                if text is not None and text.strip() and self._wanted(page, label):
                    yield (path, n, page, label, *rest[:4], text.strip(), *rest[5:], None)


class PageTrees(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagetrees"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it push filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageTrees)
