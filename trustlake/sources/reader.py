"""Landed responses as a Spark data source: `spark.read.format("landed")` after register(spark).

Options: `path`, a folder or file of JSON lines in a store that pyarrow reads; `kind`, wiki or workspace; `split`, bytes of a file a
task reads (64 MB). A scope that one pass over the pages can tell is an option too: `page` or `space` of a wiki, which needs one of
them, `database` of a workspace. Files are cut at byte ranges, so one large file is read by many tasks; a line belongs to the range that it
begins in. `landed` has file and offset of each line: rows in its order are in fetch order. Comparisons of nested fields with a value are
pushed into the reader, which drops other lines before they become rows.

Lines that are no JSON objects are left out, as are values that do not fit a column's type (null).
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from trustlake.sources import landed

KINDS = {"wiki": landed.WIKI_PAGE, "workspace": landed.WORKSPACE_PAGE, "blocks": landed.BLOCK}
_SPLIT = 64 << 20
_ROWS = 1000


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def _value(row: dict, path: tuple[str, ...]):
    for name in path:
        row = row.get(name) if isinstance(row, dict) else None
    return row


def _fit(value, kind: T.DataType):
    """value as the column's type has it, or None."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _fit(value.get(f.name), f.dataType) for f in kind} if isinstance(value, dict) else None
    if isinstance(kind, T.ArrayType):
        return [_fit(x, kind.elementType) for x in value] if isinstance(value, list) else None
    if isinstance(kind, T.MapType):
        return [(k, _fit(x, kind.valueType)) for k, x in value.items()] if isinstance(value, dict) else None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.MapType):
        return pa.map_(pa.string(), _arrow(kind.valueType))
    return {T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.LongType: pa.int64()}[type(kind)]


class LandedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, split: int, tests: list[tuple[tuple[str, ...], tuple]], tree: str | None, space: str | None):
        self.schema, self.path, self.split, self.tests, self.tree, self.space = schema, path, split, tests, tree, space

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons with values are done here; all others stay Spark's."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute[0] != "landed":
                self.tests.append((f.attribute, (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            else:
                yield f

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, path = self._store()
        found = store.get_file_info(path)
        files = [found] if found.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in files if f.is_file and not f.base_name.startswith(("_", ".")))
        return [Range(name, at, min(at + self.split, size)) for name, size in files for at in range(0, size, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        columns = [f for f in self.schema if f.name != "landed"]
        kinds = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in self.schema])
        rows: list[dict] = []
        with io.BufferedReader(store.open_input_file(partition.file), 1 << 20) as file:
            for at, line in _lines(file, partition.start, partition.end):
                try:
                    found = json.loads(line)
                except ValueError:
                    continue
                if isinstance(found, dict) and self._wanted(found):
                    rows.append({f.name: _fit(found.get(f.name), f.dataType) for f in columns} | {"landed": {"file": partition.file, "part": at, "row": 0}})
                if len(rows) >= _ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    def _wanted(self, row: dict) -> bool:
        above = [a for a in row.get("ancestors") or [] if isinstance(a, dict)]
        if self.tree is not None and self.tree not in (row.get("id"), *(a.get("id") for a in above)):
            return False
        if self.space is not None and (_value(row, ("space", "key")) or _value(above[0] if above else {}, ("space", "key"))) != self.space:
            return False
        text = T.StringType()
        return all(any((_fit(_value(row, path), text) if isinstance(v, str) else _value(row, path)) == v for v in values) for path, values in self.tests)


def _lines(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in the range."""
    at = start
    if start:  # the line before may end just here
        file.seek(start - 1)
        at = start - 1 + len(file.readline())
    else:
        file.seek(0)
    while at < end and (line := file.readline()):
        yield at, line
        at += len(line)


class LandedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def _kind(self) -> str:
        kind = self.options.get("kind", "wiki")
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        return kind

    def schema(self) -> str:
        return f"{KINDS[self._kind()]}, landed {landed.LANDED}"

    def reader(self, schema: T.StructType) -> LandedReader:
        kind, tests, tree, space = self._kind(), [], None, None
        if kind == "wiki":
            tree, space = self.options.get("page"), self.options.get("space")
            if not tree and not space:
                raise ValueError("a wiki scan needs a page or a space")
            space = None if tree else space
        elif database := self.options.get("database"):
            tests.append((("parent", "database_id"), (database,)))
        return LandedReader(schema, self.options["path"], int(self.options.get("split", _SPLIT)), tests, tree, space)


def register(spark: SparkSession) -> None:
    """Make `landed` a format of the session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedSource)
