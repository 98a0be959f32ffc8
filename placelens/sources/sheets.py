"""Spreadsheets and SQLite tables as Spark data sources: partitions by rows, only the wanted columns, filters in the reader.

Files are opened where Arrow's file systems reach them (local paths, hdfs://,
s3://), and read as streams; for stores that only Spark reads, workbooks has
readers of whole files. Register with register(spark), then

    spark.read.format("sheet").schema("name string, rank string").option("kind", "xlsx").load(path)

Options: kind (xlsx or ods), sheet (its name, else the first), skip (rows before
the header), parts (partitions per file, which take runs of rows in turn),
query_table and parts for kind sqlite. The schema's columns are all that is kept of
a row; headers are matched in snake case. Filters on them (equal, in, starts
with, null or not) are applied while reading.
"""

from __future__ import annotations

import contextlib
import fnmatch
import os
import re
import shutil
import sqlite3
import tempfile
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith

from .flat import snake_headers
from .workbooks import ods_rows, xlsx_rows

#: Rows that a partition takes before the next one's turn; the whole is known only at its end.
RUN, BATCH = 1000, 5000
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _files(path: str) -> list[str]:
    """A file, or those of a folder or pattern, without hidden ones."""
    store, inner = _open(path)
    info = store.get_file_info(inner)
    if info.type == pafs.FileType.File:
        found = [inner]
    else:
        folder, pattern = (inner, "*") if info.type == pafs.FileType.Directory else os.path.split(inner)
        found = sorted(f.path for f in store.get_file_info(pafs.FileSelector(folder)) if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and not f.base_name.startswith(("_", ".")))
    if not found:
        raise FileNotFoundError(path)
    prefix = path.partition("://")[0] + "://" if "://" in path else ""
    host = path[len(prefix) :].partition("/")[0] if prefix not in ("", "file://") else ""
    return [f"{prefix}{host}{f}" if prefix in ("", "file://") or f.startswith("/") else f"{prefix}{f}" for f in found]


class Part(InputPartition):
    def __init__(self, path: str, part: int, parts: int):
        super().__init__((path, part))
        self.path, self.part, self.parts = path, part, parts


def _test(f: Filter):
    """A test of one column's value, or None where the reader has none for this filter."""
    if len(getattr(f, "attribute", ())) != 1:
        return None
    if isinstance(f, EqualTo) and isinstance(f.value, str):
        return lambda x: x == f.value
    if isinstance(f, In) and all(isinstance(v, str) for v in f.value):
        values = frozenset(f.value)
        return lambda x: x in values
    if isinstance(f, StringStartsWith):
        return lambda x: x is not None and x.startswith(f.value)
    if isinstance(f, IsNotNull):
        return lambda x: x is not None
    if isinstance(f, IsNull):
        return lambda x: x is None
    return None


def _sql(f: Filter) -> tuple[str, list]:
    column = '"' + f.attribute[0].replace('"', '""') + '"'
    if isinstance(f, EqualTo):
        return f"CAST({column} AS TEXT) = ?", [f.value]
    if isinstance(f, In):
        return f"CAST({column} AS TEXT) IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, StringStartsWith):
        return f"substr(CAST({column} AS TEXT), 1, ?) = ?", [len(f.value), f.value]
    return f"{column} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names, self.pushed = options, names, []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if _test(f) and f.attribute[0] in self.names:
                self.pushed.append(f)
            else:
                yield f

    def partitions(self):
        parts = int(self.options.get("parts", 1))
        return [Part(p, k, parts) for p in _files(self.options["path"]) for k in range(parts)]

    def _batches(self, rows):
        tests = [(self.names.index(f.attribute[0]), _test(f)) for f in self.pushed]
        schema, out = pa.schema([(n, pa.string()) for n in self.names]), []
        for row in rows:
            if all(test(row[k]) for k, test in tests):
                out.append(row)
            if len(out) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], schema=schema)


class SheetReader(_Reader):
    def read(self, partition):
        kind, sheet, skip = self.options.get("kind", "xlsx"), self.options.get("sheet"), int(self.options.get("skip", 0))
        mine = lambda k: (k - skip - 1) // RUN % partition.parts == partition.part  # noqa: E731  k: the row in the sheet
        store, inner = _open(partition.path)
        with store.open_input_file(inner) as f:
            rows = ods_rows(f, sheet) if kind == "ods" else xlsx_rows(f, sheet, lambda k: k == skip or k > skip and mine(k))
            yield from self._batches(self._picked(rows, skip, mine))

    def _picked(self, rows, skip, mine):
        at = None
        for k, row in enumerate(rows):
            if k == skip:
                header = {h: i for i, h in enumerate(snake_headers([x or "" for x in row]))}
                at = [header.get(n) for n in self.names]
            elif k > skip and mine(k):
                yield [row[i] if i is not None and i < len(row) else None for i in at]


class SQLiteReader(_Reader):
    def read(self, partition):
        table = '"' + self.options["table"].replace('"', '""') + '"'
        tests = [_sql(f) for f in self.pushed]
        columns = ", ".join(f"CAST(\"{n.replace(chr(34), chr(34) * 2)}\" AS TEXT)" for n in self.names)
        with _local(partition.path) as path, contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
            if low is None:
                return
            step = -(-(high - low + 1) // partition.parts)
            bounds = [low + partition.part * step, low + (partition.part + 1) * step]
            where = " AND ".join(["rowid >= ? AND rowid < ?", *(t for t, _ in tests)])
            yield from self._batches(db.execute(f"SELECT {columns} FROM {table} WHERE {where}", bounds + [v for _, values in tests for v in values]))


@contextlib.contextmanager
def _local(path: str):
    """A path that SQLite can open: the file itself, or this task's copy of one in a store."""
    store, inner = _open(path)
    if isinstance(store, pafs.LocalFileSystem):
        yield inner
        return
    with tempfile.NamedTemporaryFile(suffix=".sqlite") as copy, store.open_input_stream(inner) as f:
        shutil.copyfileobj(f, copy)
        copy.flush()
        yield copy.name


class _Source(DataSource):
    def schema(self):
        raise ValueError("give the columns that are wanted with .schema(...)")

    def _names(self, schema) -> list[str]:
        if any(f.dataType.simpleString() != "string" for f in schema.fields):
            raise ValueError("columns are strings; cast them after reading")
        return schema.names


class SheetSource(_Source):
    @classmethod
    def name(cls):
        return "sheet"

    def reader(self, schema):
        return SheetReader(dict(self.options), self._names(schema))


class SQLiteSource(_Source):
    @classmethod
    def name(cls):
        return "sqlite_table"

    def reader(self, schema):
        return SQLiteReader(dict(self.options), self._names(schema))


def register(spark: SparkSession) -> SparkSession:
    """Make the formats sheet and sqlite_table known, and let filters reach them."""
    for source in (SheetSource, SQLiteSource):
        spark.dataSource.register(source)
    spark.conf.set(_PUSHDOWN, "true")
    return spark


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_OFFICE = "http://schemas.openxmlformats.org"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_FILES = {
    "[Content_Types].xml": f'<Types xmlns="{_OFFICE}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPE}.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_OFFICE}/package/2006/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_OFFICE}/package/2006/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def write_xlsx(df: DataFrame, where: str, sheet: str = "Sheet1") -> DataFrame:
    """Write df, as strings, to one workbook per partition in a folder; the names of the files and their rows.

    A task that runs again writes the same name over, by a move.
    """
    names = df.columns

    def run(batches):
        from pyspark import TaskContext

        store, inner = _open(where)
        store.create_dir(inner, recursive=True)
        name, n = f"{inner}/part-{TaskContext.get().partitionId():05d}.xlsx", 0
        cells = lambda row: "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", x))}</t></is></c>' if x is not None else "<c/>" for x in row)
        with store.open_output_stream(f"{name}.{os.getpid()}.tmp") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, body in _FILES.items():
                z.writestr(path, _HEAD + body)
            one = f'<sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets>'
            z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_OFFICE}/spreadsheetml/2006/main" xmlns:r="{_OFFICE}/officeDocument/2006/relationships">{one}</workbook>')
            with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
                f.write(f'{_HEAD}<worksheet xmlns="{_OFFICE}/spreadsheetml/2006/main"><sheetData><row>{cells(names)}</row>'.encode())
                for b in batches:
                    for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        f.write(f"<row>{cells(row)}</row>".encode())
                        n += 1
                f.write(b"</sheetData></worksheet>")
        store.move(f"{name}.{os.getpid()}.tmp", name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "n_rows"])

    return df.select(*(df[c].cast("string").alias(c) for c in names)).mapInArrow(run, "file string, n_rows long")
