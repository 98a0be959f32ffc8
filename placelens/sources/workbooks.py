"""Spreadsheets (XLSX, ODS), GeoJSON, Shapefile boxes and SQLite tables, read from the bytes of files in tasks."""

from __future__ import annotations

import io
import json
import re
import sqlite3
import struct
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .flat import snake_headers

_ODS = {k: f"{{urn:oasis:names:tc:opendocument:xmlns:{k}:1.0}}" for k in ("table", "text", "office")}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _zip(data) -> zipfile.ZipFile:
    """Of bytes or an open file, of which only what is read is fetched."""
    return zipfile.ZipFile(data if hasattr(data, "read") else io.BytesIO(data))


def xlsx_rows(data, sheet: str | None = None, wanted: Callable[[int], bool] = lambda k: True) -> Iterator[list[str | None]]:
    """Rows of a sheet by its name, else of the first, as strings; the text is streamed. Rows (from 0) that are not wanted are None."""
    z = _zip(data)
    local = lambda e: e.tag.rpartition("}")[2]
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    sheets = [e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"]
    picked = next((s for s in sheets if s.get("name") == sheet), None) if sheet else sheets[0]
    if picked is None:
        raise ValueError(f"no sheet {sheet}")
    rel = next(v for k, v in picked.attrib.items() if k.endswith("}id"))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    with z.open("xl/" + targets[rel].removeprefix("/xl/").removeprefix("xl/")) as f:
        at = -1
        for _, row in ElementTree.iterparse(f):
            if local(row) != "row":
                continue
            at += 1
            if not wanted(at):
                row.clear()
                yield None
                continue
            out: dict[int, str | None] = {}
            for k, cell in enumerate(e for e in row if local(e) == "c"):
                texts = {local(e): "".join(e.itertext()) for e in cell}
                value = texts.get("v", texts.get("is"))
                out[_column(cell.get("r")) if cell.get("r") else k] = shared[int(value)] if cell.get("t") == "s" and value is not None else value
            row.clear()
            yield [out.get(k) for k in range(max(out, default=-1) + 1)]


def ods_rows(data, sheet: str | None = None, longest_run: int = 100) -> Iterator[list[str | None]]:
    """Rows of a sheet; repeated cells and rows are expanded, runs over longest_run are padding and left out."""
    inside = False
    with _zip(data).open("content.xml") as f:
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if e.tag == _ODS["table"] + "table":
                if event == "start":
                    inside = sheet in (None, e.get(_ODS["table"] + "name"))
                elif inside:
                    return
            elif event == "end" and e.tag == _ODS["table"] + "table-row":
                if inside:
                    row: list[str | None] = []
                    for cell in e:
                        n = int(cell.get(_ODS["table"] + "number-columns-repeated", 1))
                        link = re.search(r'HYPERLINK\("([^"]+)"', cell.get(_ODS["table"] + "formula", ""))
                        text = link[1] if link else "\n".join("".join(p.itertext()) for p in cell.iter(_ODS["text"] + "p")) or cell.get(_ODS["office"] + "value")
                        if n <= longest_run:
                            row += [text] * n
                    while row and row[-1] is None:
                        row.pop()
                    times = int(e.get(_ODS["table"] + "number-rows-repeated", 1))
                    if times <= longest_run and row:
                        for _ in range(times):
                            yield list(row)
                e.clear()


def _read(spark: SparkSession, path: str, rows: Callable, columns: list[str], skip: int) -> DataFrame:
    wanted = snake_headers(columns)

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                out, header = [], None
                for k, row in enumerate(rows(bytes(data))):
                    if k < skip:
                        continue
                    if header is None:
                        header = {h: i for i, h in enumerate(snake_headers([x or "" for x in row]))}
                        continue
                    out.append([row[header[c]] if c in header and header[c] < len(row) else None for c in wanted])
                yield pd.DataFrame(out, columns=wanted, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f"`{c}` string" for c in wanted))


def read_xlsx(spark: SparkSession, path: str, columns: list[str], sheet: str | None = None, skip: int = 0) -> DataFrame:
    return _read(spark, path, lambda data: xlsx_rows(data, sheet), columns, skip)


def read_ods(spark: SparkSession, path: str, columns: list[str], sheet: str | None = None, skip: int = 0) -> DataFrame:
    return _read(spark, path, lambda data: ods_rows(data, sheet), columns, skip)


def simplify(points: list[list[float]], tolerance: float) -> list[list[float]]:
    """Douglas-Peucker: points farther than tolerance from the chord stay; the ends always do."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        (ax, ay), (bx, by) = points[a][:2], points[b][:2]
        length = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        best, at = tolerance, None
        for k in range(a + 1, b):
            x, y = points[k][:2]
            d = abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / length if length else ((x - ax) ** 2 + (y - ay) ** 2) ** 0.5
            if d > best:
                best, at = d, k
        if at is not None:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return [points[k] for k in sorted(keep)]


def read_geojson(spark: SparkSession, path: str, properties: list[str], tolerance: float = 0.0) -> DataFrame:
    """One row per feature: properties, simplified geometry as JSON, and its envelope."""

    def rings(geometry):
        c = geometry["coordinates"]
        return c if geometry["type"] == "Polygon" else [r for p in c for r in p] if geometry["type"] == "MultiPolygon" else [c] if geometry["type"] == "LineString" else [[c]]

    def run(batches):
        for pdf in batches:
            out = []
            for data in pdf["content"]:
                for f in json.loads(bytes(data).decode("utf-8-sig")).get("features", []):
                    if not f.get("geometry"):
                        continue
                    own = [simplify(r, tolerance) if tolerance and len(r) > 2 else r for r in rings(f["geometry"])]
                    xs, ys = [p[0] for r in own for p in r], [p[1] for r in own for p in r]
                    props = f.get("properties") or {}
                    out.append([None if props.get(p) is None else str(props[p]) for p in properties] + [json.dumps(own), min(ys), min(xs), max(ys), max(xs)])
            yield pd.DataFrame(out, columns=[*properties, "rings", "south", "west", "north", "east"])

    kinds = ", ".join(f"`{p}` string" for p in properties)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"{kinds}, rings string, south double, west double, north double, east double")


def shape_boxes(shp: bytes) -> list[tuple[float, float, float, float]]:
    """(west, south, east, north) of each shape of a Shapefile; points are boxes of no size."""
    at, out = 100, []
    while at + 12 <= len(shp):
        (size,) = struct.unpack_from(">i", shp, at + 4)
        (kind,) = struct.unpack_from("<i", shp, at + 8)
        if kind in (1, 11, 21):
            x, y = struct.unpack_from("<2d", shp, at + 12)
            out.append((x, y, x, y))
        elif kind:
            out.append(struct.unpack_from("<4d", shp, at + 12))
        at += 8 + 2 * size
    return out


def dbf_rows(dbf: bytes) -> list[dict[str, str]]:
    n, head, width = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode(), dbf[at + 16]))
        at += 32
    out = []
    for k in range(n):
        place, row = head + k * width + 1, {}
        for name, size in fields:
            row[name] = dbf[place : place + size].decode("utf-8", "replace").strip()
            place += size
        out.append(row)
    return out


def read_shape_boxes(spark: SparkSession, path: str, code: str) -> DataFrame:
    """(code, west, south, east, north) of every Shapefile in zip archives."""

    def run(batches):
        for pdf in batches:
            out = []
            for data in pdf["content"]:
                z = zipfile.ZipFile(io.BytesIO(bytes(data)))
                for name in (x for x in z.namelist() if x.lower().endswith(".shp")):
                    attributes = dbf_rows(z.read(name[:-4] + ".dbf"))
                    out += [[a.get(code), *box] for a, box in zip(attributes, shape_boxes(z.read(name)), strict=False)]
            yield pd.DataFrame(out, columns=["code", "west", "south", "east", "north"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "code string, west double, south double, east double, north double")


def read_sqlite(spark: SparkSession, path: str, query: str, columns: list[str]) -> DataFrame:
    """Rows of a query on SQLite files, as strings; a GeoPackage is such a file."""

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                with tempfile.NamedTemporaryFile(suffix=".sqlite") as f:
                    f.write(bytes(data))
                    f.flush()
                    db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
                    rows = [[None if x is None else str(x) for x in r] for r in db.execute(query)]
                    db.close()
                yield pd.DataFrame(rows, columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))
