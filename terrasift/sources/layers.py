"""Vector layers as files, one for each key: shapefiles, GeoPackages and GeoJSON of points, lines and polygons.

Rows are dealt by key and sorted, so a task writes one file after another and holds a bounded number of rows. A file is
made in the task's own temporary folder and moved below its name when it is whole, so a repeated task replaces it.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import sqlite3
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.session import ship

#: Kinds of geometry: the name, the code of well-known binary, the code of shapefiles; fixed by the formats.
KINDS = {"point": ("Point", 1, 1), "line": ("LineString", 2, 3), "polygon": ("Polygon", 3, 5)}
SQLITE = {"bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "boolean": "integer", "double": "real", "float": "real"}


def parts_of(kind: str, value) -> list[list[tuple[float, float]]]:
    """The parts of a geometry: a struct (x, y), an array of points, or an array of rings, the first of which is the outline."""
    if kind == "point":
        return [[(float(value["x"]), float(value["y"]))]]
    rings = [value] if kind == "line" else value
    out = [[(float(p["x"]), float(p["y"])) for p in ring] for ring in rings]
    if kind == "polygon":  # closed, the outline counter-clockwise, holes clockwise
        out = [_turned(r if r[0] == r[-1] else [*r, r[0]], k == 0) for k, r in enumerate(out)]
    return out


def _turned(ring: list[tuple[float, float]], left: bool) -> list[tuple[float, float]]:
    twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))
    return ring if (twice > 0) == left else ring[::-1]


def to_wkb(kind: str, parts: list[list[tuple[float, float]]]) -> bytes:
    """Well-known binary, little-endian."""
    head = struct.pack("<BI", 1, KINDS[kind][1])
    points = [b"".join(struct.pack("<2d", *p) for p in part) for part in parts]
    if kind == "point":
        return head + points[0]
    if kind == "line":
        return head + struct.pack("<I", len(parts[0])) + points[0]
    return head + struct.pack("<I", len(parts)) + b"".join(struct.pack("<I", len(p)) + raw for p, raw in zip(parts, points))


def _box(parts: list[list[tuple[float, float]]]) -> tuple[float, float, float, float]:
    xs, ys = zip(*(p for part in parts for p in part))
    return min(xs), min(ys), max(xs), max(ys)


class ShapeWriter:
    """A .shp with its .shx and .dbf, record by record; headers are completed at the end."""

    def __init__(self, path: str, kind: str, columns: list[tuple[str, str]]):
        self.kind, self.columns, self.box, self.count = kind, columns, None, 0
        self.files = {e: open(f"{path}.{e}", "wb") for e in ("shp", "shx", "dbf")}  # noqa: SIM115
        for e in ("shp", "shx"):
            self.files[e].write(bytes(100))
        self.files["dbf"].write(bytes(32 + 32 * len(columns) + 1))
        self.at = 50

    def _width(self, kind: str) -> tuple[bytes, int, int]:
        return (b"N", 20, 0) if SQLITE.get(kind) == "integer" else (b"F", 24, 10) if SQLITE.get(kind) == "real" else (b"C", 254, 0)

    def add(self, parts: list[list[tuple[float, float]]] | None, values: list) -> None:
        self.count += 1
        if parts is None:
            body = struct.pack("<i", 0)
        elif self.kind == "point":
            body = struct.pack("<i2d", 1, *parts[0][0])
        else:
            if self.kind == "polygon":  # this format has outlines clockwise
                parts = [p[::-1] for p in parts]
            starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
            body = struct.pack("<i4d2i", KINDS[self.kind][2], *_box(parts), len(parts), sum(map(len, parts))) + struct.pack(f"<{len(parts)}i", *starts)
            body += b"".join(struct.pack("<2d", *p) for part in parts for p in part)
        if parts is not None:
            own = _box(parts)
            self.box = own if self.box is None else (*map(min, self.box[:2], own[:2]), *map(max, self.box[2:], own[2:]))
        self.files["shp"].write(struct.pack(">2i", self.count, len(body) // 2) + body)
        self.files["shx"].write(struct.pack(">2i", self.at, len(body) // 2))
        self.at += 4 + len(body) // 2
        row = [b" "]
        for value, (_, kind) in zip(values, self.columns):
            code, width, digits = self._width(kind)
            value = None if value is None or value != value else value
            if code == b"C":
                raw = ("" if value is None else str(value)).encode()[:width].decode("utf-8", "ignore").encode()
                row.append(raw.ljust(width))
            else:
                text = "" if value is None else f"{value:.{digits}f}" if code == b"F" else str(int(value))
                row.append(text[:width].rjust(width).encode())
        self.files["dbf"].write(b"".join(row))

    def close(self) -> None:
        for e, length in (("shp", self.at), ("shx", 50 + 4 * self.count)):
            self.files[e].seek(0)
            self.files[e].write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, length) + struct.pack("<2i", 1000, KINDS[self.kind][2]) + struct.pack("<8d", *(self.box or (0.0,) * 4), 0, 0, 0, 0))
        widths = [self._width(k) for _, k in self.columns]
        head = struct.pack("<4BIHH20x", 3, 120, 1, 1, self.count, 32 + 32 * len(widths) + 1, 1 + sum(w for _, w, _ in widths))
        for (name, _), (code, width, digits) in zip(self.columns, widths):
            head += name.encode()[:10].ljust(11, b"\0") + code + bytes(4) + bytes([width, digits]) + bytes(14)
        self.files["dbf"].write(b"\x1a")
        self.files["dbf"].seek(0)
        self.files["dbf"].write(head + b"\r")
        for f in self.files.values():
            f.close()


class PackageWriter:
    """A GeoPackage with one layer."""

    def __init__(self, path: str, kind: str, columns: list[tuple[str, str]], layer: str, srid: int):
        self.kind, self.srid, self.layer, self.box, self.names = kind, srid, layer.replace('"', ""), None, [n for n, _ in columns]
        self.db = sqlite3.connect(f"{path}.gpkg")
        named = "".join(f', "{n}" {SQLITE.get(k, "text")}' for n, k in columns)
        self.db.executescript(f"""
pragma application_id = 1196444487; pragma user_version = 10300;
create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
create table gpkg_contents (table_name text primary key, data_type text not null, identifier text unique, description text default '', last_change datetime default '2020-01-01T00:00:00Z',
 min_x double, min_y double, max_x double, max_y double, srs_id integer);
create table gpkg_geometry_columns (table_name text not null, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null, primary key (table_name, column_name));
insert into gpkg_spatial_ref_sys values ('undefined cartesian', -1, 'NONE', -1, 'undefined', null), ('undefined geographic', 0, 'NONE', 0, 'undefined', null), ('EPSG:{srid}', {srid}, 'EPSG', {srid}, 'EPSG:{srid}', null);
insert into gpkg_geometry_columns values ('{self.layer}', 'geom', '{KINDS[kind][0].upper()}', {srid}, 0, 0);
create table "{self.layer}" (fid integer primary key autoincrement, geom blob{named});""")

    def add(self, parts: list[list[tuple[float, float]]] | None, values: list) -> None:
        blob = None
        if parts is not None:
            blob, own = b"GP\0\x01" + struct.pack("<i", self.srid) + to_wkb(self.kind, parts), _box(parts)
            self.box = own if self.box is None else (*map(min, self.box[:2], own[:2]), *map(max, self.box[2:], own[2:]))
        names, marks = "".join(f', "{n}"' for n in self.names), ", ?" * len(self.names)
        values = [v.item() if hasattr(v, "item") else v for v in values]
        self.db.execute(f'insert into "{self.layer}" (geom{names}) values (?{marks})', (blob, *values))

    def close(self) -> None:
        box = self.box or (None,) * 4
        self.db.execute("insert into gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) values (?, 'features', ?, ?, ?, ?, ?, ?)", (self.layer, self.layer, *box, self.srid))
        self.db.commit()
        self.db.close()


class JsonWriter:
    """A GeoJSON feature collection."""

    def __init__(self, path: str, kind: str, columns: list[tuple[str, str]], layer: str):
        self.kind, self.names, self.first = kind, [n for n, _ in columns], True
        self.file = open(f"{path}.geojson", "w", encoding="utf-8")  # noqa: SIM115
        self.file.write(f'{{"type": "FeatureCollection", "name": {json.dumps(layer)}, "features": [')

    def add(self, parts: list[list[tuple[float, float]]] | None, values: list) -> None:
        geometry = None
        if parts is not None:
            points = [[list(p) for p in part] for part in parts]
            geometry = {"type": KINDS[self.kind][0], "coordinates": points[0][0] if self.kind == "point" else points[0] if self.kind == "line" else points}
        plain = [None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in values]
        feature = {"type": "Feature", "geometry": geometry, "properties": dict(zip(self.names, plain))}
        self.file.write(("\n" if self.first else ",\n") + json.dumps(feature, ensure_ascii=False, default=str))
        self.first = False

    def close(self) -> None:
        self.file.write("\n]}\n")
        self.file.close()


def file_name(key) -> str:
    """A key as a file's name: without the characters that paths give a meaning to; a missing one is ``none``."""
    return re.sub(r'[\\/:*?"<>|\x00-\x1f]', "_", str(key)) if key is not None and key == key else "none"


def write_files(rows: DataFrame, folder: str, key: str, start: Callable, add: Callable, order: str | None = None) -> DataFrame:
    """(key, file, rows) of the files written, one for each key: ``start`` (a path without its ending) opens a writer and
    ``add`` (writer, rows of one key) gives it some rows at a time, by ``order`` if there is one."""
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    folder = folder if "://" in folder else f"file://{folder}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        with tempfile.TemporaryDirectory() as own:
            current, writer, count = None, None, 0

            def done() -> Iterator[pd.DataFrame]:
                if writer is None:
                    return
                writer.close()
                for name in sorted(os.listdir(own)):
                    target = f"{root}/.{uuid.uuid4().hex}"
                    with open(f"{own}/{name}", "rb") as a, fs.open_output_stream(target) as b:
                        shutil.copyfileobj(a, b, 1 << 20)
                    fs.move(target, f"{root}/{name}")
                    os.unlink(f"{own}/{name}")
                yield pd.DataFrame({key: [current[0]], "file": [file_name(current[0])], "rows": [count]})

            for batch in batches:
                for value, part in batch.groupby(key, sort=False, dropna=False):
                    value = None if value is None or value != value else value
                    if current != (value,):
                        yield from done()
                        current, count = (value,), 0
                        writer = start(f"{own}/{file_name(value)}")
                    add(writer, part)
                    count += len(part)
            yield from done()

    dealt = rows.repartition(F.col(key)).sortWithinPartitions(key, *([order] if order else []))
    return dealt.mapInPandas(write, f"{key} {kind}, file string, rows long")


def write_layers(rows: DataFrame, folder: str, key: str, geometry: str, kind: str, form: str = "gpkg", layer: str = "layer", srid: int = 2180) -> DataFrame:
    """One vector file for each ``key``, in a folder that all executors see: ``form`` is gpkg, shp or geojson.

    ``geometry`` is a struct (x, y) of points, an array of points of lines, or an array of rings of polygons; a null one is a
    feature without geometry. The other columns, the key too, are attributes. The result lists the files; they are
    written when it is computed.
    """
    columns = [(n, k) for n, k in rows.dtypes if n != geometry]
    makers = {
        "shp": lambda path: ShapeWriter(path, kind, columns),
        "gpkg": lambda path: PackageWriter(path, kind, columns, layer, srid),
        "geojson": lambda path: JsonWriter(path, kind, columns, layer),
    }
    if form not in makers or kind not in KINDS:
        raise ValueError(f"unknown form {form} or kind {kind}")
    if form == "shp" and len({n[:10] for n, _ in columns}) < len(columns):
        raise ValueError("a shapefile keeps ten characters of a column's name, and these are not distinct")

    def add(writer, part: pd.DataFrame) -> None:
        values = [part[n].astype(object).where(part[n].notna(), None) for n, _ in columns]
        for g, *row in zip(part[geometry], *values):
            writer.add(parts_of(kind, json.loads(g)) if isinstance(g, str) else None, row)

    # geometries travel as text: arrays of rings of different lengths have no form in numpy
    return write_files(rows.withColumn(geometry, F.to_json(geometry)), folder, key, makers[form], add)
