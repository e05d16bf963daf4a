"""Vector layers: GeoJSON, KML and GPX through Spark's own readers, shapefiles and GeoPackages through small kernels."""

from __future__ import annotations

import json
import os
import sqlite3
import struct
import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.session import ship

POINT_TYPES = (1, 11, 21)


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """One row per feature: type, coordinates (as JSON), and ``properties``, a DDL schema. Invalid files give no rows."""
    schema = f"features array<struct<geometry: struct<type: string, coordinates: string>, properties: struct<{_colons(properties)}>>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))
    return rows.select(F.inline("j.features")).select(F.col("geometry.type").alias("type"), F.col("geometry.coordinates").alias("coordinates"), "properties.*")


def _colons(ddl: str) -> str:
    return ", ".join(f"{p.split()[0]}: {' '.join(p.split()[1:])}" for p in ddl.split(","))


def point_features(rows: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Each point as one GeoJSON feature (value); ``write.text`` makes a file of one feature per line."""
    rest = [c for c in rows.columns if c not in (x, y)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def read_kml_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, lon, lat, alt) of the vertices of every placemark."""
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema("name string, LineString struct<coordinates: string>").load(path)
    points = F.split(F.trim("LineString.coordinates"), r"\s+")
    parts = F.split("p", ",")
    at = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("double")
    return rows.select("name", F.posexplode(points).alias("seq", "p")).select("name", "seq", at(1).alias("lon"), at(2).alias("lat"), at(3).alias("alt"))


def write_gpx(points: DataFrame, path: str) -> None:
    """Waypoints (lat, lon, ele, name) as GPX elements, one file per task."""
    row = F.struct(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "ele", "name")
    points.select(row.alias("w")).select("w.*").write.format("xml").option("rootTag", "gpx").option("rowTag", "wpt").save(path)


def _shapes(raw: bytes) -> list[list[list[tuple[float, float]]]]:
    """The parts of every record of a .shp file."""
    at, out = 100, []
    while at + 8 <= len(raw):
        length = struct.unpack_from(">i", raw, at + 4)[0] * 2
        body, at = raw[at + 8 : at + 8 + length], at + 8 + length
        kind = struct.unpack_from("<i", body)[0]
        if kind in POINT_TYPES:
            out.append([[struct.unpack_from("<2d", body, 4)]])
        elif kind in (3, 5, 13, 15, 23, 25):
            parts, points = struct.unpack_from("<2i", body, 36)
            first = [*struct.unpack_from(f"<{parts}i", body, 44), points]
            xy = list(struct.iter_unpack("<2d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points]))
            out.append([xy[a:b] for a, b in zip(first, first[1:])])
        else:
            out.append([])
    return out


def read_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, part, seq, x, y) of the vertices in the .shp files of a folder."""
    ship(spark)

    def vertices(batches):
        for rows in batches:
            for name, raw in zip(rows["path"], rows["content"]):
                file = os.path.basename(name)
                out = [(file, i, j, k, *p) for i, parts in enumerate(_shapes(bytes(raw))) for j, part in enumerate(parts) for k, p in enumerate(part)]
                yield pd.DataFrame(out, columns=["file", "record", "part", "seq", "x", "y"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(vertices, "file string, record long, part long, seq long, x double, y double")


def read_geopackages(spark: SparkSession, path: str, layer: str, columns: str) -> DataFrame:
    """Rows of a layer in the GeoPackages of a folder: file, the geometry as WKB, and ``columns``, a DDL schema.

    A package is an SQLite database; each task opens a private copy of the files that it was sent.
    """
    ship(spark)
    names = [c.split()[0] for c in columns.split(",")]

    def rows_of(batches):
        for rows in batches:
            for name, raw in zip(rows["path"], rows["content"]):
                with tempfile.NamedTemporaryFile(suffix=".gpkg") as own:
                    own.write(bytes(raw))
                    own.flush()
                    with sqlite3.connect(own.name) as db:
                        geometry = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()
                        listed = ", ".join(f'"{c}"' for c in [geometry[0] if geometry else "geom", *names])
                        found = db.execute(f'select {listed} from "{layer}"').fetchall()
                out = pd.DataFrame(found, columns=["wkb", *names])
                out["wkb"] = [None if g is None else _plain_wkb(g) for g in out["wkb"]]
                yield out.assign(file=os.path.basename(name))[["file", "wkb", *names]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gpkg").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(rows_of, f"file string, wkb binary, {columns}")


def _plain_wkb(blob: bytes) -> bytes:
    """The WKB of a GeoPackage geometry, after its header and envelope."""
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7]
    return blob[8 + envelope :]


def valid_json(path: str) -> bool:
    """Whether a local file holds JSON."""
    try:
        with open(path, encoding="utf-8") as f:
            json.load(f)
    except ValueError:
        return False
    return True
