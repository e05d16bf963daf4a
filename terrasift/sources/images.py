"""Uncompressed TIFF rasters and the positions in JPEG photos, read in tasks from the files' bytes."""

from __future__ import annotations

import os
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from terrasift.session import ship

#: TIFF field types: bytes and struct letters; fixed by the format.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 339
SCALE, TIEPOINT, NODATA, GPS = 33550, 33922, 42113, 34853


def read_directory(raw: bytes, at: int, order: str) -> dict[int, tuple]:
    """The fields of one directory of a TIFF structure."""
    out = {}
    for k in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
        if kind not in TYPES:
            continue
        size, letters = TYPES[kind]
        place = at + 10 + 12 * k
        if size * count > 4:
            place = struct.unpack_from(order + "I", raw, place)[0]
        if kind == 2:
            out[tag] = (raw[place : place + count].rstrip(b"\0").decode("latin-1"),)
        else:
            values = struct.unpack_from(order + letters * count, raw, place)
            out[tag] = tuple(a / b if b else 0.0 for a, b in zip(values[::2], values[1::2])) if len(letters) == 2 else values
    return out


def byte_order(raw: bytes) -> str:
    if raw[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    return "<" if raw[:2] == b"II" else ">"


def decode_tiff(raw: bytes) -> tuple[np.ndarray, dict]:
    """The bands (band, row, column) of an uncompressed striped TIFF, and its transform and no-data value."""
    order = byte_order(raw)
    f = read_directory(raw, struct.unpack_from(order + "I", raw, 4)[0], order)
    if f.get(COMPRESSION, (1,))[0] != 1:
        raise ValueError("compressed TIFF isn't supported")
    if OFFSETS not in f:
        raise ValueError("tiled TIFF isn't supported")
    width, height, bands = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, (1,))[0]
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[f.get(FORMAT, (1,))[0]]}{f[BITS][0] // 8}")
    data = np.frombuffer(b"".join(raw[a : a + n] for a, n in zip(f[OFFSETS], f[COUNTS])), kind)
    pixels = data.reshape(bands, height, width) if f.get(PLANAR, (1,))[0] == 2 else data.reshape(height, width, bands).transpose(2, 0, 1)
    scale, tie = f.get(SCALE, (1.0, 1.0, 0.0)), f.get(TIEPOINT, (0.0,) * 6)
    nodata = float(f[NODATA][0]) if NODATA in f else None
    return pixels, {"px": scale[0], "x0": tie[3], "y0": tie[4], "nodata": nodata}


def encode_tiff(pixels: np.ndarray, px: float, x0: float, y0: float, nodata: float | None = None) -> bytes:
    """A little-endian, striped, uncompressed TIFF of 32-bit floats, one strip per band."""
    bands, height, width = pixels.shape
    body = [np.ascontiguousarray(p, "<f4").tobytes() for p in pixels]
    fields: list[tuple[int, int, tuple | bytes]] = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (32,) * bands), (COMPRESSION, 3, (1,)), (262, 3, (1,)), (OFFSETS, 4, (0,) * bands),
        (SAMPLES, 3, (bands,)), (ROWS, 4, (height,)), (COUNTS, 4, tuple(len(b) for b in body)), (PLANAR, 3, (2,)), (FORMAT, 3, (3,) * bands),
        (SCALE, 12, (px, px, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, x0, y0, 0.0)),
    ]
    if nodata is not None:
        fields.append((NODATA, 2, f"{nodata}\0".encode()))
    at = 8 + 2 + 12 * len(fields) + 4
    extra = sum(len(v) * TYPES[t][0] for _, t, v in fields if len(v) * TYPES[t][0] > 4)
    starts = np.cumsum([at + extra, *(len(b) for b in body)])[:-1].tolist()
    head, tail = struct.pack("<2sHIH", b"II", 42, 8, len(fields)), b""
    for tag, kind, value in fields:
        value = tuple(starts) if tag == OFFSETS else value
        raw = value if isinstance(value, bytes) else struct.pack("<" + TYPES[kind][1] * len(value), *value)
        head += struct.pack("<HHI", tag, kind, len(value))
        if len(raw) > 4:
            head += struct.pack("<I", at + len(tail))
            tail += raw
        else:
            head += raw.ljust(4, b"\0")
    return head + struct.pack("<I", 0) + tail + b"".join(body)


def read_tiffs(spark: SparkSession, path: str) -> DataFrame:
    """(file, band, r, c, x, y, value) of the rasters of a folder, some rows at a time; no data is null.

    A raster that can't be read gives one row with its ``error``.
    """
    ship(spark)

    def cells(batches):
        for rows in batches:
            for name, raw in zip(rows["path"], rows["content"]):
                file = os.path.basename(name)
                try:
                    pixels, t = decode_tiff(bytes(raw))
                except (ValueError, KeyError, struct.error) as e:
                    yield pd.DataFrame({"file": [file], "band": [0], "r": [0], "c": [0], "x": [None], "y": [None], "value": [None], "error": [str(e)]})
                    continue
                bands, height, width = pixels.shape
                step = max(1, 200_000 // width)
                for b in range(bands):
                    for r0 in range(0, height, step):
                        part = pixels[b, r0 : r0 + step].astype(float)
                        r, c = (i.ravel() for i in np.indices(part.shape))
                        value = part.ravel()
                        if t["nodata"] is not None:
                            value = np.where(value == t["nodata"], np.nan, value)
                        out = pd.DataFrame({"file": file, "band": b + 1, "r": r + r0, "c": c, "x": t["x0"] + (c + 0.5) * t["px"], "y": t["y0"] - (r + r0 + 0.5) * t["px"], "value": value})
                        yield out.assign(error=None)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", "content").mapInPandas(cells, "file string, band int, r long, c long, x double, y double, value double, error string")
    return rows.selectExpr("file", "band", "r", "c", "x", "y", "nanvl(value, null) as value", "error")


def photo_position(raw: bytes) -> tuple[float, float] | None:
    """(latitude, longitude) of the EXIF block of a JPEG file; None if it has none."""
    at = 2
    while at + 4 < len(raw) and raw[at] == 0xFF:
        marker, length = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        if marker == 0xE1 and raw[at + 4 : at + 10] == b"Exif\0\0":
            block = raw[at + 10 : at + 2 + length]
            order = byte_order(block)
            main = read_directory(block, struct.unpack_from(order + "I", block, 4)[0], order)
            if GPS not in main:
                return None
            gps = read_directory(block, main[GPS][0], order)
            if not {1, 2, 3, 4} <= set(gps):
                return None
            degrees = [sum(v / 60**k for k, v in enumerate(gps[t])) * (-1 if gps[t - 1][0] in "SW" else 1) for t in (2, 4)]
            return degrees[0], degrees[1]
        if marker == 0xDA:
            return None
        at += 2 + length
    return None


def read_photo_positions(spark: SparkSession, path: str) -> DataFrame:
    """(path, lat, lon) of the photos of a folder and its sub-folders; null where a photo has no position."""
    ship(spark)

    def positions(batches):
        for rows in batches:
            found = []
            for raw in rows["content"]:
                try:
                    found.append(photo_position(bytes(raw)) or (None, None))
                except (ValueError, KeyError, struct.error, IndexError):
                    found.append((None, None))
            yield pd.DataFrame({"path": rows["path"], "lat": [f[0] for f in found], "lon": [f[1] for f in found]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{JPG,jpg,jpeg}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(positions, "path string, lat double, lon double")
