"""Point clouds in uncompressed LAS 1.2 to 1.4 files, as a Spark data source.

``spark.read.format("las").load(folder)`` gives one row per point. A partition is a range of the points of one file, so
a large file is read by many tasks, each of which reads its own bytes only. With the option ``header`` set to true there
is one row per file, read from its first bytes: extent, number of points, point format. Compressed LAZ files are refused.
``df.write.format("las").save(folder)`` writes one file for each task, from Arrow batches and under a temporary name until
it is whole; ``write_by_key`` writes one file for each key.
"""

from __future__ import annotations

import posixpath
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from terrasift.sources.layers import write_files

CHUNK = 1_000_000
#: The leading fields of a point record, which formats 0 to 5 share; fixed by the format.
BASE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("scan_angle_rank", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
#: The leading fields of formats 6 and above.
BASE6 = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("flags2", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle_rank", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
COLOR = [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
FIELDS = {
    0: BASE,
    1: [*BASE, ("gps_time", "<f8")],
    2: [*BASE, *COLOR],
    3: [*BASE, ("gps_time", "<f8"), *COLOR],
    6: BASE6,
    7: [*BASE6, *COLOR],
}
SCHEMA = (
    "file string, x double, y double, z double, intensity int, return_number int, number_of_returns int, classification int, "
    "scan_angle_rank int, user_data int, point_source_id int, gps_time double, red int, green int, blue int"
)
HEADER = "file string, points long, point_format int, version string, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double"
WRITTEN = 3


def read_header(raw: bytes) -> dict:
    """The public header block."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    offset, = struct.unpack_from("<I", raw, 96)
    kind, size, points = struct.unpack_from("<BHI", raw, 104)
    if kind & 0x80:
        raise ValueError("compressed point records (LAZ) aren't supported")
    if kind not in FIELDS:
        raise ValueError(f"point format {kind} isn't supported")
    major, minor = raw[24], raw[25]
    if minor >= 4 and len(raw) >= 255:
        points = struct.unpack_from("<Q", raw, 247)[0] or points
    scale, shift = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
    xmax, xmin, ymax, ymin, zmax, zmin = struct.unpack_from("<6d", raw, 179)
    return {"offset": offset, "format": kind, "size": size, "points": points, "version": f"{major}.{minor}", "scale": scale, "shift": shift, "box": (xmin, ymin, zmin, xmax, ymax, zmax)}


class Range(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.chunk = options["path"], int(options.get("chunk", CHUNK))
        self.header = str(options.get("header", "false")).lower() == "true"

    def _files(self):
        fs, root = pafs.FileSystem.from_uri(self.folder)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return fs, [root]
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        return fs, sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.lower().endswith((".las", ".laz")))

    def partitions(self):
        fs, files = self._files()
        if self.header:
            return [Range(f, 0, 0) for f in files] or [Range("", 0, 0)]
        out = []
        for f in files:
            with fs.open_input_file(f) as raw:
                points = read_header(raw.read(375))["points"]
            out += [Range(f, k, min(self.chunk, points - k)) for k in range(0, points, self.chunk)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        name = posixpath.basename(partition.path)
        with fs.open_input_file(partition.path) as raw:
            h = read_header(raw.read(375))
            if self.header:
                kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
                columns = [(n, kinds[k]) for n, k in (c.split() for c in HEADER.split(", "))]
                values = (name, h["points"], h["format"], h["version"], *h["box"])
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, columns)], schema=pa.schema(columns))
                return
            fields = FIELDS[h["format"]]
            kind = np.dtype({"names": [f for f, _ in fields], "formats": [t for _, t in fields], "itemsize": h["size"]})
            for k in range(0, partition.count, 100_000):
                n = min(100_000, partition.count - k)
                rows = np.frombuffer(raw.read_at(n * h["size"], h["offset"] + (partition.first + k) * h["size"]), kind, n)
                yield self._batch(name, rows, h)

    def _batch(self, name: str, rows: np.ndarray, h: dict) -> pa.RecordBatch:
        n, new = len(rows), h["format"] >= 6
        bits = 4 if new else 3
        has = rows.dtype.names
        zero = np.zeros(n, np.int32)
        xyz = [pa.array(rows[a] * h["scale"][k] + h["shift"][k]) for k, a in enumerate("XYZ")]
        whole = lambda f: pa.array(rows[f].astype(np.int32) if f in has else zero)
        flags = rows["flags"].astype(np.int32)
        classes = rows["classification"].astype(np.int32)
        columns = [
            pa.array([name] * n), *xyz, whole("intensity"), pa.array(flags & ((1 << bits) - 1)), pa.array((flags >> bits) & ((1 << bits) - 1)),
            pa.array(classes if new else classes & 31), whole("scan_angle_rank"), whole("user_data"), whole("point_source_id"),
            pa.array(rows["gps_time"] if "gps_time" in has else np.zeros(n)), whole("red"), whole("green"), whole("blue"),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


class Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


#: Fields that are kept within a range, and its greatest value.
MOST = {"intensity": 65535, "user_data": 255, "point_source_id": 65535, "red": 65535, "green": 65535, "blue": 65535, "classification": 31}


class LasFile:
    """A LAS 1.2 file of point format 3, written batch by batch; the header, which tells how many points there are and where
    they lie, is made at the end. Coordinates are kept to the scale, colours and classes within their range."""

    def __init__(self, body, scale: float = 0.001):
        self.body, self.scale, self.kind = body, scale, np.dtype(FIELDS[WRITTEN])
        self.count, self.low, self.high, self.shift = 0, np.zeros(3), np.zeros(3), None

    def add(self, columns: dict[str, np.ndarray]) -> None:
        """Some points: columns by name; a column that is missing, or null, is 0."""
        xyz = np.stack([np.nan_to_num(np.asarray(columns[c], float)) for c in "xyz"], axis=1)
        if not len(xyz):
            return
        low, high = xyz.min(axis=0), xyz.max(axis=0)
        if self.shift is None:
            self.shift, self.low, self.high = np.floor(low), low, high
        self.low, self.high = np.minimum(self.low, low), np.maximum(self.high, high)
        out = np.zeros(len(xyz), self.kind)
        for k, c in enumerate("XYZ"):
            whole = np.round((xyz[:, k] - self.shift[k]) / self.scale)
            if np.abs(whole).max() >= 2**31:
                raise ValueError("the points of a file lie too far apart for its scale")
            out[c] = whole
        get = lambda f: np.nan_to_num(np.asarray(columns[f], float)) if f in columns else np.zeros(len(xyz))
        for f, most in MOST.items():
            out[f] = np.clip(get(f), 0, most)
        out["flags"] = np.clip(get("return_number"), 0, 7).astype(int) | (np.clip(get("number_of_returns"), 0, 7).astype(int) << 3)
        out["scan_angle_rank"] = np.clip(get("scan_angle_rank"), -90, 90)
        out["gps_time"] = get("gps_time")
        self.body.write(out.tobytes())
        self.count += len(out)

    def header(self) -> bytes:
        shift = np.zeros(3) if self.shift is None else self.shift
        counts = (self.count, self.count, 0, 0, 0, 0)
        head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I", b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"", b"terrasift", 1, 2020, 227, 227, 0, WRITTEN, self.kind.itemsize, *counts)
        (x0, y0, z0), (x1, y1, z1) = self.low, self.high
        return head + struct.pack("<12d", *[self.scale] * 3, *shift, x1, x0, y1, y0, z1, z0)


class KeyedFile(LasFile):
    """A file of its own, completed when it is closed."""

    def __init__(self, path: str):
        self.path, self.spool = f"{path}.las", tempfile.TemporaryFile()  # noqa: SIM115
        super().__init__(self.spool)

    def close(self) -> None:
        self.spool.seek(0)
        with open(self.path, "wb") as out:
            out.write(self.header())
            shutil.copyfileobj(self.spool, out, 1 << 20)
        self.spool.close()


def write_by_key(points: DataFrame, folder: str, key: str) -> DataFrame:
    """One LAS file for each ``key``, such as scan^tile; the result lists the files, which are written when it is computed."""

    def add(writer: KeyedFile, part: pd.DataFrame) -> None:
        writer.add({c: part[c].to_numpy() for c in part.columns if c != key})

    return write_files(points, folder, key, KeyedFile, add)


class LasWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        with tempfile.TemporaryFile() as body:  # on the task's own disk until the header is known
            file = LasFile(body)
            for batch in iterator:
                known = [f for f in batch.schema.names if f in (*"xyz", *MOST, "return_number", "number_of_returns", "scan_angle_rank", "gps_time")]
                file.add({f: batch.column(f).to_numpy(zero_copy_only=False) for f in known})
            if not file.count:  # no file for no points
                return Written(None)
            fs, root = pafs.FileSystem.from_uri(self.folder)
            fs.create_dir(root, recursive=True)
            name = f"part-{uuid.uuid4().hex}.las"
            body.seek(0)
            with fs.open_output_stream(f"{root}/.{name}") as out:
                out.write(file.header())
                shutil.copyfileobj(body, out, 1 << 20)
        return Written(name)

    def commit(self, messages) -> None:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        for m in messages:
            if m and m.name:
                fs.move(f"{root}/.{m.name}", f"{root}/{m.name}")

    def abort(self, messages) -> None:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{root}/.{m.name}")


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return HEADER if str(self.options.get("header", "false")).lower() == "true" else SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> LasWriter:
        return LasWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LasSource)
