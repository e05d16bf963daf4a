"""Round trips of the sources and sinks, and what they refuse."""

import io
import json
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.sources import las, layers, tables, vectors


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    las.register(spark)


def test_las_round_trip(spark, tmp_path):
    rows = [(float(i) / 4, float(i % 7), i / 1000, i % 6, i % 40, i * 0.5, i % 256, 3, 70000, 1, 2) for i in range(2500)]
    df = spark.createDataFrame(rows, "x double, y double, z double, classification int, intensity int, gps_time double, red int, green int, blue int, return_number int, number_of_returns int")
    df.repartition(3).write.format("las").mode("append").save(f"file://{tmp_path}/las")
    back = spark.read.format("las").option("chunk", 400).load(f"file://{tmp_path}/las")
    assert back.rdd.getNumPartitions() >= 7
    got = sorted((round(r.x, 3), round(r.y, 3), round(r.z, 3), r.classification, r.intensity, r.gps_time, r.red, r.green, r.blue, r.return_number, r.number_of_returns) for r in back.collect())
    assert got == sorted((x, y, round(z, 3), c, i, g, r, gr, min(b, 65535), a, n) for x, y, z, c, i, g, r, gr, b, a, n in rows)
    head = spark.read.format("las").option("header", "true").load(f"file://{tmp_path}/las").collect()
    assert sum(r.points for r in head) == 2500 and min(r.xmin for r in head) == 0.0 and max(r.xmax for r in head) == 2499 / 4


def test_las_of_no_points_and_laz(spark, tmp_path):
    empty = spark.createDataFrame([], "x double, y double, z double")
    empty.write.format("las").mode("append").save(f"file://{tmp_path}/none")
    with pytest.raises(ValueError, match="not a LAS"):
        las.read_header(b"nope" + bytes(400))
    file = las.LasFile(io.BytesIO())
    file.add({"x": np.array([1.0]), "y": np.array([2.0]), "z": np.array([3.0])})
    raw = bytearray(file.header() + file.body.getvalue())
    assert las.read_header(bytes(raw))["points"] == 1
    raw[104] |= 0x80
    with pytest.raises(ValueError, match="LAZ"):
        las.read_header(bytes(raw))


def test_geojson(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2]}, "properties": {"id": 7, "name": "x"}}]}')
    (tmp_path / "b.json").write_text("not json")
    got = vectors.read_geojson(spark, f"{tmp_path}/*.json", "id long, name string").collect()
    assert [(r.type, r.coordinates, r.id, r.name) for r in got] == [("Point", "[1.5,2]", 7, "x")]
    assert vectors.valid_json(str(tmp_path / "a.json")) and not vectors.valid_json(str(tmp_path / "b.json"))
    line = vectors.point_features(spark.createDataFrame([(1.0, 2.0, "k")], "x double, y double, code string")).first().value
    assert line == '{"type":"Feature","geometry":{"type":"Point","coordinates":[1.0,2.0]},"properties":{"code":"k"}}'


def test_kml(spark, tmp_path):
    (tmp_path / "a.kml").write_text("<kml><Document><Placemark><name>t</name><LineString><coordinates>1,2,3 4,5,6</coordinates></LineString></Placemark></Document></kml>")
    assert [tuple(r) for r in vectors.read_kml_lines(spark, str(tmp_path / "a.kml")).collect()] == [("t", 0, 1.0, 2.0, 3.0), ("t", 1, 4.0, 5.0, 6.0)]


def test_gpx(spark, tmp_path):
    vectors.write_gpx(spark.createDataFrame([(52.0, 19.0, 1.5, "a")], "lat double, lon double, ele double, name string").coalesce(1), str(tmp_path / "g"))
    text = "".join(p.read_text() for p in (tmp_path / "g").glob("part-*"))
    assert 'lat="52.0"' in text and "<ele>1.5</ele>" in text and "<gpx>" in text


def test_shapefile(spark, tmp_path):
    line = struct.pack("<i4d2i", 3, 0, 0, 2, 2, 1, 2) + struct.pack("<i", 0) + struct.pack("<4d", 0, 0, 2, 2)
    point = struct.pack("<i2d", 1, 5.0, 6.0)
    body = b"".join(struct.pack(">2i", k + 1, len(x) // 2) + x for k, x in enumerate((line, point)))
    (tmp_path / "a.shp").write_bytes(bytes(100) + body)
    got = [tuple(r)[1:] for r in vectors.read_shapefiles(spark, str(tmp_path)).collect()]
    assert got == [(0, 0, 0, 0.0, 0.0), (0, 0, 1, 2.0, 2.0), (1, 0, 0, 5.0, 6.0)]


def test_geopackage(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.gpkg") as db:
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
        db.execute("insert into gpkg_geometry_columns values ('pts', 'geom')")
        db.execute("create table pts (id integer, geom blob)")
        wkb = struct.pack("<BI2d", 1, 1, 3.0, 4.0)
        db.execute("insert into pts values (9, ?)", (b"GP\0\x01" + struct.pack("<i", 2180) + wkb,))
    db.close()
    row = vectors.read_geopackages(spark, str(tmp_path), "pts", "id long").first()
    assert (row.file, bytes(row.wkb), row.id) == ("a.gpkg", wkb, 9)


def test_columns_with_skipped_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text("head\nunits\n 1.0   2.5 x\n3.0 bad y\n\n")
    got = tables.read_columns(spark, str(tmp_path / "t.txt"), {"a": "double", "b": "double", "c": "string"}, skip=2).collect()
    assert [tuple(r) for r in got] == [("t.txt", 1.0, 2.5, "x"), ("t.txt", 3.0, None, "y")]


def test_csv_in_cp1250(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("1;Łąka\n2;x\n".encode("cp1250"))
    assert [r.name for r in tables.read_csv(spark, str(tmp_path / "t.csv"), "id int, name string", sep=";", encoding="cp1250").orderBy("id").collect()] == ["Łąka", "x"]


def test_template_header_and_worldfile(spark, tmp_path):
    tables.write_with_header(spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string").coalesce(1), str(tmp_path / "h"), ["x", "y", "z"])
    assert "".join(p.read_text() for p in (tmp_path / "h").glob("part-*")) == "x\ny\nz\n1;a\n2;b\n"
    tables.write_worldfiles(spark.createDataFrame([("r1", 0.25, 10.0, 20.0)], "raster string, px double, x double, y double"), str(tmp_path / "w"), "raster")
    assert "".join(p.read_text() for p in (tmp_path / "w" / "raster=r1").glob("part-*")).split() == ["0.25", "0.0", "0.0", "-0.25", "10.0", "20.0"]


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 1\nNODATA_value -9999\n1 -9999\n3 4\n")
    got = sorted(tuple(r)[1:] for r in tables.read_ascii_grid(spark, str(tmp_path / "g.asc")).collect())
    assert got == [(0, 0, 10.5, 21.5, 1.0), (0, 1, 11.5, 21.5, None), (1, 0, 10.5, 20.5, 3.0), (1, 1, 11.5, 20.5, 4.0)]
    tables.write_ascii_rows(spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "r int, c int, value double"), str(tmp_path / "o"))
    assert "".join(p.read_text() for p in (tmp_path / "o").glob("part-*")) == "1.0 -9999.0\n"


def test_listing(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"12345")
    (tmp_path / "b.txt").write_bytes(b"1")
    assert [(r.name, r.length) for r in tables.listing(spark, str(tmp_path), "*.tif").collect()] == [("a.tif", 5)]


def test_tiff_round_trip_and_refusals(spark, tmp_path):
    from terrasift.sources import images

    pixels = np.arange(12, dtype="f4").reshape(2, 2, 3)
    (tmp_path / "a.tif").write_bytes(images.encode_tiff(pixels, 0.5, 100.0, 200.0, nodata=4.0))
    (tmp_path / "b.tif").write_bytes(b"broken")
    rows = images.read_tiffs(spark, str(tmp_path)).collect()
    assert {r.error for r in rows if r.file == "b.tif"} == {"not a TIFF file"}
    good = {(r.band, r.r, r.c): r for r in rows if r.file == "a.tif"}
    assert len(good) == 12 and good[1, 1, 1].value is None and good[2, 0, 2].value == 8.0
    assert (good[1, 0, 0].x, good[1, 0, 0].y) == (100.25, 199.75)


def test_photo_positions(spark, tmp_path):
    from terrasift.sources import images

    gps = struct.pack("<H", 4) + struct.pack("<HHI4s", 1, 2, 2, b"S\0") + struct.pack("<HHII", 2, 5, 3, 100) + struct.pack("<HHI4s", 3, 2, 2, b"E\0") + struct.pack("<HHII", 4, 5, 3, 124)
    block = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 34853, 4, 1, 30) + bytes(4)
    block = block.ljust(30, b"\0") + gps
    block = block.ljust(100, b"\0") + struct.pack("<6I", 52, 1, 30, 1, 0, 1) + struct.pack("<6I", 19, 1, 15, 1, 36, 1)
    app = b"Exif\0\0" + block
    (tmp_path / "p.JPG").write_bytes(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xda\0\0")
    (tmp_path / "q.jpg").write_bytes(b"\xff\xd8\xff\xda\0\0")
    got = {r.path.rsplit("/", 1)[1]: (r.lat, r.lon) for r in images.read_photo_positions(spark, str(tmp_path)).collect()}
    assert got["q.jpg"] == (None, None) and abs(got["p.JPG"][0] + 52.5) < 1e-9 and abs(got["p.JPG"][1] - 19.26) < 1e-9


def test_las_by_key(spark, tmp_path):
    rows = [(f"s{i % 3}^t/{i % 2}", i / 4, float(i), -i / 2, i % 4, None if i % 5 else i) for i in range(600)] + [(None, 1.0, 2.0, 3.0, 2, 7)]
    points = spark.createDataFrame(rows, "scan string, x double, y double, z double, classification int, red int")
    files = {r.file: r.rows for r in las.write_by_key(points, str(tmp_path / "out"), "scan").collect()}
    assert files == {f"s{a}^t_{b}": 100 for a in range(3) for b in range(2)} | {"none": 1}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"{f}.las" for f in files)
    back = spark.read.format("las").load(f"file://{tmp_path}/out").collect()
    got = sorted((r.file[:-4], round(r.x, 3), round(r.y, 3), round(r.z, 3), r.classification, r.red) for r in back)
    assert got == sorted((layers.file_name(k), x, y, z, c, r or 0) for k, x, y, z, c, r in rows)
    las.write_by_key(points, str(tmp_path / "out"), "scan").collect()  # a repeated write replaces the files
    assert spark.read.format("las").load(f"file://{tmp_path}/out").count() == len(rows)


SQUARE = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)]  # clockwise
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)]
GEOMETRIES = {
    "point": ("struct<x: double, y: double>", [(1.5, 2.5), (3.0, 4.0), None]),
    "line": ("array<struct<x: double, y: double>>", [[(0.0, 0.0), (1.0, 2.0)], [(5.0, 5.0), (6.0, 5.0), (6.0, 7.0)], None]),
    "polygon": ("array<array<struct<x: double, y: double>>>", [[SQUARE], [SQUARE, HOLE], None]),
}


@pytest.mark.parametrize("kind", GEOMETRIES)
@pytest.mark.parametrize("form", ["gpkg", "shp", "geojson"])
def test_layers_by_key(spark, tmp_path, form, kind):
    ddl, values = GEOMETRIES[kind]
    rows = [(f"k{i % 2}", v, i, i / 2, f"żółw {i}" if i else None) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, f"key string, geom {ddl}, n long, height double, note string")
    files = layers.write_layers(table, str(tmp_path / "out"), "key", "geom", kind, form, layer="strefy").collect()
    assert {(r.key, r.file, r.rows) for r in files} == {("k0", "k0", 2), ("k1", "k1", 1)}
    if form == "geojson":
        whole = [f for k in ("k0", "k1") for f in json.loads((tmp_path / "out" / f"{k}.geojson").read_text())["features"]]
        assert sorted((f["properties"]["n"], f["properties"]["note"]) for f in whole) == [(0, None), (1, "żółw 1"), (2, "żółw 2")]
        by = {f["properties"]["n"]: f["geometry"] for f in whole}
        assert by[2] is None and by[0]["type"] == layers.KINDS[kind][0]
        if kind == "polygon":
            assert by[1]["coordinates"][0][:2] == [[0.0, 0.0], [4.0, 0.0]] and len(by[1]["coordinates"]) == 2 and by[1]["coordinates"][1][0] == by[1]["coordinates"][1][-1]
    elif form == "gpkg":
        back = {r.n: r for r in vectors.read_geopackages(spark, str(tmp_path / "out"), "strefy", "n long, height double, note string").collect()}
        assert {i: (r.height, r.note) for i, r in back.items()} == {i: (h, t) for _, _, i, h, t in rows}
        for i, v in enumerate(values):
            assert (back[i].wkb is None) == (v is None)
            if v is not None:
                plain = {"x": v[0], "y": v[1]} if kind == "point" else [{"x": x, "y": y} for x, y in v] if kind == "line" else [[{"x": x, "y": y} for x, y in r] for r in v]
                assert bytes(back[i].wkb) == layers.to_wkb(kind, layers.parts_of(kind, plain))
        with sqlite3.connect(tmp_path / "out" / "k1.gpkg") as db:
            assert db.execute("select table_name, data_type, srs_id, min_x is not null from gpkg_contents").fetchall() == [("strefy", "features", 2180, 1)]
            assert db.execute("pragma application_id").fetchone() == (0x47504B47,)
    else:
        back = vectors.read_shapefiles(spark, str(tmp_path / "out")).collect()
        own = sorted((r.record, r.part, r.seq, r.x, r.y) for r in back if r.file == "k1.shp")
        if kind == "point":
            assert own == [(0, 0, 0, 3.0, 4.0)]
        elif kind == "line":
            assert [(x, y) for *_, x, y in own] == values[1]
        else:
            assert [(x, y) for _, p, _, x, y in own if p == 0][:2] == [(0.0, 0.0), (0.0, 4.0)] and {p for _, p, *_ in own} == {0, 1}
        raw = (tmp_path / "out" / "k0.dbf").read_bytes()
        assert struct.unpack_from("<IHH", raw, 4)[0] == 2 and b"n\0" in raw[:200] and "żółw 2".encode() in raw
        assert len((tmp_path / "out" / "k0.shx").read_bytes()) == 100 + 8 * 2
        length = struct.unpack(">i", (tmp_path / "out" / "k0.shp").read_bytes()[24:28])[0]
        assert length * 2 == len((tmp_path / "out" / "k0.shp").read_bytes())


def test_layers_refuse(spark, tmp_path):
    table = spark.createDataFrame([("a", (1.0, 2.0), 1, 2)], "key string, geom struct<x: double, y: double>, a_long_name_1 int, a_long_name_2 int")
    with pytest.raises(ValueError, match="ten characters"):
        layers.write_layers(table, str(tmp_path), "key", "geom", "point", "shp")
    with pytest.raises(ValueError, match="unknown"):
        layers.write_layers(table, str(tmp_path), "key", "geom", "point", "dwg")


def test_append_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    for _ in range(2):
        tables.append_once(rows, str(tmp_path / "t"), "scan-1", header=True)
    tables.append_once(rows.where("id = 1"), str(tmp_path / "t"), "scan-2", header=True)
    got = spark.read.csv(str(tmp_path / "t"), header=True, schema="id int, name string").collect()
    assert sorted((r.id, r["batch"]) for r in got) == [(1, "scan-1"), (1, "scan-2"), (2, "scan-1")]


def test_coverage_report(spark, tmp_path):
    files = spark.createDataFrame([("a.laz", None), ("c.laz", "broken"), ("b.laz", "broken")], "name string, error string")
    cells = spark.range(30)
    tables.write_report(tables.coverage_report(files, cells, "/skany", 0.5), str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part-*")).split("\n")
    assert text[1] == "Źródłowy katalog: /skany" and text[4] == "Liczba plików z błędem: 2"
    assert text[7:9] == ["Powierzchnia pokrycia: 7.50 m²", "Powierzchnia pokrycia: 0.0008 ha"]
    assert text[9:13] == ["", "Pliki, których nie udało się przetworzyć:", " - b.laz", " - c.laz"]
    whole = tables.coverage_report(files.where("error is null"), cells, "/skany", 0.5)
    assert whole.count() == 9


def test_what_is_missing(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"1")
    wanted = spark.createDataFrame([("https://x.example/d/a.tif",), ("https://x.example/d/b.tif",)], "address string")
    assert [r.address for r in tables.missing(wanted, tables.listing(spark, str(tmp_path)), "address").collect()] == ["https://x.example/d/b.tif"]


def test_workbooks(spark, tmp_path):
    import pickle

    from terrasift.sources import office

    rows = [("a", 2, 1.5, "x & <y>"), ("a", 1, None, "żółw"), ("b", 1, -3.0, None)]
    table = spark.createDataFrame(rows, "key string, n int, height double, note string")
    assert {(r.file, r.rows) for r in office.write_workbooks(table, str(tmp_path / "w"), "key", "n").collect()} == {("a", 2), ("b", 1)}
    cells = {(r.file, r.r, r.c): r.value for r in office.read_workbooks(spark, str(tmp_path / "w")).collect()}
    assert cells == {
        ("a.xlsx", 0, 0): "n", ("a.xlsx", 0, 1): "height", ("a.xlsx", 0, 2): "note", ("a.xlsx", 1, 0): "1", ("a.xlsx", 1, 2): "żółw",
        ("a.xlsx", 2, 0): "2", ("a.xlsx", 2, 1): "1.5", ("a.xlsx", 2, 2): "x & <y>",
        ("b.xlsx", 0, 0): "n", ("b.xlsx", 0, 1): "height", ("b.xlsx", 0, 2): "note", ("b.xlsx", 1, 0): "1", ("b.xlsx", 1, 1): "-3.0",
    }
    got = office.read_table(spark, str(tmp_path / "w"), {"n": "int", "height": "double", "note": "string"}).collect()
    assert sorted((r.file, r.n, r.height, r.note) for r in got if r.height) == [("a.xlsx", 2, 1.5, "x & <y>"), ("b.xlsx", 1, -3.0, None)]
    (tmp_path / "w" / "c.xlsx").write_bytes(b"broken")
    assert [r.file for r in office.read_workbooks(spark, str(tmp_path / "w")).where("error is not null").collect()] == ["c.xlsx"]
    assert [office.column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(office.column_number(office.column_name(k) + "7") == k for k in range(1500))
    office.write_documents(table, str(tmp_path / "d"), "key", "n", "note").collect()
    import zipfile

    text = zipfile.ZipFile(tmp_path / "d" / "a.docx").read("word/document.xml").decode()
    assert text.index("żółw") < text.index("x &amp; &lt;y&gt;")
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "plain").write_bytes(pickle.dumps({"a": [1, 2.5, None], "b": "é"}))
    (tmp_path / "p" / "code").write_bytes(pickle.dumps(print))
    found = {r.file: (r.value, r.error) for r in office.read_pickles(spark, str(tmp_path / "p")).collect()}
    assert json.loads(found["plain"][0]) == {"a": [1, 2.5, None], "b": "é"} and "isn't a plain value" in found["code"][1]
