"""Results over all rows against brute force, and hand-made cases with the values that they must have."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from terrasift.operators import raster as R
from terrasift.operators import spatial as S
from terrasift.operators import vector as V
from terrasift.plans.fixtures import view, with_views
from terrasift.plans import joins as J
from tests import oracle
from tests.oracle import connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_registered_sql_has_no_cuts():
    for name in ("join_corridor", "join_nearest_per_side", "cq_cross_section_validate", "join_same_line_group", "cq_shift_snap"):
        assert "id %" not in SQL[name].split("where kod", 1)[1]
    for name in ("join_extent_intersects", "cq_cross_section_metadata"):
        assert "x < 12" not in SQL[name]
    assert "% 11" not in SQL["agg_mode"] and "499" not in SQL["ras_bbox_expand"]


def on_hull(p):
    h = V.hull(p)
    return sum(any((b[0] - a[0]) * (q[1] - a[1]) == (b[1] - a[1]) * (q[0] - a[0]) for a, b in zip(h, np.roll(h, -1, axis=0))) for q in p)


def test_triangles_are_delaunay_and_fill_the_hull():
    rng = np.random.default_rng(0)
    for size in (5, 9, 30):
        p = np.unique(rng.integers(0, size, (40, 2)).astype(float), axis=0)
        t = V.triangulated(p)
        assert len(t) == 2 * len(p) - 2 - on_hull(p)
        for tri in t:
            lifted = p[tri][:, None] - p[None]
            m = np.concatenate([lifted, (lifted**2).sum(axis=2, keepdims=True)], axis=2).transpose(1, 0, 2)
            assert (np.linalg.det(m) <= 1e-6).all()


def test_whole_files_are_triangulated(spark):
    points = view(spark, SF, "v_points").select("file", "x", "y").toPandas()
    area = {r.file: r.area for r in QUERIES["geo_alpha_shape"](spark, SF).collect()}
    got = {r.file: (r.points, r.triangles) for r in QUERIES["geo_delaunay_2d"](spark, SF).collect()}
    assert set(got) == set(area) == set(points["file"])
    for file, part in points.groupby("file"):
        p = np.unique(part[["x", "y"]].to_numpy(float), axis=0)
        assert got[file] == (len(p), len(V.triangulated(p)))
        assert abs(area[file] - V.alpha_area(p, 0.25)) < 1e-5


def test_meshes_and_ground_take_all_points(spark, db):
    want = dict(db.execute(with_views("select file, count(*) from v_points group by file")).fetchall())
    assert sum(r.n for r in QUERIES["cq_csf_ground"](spark, SF).collect()) == sum(want.values())
    assert {r.file for r in QUERIES["smp_mesh_area_weighted"](spark, SF).collect()} == set(want)


def test_heights_are_lowered(spark):
    kods = [
        (1, "RD", 0.0, 5.0), (2, "RDS", 1.0, 6.0), (3, "RGS", 2.0, 4.0),  # both are lowered
        (11, "RD", 100.0, 5.0), (12, "RGS", 101.0, 1.0), (13, "RGS", 102.0, 1.0),  # no RDS and two RGS: no change
        (21, "RD", 200.0, 1.0), (22, "RDS", 201.0, 2.0), (23, "RGS", 202.0, 3.0),  # already in order
        (31, "RDS", 300.0, 7.0),  # no RD within reach
        (41, "RD", 400.0, 2.0), (42, "RDS", 401.0, 2.0),  # no RGS; equal heights
        (51, "RD", 500.0, 9.0), (52, "RDS", 507.5, 1.0),  # beyond 7
        (61, "RL", 0.5, 0.0),
    ]
    points = spark.createDataFrame([(i, kod, x, 0.0, z) for i, kod, x, z in kods], "id long, kod string, x double, y double, z double")
    rows_ = {r.id: r for r in S.fixed_heights(points).collect()}
    assert {i: round(r.z, 6) for i, r in rows_.items()} == {
        1: 3.78, 2: 3.89, 3: 4.0, 11: 5.0, 12: 1.0, 13: 1.0, 21: 1.0, 22: 2.0, 23: 3.0, 31: 7.0, 41: 1.89, 42: 2.0, 51: 9.0, 52: 1.0, 61: 0.0
    }
    assert {i: r.old_z for i, r in rows_.items() if r.old_z is not None} == {1: 5.0, 41: 2.0}
    assert {i: r.fix_reason for i, r in rows_.items() if r.auto_fixed} == {1: "RD<RDS enforced", 2: "RDS<RGS enforced", 41: "RD<RDS enforced"}
    assert {r.fix_reason for r in rows_.values() if not r.auto_fixed} == {""}


def test_heights_are_those_of_brute_force(spark):
    points = view(spark, SF, "v_codes").toPandas()
    by = {k: part[["id", "x", "y", "z"]].to_numpy(float) for k, part in points.groupby("kod")}

    def nearest(p, kod):
        d = np.sqrt((by[kod][:, 1] - p[1]) ** 2 + (by[kod][:, 2] - p[2]) ** 2)
        return [i for i in np.lexsort((by[kod][:, 0], d))[:2] if d[i] <= 7]

    z, top = by["RDS"][:, 3].copy(), np.full(len(by["RDS"]), np.inf)
    for p in by["RD"]:
        if banks := nearest(p, "RGS"):
            for i in nearest(p, "RDS"):
                top[i] = min(top[i], by["RGS"][banks, 3].min())
    z = np.where(z >= top, top - 0.11, z)
    want = dict(zip(points["id"], points["z"])) | dict(zip(by["RDS"][:, 0], z))
    for p in by["RD"]:
        foot = min((z[i] for i in nearest(p, "RDS")), default=np.inf)
        want[p[0]] = foot - 0.11 if p[3] >= foot else p[3]
    got = {r.id: r.z for r in QUERIES["cq_height_fix"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)


SECTIONS = "rd long, near boolean, rz double, rds_l double, rds_r double, rgs_l double, rgs_r double, rl double"


def test_rules_of_a_cross_section(spark):
    """The six rules, each kept, broken or not applicable, and the texts of the issues."""
    n = None
    data = [
        (1, True, 1.0, 2.0, 2.5, 3.0, 3.5, 1.5),  # all kept
        (2, True, 2.0, 2.0, 1.5, 2.0, 1.5, 2.0),  # all broken: RL is below neither RGS
        (3, True, 1.0, n, n, n, n, n),  # none applies
        (4, True, 1.0, n, 2.0, 0.5, n, 0.9),  # one side only; RL needs both RGS
        (5, True, 1.0, 2.0, 2.0, 3.0, 4.0, 3.5),  # RL is above one RGS only, so the rule is kept
        (6, False, 1.0, n, n, n, n, n),
    ]
    got = {r.rd: r for r in J.validated(spark.createDataFrame(data, SECTIONS)).collect()}
    rules = lambda i: tuple(got[i][name] for name, _, _ in J.RULES)
    assert rules(1) == (True,) * 6 and got[1].ok and got[1].issues == ""
    assert rules(2) == (False,) * 6 and not got[2].ok
    assert got[2].issues == (
        "Left side: RGS(2.000) <= RDS(2.000); Right side: RGS(1.500) <= RDS(1.500); RD(2.000) >= RDS_left(2.000); "
        "RD(2.000) >= RDS_right(1.500); RL(2.000) <= RD(2.000); RL(2.000) <= RGS(1.500)"
    )
    assert rules(3) == (n,) * 6 and got[3].ok and got[3].issues == ""
    assert rules(4) == (n, n, n, True, False, n) and got[4].issues == "RL(0.900) <= RD(1.000)" and not got[4].ok
    assert (got[4].found_rds_l, got[4].found_rds_r, got[4].found_rgs_l, got[4].found_rgs_r, got[4].found_rl) == (False, True, True, False, True)
    assert rules(5) == (True,) * 6 and got[5].ok
    assert not got[6].ok and got[6].issues == "RD not intersecting/near line" and not got[6].intersects_line


def test_some_rules_apply_and_some_are_broken(spark):
    got = QUERIES["cq_cross_section_validate"](spark, "/root/testdata/sf0.01").collect()
    assert {True, False} == {r.ok for r in got} == {r.intersects_line for r in got}
    for name, _, _ in J.RULES:
        assert {True, False, None} == {r[name] for r in got}


def brute_nearest(points, segments):
    d = segments[:, 4:6] - segments[:, 2:4]
    out = {}
    for i, x, y in points:
        t = ((x - segments[:, 2]) * d[:, 0] + (y - segments[:, 3]) * d[:, 1]) / np.maximum((d**2).sum(axis=1), 1e-300)
        t = np.clip(t, 0, 1)
        dist = np.hypot(segments[:, 2] + t * d[:, 0] - x, segments[:, 3] + t * d[:, 1] - y)
        k = np.lexsort((segments[:, 1], segments[:, 0], np.round(dist, 12)))[0]
        out[i] = (int(segments[k, 0]), int(segments[k, 1]), dist[k])
    return out


@pytest.mark.parametrize("spread", [1.0, 1e5])
def test_nearest_segments_are_those_of_brute_force(spark, spread):
    """Long and short, upright, level and pointlike segments; with a spread, points very far from all of them."""
    rng = np.random.default_rng(7)
    seg = [(k % 5, k, *rng.uniform(0, 50, 2), *rng.uniform(0, 50, 2)) for k in range(25)]
    seg += [(7, 1, 3.0, 3.0, 3.0, 40.0), (7, 2, 3.0, 9.0, 44.0, 9.0), (7, 3, 5.0, 5.0, 5.0, 5.0), (8, 1, -60.0, 0.0, -60.1, 0.1)]
    points = [(i, *rng.uniform(-20, 70, 2)) for i in range(150)] + [(900 + i, *(rng.uniform(-1, 1, 2) * 100 * spread)) for i in range(12)]
    seg, points = [tuple(map(float, r)) for r in seg], [tuple(map(float, r)) for r in points]
    a = spark.createDataFrame([(int(i), x, y) for i, x, y in points], "id long, x double, y double")
    b = spark.createDataFrame([(int(r[0]), int(r[1]), *r[2:]) for r in seg], "line_id long, seq long, x1 double, y1 double, x2 double, y2 double")
    want = brute_nearest(points, np.array(seg, float))
    got = {r.id: (r.line_id, r.seq, r.dist) for r in S.nearest_segment(a, b).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i][2] - want[i][2]) < 1e-6 for i in want) and sum(got[i][:2] != want[i][:2] for i in want) <= 1
    near = {(r.id, r.line_id, r.seq) for r in S.near_segments(a, b, 2.5).select("id", "line_id", "seq").collect()}
    assert {i for i, _, _ in near} == {i for i in want if want[i][2] <= 2.5}
    assert S.nearest_segment(a, b.limit(0)).count() == 0 == S.nearest_segment(a.limit(0), b).count()


def test_nearest_points_are_those_of_brute_force(spark):
    rng = np.random.default_rng(9)
    crowd = rng.normal(size=(300, 2)) * 0.2
    others = np.concatenate([crowd, rng.uniform(-30, 30, (40, 2)), [[500.0, 500.0]]])
    base = np.concatenate([rng.normal(size=(30, 2)), rng.uniform(-30, 30, (40, 2)), [[499.0, 499.0], [900.0, 0.0]]])
    a = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(base)], "id long, x double, y double")
    b = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(others)], "oid long, ox double, oy double")
    want = set()
    for i, p in enumerate(base):
        d = np.hypot(*(others - p).T)
        want |= {(i, int(o), n + 1) for n, o in enumerate(np.argsort(d, kind="stable")[:3]) if d[o] <= 7}
    assert {(r.id, r.oid, r.nth) for r in S.nearest_points(a, b, 3, 7.0).collect()} == want
    assert S.nearest_points(a, b.limit(0), 3, 7.0).count() == 0


def test_ground_of_a_slope_with_a_low_outlier(spark):
    slope = [(f"g{i}-{j}", float(i), float(j), 0.2 * i) for i in range(51) for j in range(0, 51, 2)]
    above = [(f"a{j}", 25.0, float(j), 9.0) for j in range(1, 50, 12)]
    low = [("low", 40.0, 30.5, 1.0)]
    rows = V.cloth_ground(spark.createDataFrame(slope + above + low, "pt_key string, x double, y double, z double")).collect()
    assert len(rows) == len(slope) + len(above) + 1
    found = {r.pt_key: r.classification for r in rows}
    assert all(found[f"a{j}"] == 1 for j in range(1, 50, 12)) and found["low"] == 2
    assert sum(found[k] == 2 for k, *_ in slope) > 0.9 * len(slope)
    assert all(found[f"g{i}-{j}"] == 2 for i in range(51) for j in range(0, 20, 2))


def surface(p):
    t = p[V.triangulated(p[:, :2])]
    return np.linalg.norm(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), axis=1).sum() / 2


def test_every_corner_counts_for_the_surface(spark):
    """A ridge of 1 m teeth on 51 x 41 corners, of which no 300 or 2000 have the whole surface."""
    corners = [(1, float(i), float(j), float(i % 2)) for i in range(51) for j in range(41)]
    points = spark.createDataFrame(corners, "gap long, x double, y double, z double")
    rows = V.mesh_samples(points, "gap", 100).toPandas()
    assert len(rows) == int(50 * 40 * 2**0.5) * 100
    teeth = 1 - (rows["x"] % 2 - 1).abs()
    assert (rows["z"] - (1 - teeth)).abs().max() < 1e-9 or (rows["z"] - teeth).abs().max() < 1e-9
    assert abs(rows["x"].mean() - 25) < 0.2 and abs(rows["y"].mean() - 20) < 0.2
    assert V.mesh_triangles(points, "gap", 100, above=1000, most=500).toPandas()["n"].sum() < len(rows)


def test_gaps_are_filled_by_their_whole_surface(spark, db):
    names = {"smp_mesh_area_weighted": ("select file, x, y, z from v_points", "file")}
    names["cq_fill_gaps"] = ("""select b.poly_id, p.x, p.y, p.z from v_points p join v_boxes b on p.classification = 2 and p.x > xmin and p.x < xmax and p.y > ymin and p.y < ymax
     and not (p.x >= (xmin + xmax) / 2 and p.y >= (ymin + ymax) / 2)""", "poly_id")
    for name, (sql, by) in names.items():
        want = {}
        for group, part in db.execute(with_views(sql)).df().groupby(by):
            p = part.sort_values(["x", "y", "z"]).drop_duplicates(["x", "y"])[["x", "y", "z"]].to_numpy(float)
            if n := int(surface(p)) * 100:
                want[group] = n
        assert {r[by]: r.n for r in QUERIES[name](spark, SF).collect()} == want


def gap_of_ridges(path):
    """One gap (47 < x < 51, 11 < y < 15) with 122400 ground points on 51000 places, which lie 0, 1 and 2 m high in turn."""
    rows = """select cast(i as bigint) as l_orderkey, cast(0 as integer) as l_linenumber, cast(n as bigint) as l_partkey, cast(1 as bigint) as l_suppkey,
     47000 + (i % 255 + 1) * 7.8e0 + (i * 7919 % 1000) / 1e3 as l_extendedprice, (11 + (i // 255 + 1) / 201e0 * 4) / 2 + (i * 104729 % 1000) / 1e6 as l_quantity,
     (i * 7 % 3) / 100e0 as l_discount, 0e0 as l_tax, 'A' as l_returnflag, 'F' as l_linestatus, date '1995-01-01' as l_shipdate"""
    duckdb.sql(f"copy ({rows} from range(51000) r(i), range(3) k(n) where n < 2 or i < 20400) to '{path}/lineitem.parquet'")
    duckdb.sql(f"copy (select cast(17 as bigint) as s_suppkey, 'one' as s_name, 1 as s_nationkey) to '{path}/supplier.parquet'")


@pytest.mark.parametrize("name", ["cq_fill_gaps", "cq_fill_gaps_scan"])
def test_gaps_of_many_points_are_not_thinned(spark, tmp_path, name):
    """Above 120000 points a gap had the surface of 50000 of them."""
    gap_of_ridges(tmp_path)
    points = view(spark, str(tmp_path), "v_points").toPandas()
    box = view(spark, str(tmp_path), "v_boxes").first()
    x, y = points["x"], points["y"]
    inside = points[(x > box.xmin) & (x < box.xmax) & (y > box.ymin) & (y < box.ymax) & ~((x >= (box.xmin + box.xmax) / 2) & (y >= (box.ymin + box.ymax) / 2))]
    assert len(inside) > 120_000
    p = inside.sort_values(["x", "y", "z"]).drop_duplicates(["x", "y"])[["x", "y", "z"]].to_numpy(float)
    assert len(p) > 50_000
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert [r.n for r in got if r[0] in (17, "fill")] == [int(surface(p)) * 100]


def test_boxes_are_cut_to_the_raster(spark, db):
    cells = spark.createDataFrame([(0, 0), (0, 1), (599, 7), (600, 7), (700, 199)], "r long, c long")
    raster = spark.range(1).selectExpr("701L - 1 as r", "199L as c")
    got = {(x.r0, x.r1, x.c0, x.c1, x.cells) for x in R.component_boxes(R.labelled(cells), 3, raster).collect()}
    assert got == {(0, 3, 0, 4, 2), (596, 603, 4, 10, 2), (697, 700, 196, 199, 1)}


@pytest.mark.parametrize("name", ["join_bbox_clip", "join_pip"])
def test_points_on_one_place_are_tested_once_and_all_returned(spark, monkeypatch, tmp_path, name):
    sf = "/root/testdata/sf0.001"
    copies = "select l.* replace (l_orderkey + 100000 * i as l_orderkey) from '{}/lineitem.parquet' l, range(3) r(i)".format(sf)
    duckdb.sql(f"copy ({copies}) to '{tmp_path}/lineitem.parquet'")
    duckdb.sql(f"copy (from '{sf}/supplier.parquet') to '{tmp_path}/supplier.parquet'")
    monkeypatch.setattr(S, "SHARED", 2)  # places of three points are two rows
    got = entry.queries()[name](spark, str(tmp_path))
    want = connect(str(tmp_path)).execute(entry.oracle_sql()[name]).df()
    assert len(want) and oracle.rows(got.toPandas()) == oracle.rows(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(keys") < plan.index("Join Inner")  # above the join: pairs of places become pairs of points
    rows = S.places(view(spark, str(tmp_path), "v_points"), "pt_key").collect()
    assert max(len(r["keys"]) for r in rows) == 2 and len(rows) < len(set(sum((list(r["keys"]) for r in rows), [])))
