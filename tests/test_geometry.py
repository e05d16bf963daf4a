"""Micro-fixtures with results worked out by hand, and laws that hold for any input."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrasift.functions import calc
from terrasift.functions import geometry as G
from terrasift.functions import text as X
from terrasift.operators import points as P
from terrasift.operators import raster as R
from terrasift.operators import spatial as S
from terrasift.operators import trajectory as TR
from terrasift.operators import vector as V


def ring(poly_id, *corners):
    return [(poly_id, *a, *b) for a, b in zip(corners, corners[1:] + corners[:1])]


@pytest.fixture(scope="module")
def square_with_hole(spark):
    edges = ring(1, (0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)) + ring(1, (1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0))
    return S.polygons(spark.createDataFrame(edges, "poly_id long, x1 double, y1 double, x2 double, y2 double"))


@pytest.mark.parametrize("boundary,want", [(False, {"in"}), (True, {"in", "edge", "corner", "hole_edge"})])
@pytest.mark.parametrize("shortcut", [False, True])
def test_point_in_polygon(spark, square_with_hole, boundary, want, shortcut):
    pts = [("in", 0.5, 0.5), ("hole", 2.0, 2.0), ("edge", 4.0, 2.0), ("corner", 0.0, 0.0), ("hole_edge", 1.0, 2.0), ("out", 5.0, 5.0)]
    rows = S.point_in_polygon(spark.createDataFrame(pts, "pt_key string, x double, y double"), square_with_hole, 0.3, boundary, shortcut)
    assert {r.pt_key for r in rows.collect()} == want


def test_azimuths(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 1.0, 1.0), (1, 2, 1.0, 2.0), (1, 3, 2.0, 1.0), (1, 4, 1.0, 0.0), (1, 5, 0.0, 1.0)]
    got = TR.azimuths(spark.createDataFrame(rows, "fid long, vertex_ind long, x double, y double")).orderBy("vertex_ind").collect()
    assert [None if r.azimuth is None else round(r.azimuth) for r in got] == [None, 45, None, 135, 225, 315]


def test_sessions_split_on_more_than_the_gap(spark):
    rows = spark.createDataFrame([(1, 0, 1), (1, 3_000_000, 2), (1, 6_000_001, 3)], "k long, us long, id long")
    assert [r.session for r in TR.sessions(rows, "k", "us", ["us", "id"], 3_000_000).orderBy("us").collect()] == [0, 0, 1]


def test_lines_without_length_have_no_samples(spark):
    rows = [(1, 0, 0.0, 0.0), (2, 0, 1.0, 1.0), (2, 1, 1.0, 1.0), (3, 0, 0.0, 0.0), (3, 1, 10.0, 0.0)]
    got = TR.sample_lines(spark.createDataFrame(rows, "fid long, vertex_ind long, x double, y double"), 4.0).orderBy("k").collect()
    assert [(r.fid, round(r.x, 6)) for r in got] == [(3, 0.0), (3, 3.333333), (3, 6.666667)]


def test_histogram_keeps_the_far_edge(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.0), ("b", 2.0, 2.0), ("c", 1.5, 1.5)], "pt_key string, x double, y double")
    assert {(r.ix, r.iy): r.n for r in P.histogram(rows, P.extent(rows)).collect()} == {(0, 0): 1, (1, 1): 2}


@pytest.mark.parametrize("n,kept", [(100, 100), (101, 100), (7, 7)])
def test_cap_per_tile(spark, n, kept):
    rows = spark.createDataFrame([(f"p{i}", 0.5, 0.5) for i in range(n)], "pt_key string, x double, y double")
    assert P.cap_per_tile(rows, 100).count() == kept


@pytest.mark.parametrize("n", [0, 1, 10, 333])
def test_fraction_is_exact_and_repeatable(spark, n):
    rows = spark.createDataFrame([(f"p{i}",) for i in range(n)], "pt_key string")
    a = {r.pt_key for r in P.sample_fraction(rows, 0.4).collect()}
    assert len(a) == int(n * 0.4) and a == {r.pt_key for r in P.sample_fraction(rows.repartition(3), 0.4).collect()}


def test_angles(spark):
    row = spark.range(1).select(
        G.dms_to_degrees(F.lit("51:30:36 S")).alias("s"), G.dms_to_degrees(F.lit("x")).alias("bad"), G.ddmm_to_degrees(F.lit("5230.00N")).alias("n"),
        G.signed_heading(F.lit(181)).alias("h"), G.flipped_roll(F.lit(-0.1)).alias("r"), G.flipped_roll(F.lit(0.0)).alias("r0"),
        X.plain(F.lit("Żółw")).alias("t"), X.without_suffix(F.lit("tom\nPomiar"), "Pomiar").alias("w"),
    ).first()
    assert (round(row.s, 6), row.bad, row.n, row.h, round(row.r, 6), row.r0, row.t, row.w) == (-51.51, None, 52.5, -179, 179.9, -180.0, "Zolw", "tom")


def test_reprojection_of_the_meridian(spark):
    east, north = G.to_grid(F.lit(0.0), F.lit(19.0), 2180)
    row = spark.range(1).select(east.alias("e"), north.alias("n")).first()
    assert math.isclose(row.e, 500000.0, abs_tol=1e-6) and math.isclose(row.n, -5300000.0, abs_tol=1e-6)


def test_calculator(spark):
    rows = spark.createDataFrame([(3.0, 0.0)], "a double, b double")
    assert rows.select(calc.expression("-(a + 1) * 2 / 4", {"a", "b"}).alias("v"), calc.expression("a / b", {"a", "b"}).alias("z")).first() == (-2.0, None)
    for bad in ("__import__('os')", "a +", "(a", "a ** 2 ;", "c"):
        with pytest.raises(ValueError):
            calc.expression(bad, {"a", "b"})


def test_labels_of_a_spiral_and_a_dot(spark):
    art = ["######", "     #", "#### #", "#  # #", "# ## #", "#    #", "######", "      ", "     #"]
    cells = [(r, c) for r, line in enumerate(art) for c, ch in enumerate(line) if ch == "#"]
    got = R.labelled(spark.createDataFrame(cells, "r long, c long")).collect()
    assert {x.label for x in got} == {0, 8 * 2**32 + 5} and len(got) == len(cells)


def test_dilation_grows(spark):
    cells = spark.createDataFrame([(0, 0)], "r long, c long")
    assert [R.dilated(cells, k).count() for k in (0, 1, 2)] == [1, 5, 13]


def test_gaussian_forms_agree(spark):
    rows = spark.createDataFrame([(r, c, None if (r + c) % 5 == 0 else float(r * c)) for r in range(250, 262) for c in range(12)], "r long, c long, v double")
    a = {(x.r, x.c): x.v for x in R.gaussian(rows, "v", 1.0, 3).collect()}
    b = {(x.r, x.c): x.v for x in R.gaussian_tiles(rows, "v", 1.0, 3).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


def test_clusters_are_chains(spark):
    rows = [(1, 0.0, 0.0), (2, 3.0, 0.0), (3, 6.0, 0.0), (9, 50.0, 50.0), (10, 0.1, 0.0)]
    got = V.clusters(spark.createDataFrame(rows, "id long, x double, y double"), 3.0).collect()
    assert {r.id: r.label for r in got} == {1: 1, 2: 1, 3: 1, 10: 1, 9: 9}


def test_route_is_greedy():
    import pandas as pd

    edges = pd.DataFrame({"numer": [1, 2, 3], "sasiedzi": ["2,3", "1", "1"], "length": [10.0, 20.0, 30.0]})
    assert V.route(edges, 1000.0)["numer"].tolist() == [2, 1, 3]
    # 1 leads to 2; there 3 and 4 hang (three neighbours each), then 5 goes on, past 6, to its end 7
    near = {1: "2", 2: "1,3,4,5,6", 3: "2,4,9", 4: "2,3,9", 5: "2,6,7,8", 6: "2,5,7,8", 7: "5", 8: "", 9: ""}
    net = pd.DataFrame({"numer": list(near), "sasiedzi": list(near.values()), "length": [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0]})
    start = net[~net["numer"].isin([8, 9])]
    plain, back = V.route(start, 1e9), V.route(start, 1e9, returns=True)
    assert plain["numer"].tolist() == [1, 2, 3, 4, 5, 7] or plain["numer"].tolist()[:5] == [1, 2, 3, 4, 5]
    assert plain["total"].tolist()[:5] == [1.0, 3.0, 11.0, 27.0, 43.0]
    assert set(back["numer"]) == {1, 2, 3, 4, 5, 6, 7} and back["numer"].tolist()[: len(plain)] == plain["numer"].tolist()
    assert V.route(start, 2.0)["numer"].tolist() == [1, 2] and len(V.route(start.iloc[:0], 1.0)) == 0


def test_slopes_are_smoothed():
    import numpy as np

    floor = np.cumsum(np.full((1, 9), 0.2), axis=1).repeat(3, axis=0)
    floor[:, 6:] += 5
    cloth = floor + 2.0
    cloth[:, 0] = floor[:, 0]
    got = V.smoothed_slopes(floor, cloth)
    assert (got[:, :6] == floor[:, :6]).all() and (got[:, 6:] == cloth[:, 6:]).all()


coordinate = st.integers(0, 30).map(float)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(coordinate, coordinate), min_size=1, max_size=25))
def test_hull_holds_its_points(pts):
    pts = np.array(pts)
    corners = V.hull(pts)
    for a, b in zip(corners, np.roll(corners, -1, axis=0)):
        if len(corners) > 2:
            assert all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for p in pts)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 50), st.floats(0, 50)), min_size=3, max_size=25, unique=True))
def test_triangles_fill_the_hull(pts):
    pts = np.unique(np.round(np.array(pts), 1), axis=0)
    corners = V.hull(pts)
    area = lambda p: abs(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1))) / 2
    total = sum(area(pts[list(t)]) for t in V.triangulated(pts))
    assert total <= area(corners) + 1e-6


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(coordinate, coordinate), min_size=2, max_size=30), st.floats(0.1, 10))
def test_simplified_lines_stay_near(pts, tolerance):
    line = np.array(pts)
    kept = V.simplified(line, tolerance)
    assert (kept[0] == line[0]).all() and (kept[-1] == line[-1]).all()
    for p in line:
        best = math.inf
        for a, b in zip(kept, kept[1:]):
            d = b - a
            t = 0.0 if not d.any() else min(1, max(0, np.dot(p - a, d) / np.dot(d, d)))
            best = min(best, math.hypot(*(a + t * d - p)))
        assert best <= max(tolerance, 0) * 2 + 1e-9 or len(kept) == 2
