"""Points near lines and in corridors, against brute force; and joins whose exploded side must not go to the driver."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terrasift.operators import nearby as N
from terrasift.operators import spatial as S
from terrasift.operators import vector as V
from terrasift.plans import joins as J

SF = "/root/testdata/sf0.001"
SEGMENT = "line_id long, seq long, x1 double, y1 double, x2 double, y2 double"


def collected_explosions(df) -> int:
    """How many sides of joins are exploded and then collected to be broadcast."""
    lines, found = df._jdf.queryExecution().executedPlan().toString().splitlines(), 0
    depth = lambda line: re.search(r"[A-Z*(]", line).start()
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[k + 1 :]:
                if not re.search(r"[A-Z*(]", below) or depth(below) <= depth(line):
                    break
                found += "Generate" in below
    return found


@pytest.mark.parametrize("name", ["geo_buffer", "join_dwithin", "cq_rd_endpoint_gap", "join_corridor", "join_nearest_per_side", "cq_cross_section_validate", "join_same_line_group", "cq_shift_snap", "join_bbox_clip", "join_pip"])
def test_exploded_sides_are_not_broadcast(spark, name):
    """Spark takes an exploded side to be as small as before; it has many times the rows, which the driver can't hold."""
    assert collected_explosions(entry.queries()[name](spark, SF)) == 0


def layer(rng, n):
    seg = [(k % 5, k, *rng.uniform(0, 50, 2), *rng.uniform(0, 50, 2)) for k in range(n)]
    return [*seg, (7, 1, 3.0, 3.0, 3.0, 40.0), (7, 2, 3.0, 9.0, 44.0, 9.0), (7, 3, 5.0, 5.0, 5.0, 5.0)]


def tables(spark, points, seg):
    a = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double")
    return a, spark.createDataFrame([(r[0], r[1], *map(float, r[2:])) for r in seg], SEGMENT)


@pytest.mark.parametrize("crowd", [20_000, 7])
def test_lines_within_reach_are_those_of_brute_force(spark, monkeypatch, crowd):
    """Scattered points, many on one place, and cells so crowded that several tasks take their points."""
    monkeypatch.setattr(N, "CROWD", crowd)
    rng = np.random.default_rng(3)
    points, seg = np.concatenate([rng.uniform(-5, 55, (300, 2)), np.full((60, 2), 9.0), rng.normal(20, 0.01, (60, 2))]), layer(rng, 30)
    a, b = tables(spark, points, seg)
    dist = N.measured(points[:, 0], points[:, 1], np.array([r[2:] for r in seg]).T)[0]
    for reach in (0.01, 1.5, 200.0):
        want = {(i, seg[k][0]) for i, k in zip(*np.nonzero(dist <= reach))}
        got = [(r.id, r.line_id) for r in N.lines_within(a, b, reach, "line_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    near = {(r.id, r.line_id, r.seq) for r in S.nearest_segment(a, b).collect()}
    assert near == {(i, *min((d, *s[:2]) for d, s in zip(row, seg))[1:]) for i, row in enumerate(dist)}
    assert N.lines_within(a, b.limit(0), 1.0, "line_id").count() == 0 == N.lines_within(a.limit(0), b, 1.0, "line_id").count()


def test_points_without_a_place_have_no_nearest_segment(spark):
    """They were searched for ever."""
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 1.0)], "id long, x double, y double")
    seg = spark.createDataFrame([(1, 1, 1.0, 0.0, 2.0, 0.0), (2, 1, None, 0.0, 0.0, 0.0)], SEGMENT)
    assert [(r.id, r.line_id, r.dist) for r in S.nearest_segment(points, seg).collect()] == [(1, 1, 1.0)]
    assert S.nearest_segment(points, seg.where("line_id = 2")).count() == 0


def test_nearest_across_is_that_of_brute_force(spark):
    """Crowded and lonely sections, points on the line, and equal distances."""
    rng = np.random.default_rng(5)
    turn = rng.uniform(0, 2 * np.pi, 40)
    rd = [(i, 1, *map(float, rng.uniform(0, 30, 2)), 1.0, float(np.cos(t)), float(np.sin(t))) for i, t in enumerate(turn)]
    rd += [(90, 1, 10.0, 10.0, 1.0, 1.0, 0.0), (91, 1, 500.0, 500.0, 1.0, 0.0, 1.0)]
    places = [*rng.uniform(0, 30, (1500, 2)), (10.5, 10.0), (10.0, 10.001), (10.2, 10.001), (504.9, 500.5), (500.0, 501.0)]
    others = [(i, J.BANKS[i % 3], float(x), float(y), float(i)) for i, (x, y) in enumerate(places)]
    a = spark.createDataFrame(rd, "rd long, line_id long, rx double, ry double, rz double, tx double, ty double")
    b = spark.createDataFrame(others, "oid long, kod string, x double, y double, oz double")
    pairs, want = set(), {}
    for i, _, rx, ry, _, tx, ty in rd:
        for oid, kod, x, y, _ in others:
            along, across = (x - rx) * tx + (y - ry) * ty, (x - rx) * -ty + (y - ry) * tx
            if abs(along) <= J.ALONG and abs(across) <= J.ACROSS:
                pairs.add((i, oid))
                key = (i, kod, int(np.sign(across)))
                want[key] = min(want.get(key, (9.0, 0)), (abs(across), oid))
    assert {(r.rd, r.oid) for r in J.corridor(a, b).collect()} == pairs
    assert {(r.rd, r.kod, r.side): r.oid for r in J.nearest_across(a, b).collect()} == {k: v[1] for k, v in want.items()}
    assert J.nearest_across(a, b.limit(0)).count() == 0


@pytest.mark.parametrize("links", [500_000, 400])
def test_components_of_long_chains(spark, monkeypatch, links):
    """Chains, loops and lonely nodes, contracted in one task and in many; a chain needed a step for every doubling."""
    monkeypatch.setattr(V, "LINKS", links)
    rng = np.random.default_rng(1)
    names = rng.permutation(700)
    chains = [[int(names[k]) for k in range(a, b)] for a, b in ((0, 300), (300, 302), (302, 600))]
    pairs = [(c[k], c[k + 1]) for c in chains for k in range(len(c) - 1)] + [(chains[2][-1], chains[2][0]), (5, 5)]
    want = {int(n): int(n) for n in names} | {n: min(c) for c in chains for n in c}
    edges, nodes = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(int(n),) for n in names], "node long")
    assert {r.node: r.label for r in V.reached(edges, nodes).collect()} == want
    steps = V.contracted(edges)
    assert steps.count() == 300 + 2 + 298 - 3 if links > 1000 else steps.count() >= 597
    assert V.reached(edges.limit(0), nodes).where("node <> label").count() == 0


def places_first(df) -> bool:
    """Whether points are grouped by their place before any side of a join is exploded."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return bool(re.search(r"Aggregate \[[^\]]*x#\d+, y#\d+", plan))


@pytest.mark.parametrize("name", ["cq_tile_clip_merge", "cq_fill_gaps", "cq_fill_gaps_scan", "geo_alpha_shape"])
def test_each_place_is_tested_once(spark, name):
    assert places_first(entry.queries()[name](spark, SF))


def test_corners_stand_for_all_points_of_their_place(spark):
    """The lowest point of a place is its corner, and thinning goes by the number of points."""
    rng = np.random.default_rng(4)
    points = [(1, float(x), float(y), float(z)) for x, y, z in rng.integers(0, 12, (900, 3))]
    a = spark.createDataFrame(points, "gap long, x double, y double, z double")
    whole = V.mesh_triangles(a, "gap", 10).collect()
    b = V.corners(a).withColumn("gap", F.lit(1).cast("long"))
    assert whole and V.mesh_triangles(b, "gap", 10, weight="points").collect() == whole
    assert V.mesh_triangles(b, "gap", 10, above=899, most=20, weight="points").collect() != whole
    assert V.mesh_triangles(b, "gap", 10, above=900, most=20, weight="points").collect() == whole


@pytest.mark.parametrize("name", ["join_nearest_per_side", "cq_cross_section_validate"])
def test_lines_are_sent_to_few_cells(spark, monkeypatch, name):
    """Each long segment and each corridor went to dozens of narrow cells, which is what filled the disk."""
    sent, along = [], S.cells_along

    def counted(rows, size, reach):
        out = along(rows, size, reach)
        sent.append((out.count(), rows.count()))
        return out

    monkeypatch.setattr(S, "cells_along", counted)
    monkeypatch.setattr(N, "AIM", 1)  # as if points were 400 times as dense
    assert entry.queries()[name](spark, "/root/testdata/sf0.01").count()
    assert sent and sum(a for a, _ in sent) < 12 * sum(b for _, b in sent)


def test_points_across_wide_gaps_and_in_several_chunks(spark):
    """Rows of points far from each other, directions along both axes, and many copies of one place and one direction."""
    rng = np.random.default_rng(8)
    x, y = np.r_[rng.integers(0, 40, 400), 3.0] * 0.5, np.r_[rng.integers(0, 6, 400) * 3.0, 1e3]
    kind, ids = rng.integers(0, 2, 401), rng.permutation(401)
    turn = np.r_[0, 0.5, 1, 1.5, rng.uniform(0, 2, 60)] * np.pi
    rd = np.array([rng.integers(0, 40, 64) * 0.5, rng.integers(0, 6, 64) * 3.0, np.cos(turn), np.sin(turn)])
    rd[2, [1, 3]] = rd[3, [0, 2]] = 0.0
    got = {}
    for q, o, side, d in N.across(rd, x, y, kind, 2, ids, 1.0, 0.01, 5.0):
        for key, value in zip(zip(q, kind[o], side), zip(d, ids[o])):
            assert key not in got
            got[key] = value
    want = {}
    for q, (rx, ry, tx, ty) in enumerate(rd.T):
        for px, py, k, i in zip(x, y, kind, ids):
            dx, dy = px - rx, py - ry
            cross = dx * -ty + dy * tx
            if abs(dx * tx + dy * ty) <= 1 and abs(cross) <= 5:
                key = (q, k, np.sign(cross))
                want[key] = min(want.get(key, (9.0, 0)), (abs(cross), i))
    assert got == want and {s for _, _, s in want} == {-1, 0, 1}


@pytest.mark.parametrize("name", ["cq_fill_gaps", "cq_tile_clip_merge", "join_pip"])
def test_polygons_of_one_shape_are_tested_once(spark, monkeypatch, tmp_path, name):
    """Three polygons of each shape count three times, but only one of them is held against the points."""
    tested, test = [], S.point_in_polygon

    def counted(points, polys, **more):
        tested.append(polys.count())
        return test(points, polys, **more)

    suppliers = spark.read.parquet(f"{SF}/supplier.parquet")
    once = entry.queries()[name](spark, SF).collect()
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    copies = suppliers.withColumn("s_suppkey", F.explode(F.array(*(F.col("s_suppkey") + 97 * 89 * k for k in range(3)))))
    copies.write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(S, "point_in_polygon", counted)
    got = entry.queries()[name](spark, str(tmp_path)).collect()
    assert tested and sum(tested) == suppliers.count()
    if name == "cq_tile_clip_merge":
        assert once and {(r.tx, r.ty, r.n) for r in got} == {(r.tx, r.ty, 3 * r.n) for r in once}
    else:
        moved = lambda r, k: tuple(r[c] + 97 * 89 * k if c == "poly_id" else r[c] for c in sorted(r.asDict()))
        assert once and sorted(moved(r, 0) for r in got) == sorted(moved(r, k) for r in once for k in range(3))
