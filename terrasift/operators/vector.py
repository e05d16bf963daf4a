"""Vector operators: dissolving, merging lines, hulls, simplification, clipping, clusters, triangulation, routes."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasift.functions import geometry as G
from terrasift.operators.lineage import cut
from terrasift.operators.spatial import keyed, touched_cells
from terrasift.session import ship

POINTS = "array<struct<x: double, y: double>>"


def ring_area(edges: DataFrame, *by: str) -> DataFrame:
    """The signed area of each ring: positive if it runs counter-clockwise."""
    return edges.groupBy(*by).agg((F.sum(G.shoelace_term("x1", "y1", "x2", "y2")) / 2).alias("area"))


def without_small_holes(rings: DataFrame, least: float) -> DataFrame:
    """Rings (poly_id, ring, x1, y1, x2, y2); ring 0 is the outline, other rings stay if their area is above ``least``."""
    areas = ring_area(rings, "poly_id", "ring").where((F.col("ring") == 0) | (F.abs("area") > least))
    return rings.join(areas.select("poly_id", "ring"), ["poly_id", "ring"], "left_semi")


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, counter-clockwise from the smallest point, without points on its sides."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(rows):
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def convex_hulls(points: DataFrame, by: str) -> DataFrame:
    """(by, hull, area) of the points (x, y) of each group.

    A hull's corners are corners of the hull of any part that holds them; so each task first reduces its own points to
    their hull, and only hulls are grouped.
    """
    ship(points.sparkSession)
    kind = points.schema[by].dataType.simpleString()

    def own(batches):
        for rows in batches:
            for key, part in rows.groupby(by, sort=False):
                corners = hull(part[["x", "y"]].to_numpy(float))
                yield pd.DataFrame({by: [key] * len(corners), "x": corners[:, 0], "y": corners[:, 1]})

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        corners = hull(rows[["x", "y"]].to_numpy(float))
        x, y = corners[:, 0], corners[:, 1]
        area = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2 if len(corners) > 2 else 0.0
        return pd.DataFrame({by: [rows[by].iloc[0]], "hull": [[{"x": a, "y": b} for a, b in corners.tolist()]], "area": [area]})

    reduced = points.select(by, "x", "y").mapInPandas(own, f"{by} {kind}, x double, y double")
    return reduced.groupBy(by).applyInPandas(whole, f"{by} {kind}, hull {POINTS}, area double")


def simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: the vertices that are needed to stay within the tolerance."""
    keep, todo = np.zeros(len(line), bool), [(0, len(line) - 1)]
    keep[[0, -1]] = True
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, v = line[b] - line[a], line[a + 1 : b] - line[a]
        n = np.hypot(*d)
        far = np.abs(d[0] * v[:, 1] - d[1] * v[:, 0]) / n if n else np.hypot(v[:, 0], v[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[keep]


def simplify_lines(vertices: DataFrame, tolerance: float) -> DataFrame:
    """(fid, vertices, kept) of each line of vertices (fid, vertex_ind, x, y)."""
    ship(vertices.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vertex_ind")
        line = rows[["x", "y"]].to_numpy(float)
        kept = simplified(line, tolerance) if len(line) > 1 else line
        return pd.DataFrame({"fid": [rows["fid"].iloc[0]], "vertices": [len(line)], "kept": [len(kept)], "line": [[{"x": a, "y": b} for a, b in kept.tolist()]]})

    return vertices.select("fid", "vertex_ind", "x", "y").groupBy("fid").applyInPandas(run, f"fid long, vertices long, kept long, line {POINTS}")


def clip_ring(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """A ring cut to a box, side by side."""
    for axis, limit, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        out: list = []
        for a, b in zip(ring, np.roll(ring, -1, axis=0)):
            ina, inb = sign * (a[axis] - limit) >= 0, sign * (b[axis] - limit) >= 0
            if ina:
                out.append(a)
            if ina != inb:
                out.append(a + (b - a) * (limit - a[axis]) / (b[axis] - a[axis]))
        ring = np.array(out)
        if not len(ring):
            return np.zeros((0, 2))
    return ring


def clip_polygons(polys: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(poly_id, area) of what a box leaves of each polygon (poly_id, edges as an ordered array)."""
    ship(polys.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def area(rings: pd.Series) -> pd.Series:
        out = []
        for edges in rings:
            ring = clip_ring(np.array([[e["x1"], e["y1"]] for e in edges], float), box)
            x, y = (ring[:, 0], ring[:, 1]) if len(ring) else (np.zeros(1), np.zeros(1))
            out.append(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)
        return pd.Series(out)

    return polys.select("poly_id", area("edges").alias("area"))


def clusters(points: DataFrame, eps: float, key: str = "id") -> DataFrame:
    """Points (key, x, y) with the smallest key that can be reached in steps of at most ``eps``.

    Cells of eps / sqrt(2) hold points that are all within reach of each other, so a cell is one node, and the points of
    a crowded cell are never paired; neighbouring cells are linked if any two of their points are near enough.
    """
    size = eps / 2**0.5 * (1 - 1e-9)
    cells = keyed(points.select(key, "x", "y"), size)
    least = cells.groupBy("cx", "cy").agg(F.min(key).alias("node"))
    nodes = cells.join(least, ["cx", "cy"])
    reach = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3) if (a, b) > (0, 0)))
    moved = nodes.select(F.col("node").alias("n2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy", F.explode(reach).alias("m"))
    moved = moved.select("n2", "x2", "y2", (F.col("cx") + F.col("m.a")).alias("cx"), (F.col("cy") + F.col("m.b")).alias("cy"))
    near = nodes.join(moved, ["cx", "cy"]).where(G.distance("x", "y", "x2", "y2") <= eps)
    return nodes.select(key, "node").join(reached(near.select(F.col("node").alias("a"), F.col("n2").alias("b")).distinct(), nodes.select("node").distinct()), "node").drop("node")


#: Links that one task contracts at once.
LINKS = 500_000


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        if (label[a] == label[b]).all():
            return nodes, nodes[label]
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label != label[label]).any():
            label = label[label]


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same nodes as ``links``: each task's links become one from each node to the smallest that it
    is connected with there, so that long chains need few steps."""
    ship(links.sparkSession)
    kind = links.schema["a"].dataType.simpleString()
    parts = -(-links.count() // LINKS)

    def own(batches):
        batches = [x for x in batches if len(x)]
        if batches:
            rows = pd.concat(batches)
            nodes, least = rooted(rows["a"].to_numpy(), rows["b"].to_numpy())
            yield pd.DataFrame({"a": least, "b": nodes})[least != nodes]

    dealt = links.coalesce(1) if parts < 2 else links.repartitionByRange(parts, "a")
    return dealt.mapInPandas(own, f"a {kind}, b {kind}")


def reached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node is connected with.

    Each round, tasks contract their links, every node goes on to the smallest one that it is linked with, and links are
    carried over to where their ends have gone; none is left when each component is at its smallest node.
    """
    labels = nodes.select("node", F.col("node").alias("label"))
    links = cut(edges.select("a", "b").where("a <> b"))
    while not links.isEmpty():
        steps = cut(contracted(links))
        moved = steps.groupBy("b").agg(F.min("a").alias("to"))
        further = moved.select(F.col("b").alias("to"), F.col("to").alias("next"))
        moved = cut(moved.join(further, "to", "left").select("b", F.coalesce("next", "to").alias("to")))
        labels = cut(labels.join(moved.withColumnRenamed("b", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        to = lambda c: moved.select(F.col("b").alias(c), F.col("to").alias(f"{c}_to"))
        ends = steps.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
        links = cut(ends.where("a <> b").distinct())
    return labels


def _turn(ax, ay, bx, by, cx, cy):
    """Positive if a, b, c turn left, negative if right, 0 if they lie on a line; exact where rounding could matter."""
    left, right = (ax - cx) * (by - cy), (ay - cy) * (bx - cx)
    if abs(left - right) >= 4e-16 * (abs(left) + abs(right)):
        return left - right
    ax, ay, bx, by, cx, cy = map(Fraction, (ax, ay, bx, by, cx, cy))
    return (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)


def _within(ax, ay, bx, by, cx, cy, dx, dy):
    """Whether d lies within the circle through a, b, c, which turn left; exact where rounding could matter."""
    ax, ay, bx, by, cx, cy, exact = ax - dx, ay - dy, bx - dx, by - dy, cx - dx, cy - dy, (ax, ay, bx, by, cx, cy, dx, dy)
    a, b, c = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    p, q, r, s, t, u = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
    det = a * (p - q) + b * (r - s) + c * (t - u)
    if abs(det) > 1.2e-15 * (a * (abs(p) + abs(q)) + b * (abs(r) + abs(s)) + c * (abs(t) + abs(u))):
        return det > 0
    ax, ay, bx, by, cx, cy, dx, dy = map(Fraction, exact)
    ax, ay, bx, by, cx, cy = ax - dx, ay - dy, bx - dx, by - dy, cx - dx, cy - dy
    return (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0


def _insertion_order(points: np.ndarray) -> np.ndarray:
    """Rounds of doubling size, each along a snake of cells: a point lies near the one before it, and cavities stay small."""
    n = len(points)
    rank = np.random.default_rng(1).permutation(n)
    rounds = np.ceil(np.log2((rank + 1) / 64).clip(0)).astype(int)
    low, span = points.min(axis=0), np.ptp(points, axis=0).max()
    side = np.sqrt(2.0 ** (rounds + 6)).clip(1) / 2
    col, row = (((points - low) / span) * side[:, None]).astype(int).T
    along = np.where(row % 2 == 0, points[:, 0], -points[:, 0])
    return np.lexsort((along, row, rounds))


def triangulated(points: np.ndarray) -> np.ndarray:
    """Delaunay triangles (indices) of distinct points in the plane, to their hull; none if all lie on one line.

    Points are inserted one after another. ``over`` has the third corner of the triangle to the left of each directed
    edge; a corner -1 at infinity closes the hull. The triangle of a point is found by walking from the last one.
    """
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), int)
    xs, ys = points[:, 0].tolist(), points[:, 1].tolist()
    turn = lambda i, j, k: _turn(xs[i], ys[i], xs[j], ys[j], xs[k], ys[k])
    order = _insertion_order(points).tolist()
    a, b = order[:2]
    c = next((k for k in order[2:] if turn(a, b, k)), None)
    if c is None:
        return np.zeros((0, 3), int)
    if turn(a, b, c) < 0:
        a, b = b, a
    over: dict[tuple[int, int], int] = {}

    def add(i, j, k):
        over[i, j], over[j, k], over[k, i] = k, i, j

    def conflicts(i, j, k, p):
        while i < 0 or j < 0:
            i, j, k = j, k, i
        if k >= 0:
            return _within(xs[i], ys[i], xs[j], ys[j], xs[k], ys[k], xs[p], ys[p])
        side = turn(i, j, p)
        return side > 0 or side == 0 and min((xs[i], ys[i]), (xs[j], ys[j])) < (xs[p], ys[p]) < max((xs[i], ys[i]), (xs[j], ys[j]))

    for t in ((a, b, c), (b, a, -1), (c, b, -1), (a, c, -1)):
        add(*t)
    first, last = {a, b, c}, (a, b, c)
    for p in order:
        if p in first:
            continue
        i, j, k = last
        while True:
            if k < 0:
                if conflicts(i, j, k, p):
                    break
                i, j = j, i
                k = over[i, j]
            for u, v in ((i, j), (j, k), (k, i)):
                if turn(u, v, p) < 0:
                    i, j, k = v, u, over[v, u]
                    break
            else:
                break
            if k < 0:
                break
        for e in ((i, j), (j, k), (k, i)):
            del over[e]
        todo = [(i, j), (j, k), (k, i)]
        while todo:
            u, v = todo.pop()
            w = over.get((v, u))
            if w is None:
                continue
            if conflicts(v, u, w, p):
                del over[v, u], over[u, w], over[w, v]
                todo += [(u, w), (w, v)]
            else:
                add(u, v, p)
                if u >= 0 and v >= 0:
                    last = (u, v, p)
    return np.array([(i, j, k) for (i, j), k in over.items() if -1 < i < j and i < k], int).reshape(-1, 3)


def corners(points: DataFrame, *values: str) -> DataFrame:
    """(x, y, z, values, points): of the points on each place the one that a surface takes as its corner, and how many there are."""
    least = F.min(F.struct("z", *values)).alias("_c")
    return points.groupBy("x", "y").agg(least, F.count(F.lit(1)).alias("points")).select("x", "y", "_c.*", "points")


def mesh_of(rows: pd.DataFrame, named: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners (``named``), triangles and their areas of the surface of points, which are sorted by ``named``."""
    p = rows.drop_duplicates(["x", "y"])[named].to_numpy(float)
    t = triangulated(p[:, :2])
    t = t[np.lexsort(t.T[::-1])]
    a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
    return p, t, np.linalg.norm(np.cross((b - a)[:, :3], (c - a)[:, :3]), axis=1) / 2


def mesh_counts(points: DataFrame, by: str, per_area: int) -> DataFrame:
    """(by, n): how many samples ``mesh_samples`` spreads over the triangulated surface of each group, if any."""
    ship(points.sparkSession)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(mesh_of(rows.sort_values(["x", "y", "z"]), ["x", "y", "z"])[2].sum()) * int(per_area)
        return pd.DataFrame({by: rows[by].iloc[:1], "n": [n]}).loc[lambda r: r["n"] > 0]

    return points.select(by, "x", "y", "z").groupBy(by).applyInPandas(count, f"{by} {points.schema[by].dataType.simpleString()}, n long")


def mesh_triangles(
    points: DataFrame, by: str, per_area: int, seed: int = 1, above: int | None = None, most: int = 50_000, values: tuple[str, ...] = (), weight: str | None = None
) -> DataFrame:
    """The triangulated surface of each group, with how many of its floor(area) * per_area samples fall on each triangle:
    (by, triangle, ax, ay, az, bx, ..., cz, n), without triangles that get none; ``values`` come along like z.

    All points are corners, whatever their number. Only a caller that gives ``above`` has groups of more points than that
    thinned to ``most``; no query does. ``weight`` is the number of points that a row of ``corners`` stands for.
    """
    ship(points.sparkSession)
    kind = points.schema[by].dataType.simpleString()
    named = ["x", "y", "z", *values]
    ends = [p + c for p in "abc" for c in named]

    def surface(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(named)
        rng = np.random.default_rng(seed)
        if above is not None and (rows[weight].sum() if weight else len(rows)) > above and len(rows) > most:
            rows = rows.iloc[np.sort(rng.choice(len(rows), most, replace=False))]
        p, t, area = mesh_of(rows, named)
        a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
        n = rng.multinomial(int(area.sum()) * int(per_area), area / area.sum()) if len(t) else np.zeros(0, int)
        out = pd.DataFrame(np.hstack([a, b, c]), columns=ends).assign(n=n, triangle=np.arange(len(t)), **{by: rows[by].iloc[0]})
        return out.loc[out["n"] > 0, [by, "triangle", *ends, "n"]]

    schema = ", ".join([f"{by} {kind}", "triangle long", *(f"{c} double" for c in ends), "n long"])
    return points.select(by, *named, *([weight] if weight else [])).groupBy(by).applyInPandas(surface, schema)


def mesh_samples(points: DataFrame, by: str, per_area: int, seed: int = 1, values: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Points spread evenly over the triangulated surface of each group: floor(area) * per_area of them, with ``values``
    interpolated between the corners.

    The places on a triangle come from hashes of its number and the sample's, so they are the same in every layout.
    """
    unit = lambda salt: F.pmod(F.xxhash64(by, "triangle", "k", F.lit(seed), F.lit(salt)), F.lit(2**53)) / 2.0**53
    rows = mesh_triangles(points, by, per_area, seed, values=values, weight=weight).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    rows = rows.withColumn("u", F.sqrt(unit("u"))).withColumn("v", unit("v"))
    at = lambda c: ((1 - F.col("u")) * F.col(f"a{c}") + F.col("u") * (1 - F.col("v")) * F.col(f"b{c}") + F.col("u") * F.col("v") * F.col(f"c{c}")).alias(c)
    return rows.select(by, *map(at, ("x", "y", "z", *values)))


def route(edges: pd.DataFrame, most: float, returns: bool = False) -> pd.DataFrame:
    """A greedy walk over lines (numer, sasiedzi, length): (step, numer, total).

    It starts at the line with the fewest neighbours. At each line, unused neighbours that have the fewest neighbours, if
    those are two or three, hang: all of them are walked there and back, and count twice. Otherwise the first of those with
    the fewest is walked on. The walk ends above ``most``, or where nothing is left; with ``returns`` it then goes back to
    the first line that it has passed by, which is counted when it was passed.
    """
    near = {int(n): [int(x) for x in s.split(",") if x] for n, s in zip(edges["numer"], edges["sasiedzi"])}
    length = dict(zip(edges["numer"].astype(int), edges["length"].astype(float)))
    at = min(near, key=lambda k: (len(near[k]), k), default=None)
    used, out, total, waiting = set(), [], 0.0, []

    def walk(line: int, times: int) -> None:
        nonlocal total
        used.add(line)
        total += times * length[line]
        out.append((len(out), line, total))
        if line in waiting:
            waiting.remove(line)

    if at is not None:
        walk(at, 1)
    while at is not None and total <= most:
        left = [k for k in dict.fromkeys(near[at]) if k in near and k not in used]
        while len(left) > 1:
            fewest = min(len(near[k]) for k in left)
            least = [k for k in left if len(near[k]) == fewest]
            if fewest in (2, 3):
                for k in least:
                    walk(k, 2)
                left = [k for k in left if k not in used]
            else:
                waiting += [k for k in left if k != least[0] and k not in waiting]
                left = least[:1]
        if left:
            at = left[0]
            walk(at, 1)
        elif returns and waiting:
            at = waiting[0]
            walk(at, 0)
        else:
            at = None
    return pd.DataFrame(out, columns=["step", "numer", "total"]).astype({"step": "int64", "numer": "int64", "total": "float64"})


def greedy_routes(edges: DataFrame, by: str, most: float = 5000.0, returns: bool = False) -> DataFrame:
    """One walk in each network; a walk is a sequence, so a network is one task."""
    ship(edges.sparkSession)
    kind = edges.schema[by].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return route(rows, most, returns).assign(**{by: rows[by].iloc[0]})[[by, "step", "numer", "total"]]

    return edges.groupBy(by).applyInPandas(run, f"{by} {kind}, step long, numer long, total double")


def settled(floor: np.ndarray, cloth: np.ndarray, still: float) -> np.ndarray:
    """The cloth where it has come to rest on ``floor``: when no cell moves by more than ``still`` in a step.

    Each step keeps the order of two cloths and a level cloth can only sink, so it never rises and does come to rest.
    """
    while True:
        before = cloth
        cloth = np.maximum(cloth - 0.02, floor)  # falls, and rests on the cloud
        edged = np.pad(cloth, 1, mode="edge")
        around = (edged[2:, 1:-1] + edged[:-2, 1:-1] + edged[1:-1, 2:] + edged[1:-1, :-2]) / 4
        cloth = np.maximum(cloth + 0.5 * (around - cloth), floor)  # and is pulled by its neighbours
        if np.abs(cloth - before).max() <= still:
            return cloth


def smoothed_slopes(floor: np.ndarray, cloth: np.ndarray, step: float = 0.3) -> np.ndarray:
    """The cloth, drawn onto the cloud on steep slopes: cells that hang free but border on one that rests take its place on the
    cloud where theirs differs by less than ``step``, and so on from cell to cell."""
    cloth, rests = cloth.copy(), cloth <= floor + 1e-9
    border = rests
    while True:
        new = np.zeros_like(rests)
        for axis in (0, 1):
            for shift in (1, -1):
                near, level = np.roll(border, shift, axis), np.roll(floor, shift, axis)
                edge = [slice(None), slice(None)]
                edge[axis] = 0 if shift == 1 else -1
                near[tuple(edge)] = False
                with np.errstate(invalid="ignore"):  # cells without points
                    new |= near & ~rests & (np.abs(level - floor) < step)
        if not new.any():
            return cloth
        cloth[new] = floor[new]
        rests, border = rests | new, new


def cloth_ground(
    points: DataFrame, tile: float = 50.0, cell: float = 0.5, still: float = 1e-4, threshold: float = 0.5, margin: float = 5.0, slopes: bool = True
) -> DataFrame:
    """Points (pt_key, x, y, z) with class 2 where they lie within ``threshold`` of a cloth dropped on the upturned cloud.

    Tiles with a margin are settled by themselves; a point takes the result of the tile that it lies in. With ``slopes``
    the settled cloth is then drawn onto steep slopes.
    """
    ship(points.sparkSession)
    side = lambda c: F.explode(F.array_distinct(F.transform(F.array(F.lit(-margin), F.lit(0.0), F.lit(margin)), lambda d: F.floor((F.col(c) + d) / tile))))
    dealt = points.select("pt_key", "x", "y", "z").withColumn("tx", side("x")).withColumn("ty", side("y"))

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = rows["tx"].iloc[0] * tile - margin, rows["ty"].iloc[0] * tile - margin
        n = int(np.ceil((tile + 2 * margin) / cell)) + 1
        i = ((rows["x"] - x0) / cell).astype(int).clip(0, n - 1).to_numpy()
        j = ((rows["y"] - y0) / cell).astype(int).clip(0, n - 1).to_numpy()
        up = -rows["z"].to_numpy(float)
        floor = np.full((n, n), -np.inf)
        np.maximum.at(floor, (i, j), up)
        known = np.isfinite(floor)
        floor[~known] = up.min()
        cloth = settled(floor, np.full((n, n), up.max() + 1.0), still)
        if slopes:
            cloth = np.where(known, smoothed_slopes(np.where(known, floor, np.inf), cloth), cloth)
        ground = np.abs(cloth[i, j] - up) <= threshold
        own = (np.floor(rows["x"] / tile) == rows["tx"]) & (np.floor(rows["y"] / tile) == rows["ty"])
        return pd.DataFrame({"pt_key": rows["pt_key"], "classification": np.where(ground, 2, 1)})[own.to_numpy()]

    return dealt.groupBy("tx", "ty").applyInPandas(settle, "pt_key string, classification int")


def alpha_triangles(points: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The centres of the circles around the triangles of the alpha shape, the triangles' areas, and their corners: of the
    Delaunay triangles, those whose circumscribed circle has a radius below 1 / alpha."""
    t = triangulated(points)
    a, b, c = points[t[:, 0]], points[t[:, 1]], points[t[:, 2]]
    sides = [np.hypot(*(u - v).T) for u, v in ((a, b), (b, c), (c, a))]
    u, v = b - a, c - a
    twice = np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    radius = np.divide(sides[0] * sides[1] * sides[2], 2 * twice, out=np.full(len(t), np.inf), where=twice > 0)
    kept = radius < 1 / alpha
    a, u, v = a[kept], u[kept], v[kept]
    d, uu, vv = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]), (u * u).sum(axis=1), (v * v).sum(axis=1)
    centre = a + np.stack([v[:, 1] * uu - u[:, 1] * vv, u[:, 0] * vv - v[:, 0] * uu], axis=1) / d[:, None]
    return centre, twice[kept] / 2, t[kept]


def alpha_area(points: np.ndarray, alpha: float) -> float:
    """The area of the alpha shape."""
    return float(alpha_triangles(points, alpha)[1].sum())


def alpha_areas(points: DataFrame, by: str, alpha: float, tile: float = 32.0) -> DataFrame:
    """The area of each group's alpha shape: (by, area).

    A triangle counts in the tile of its circle's centre. The circle is smaller than the margin, so the tile's points
    settle whether it is empty, and triangles on one circle fall into one tile.
    """
    ship(points.sparkSession)
    kind = points.schema[by].dataType.simpleString()
    margin = 1.001 / alpha
    dealt = touched_cells(points.select(by, "x", "y").distinct(), tile, F.col("x") - margin, F.col("y") - margin, F.col("x") + margin, F.col("y") + margin)

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        centre, area, _ = alpha_triangles(np.unique(rows[["x", "y"]].to_numpy(float), axis=0), alpha)
        here = (np.floor(centre / tile) == rows[["cx", "cy"]].iloc[0].to_numpy()).all(axis=1)
        return pd.DataFrame({by: [rows[by].iloc[0]], "area": [float(area[here].sum())]})

    return dealt.groupBy(by, "cx", "cy").applyInPandas(own, f"{by} {kind}, area double").groupBy(by).agg(F.sum("area").alias("area"))


def alpha_edges(points: DataFrame, by: str, alpha: float, tile: float = 32.0) -> DataFrame:
    """(by, x1, y1, x2, y2): the directed outline of each group's alpha shape, which lies on its left: the sides that only
    one of its triangles has. Triangles are found as in ``alpha_areas``."""
    ship(points.sparkSession)
    kind = points.schema[by].dataType.simpleString()
    margin = 1.001 / alpha
    dealt = touched_cells(points.select(by, "x", "y").distinct(), tile, F.col("x") - margin, F.col("y") - margin, F.col("x") + margin, F.col("y") + margin)

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        p = np.unique(rows[["x", "y"]].to_numpy(float), axis=0)
        centre, _, t = alpha_triangles(p, alpha)
        t = t[(np.floor(centre / tile) == rows[["cx", "cy"]].iloc[0].to_numpy()).all(axis=1)]
        sides = np.concatenate([np.hstack([p[t[:, a]], p[t[:, b]]]) for a, b in ((0, 1), (1, 2), (2, 0))])
        return pd.DataFrame(sides, columns=["x1", "y1", "x2", "y2"]).assign(**{by: rows[by].iloc[0]})[[by, "x1", "y1", "x2", "y2"]]

    sides = dealt.groupBy(by, "cx", "cy").applyInPandas(own, f"{by} {kind}, x1 double, y1 double, x2 double, y2 double")
    low = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    ends = {c: F.when(low, F.col(c)).otherwise(F.col(d)) for c, d in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))}
    once = sides.select(by, low.alias("up"), *(v.alias(c) for c, v in ends.items())).groupBy(by, "x1", "y1", "x2", "y2").agg(F.count(F.lit(1)).alias("n"), F.first("up").alias("up")).where("n = 1")
    back = {c: F.when(F.col("up"), F.col(c)).otherwise(F.col(d)) for c, d in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))}
    return once.select(by, *(v.alias(c) for c, v in back.items()))
