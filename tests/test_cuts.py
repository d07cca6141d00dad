"""Polygons of cut polyhedra, location by solid angles, candidates by size levels, walls with one huge face."""

import math
import random

import numpy as np
from gnomon.operators import interpolation, mesh, spatial, surfaces, walls
from pyspark.sql import functions as F

XYZ = "vertex long, x double, y double, z double"


def block(spark, n, moved=lambda x, y, z: (x, y, z)):
    """Faces and vertices of an n x n x n block of unit cells, places moved."""
    m = n + 1
    at = lambda i, j, k: 1 + i + m * j + m * m * k
    vertices = [(at(i, j, k), *map(float, moved(i, j, k))) for i in range(m) for j in range(m) for k in range(m)]
    cells = []
    for k in range(n):
        for j in range(n):
            for i in range(n):
                low = [at(i, j, k), at(i + 1, j, k), at(i + 1, j + 1, k), at(i, j + 1, k)]
                cells.append((1 + i + n * j + n * n * k, low + [v + m * m for v in low]))
    faces = mesh.elements_to_faces(spark.createDataFrame(cells, "cell long, vtx array<long>"), "HEXA_8")
    return faces, spark.createDataFrame(vertices, XYZ)


def test_sphere_area(spark):
    """The polygons of a sphere close: vector areas add up to nothing, areas to nearly 4 pi r2, and every inner edge is in two polygons."""
    faces, vertices = block(spark, 10)
    points, segments = surfaces.cut_segments(faces, vertices, surfaces.ellipsoid((5.02, 4.97, 5.01), radius2=9.0))
    rings = surfaces.polygons(segments)
    sums = surfaces.ring_areas(rings, points).agg(*[F.sum(c) for c in ("area", "nx", "ny", "nz")]).first()
    assert abs(sums[0] / (4 * math.pi * 9) - 1) < 0.05 and max(map(abs, sums[1:])) < 1e-9
    edges = {}
    for r in rings.collect():
        p = r["points"]
        assert len(set(p)) == len(p) >= 3
        for a, b in zip(p, p[1:] + p[:1]):
            edges[a, b] = edges.get((a, b), 0) + 1
    assert all(n == 1 and (b, a) in edges for (a, b), n in edges.items())
    # They look to where the field is lower: inward.
    d = surfaces.ring_areas(rings, points).join(rings.select("cell", "ring", F.explode("points").alias("point")).join(points.select("point", "x", "y", "z"), "point").groupBy("cell", "ring").agg(*[F.avg(c).alias(c) for c in "xyz"]), ["cell", "ring"])
    assert d.filter("nx * (x - 5.02) + ny * (y - 4.97) + nz * (z - 5.01) >= 0").count() == 0


def test_cell_with_two_rings(spark):
    """A field that is high at two opposite corners of a cube cuts off both; one high along a diagonal face alternates there."""
    cube = spark.createDataFrame([(1, list(range(1, 9)))], "cell long, vtx array<long>")
    faces = mesh.elements_to_faces(cube, "HEXA_8")
    corners = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    for high, sizes in (({1, 7}, [3, 3]), ({1, 3}, [3, 3]), ({1, 2, 3, 4, 5, 6, 8}, [3]), ({1, 2, 3, 4}, [4]), ({1, 3, 6, 8}, [3, 3, 3, 3]), (set(), []), (set(range(1, 9)), [])):
        vertices = spark.createDataFrame([(i, *map(float, c), float(i in high)) for i, c in enumerate(corners, 1)], f"{XYZ}, f double")
        points, segments = surfaces.cut_segments(faces, vertices, F.col("f"), 0.5, ["f"])
        rings = [r["points"] for r in surfaces.polygons(segments).collect()]
        assert sorted(map(len, rings)) == sizes
        assert all(abs(r["f"] - 0.5) < 1e-12 and abs(r["t"] - 0.5) < 1e-12 for r in points.collect())
        assert sorted(x for r in rings for x in r) == sorted(r["point"] for r in points.collect())


def test_location_in_warped_cells(spark):
    """Every point inside the block is in one cell, and the centre of every cell in its own, though no face is flat."""
    r = random.Random(4)
    shift = {(i, j, k): [r.uniform(-0.25, 0.25) * (0 < c < 4) for c in (i, j, k)] for i in range(5) for j in range(5) for k in range(5)}
    faces, vertices = block(spark, 4, lambda x, y, z: tuple(c + s for c, s in zip((x, y, z), shift[x, y, z])))
    inside = [(i, *(r.uniform(0.01, 3.99) for _ in range(3))) for i in range(300)]
    outside = [(1000 + i, 4.2 + r.random(), r.uniform(-1, 5), r.uniform(-1, 5)) for i in range(50)] + [(2000, None, 1.0, 1.0), (2001, float("nan"), 1.0, 1.0)]
    targets = spark.createDataFrame(inside + outside, "target long, x double, y double, z double")
    shells = interpolation.cell_shells(faces, vertices)
    got = dict(interpolation.locate_any(targets, faces, vertices).collect())
    assert len(got) == len(inside) + len(outside) and all((got[i] > 0) == (i < 1000) for i in got)
    near = spatial.box_candidates(targets, shells, "target", "cell").join(targets, "target").join(shells.select("cell", "shell"), "cell")
    angles = near.select("target", interpolation.solid_angle(F.col("shell"), [F.col(c) for c in "xyz"]).alias("w")).groupBy("target").agg(F.sum("w").alias("w")).filter("target < 1000").collect()
    assert np.allclose([a["w"] for a in angles], 4 * math.pi)


def test_location_on_surfaces(spark):
    """Points on faces, edges and corners belong to the least cell there, those beyond the tolerance to none."""
    faces, vertices = block(spark, 2)
    rows = [(1, 1.0, 0.5, 0.5), (2, 1.0, 1.0, 0.5), (3, 1.0, 1.0, 1.0), (4, 2.0, 2.0, 2.0), (5, 0.0, 0.3, 1.7), (6, 2.0 + 5e-7, 0.5, 0.5), (7, 2.1, 0.5, 0.5), (8, -1e-3, 0.5, 0.5)]
    got = dict(interpolation.locate_any(spark.createDataFrame(rows, "target long, x double, y double, z double"), faces, vertices, 1e-6).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 8, 5: 5, 6: 2, 7: -1, 8: -1}


def test_candidates_of_boxes_of_all_sizes(spark):
    r = random.Random(9)
    boxes = [(0, *[-1e5, 1e5] * 3)] + [(i, *[v for c in [r.uniform(0, 50) for _ in range(3)] for v in (c, c + 10 ** r.uniform(-3, 1))]) for i in range(1, 400)] + [(400, *[3.0, 3.0] * 3)]
    names = ", ".join(f"low{c} double, high{c} double" for c in "xyz")
    points = [(i, *[r.uniform(-1, 52) for _ in range(3)]) for i in range(500)] + [(500, 3.0, 3.0, 3.0)]
    b, p = spark.createDataFrame(boxes, f"box long, {names}"), spark.createDataFrame(points, "point long, x double, y double, z double")
    rows = spatial.box_candidates(p, b, "point", "box").collect()
    want = {(i, k) for i, *at in points for k, *e in boxes if all(e[2 * a] <= at[a] <= e[2 * a + 1] for a in range(3))}
    assert {tuple(x) for x in rows} == want and len(rows) == len(want)


def test_walls_with_one_huge_face(spark, monkeypatch):
    """One face of a million times the others' size, targets near and far; the candidates stay few, and repeated numbers keep their places."""
    r = random.Random(6)
    vertices, faces = [(1, -1e4, -1e4, -3.0), (2, 1e4, -1e4, -3.0), (3, 1e4, 1e4, -3.0), (4, -1e4, 1e4, -3.0)], [(0, [1, 2, 3, 4])]
    for i in range(1, 300):
        c = [r.uniform(0, 5) for _ in range(3)]
        vertices += [(3 * i + k + 2, *[x + r.uniform(0, 0.02) for x in c]) for k in range(3)]
        faces.append((i, [3 * i + 2, 3 * i + 3, 3 * i + 4]))
    targets = [(i % 150, *[r.uniform(-2, 7) for _ in range(3)]) for i in range(200)] + [(900, 3000.0, -500.0, 40.0)]
    seen = spark.sparkContext.accumulator(0)
    plain = walls._nearest

    def counted(batches):
        def each():
            for b in batches:
                seen.add(len(b))
                yield b

        return plain(each())

    monkeypatch.setattr(walls, "_nearest", counted)
    rows = walls.distance_to_faces(spark.createDataFrame(targets, "target long, x double, y double, z double"), spark.createDataFrame(faces, "face long, vtx array<long>"), spark.createDataFrame(vertices, XYZ)).collect()
    place = {v: np.array(c) for v, *c in vertices}
    tri = [(f, *(place[v] for v in (vs[0], b, c))) for f, vs in faces for b, c in zip(vs[1:], vs[2:])]
    a, b, c = (np.array([t[k] for t in tri]) for k in (1, 2, 3))
    want = sorted((t, round(math.sqrt(plain_distance(np.array(at), a, b, c)), 9)) for t, *at in targets)
    assert sorted((x["target"], round(x["distance"], 9)) for x in rows) == want
    assert seen.value < 200 * 300 * 2


def plain_distance(p, a, b, c):
    return walls.nearest_on_triangles(np.repeat(p[None], len(a), 0), a, b, c)[0].min()
