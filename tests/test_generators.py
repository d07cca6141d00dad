"""Generated meshes: counts, closed surfaces, volumes."""

import numpy as np
import pytest
from gnomon.operators import generators as g
from gnomon.operators import mesh
from pyspark.sql import functions as F


def volumes(cells, vertices):
    xyz = {r.vertex: np.array([r.x, r.y, r.z]) for r in vertices.collect()}
    out = []
    for r in cells.collect():
        a, b, c, d = (xyz[v] for v in r.vtx)
        out.append(np.dot(np.cross(b - a, c - a), d - a) / 6)
    return np.array(out)


def test_points(spark):
    rows = g.cartesian_points(spark, (3, 2), (0, 1), (1, 3)).orderBy("vertex").collect()
    assert [(r.x, r.y) for r in rows] == [(0, 1), (0.5, 1), (1, 1), (0, 3), (0.5, 3), (1, 3)]
    assert g.cartesian_points(spark, (1,), (4,), (9,)).first()["x"] == 4
    a = g.random_points(spark, 500, (0, 0, -1), (1, 2, 1), 7)
    assert sorted(a.collect()) == sorted(a.repartition(3).collect())
    assert a.filter("x < 0 or x >= 1 or y >= 2 or z < -1").count() == 0 and abs(a.agg(F.avg("y")).first()[0] - 1) < 0.1


@pytest.mark.parametrize("n", [(3, 4, 2), (2, 2, 2), (4, 3, 3)])
def test_cube_faces_are_those_of_its_cells(spark, n):
    key = lambda d: {(tuple(sorted(r.vtx)), min(r.left, r.right), max(r.left, r.right)) for r in d.collect()}
    made, found = g.cube_faces(spark, n), mesh.elements_to_faces(g.cube_cells(spark, n), "HEXA_8")
    assert key(made) == key(found) and made.count() == found.count()
    sides = g.cube_boundaries(spark, n).join(made.withColumnRenamed("face", "element"), "element")
    assert sides.count() == made.filter("right = 0").count() == sides.filter("right = 0").count()


def test_faces_point_out_of_their_left_cell(spark):
    n = (3, 3, 3)
    v = g.cube_vertices(spark, n)
    centre = lambda c: v.join(g.cube_cells(spark, n).select("cell", F.explode("vtx").alias("vertex")), "vertex").groupBy("cell").agg(*[F.avg(x).alias(f"c{x}") for x in "xyz"])
    f = g.cube_faces(spark, n)
    d = f.select("face", "left", F.col("vtx")[0].alias("vertex")).join(v, "vertex").join(mesh.face_normals(f, v), "face").join(centre(n).withColumnRenamed("cell", "left"), "left")
    assert d.filter("nx * (x - cx) + ny * (y - cy) + nz * (z - cz) <= 0").count() == 0


@pytest.mark.parametrize("kind", ["TETRA_4", "PENTA_6", "PYRA_5"])
def test_cut_cubes_are_conforming(spark, kind):
    n = (3, 3, 4)
    cells = g.cube_cells(spark, n, kind)
    f = mesh.elements_to_faces(cells, kind)
    sides = {"TETRA_4": 6, "PENTA_6": 5, "PYRA_5": 6}[kind]
    assert cells.count() == 2 * 2 * 3 * len(g.CUTS[kind]) and sides
    v = g.cube_vertices(spark, n).unionByName(g.cube_centres(spark, n))
    area = mesh.face_normals(f.filter("right = 0"), v).select(F.sum(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2))).first()[0]
    assert abs(area - 6) < 1e-9  # only the outside of the cube is boundary
    if kind == "TETRA_4":
        x = volumes(cells, v)
        assert (x > 0).all() and abs(x.sum() - 1) < 1e-9


def test_plane(spark):
    v, c = g.plane_polygons(spark, 5, 4, 0.3, 1)
    rows = c.orderBy("cell").collect()
    assert [r.cell for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == 12 + 6
    n = mesh.face_normals(c.withColumnRenamed("cell", "face"), v).agg(F.sum("nz"), F.min("nz")).first()
    assert abs(n[0] - 1) < 1e-9 and n[1] > 0


@pytest.mark.parametrize("m", [1, 2, 5])
def test_sphere(spark, m):
    v, c = g.sphere_triangles(spark, m, 2.0, (1, 0, 0))
    assert v.count() == 10 * m * m + 2 == v.agg(F.max("vertex")).first()[0]
    cells = sorted(r.cell for r in c.collect())
    assert cells == list(range(1, 20 * m * m + 1))
    e = mesh.edges(c)
    assert e.count() == 30 * m * m  # a closed surface
    assert v.filter("abs((x - 1) * (x - 1) + y * y + z * z - 4) > 1e-9").count() == 0
    solid, tetra = g.filled(v, c, 10 * m * m + 2, (1, 0, 0))
    x = volumes(tetra, solid)
    assert (x > 0).all() and x.sum() < 4 / 3 * np.pi * 8 + 1e-9 and (m < 5 or x.sum() > 0.9 * 4 / 3 * np.pi * 8)


def test_shells(spark):
    v, c = g.sphere_triangles(spark, 2)
    radii = g.geometric_radii(1, 4, 2, 2.0)
    assert radii == [1, 2, 4]
    w, p = g.shells(v, c, 42, 80, radii)
    f = mesh.elements_to_faces(p, "PENTA_6")
    assert w.count() == 126 and p.count() == 160 and f.filter("right = 0").count() == 160
