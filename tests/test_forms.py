"""Element forms, surfaces, interpolation, zones, sources."""

from math import pi

import numpy as np
import pytest
from gnomon.operators import convert, interpolation, mesh, partition, surfaces, zones
from gnomon.operators import generators as g
from gnomon.sources import tables, tree_text
from pyspark.sql import functions as F


def test_mixed_and_sections(spark):
    e = spark.createDataFrame([(1, "HEXA_8", list(range(1, 9))), (2, "TRI_3", [1, 2, 3]), (3, "NODE", [5]), (4, "QUAD_4", [4, 3, 2, 1])], "element bigint, kind string, vtx array<bigint>")
    m = convert.to_mixed(e)
    rows = m.orderBy("element").collect()
    assert [r.start for r in rows] == [0, 9, 13, 15] and rows[1].connectivity == [5, 1, 2, 3]
    assert sorted(convert.from_mixed(m).collect()) == sorted(e.collect())
    assert [r.element for r in convert.sections(e).orderBy("number").collect()] == [3, 2, 4, 1]
    assert convert.to_mixed(e.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["TETRA_4", "PENTA_6", "PYRA_5", "HEXA_8"])
def test_polyhedra_become_elements_again(spark, kind):
    cells = g.cube_cells(spark, (3, 2, 3), kind)
    faces = mesh.elements_to_faces(cells, kind)
    back = convert.polyhedra_to_elements(faces)
    assert {r.kind for r in back.collect()} == {kind}
    again = mesh.elements_to_faces(back, kind)
    same = lambda d: {(tuple(sorted(r.vtx)), r.left, r.right) for r in d.collect()}
    assert same(again) == same(faces)
    v = g.cube_vertices(spark, (3, 2, 3)).unionByName(g.cube_centres(spark, (3, 2, 3)))
    # All faces of the elements point outwards again.
    total = lambda d: mesh.face_normals(d.filter("right = 0"), v)
    first = faces.filter("right = 0").select("face", F.col("vtx")[0].alias("vertex")).join(v, "vertex")
    flux = lambda d: first.join(total(d), "face").agg(F.sum(F.expr("nx * x + ny * y + nz * z"))).first()[0]
    assert flux(faces) == pytest.approx(3) and flux(again) == pytest.approx(3)


def test_unknown_shapes_keep_their_vertices(spark):
    f = spark.createDataFrame([(1, 1, 0, [1, 2, 3, 4, 5]), (2, 1, 0, [3, 2, 1])], "face bigint, left bigint, right bigint, vtx array<bigint>")
    assert convert.polyhedra_to_elements(f).collect() == [(1, None, [1, 2, 3, 4, 5])]


def test_ranges_and_registry(spark):
    n = (3, 4, 5)
    low = convert.structured_faces("IFaceCenter", (1, 1, 1), (1, 3, 4), n, spark.range(1))
    assert sorted(low.collect()) == sorted(g.cube_boundaries(spark, n).filter("name = 'Xmin'").select("element").collect())
    nodes = spark.createDataFrame([("Zone_t", "b/z2"), ("Zone_t", "b/z1"), ("Base_t", "b")], "label string, path string")
    assert sorted(convert.registry(nodes).collect()) == [("Base_t", "b", 1), ("Zone_t", "b/z1", 1), ("Zone_t", "b/z2", 2)]
    own = spark.createDataFrame([(5, True), (7, False), (9, True)], "vertex bigint, own boolean")
    assert sorted(convert.without_ghosts(own, "vertex", F.col("own"), ["vertex"]).collect()) == [(5, 1), (9, 2)]


@pytest.mark.parametrize("kind", ["HEXA_8", "PENTA_6", "TETRA_4"])
def test_slices(spark, kind):
    n = (7, 7, 7)
    v, cells = g.cube_vertices(spark, n), g.cube_cells(spark, n, kind)
    t = surfaces.tetrahedra(cells, kind)
    pts, poly = surfaces.level_surface(t, v, surfaces.plane((0, 0, 1), 0.4), values=["x"])
    assert pts.filter("abs(z - 0.4) > 1e-12").count() == 0
    assert surfaces.polygon_areas(poly, pts).agg(F.sum("area")).first()[0] == pytest.approx(1)
    pts, poly = surfaces.level_surface(t, v, surfaces.ellipsoid((0.5, 0.5, 0.5), radius2=0.16))
    assert surfaces.polygon_areas(poly, pts).agg(F.sum("area")).first()[0] == pytest.approx(4 * pi * 0.16, rel=0.1)
    assert surfaces.parent_values(poly, cells.select("cell", F.lit(2.0).alias("f")), ["f"]).filter("f = 2").count() == poly.count()
    pts, poly = surfaces.level_surface(t, v, surfaces.plane((0, 0, 1), 9))
    assert pts.count() == 0 and poly.count() == 0


def test_interpolation(spark):
    n = (5, 5, 5)
    v, cells, f = g.cube_vertices(spark, n), g.cube_cells(spark, n), g.cube_faces(spark, n)
    rng = np.random.default_rng(1)
    p = rng.uniform(0.01, 1.2, (60, 3))
    targets = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "target bigint, x double, y double, z double")
    want = {i: 1 + int(np.dot(np.floor(r * 4), (1, 4, 16))) if (r < 1).all() else -1 for i, r in enumerate(p)}
    assert dict(interpolation.locate(targets, f, v).collect()) == want
    centres = cells.select("cell", F.explode("vtx").alias("vertex")).join(v, "vertex").groupBy("cell").agg(*[F.avg(c).alias(c) for c in "xyz"])
    at = {r.cell: np.array([r.x, r.y, r.z]) for r in centres.collect()}
    nearest = {i: min(at, key=lambda c: (((at[c] - r) ** 2).sum(), c)) for i, r in enumerate(p)}
    both = dict(interpolation.source_of(targets, centres, f, v, "LocationAndClosest").collect())
    assert both == {i: c if c > 0 else nearest[i] for i, c in want.items()}
    assert dict(interpolation.source_of(targets, centres, None, None).collect()) == nearest
    m = interpolation.source_of(targets, centres, f, v, "Location")
    out = dict(interpolation.interpolate(m, centres.withColumn("f", F.col("cell") * 1.0), ["f"]).collect())
    assert all(np.isnan(out[i]) if c < 0 else out[i] == c for i, c in want.items())
    with pytest.raises(ValueError):
        interpolation.source_of(targets, centres, f, v, "other")


def test_moves_between_cells_and_vertices(spark):
    n = (3, 3, 3)
    v, cells = g.cube_vertices(spark, n), g.cube_cells(spark, n)
    one = cells.select("cell", F.lit(3.0).alias("f"))
    assert {round(r.f, 9) for r in interpolation.centres_to_vertices(cells, v, one, ["f"]).collect()} == {3.0}
    c = interpolation.vertices_to_centres(cells, v, v.select("vertex", F.col("x").alias("f")), ["f"], 2)
    assert {round(r.f, 9) for r in c.collect()} == {0.25, 0.75}


def two_blocks(spark, n=(3, 3, 3)):
    """Two cubes side by side in x, joined Xmax to Xmin."""
    zone = lambda d, z: d.withColumn("zone", F.lit(z))
    both = lambda d, e=None: zone(d, "A").unionByName(zone(d if e is None else e, "B"))
    v, f = g.cube_vertices(spark, n), g.cube_faces(spark, n)
    centre = f.select("face", F.explode("vtx").alias("vertex")).join(v, "vertex").groupBy("face").agg(*[F.avg(c).alias(c) for c in "xyz"])
    side = lambda s, dx: centre.join(g.cube_boundaries(spark, n).filter(F.col("name") == s).select(F.col("element").alias("face")), "face").withColumn("x", F.col("x") + dx)
    pairs = zones.match_faces(side("Xmax", 0.0), side("Xmin", 0.0), 1e-6, shift=(-1, 0, 0))
    joins = pairs.select(F.lit("A").alias("zone"), "face", F.lit("B").alias("donor_zone"), "donor_face")
    cells = both(g.cube_cells(spark, n).select("cell"))
    return cells, both(f), both(v, v.withColumn("x", F.col("x") + 1)), joins


def test_merge(spark):
    cells, faces, vertices, joins = two_blocks(spark)
    assert joins.count() == 4
    ids, f, v = zones.merge(cells, faces, vertices, joins)
    want = g.cube_faces(spark, (5, 3, 3))
    assert f.count() == want.count() and v.count() == 45 and v.select("x", "y", "z").distinct().count() == 45
    assert f.filter("right = 0").count() == want.filter("right = 0").count() and f.filter("left = 0").count() == 0
    assert sorted(r.cell for r in ids.collect()) == list(range(1, 17))
    assert {r.kind for r in convert.polyhedra_to_elements(f).collect()} == {"HEXA_8"}
    items = spark.createDataFrame([("A", "s", 1), ("B", "s", 1)], "zone string, name string, gnum bigint")
    assert zones.merge_subsets(items, ids).filter("name = 's'").count() == 2
    assert {r.name for r in zones.merge_subsets(items, ids, "None").collect()} == {"s.A", "s.B"}
    assert {r.component for r in zones.connected_zones(joins).collect()} == {"A"}


def test_join_names_and_turns(spark):
    j = spark.createDataFrame([("A", "j1", "B", "k"), ("B", "j2", "A", "k"), ("A", "p1", "A", "m"), ("A", "p2", "A", "m")], "zone string, name string, donor_zone string, marks string")
    got = {(r.zone, r.name): (r.donor_name, r.reference) for r in zones.donor_names(j).collect()}
    assert got == {("A", "j1"): ("j2", True), ("B", "j2"): ("j1", False), ("A", "p1"): ("p2", True), ("A", "p2"): ("p1", False)}
    assert zones.copies_to_full_turn(-pi / 4) == 7
    with pytest.raises(ValueError):
        zones.copies_to_full_turn(1.0)
    v = spark.createDataFrame([(1, 1.0, 0.0, 0.0)], "vertex bigint, x double, y double, z double")
    out = {r.vertex: (round(r.x, 9), round(r.y, 9)) for r in zones.rotated_copies(v, 3, (0, 0, pi / 2), 10).collect()}
    assert out[11] == (0, 1) and out[21] == (-1, 0) and out[31] == (0, -1)


TEXT = """
Base CGNSBase_t I4 [3,3]:
  Zone Zone_t I4 [[8,1,0]]:
    ZoneType ZoneType_t "Unstructured":
    GridCoordinates GridCoordinates_t:
      CoordinateX DataArray_t:
        R8 : [0, 1.5, 2]
"""


def test_tree_text(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.yaml").write_text(TEXT)
    (tmp_path / "in" / "empty.yaml").write_text("")
    nodes = tree_text.read(spark, str(tmp_path / "in"))
    rows = {r.path: r for r in nodes.collect()}
    assert len(rows) == 5 and rows["Base/Zone"].size == 3 and rows["Base/Zone"].dtype == "I4"
    assert rows["Base/Zone/GridCoordinates/CoordinateX"].value == "[0, 1.5, 2]" and rows["Base/Zone/ZoneType"].value == '"Unstructured"'
    assert tree_text.sizes_only(nodes, 2).filter("name = 'CoordinateX' and value is null and size = 3").count() == 1
    tree_text.write(nodes, str(tmp_path / "out"))
    back = {r.path: r for r in tree_text.read(spark, str(tmp_path / "out" / "*" / "*.txt")).collect()}
    assert {p: r[2:] for p, r in back.items()} == {p: r[2:] for p, r in rows.items()}
    assert tree_text.outline(nodes).filter("line = '    ZoneType ZoneType_t C1(1)'").count() == 1
    with pytest.raises(ValueError):
        tree_text.parse("a L I4 1:\n  I4 : [2]\n")


def test_mesh_tables(spark, tmp_path):
    n = (3, 3, 3)
    f = g.cube_faces(spark, n).withColumn("zone", F.lit("01"))
    p = partition.by_number(g.cube_cells(spark, n).select("cell"), [1, 1]).withColumn("zone", F.lit("01"))
    tables.write({"faces": f, "part_map": p}, str(tmp_path / "m"))
    got = tables.read(spark, str(tmp_path / "m"), ["faces"])["faces"]
    assert sorted(got.select(f.columns).collect()) == sorted(f.collect())
    some = tables.read_parts(spark, str(tmp_path / "m"), "part_map", parts=[1], zones=["01"])
    assert some.count() == 4 and len(some.inputFiles()) > 0
    assert tables.read_parts(spark, str(tmp_path / "m"), "part_map", zones=["02"]).count() == 0
    with pytest.raises(ValueError):
        tables.write({"other": f}, str(tmp_path / "m"))
