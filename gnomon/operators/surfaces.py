"""Level surfaces of vertex fields through tetrahedra or any polyhedra, and slices by planes, spheres and ellipsoids.

Polyhedra are cut without tetrahedra: walking round a face, the field rises above the level at one edge and falls below
it at a later one; the two points are the ends of a segment that both cells of the face share, in opposite directions.
In a cell every cut edge ends one segment and begins one, so the segments are a permutation of the cell's points, whose
cycles are its polygons.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import generators, mesh, numbering


def plane(normal: Sequence[float], offset: float) -> Column:
    """The field whose zero level is normal . x = offset."""
    return F.col("x") * normal[0] + F.col("y") * normal[1] + F.col("z") * normal[2] - offset


def ellipsoid(centre: Sequence[float], axes: Sequence[float] = (1, 1, 1), radius2: float = 1.0) -> Column:
    """The field that vanishes on an ellipsoid; with equal axes a sphere."""
    t = [((F.col(c) - o) / a) ** 2 for c, o, a in zip("xyz", centre, axes)]
    return t[0] + t[1] + t[2] - radius2


def tetrahedra(cells: DataFrame, kind: str) -> DataFrame:
    """(cell, vtx): cells as tetrahedra, each keeping the number of its cell."""
    cuts = {
        "TETRA_4": ((1, 2, 3, 4),), "PYRA_5": ((1, 2, 3, 5), (1, 3, 4, 5)), "PENTA_6": ((1, 2, 3, 6), (1, 2, 6, 5), (1, 5, 6, 4)),
        "HEXA_8": generators.CUTS["TETRA_4"],
    }[kind]
    v = F.col("vtx")
    return cells.select("cell", F.explode(F.array(*[F.array(*[v[p - 1] for p in c]) for c in cuts])).alias("vtx"))


def level_surface(tetra: DataFrame, vertices: DataFrame, field: Column, level: float = 0.0, values: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(points, polygons) where the field takes the level.

    points: (point, a, b, t, x, y, z, values), one an edge of the mesh that crosses the level, numbered by its ends (a, b).
    polygons: (cell, points): a triangle or quadrangle for each tetrahedron that crosses it, in a cycle, its parent kept.
    A vertex at the level counts as above it.
    """
    f = vertices.select("vertex", field.alias("field"), *dict.fromkeys(["x", "y", "z", *values]))
    d = tetra.select("cell", F.xxhash64("cell", "vtx").alias("_t"), F.explode("vtx").alias("vertex")).join(f.select("vertex", "field"), "vertex")
    side = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("vertex"))))
    d = d.groupBy("cell", "_t").agg(side(F.col("field") < level).alias("lo"), side(F.col("field") >= level).alias("hi"))
    d = d.filter((F.size("lo") > 0) & (F.size("hi") > 0))
    lo, hi = F.col("lo"), F.col("hi")
    edge = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    # Two and two: consecutive edges share a face of the tetrahedron.
    ring = (
        F.when(F.size(lo) == 1, F.transform(hi, lambda h: edge(lo[0], h))).when(F.size(hi) == 1, F.transform(lo, lambda x: edge(x, hi[0])))
        .otherwise(F.array(edge(lo[0], hi[0]), edge(lo[0], hi[1]), edge(lo[1], hi[1]), edge(lo[1], hi[0])))
    )
    d = d.select("cell", "_t", F.posexplode(ring).alias("pos", "e")).select("cell", "_t", "pos", "e.*")
    crossed = mesh.level_points(d.select("a", "b").distinct(), f, level, list(dict.fromkeys(["x", "y", "z", *values])))
    points = numbering.row_numbers(crossed, ["a", "b"], "point")
    d = d.join(points.select("a", "b", "point"), ["a", "b"]).groupBy("cell", "_t").agg(F.sort_array(F.collect_list(F.struct("pos", "point"))).alias("p"))
    return points, d.select("cell", F.col("p.point").alias("points"))


def polygon_areas(polygons: DataFrame, points: DataFrame) -> DataFrame:
    """(cell, area): the surface inside each cell."""
    d = polygons.select("cell", F.xxhash64("cell", "points").alias("face"), F.col("points").alias("vtx"))
    n = mesh.face_normals(d, points.select(F.col("point").alias("vertex"), "x", "y", "z"))
    area = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return d.select("cell", "face").join(n, "face").groupBy("cell").agg(F.sum(area).alias("area"))


def parent_values(polygons: DataFrame, field: DataFrame, values: Sequence[str]) -> DataFrame:
    """Polygons with values of the cells they lie in."""
    return polygons.join(field.select("cell", *values).hint("merge"), "cell")  # a field has as many rows as the mesh has cells


def _entry(order: Column) -> Column:
    return F.struct(order.alias("_pos"), F.col("vertex"), F.col("_above"))


def cut_segments(faces: DataFrame, vertices: DataFrame, field: Column, level: float = 0.0, values: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(points, segments) of the faces (face, left, right, vtx) that the level cuts.

    points: (point, a, b, t, x, y, z, values) as level_surface gives them.  segments: (face, left, right, start, stop):
    seen from outside the left cell, from the point where the field rises to the one where it falls, for each stretch of
    the face above the level.  A vertex at the level counts as above it; faces with vertices of unknown place are not cut.
    """
    f = vertices.select("vertex", field.alias("field"), *dict.fromkeys(["x", "y", "z", *values]))
    d = faces.select("face", F.size("vtx").alias("_n"), F.posexplode("vtx").alias("_pos", "vertex")).join(f.select("vertex", (F.col("field") >= level).alias("_above")), "vertex")
    ring = F.sort_array(F.collect_list(_entry(F.col("_pos"))))
    d = d.groupBy("face", "_n").agg(ring.alias("_ring")).filter((F.size("_ring") == F.col("_n")) & F.exists("_ring", lambda v: v["_above"]) & F.exists("_ring", lambda v: ~v["_above"]))
    after = lambda i: F.get("_ring", F.pmod(i + 1, F.col("_n")))
    edge = lambda v, w: F.struct(F.least(v["vertex"], w["vertex"]).alias("a"), F.greatest(v["vertex"], w["vertex"]).alias("b"), w["_above"].alias("up"))
    crossed = F.filter(F.transform("_ring", lambda v, i: F.when(v["_above"] != after(i)["_above"], edge(v, after(i)))), lambda x: x.isNotNull())
    d = d.select("face", crossed.alias("_c"))
    # Rising and falling edges alternate; each rising one is followed by its falling one, the last perhaps by the first.
    pair = lambda x, i: F.when(x["up"], F.struct(F.struct(x["a"].alias("a"), x["b"].alias("b")).alias("start"), F.get("_c", F.pmod(i + 1, F.size("_c"))).alias("stop")))
    d = d.select("face", F.explode(F.filter(F.transform("_c", pair), lambda x: x.isNotNull())).alias("s"))
    d = d.select("face", F.col("s.start.a").alias("a"), F.col("s.start.b").alias("b"), F.col("s.stop.a").alias("a2"), F.col("s.stop.b").alias("b2"))
    ends = d.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("a2").alias("a"), F.col("b2").alias("b"))))).distinct()
    points = numbering.row_numbers(mesh.level_points(ends, f, level, list(dict.fromkeys(["x", "y", "z", *values]))), ["a", "b"], "point")
    at = lambda a, b, name: points.select(F.col("a").alias(a), F.col("b").alias(b), F.col("point").alias(name))
    d = d.join(at("a", "b", "start"), ["a", "b"]).join(at("a2", "b2", "stop"), ["a2", "b2"])
    return points, d.join(faces.select("face", "left", "right"), "face").select("face", "left", "right", "start", "stop")


def _rings(follow: Column) -> Column:
    """The cycles of a map from point to point, each from its least point, by a fold over as many steps as there are points."""
    keys = F.sort_array(F.map_keys(follow))
    none = F.array().cast("array<array<bigint>>")
    start = F.struct(none.alias("done"), F.slice(keys, 1, 1).cast("array<bigint>").alias("now"), F.slice(keys, 2, F.size(keys)).cast("array<bigint>").alias("left"))

    def step(acc: Column, _: Column) -> Column:
        follows = F.element_at(follow, F.element_at(acc["now"], -1))
        closed = follows == F.get(acc["now"], 0)
        going = F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.array(follows)).alias("now"), F.array_remove(acc["left"], follows).alias("left"))
        begun = F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), F.slice(acc["left"], 1, 1).alias("now"), F.slice(acc["left"], 2, F.size(keys)).alias("left"))
        return F.when(closed, begun).otherwise(going)

    return F.aggregate(keys, start, step, lambda acc: acc["done"])


def polygons(segments: DataFrame) -> DataFrame:
    """(cell, ring, points): the closed polygons of every cell that is cut, numbered from 0 by their least point; they look to where the field is lower."""
    sides = F.array(F.struct(F.col("left").alias("cell"), F.col("start").alias("p"), F.col("stop").alias("q")), F.struct(F.col("right").alias("cell"), F.col("stop").alias("p"), F.col("start").alias("q")))
    d = segments.select(F.inline(sides)).filter("cell > 0")
    d = d.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("p", "q"))).alias("_follow"))
    return d.select("cell", F.posexplode(_rings(F.col("_follow"))).alias("ring", "points"))


def boundary_edges(segments: DataFrame, families: DataFrame) -> DataFrame:
    """(face, cell, start, stop, family): the edges of the surface on outer faces, with the family of the face (face, family; null if it has none)."""
    outer = segments.filter("left = 0 or right = 0")
    inside = F.col("left") > 0
    turned = lambda a, b: F.when(inside, F.col(a)).otherwise(F.col(b))
    d = outer.select("face", F.greatest("left", "right").alias("cell"), turned("start", "stop").alias("start"), turned("stop", "start").alias("stop"))
    return d.join(families.select("face", "family"), "face", "left")


def ring_areas(rings: DataFrame, points: DataFrame) -> DataFrame:
    """(cell, ring, n_points, area, nx, ny, nz): vector areas of polygons; area is the vector's length, the area itself where a polygon is flat."""
    d = rings.select(F.struct("cell", "ring").alias("face"), F.col("points").alias("vtx"))
    n = mesh.face_normals(d, points.select(F.col("point").alias("vertex"), "x", "y", "z"))
    area = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    n = n.select("face.cell", "face.ring", area.alias("area"), "nx", "ny", "nz")
    return rings.select("cell", "ring", F.size("points").alias("n_points")).join(n, ["cell", "ring"])
