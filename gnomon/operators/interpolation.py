"""Fields from one mesh to another: containment in convex cells, nearest points, both; cells to vertices and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mesh, spatial

XYZ = ("x", "y", "z")


def _dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cell_planes(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(cell, low.., high.., planes): box of each cell and its faces as outward planes (unit normal, offset)."""
    corners = faces.select("face", F.explode("vtx").alias("vertex")).join(vertices.select("vertex", *XYZ), "vertex")
    size = corners.groupBy("face").agg(*[F.avg(c).alias(f"_m{c}") for c in XYZ], *[f(c).alias(f"{k}{c}") for c in XYZ for k, f in (("low", F.min), ("high", F.max))])
    d = faces.select("face", "left", "right").join(mesh.face_normals(faces, vertices), "face").join(size, "face")
    length = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    unit = [F.col(f"n{c}") / length for c in XYZ]
    plane = lambda s: F.struct(*[(u * s).alias(f"n{c}") for u, c in zip(unit, XYZ)], (_dot(unit, [F.col(f"_m{c}") for c in XYZ]) * s).alias("d"))
    both = F.array(F.struct(F.col("left").alias("cell"), plane(1.0).alias("p")), F.struct(F.col("right").alias("cell"), plane(-1.0).alias("p")))
    edges = [f"{k}{c}" for c in XYZ for k in ("low", "high")]
    d = d.select(*edges, F.explode(both).alias("s")).select(*edges, "s.*").filter("cell > 0")
    return d.groupBy("cell").agg(*[(F.min if e.startswith("low") else F.max)(e).alias(e) for e in edges], F.collect_list("p").alias("planes"))


def locate(targets: DataFrame, faces: DataFrame, vertices: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(target, cell): the convex cell that holds each point (within tolerance, a length; the least of several), -1 where none does.

    Candidates are the cells whose boxes hold a point, found on levels of grids by the boxes' sizes; then the planes of
    each candidate decide.
    """
    cells = cell_planes(faces, vertices)
    near = spatial.box_candidates(targets, cells, "target", "cell", tolerance)
    at = [F.col(c) for c in XYZ]
    inside = F.forall("planes", lambda q: _dot(at, [q[f"n{c}"] for c in XYZ]) <= q["d"] + tolerance)
    found = near.join(targets.select("target", *XYZ), "target").join(cells.select("cell", "planes"), "cell").filter(inside)
    found = found.groupBy("target").agg(F.min("cell").alias("cell"))
    return targets.select("target").join(found, "target", "left").select("target", F.coalesce("cell", F.lit(-1)).alias("cell"))


def cell_shells(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(cell, low.., high.., shell): box of each cell and its closed surface as outward triangles (a, b, c), each a triple of coordinates.

    A face is cut into triangles around its centre, in the same way for both of its cells: warped faces leave no gap and
    no overlap between cells.
    """
    d = faces.select("face", F.size("vtx").alias("_n"), F.posexplode("vtx").alias("_pos", "vertex")).join(vertices.select("vertex", F.array(*XYZ).alias("_at")), "vertex")
    edge = [f(F.get("_at", i)).alias(f"{k}{c}") for i, c in enumerate(XYZ) for k, f in (("low", F.min), ("high", F.max))]
    centre = F.array(*[F.avg(F.get("_at", i)) for i in range(3)])
    d = d.groupBy("face").agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_at"))), lambda v: v["_at"]).alias("_v"), centre.alias("_m"), *edge)
    after = lambda i: F.get("_v", F.pmod(i + 1, F.size("_v")))
    fan = lambda turned: F.transform("_v", lambda v, i: F.struct(F.col("_m").alias("a"), (after(i) if turned else v).alias("b"), (v if turned else after(i)).alias("c")))
    d = d.join(faces.select("face", "left", "right"), "face")
    sides = F.array(F.struct(F.col("left").alias("cell"), fan(False).alias("_t")), F.struct(F.col("right").alias("cell"), fan(True).alias("_t")))
    names = [f"{k}{c}" for c in XYZ for k in ("low", "high")]
    d = d.select(*names, F.inline(sides)).filter("cell > 0")
    return d.groupBy("cell").agg(*[(F.min if n.startswith("low") else F.max)(n).alias(n) for n in names], F.flatten(F.collect_list("_t")).alias("shell"))


def solid_angle(shell: Column, at: Sequence[Column], tolerance: float = 0.0) -> Column:
    """The signed solid angle of a shell seen from a point: 4 pi from inside a closed outward one, 0 from outside.

    Triangles whose plane is within tolerance of the point give none, so a point on the surface sees part of 4 pi.
    """

    def one(total: Column, t: Column) -> Column:
        u, v, w = ([t[k][i] - at[i] for i in range(3)] for k in "abc")
        cross = [v[1] * w[2] - v[2] * w[1], v[2] * w[0] - v[0] * w[2], v[0] * w[1] - v[1] * w[0]]
        volume = _dot(u, cross)
        p, q = ([y[i] - x[i] for i in range(3)] for x, y in ((u, v), (u, w)))
        normal = [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
        a, b, c = (F.sqrt(_dot(x, x)) for x in (u, v, w))
        angle = 2 * F.atan2(volume, a * b * c + _dot(u, v) * c + _dot(v, w) * a + _dot(w, u) * b)
        return total + F.when(F.abs(volume) <= F.sqrt(_dot(normal, normal)) * F.lit(tolerance) + 1e-300, 0.0).otherwise(angle)

    return F.aggregate(shell, F.lit(0.0), one)


def locate_any(targets: DataFrame, faces: DataFrame, vertices: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(target, cell): the cell, convex or not, with flat or warped faces, that holds each point; the least of several, -1 where none does.

    A point within tolerance of a cell's surface counts as inside.  Cells are closed: every edge is in two of their faces.
    Targets are taken to be distinct; one with a null or NaN coordinate is in no cell.
    """
    cells = cell_shells(faces, vertices)
    near = spatial.box_candidates(targets, cells, "target", "cell", tolerance)
    near = near.join(targets.select("target", *XYZ), "target").join(cells.select("cell", "shell"), "cell")
    # Less than any corner of a cell shows from its tip, more than the rounding of a shell seen from outside.
    found = near.filter(solid_angle(F.col("shell"), [F.col(c) for c in XYZ], tolerance) > 1e-3).groupBy("target").agg(F.min("cell").alias("cell"))
    return targets.select("target").join(found, "target", "left").select("target", F.coalesce("cell", F.lit(-1)).alias("cell"))


def source_of(targets: DataFrame, centres: DataFrame, faces: DataFrame | None, vertices: DataFrame | None, strategy: str = "Closest", tolerance: float = 1e-6) -> DataFrame:
    """(target, cell): the source of each target.  Closest: the nearest centre; Location: the holding cell, null if none; LocationAndClosest: the nearest centre for the rest."""
    nearest = lambda t: spatial.closest_point(centres, t, list(XYZ), "cell", "target").select("target", "cell")
    if strategy == "Closest":
        return nearest(targets)
    found = locate(targets, faces, vertices, tolerance)
    if strategy == "Location":
        return found.select("target", F.when(F.col("cell") > 0, F.col("cell")).alias("cell"))
    if strategy != "LocationAndClosest":
        raise ValueError(f"unknown strategy: {strategy}")
    rest = targets.join(found.filter("cell < 0"), "target", "left_semi")
    return found.filter("cell > 0").unionByName(nearest(rest))


def interpolate(mapping: DataFrame, field: DataFrame, values: Sequence[str]) -> DataFrame:
    """(target, values): each target takes its source's values, NaN without a source."""
    d = mapping.join(field.select("cell", *values).hint("merge"), "cell", "left")  # as many rows as the mesh has cells
    return d.select("target", *[F.coalesce(v, F.lit(float("nan"))).alias(v) for v in values])


def _moved(links: DataFrame, field: DataFrame, a: str, b: str, values: Sequence[str], power: float) -> DataFrame:
    d2 = sum(((F.col(f"_a{c}") - F.col(f"_b{c}")) ** 2 for c in "yz"), (F.col("_ax") - F.col("_bx")) ** 2)
    d = links.withColumn("_w", 1 / F.greatest(d2 ** (power / 2), F.lit(1e-20))).join(field.select(a, *values).hint("merge"), a)  # as many rows as the mesh has
    return d.groupBy(b).agg(*[(F.sum(F.col(v) * F.col("_w")) / F.sum("_w")).alias(v) for v in values])


def _links(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """Each vertex of each cell with the places of both."""
    d = cells.select("cell", F.explode("vtx").alias("vertex")).join(vertices.select("vertex", *[F.col(c).alias(f"_v{c}") for c in XYZ]), "vertex")
    centres = d.groupBy("cell").agg(*[F.avg(f"_v{c}").alias(f"_c{c}") for c in XYZ])
    return d.join(centres, "cell")


def centres_to_vertices(cells: DataFrame, vertices: DataFrame, field: DataFrame, values: Sequence[str], power: float = 1.0) -> DataFrame:
    """(vertex, values): means over the cells around each vertex, weighted by 1 / distance ** power."""
    d = _links(cells, vertices)
    d = d.select("cell", "vertex", *[F.col(f"_c{c}").alias(f"_a{c}") for c in XYZ], *[F.col(f"_v{c}").alias(f"_b{c}") for c in XYZ])
    return _moved(d, field, "cell", "vertex", values, power)


def vertices_to_centres(cells: DataFrame, vertices: DataFrame, field: DataFrame, values: Sequence[str], power: float = 1.0) -> DataFrame:
    """(cell, values): means over the vertices of each cell, weighted likewise."""
    d = _links(cells, vertices)
    d = d.select("cell", "vertex", *[F.col(f"_v{c}").alias(f"_a{c}") for c in XYZ], *[F.col(f"_c{c}").alias(f"_b{c}") for c in XYZ])
    return _moved(d, field, "vertex", "cell", values, power)
