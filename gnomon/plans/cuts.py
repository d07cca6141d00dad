"""Queries of cut polyhedra and of location in cells that are not convex, on the block of all parts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import interpolation, surfaces
from ..storage import stored
from .catalog import query
from .forms import _AT
from .meshes import _FACES, _SIDES, _VERTICES, faces, vertices
from .more import targets

_RISE = (0.3, 0.2, 1.0)
_PLANE = "0.3 * x + 0.2 * y + z - 4.1234"
_BALL = "(x - 2.3) * (x - 2.3) + (y - 3.1) * (y - 3.1) + (z - 4.2) * (z - 4.2) - 6.7"


def _rings(field: str, u: str, v: str) -> str:
    """Points of each cell's polygon in order around their middle, as seen in the directions u and v, with the sums of cross products."""
    return f"""SELECT cell, count(*) AS n_points, sqrt(sum(cx) ** 2 + sum(cy) ** 2 + sum(cz) ** 2) / 2 AS area FROM (
    SELECT cell, y * nz - z * ny AS cx, z * nx - x * nz AS cy, x * ny - y * nx AS cz FROM (
    SELECT cell, x, y, z, coalesce(lead(x) OVER o, first_value(x) OVER o) AS nx, coalesce(lead(y) OVER o, first_value(y) OVER o) AS ny, coalesce(lead(z) OVER o, first_value(z) OVER o) AS nz FROM (
    SELECT *, atan2({v}, {u}) AS turn FROM (SELECT cell, x, y, z, x - avg(x) OVER c AS dx, y - avg(y) OVER c AS dy, z - avg(z) OVER c AS dz, avg(x) OVER c - 2.3 AS rx, avg(y) OVER c - 3.1 AS ry, avg(z) OVER c - 4.2 AS rz FROM (
    SELECT cell, p.x + t * (q.x - p.x) AS x, p.y + t * (q.y - p.y) AS y, p.z + t * (q.z - p.z) AS z FROM (
    SELECT cell, p, q, p.f / (p.f - q.f) AS t FROM (SELECT DISTINCT cell, least(q[i], q[i % 4 + 1]) AS a, greatest(q[i], q[i % 4 + 1]) AS b FROM ({_SIDES}), range(1, 5) t(i))
    JOIN (SELECT *, {field} AS f FROM ({_VERTICES})) p ON a = p.vertex JOIN (SELECT *, {field} AS f FROM ({_VERTICES})) q ON b = q.vertex WHERE (p.f < 0) <> (q.f < 0)))
    WINDOW c AS (PARTITION BY cell))) WINDOW o AS (PARTITION BY cell ORDER BY turn))) GROUP BY cell"""


def cut(spark: SparkSession, sf_dir: str, field) -> tuple[DataFrame, DataFrame]:
    points, segments = surfaces.cut_segments(faces(spark, sf_dir), vertices(spark, sf_dir), field)
    return stored(points, "cut-points"), stored(segments, "cut-segments")


def _polygons(spark, sf_dir, field):
    points, segments = cut(spark, sf_dir, field)
    return surfaces.ring_areas(surfaces.polygons(segments), points)


@query(f"SELECT cell, 0 AS ring, n_points::INT AS n_points, round(area, 9) AS area FROM ({_rings(_PLANE, '(dx - 0.3 * dz) / sqrt(1.09)', '(1.04 * dy - 0.06 * dx - 0.2 * dz) / sqrt(1.09 * 1.13)')})")
def plane_polygons(spark, sf_dir):
    """A tilted plane: one polygon of three to six corners for each cell that it cuts, with its area."""
    return _polygons(spark, sf_dir, surfaces.plane(_RISE, 4.1234)).select("cell", "ring", "n_points", F.round("area", 9).alias("area"))


@query(f"SELECT cell, 0 AS ring, n_points::INT AS n_points, round(area, 9) AS area FROM ({_rings(_BALL, '(dx * ry - dy * rx)', '(dz * (rx * rx + ry * ry) - rz * (dx * rx + dy * ry)) / sqrt(rx * rx + ry * ry + rz * rz)')})")
def sphere_polygons(spark, sf_dir):
    """A sphere of radius sqrt(6.7): vector areas of the polygons, which are not flat."""
    d = _polygons(spark, sf_dir, surfaces.ellipsoid((2.3, 3.1, 4.2), radius2=6.7))
    return d.select("cell", "ring", "n_points", F.round("area", 9).alias("area"))


@query(
    f"""WITH f AS (SELECT face, l AS cell, q FROM ({_FACES}) WHERE r = 0), v AS (SELECT *, {_PLANE} AS f FROM ({_VERTICES})),
    e AS (SELECT face, cell, i, q[i] AS a, q[i % 4 + 1] AS b FROM f, range(1, 5) t(i)),
    c AS (SELECT face, cell, p.f / (p.f - q.f) AS t, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz, q.f >= 0 AS up FROM e JOIN v p ON a = p.vertex JOIN v q ON b = q.vertex WHERE (p.f < 0) <> (q.f < 0)),
    s AS (SELECT face, cell, up, px + t * (qx - px) AS x, py + t * (qy - py) AS y, pz + t * (qz - pz) AS z FROM c),
    m AS (SELECT face, CASE WHEN max(x) = 0 THEN 'west' WHEN min(x) = 5 THEN 'east' END AS family FROM (SELECT face, unnest(q) AS vertex FROM f) JOIN v USING (vertex) GROUP BY face)
    SELECT u.face, u.cell, round(u.x, 9) AS x0, round(u.y, 9) AS y0, round(d.x, 9) AS x1, round(d.y, 9) AS y1, family FROM s u JOIN s d ON u.face = d.face AND u.up AND NOT d.up JOIN m ON m.face = u.face"""
)
def surface_boundary(spark, sf_dir):
    """Edges of the plane's polygons on outer faces, from where the field rises, with the family of the face."""
    points, segments = cut(spark, sf_dir, surfaces.plane(_RISE, 4.1234))
    f, v = faces(spark, sf_dir), vertices(spark, sf_dir)
    x = f.filter("right = 0").select("face", F.explode("vtx").alias("vertex")).join(v, "vertex").groupBy("face").agg(F.max("x").alias("hi"), F.min("x").alias("lo"))
    families = x.select("face", F.when(F.col("hi") == 0, "west").when(F.col("lo") == 5, "east").alias("family"))
    at = lambda k, n: points.select(F.col("point").alias(k), *[F.round(c, 9).alias(f"{c}{n}") for c in "xy"])
    return surfaces.boundary_edges(segments, families).join(at("start", 0), "start").join(at("stop", 1), "stop").select("face", "cell", "x0", "y0", "x1", "y1", "family")


def _group(cell: str, sql: bool = True) -> str:
    """Cells of a layer in squares of two by two: three make an L, which takes the number of its first, the fourth stays alone; what is cut off at the sides goes along."""
    i, j = (f"({cell} - 1) % 5", f"({cell} - 1) // 5 % 7") if sql else (f"({cell} - 1) % 5", f"({cell} - 1) div 5 % 7")
    return f"CASE WHEN {i} % 2 = 1 AND {j} % 2 = 1 THEN {cell} ELSE {cell} - {i} % 2 - 5 * ({j} % 2) END"


_INSIDE = "x < 5 AND y < 7 AND p_partkey = floor(x) + 5 * floor(y) + 35 * floor(z)"


@query(f"SELECT target, coalesce({_group('(p_partkey + 1)')}, -1) AS cell FROM (SELECT s_suppkey AS target, {_AT} FROM supplier) LEFT JOIN part ON {_INSIDE}")
def locate_in_shapes(spark, sf_dir):
    """Cells in the form of an L: their faces are those between two of them."""
    f = faces(spark, sf_dir)
    shaped = lambda c: F.expr(f"if({c} = 0, 0, {_group(c, False)})").cast("long").alias(c)
    f = f.select("face", shaped("left"), shaped("right"), "vtx").filter("left <> right")
    return interpolation.locate_any(targets(spark, sf_dir), f, vertices(spark, sf_dir))
