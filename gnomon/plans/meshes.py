"""Queries of the mesh operators: parts are the cells of a block of 5 x 7 x n, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mesh, spatial
from .catalog import _POINTS, _TARGETS, _points, query, table

BLOCK = (6, 8, 1 << 30)
_CELLS = "SELECT p_partkey + 1 AS cell, [u, u + 1, u + 7, u + 6, u + 48, u + 49, u + 55, u + 54] AS v FROM (SELECT p_partkey, 1 + p_partkey % 5 + 6 * (p_partkey // 5 % 7) + 48 * (p_partkey // 35) AS u FROM part)"
_SIDES = f"""SELECT cell, unnest([[v[1], v[4], v[3], v[2]], [v[1], v[2], v[6], v[5]], [v[2], v[3], v[7], v[6]], [v[3], v[4], v[8], v[7]], [v[1], v[5], v[8], v[4]], [v[5], v[6], v[7], v[8]]]) AS q
FROM ({_CELLS})"""
_FACES = f"""SELECT row_number() OVER (ORDER BY key) AS face, l, r, q FROM (SELECT list_sort(q) AS key, min(cell) AS l, CASE WHEN count(*) > 1 THEN max(cell) ELSE 0 END AS r, arg_min(q, cell) AS q
FROM ({_SIDES}) GROUP BY list_sort(q))"""
_XYZ = "SELECT vertex, ((vertex - 1) % 6)::DOUBLE AS x, ((vertex - 1) // 6 % 8)::DOUBLE AS y, ((vertex - 1) // 48)::DOUBLE AS z"
_VERTICES = f"{_XYZ} FROM (SELECT DISTINCT unnest(v) AS vertex FROM ({_CELLS}))"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins of cells, and of the vertices made of them, merge: one narrow column is all that Spark sees of their size, and it would collect millions of rows to broadcast them."""
    g = (F.col("p_partkey") + 1).alias("cell")
    return table(spark, sf_dir, "part").select(g).select("cell", mesh.block_vertices(F.col("cell"), BLOCK).alias("vtx")).hint("merge")


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.elements_to_faces(cells(spark, sf_dir), "HEXA_8")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vertex") - 1
    d = cells(spark, sf_dir).select(F.explode("vtx").alias("vertex")).distinct()
    at = (v % 6, F.floor(v / 6) % 8, F.floor(v / 48))
    return d.select("vertex", *[c.cast("double").alias(n) for n, c in zip("xyz", at)])


def joined(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query(f"SELECT cell, array_to_string(v, ',') AS vtx FROM ({_CELLS})")
def block_cell_vertices(spark, sf_dir):
    return cells(spark, sf_dir).select("cell", joined("vtx"))


@query(f"""SELECT face, l AS "left", r AS "right", array_to_string(q, ',') AS vtx FROM ({_FACES})""")
def elements_to_faces(spark, sf_dir):
    return faces(spark, sf_dir).select("face", "left", "right", joined("vtx"))


@query(f"""SELECT cell, string_agg(f::VARCHAR, ',' ORDER BY abs(f)) AS faces FROM (SELECT l AS cell, face AS f FROM ({_FACES}) UNION ALL SELECT r, -face FROM ({_FACES}) WHERE r > 0) GROUP BY cell""")
def parents_to_cells(spark, sf_dir):
    return mesh.parents_to_cells(faces(spark, sf_dir)).select("cell", joined("faces"))


@query(f"""SELECT face, l AS "left", r AS "right" FROM ({_FACES})""")
def cells_to_parents(spark, sf_dir):
    return mesh.cells_to_parents(mesh.parents_to_cells(faces(spark, sf_dir)))


@query(f"SELECT cell, array_to_string(list_sort(v), ',') AS vtx FROM ({_CELLS})")
def cell_vertices(spark, sf_dir):
    return mesh.cell_vertices(faces(spark, sf_dir)).select("cell", joined("vtx"))


@query(
    f"""WITH e AS (SELECT face, q[i] AS a, q[i % 4 + 1] AS b FROM ({_FACES}), range(1, 5) t(i)), v AS ({_VERTICES})
    SELECT face, sum(a.y * b.z - a.z * b.y) / 2 + 0.0 AS nx, sum(a.z * b.x - a.x * b.z) / 2 + 0.0 AS ny, sum(a.x * b.y - a.y * b.x) / 2 + 0.0 AS nz
    FROM e JOIN v a ON e.a = a.vertex JOIN v b ON e.b = b.vertex GROUP BY face"""
)
def face_normals(spark, sf_dir):
    d = mesh.face_normals(faces(spark, sf_dir), vertices(spark, sf_dir))
    return d.select("face", *[(F.col(c) + 0.0).alias(c) for c in ("nx", "ny", "nz")])  # no negative zeros


@query(
    f"""WITH k AS (SELECT cell, unnest(v) AS o, generate_subscripts(v, 1) AS pos FROM ({_CELLS}) JOIN part ON cell = p_partkey + 1 WHERE p_size > 25),
    n AS (SELECT o, row_number() OVER (ORDER BY o) AS g FROM (SELECT DISTINCT o FROM k)) SELECT cell, string_agg(g::VARCHAR, ',' ORDER BY pos) AS vtx FROM k JOIN n USING (o) GROUP BY cell"""
)
def extract_cells(spark, sf_dir):
    chosen = table(spark, sf_dir, "part").filter("p_size > 25").select((F.col("p_partkey") + 1).alias("cell"))
    return mesh.extract(cells(spark, sf_dir), chosen)[0].select("cell", joined("vtx"))


@query(f"SELECT c AS copy, vertex + c * 1000000000 AS vertex, x, y, z + c * 2.5 AS z FROM ({_VERTICES}), range(0, 4) t(c)")
def duplicate(spark, sf_dir):
    return mesh.duplicate(vertices(spark, sf_dir), 3, (0, 0, 2.5), 1_000_000_000)


@query(
    f"""WITH v AS (SELECT *, x * x + y * y - z AS f FROM ({_VERTICES})), e AS (SELECT DISTINCT least(q[i], q[i % 4 + 1]) AS a, greatest(q[i], q[i % 4 + 1]) AS b FROM ({_SIDES}), range(1, 5) t(i)),
    c AS (SELECT a, b, (4.5 - p.f) / (q.f - p.f) AS t, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz FROM e JOIN v p ON a = p.vertex JOIN v q ON b = q.vertex WHERE (p.f < 4.5) <> (q.f < 4.5))
    SELECT a, b, round(t, 9) AS t, round(px + t * (qx - px), 9) AS x, round(py + t * (qy - py), 9) AS y, round(pz + t * (qz - pz), 9) AS z FROM c"""
)
def level_points(spark, sf_dir):
    field = vertices(spark, sf_dir).withColumn("field", F.col("x") * F.col("x") + F.col("y") * F.col("y") - F.col("z"))
    d = mesh.level_points(mesh.edges(mesh.faces_of(cells(spark, sf_dir), "HEXA_8")), field, 4.5, ["x", "y", "z"])
    return d.select("a", "b", *[F.round(c, 9).alias(c) for c in ("t", "x", "y", "z")])


@query(f"SELECT t, id, (p.x - q.x) ** 2 + (p.y - q.y) ** 2 AS distance2 FROM ({_TARGETS}) q JOIN ({_POINTS}) p ON (p.x - q.x) ** 2 + (p.y - q.y) ** 2 <= 1600")
def match_points(spark, sf_dir):
    a, b = _points(spark, sf_dir)
    return mesh.within(a, b, ["x", "y"], 40.0, "id", "t")


@query(f"SELECT id, round(sqrt(min((p.x - q.x) ** 2 + (p.y - q.y) ** 2)), 9) AS distance FROM ({_POINTS}) p, ({_TARGETS}) q GROUP BY id")
def nearest_point_distance(spark, sf_dir):
    a, b = _points(spark, sf_dir)
    d = spatial.closest_point(b, a, ["x", "y"], "t", "id")
    return d.select("id", F.round(F.sqrt("distance2"), 9).alias("distance"))
