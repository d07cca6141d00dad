"""Queries of generators, partitioning, transfer, element forms, surfaces and interpolation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import convert, generators, interpolation, partition, surfaces, transfer, zones
from .catalog import _POINTS, _TARGETS, _points, query, table
from .meshes import _CELLS, _FACES, _VERTICES, cells, faces, joined, vertices

N = (6, 5, 4)
_SPLIT = "CASE WHEN rn - 0.5 >= n * 0.75 THEN 2 WHEN rn - 0.5 >= n * 0.25 THEN 1 ELSE 0 END"
_PARTS = f"SELECT cell, part, row_number() OVER (PARTITION BY part ORDER BY cell) AS lnum FROM (SELECT cell, {_SPLIT} AS part FROM (SELECT p_partkey + 1 AS cell, row_number() OVER (ORDER BY p_partkey) AS rn, count(*) OVER () AS n FROM part))"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.by_number(cells(spark, sf_dir).select("cell"), [1, 2, 1])


@query("SELECT 1 + i + 6 * j + 30 * k AS vertex, round(i * 0.2, 9) AS x, round(1 + j * 0.5, 9) AS y, round(2 + k / 3, 9) AS z FROM range(0, 6) a(i), range(0, 5) b(j), range(0, 4) c(k)")
def cartesian_points(spark, sf_dir):
    d = generators.cartesian_points(spark, N, (0, 1, 2), (1, 3, 3))
    return d.select("vertex", *[F.round(c, 9).alias(c) for c in "xyz"])


@query(
    """WITH c AS (SELECT 1 + i + 5 * j + 20 * k AS cell, 1 + i + 6 * j + 30 * k AS u FROM range(0, 5) a(i), range(0, 4) b(j), range(0, 3) c(k))
    SELECT cell, concat_ws(',', u, u + 1, u + 7, u + 6, u + 30, u + 31, u + 37, u + 36) AS vtx FROM c"""
)
def cube_cells(spark, sf_dir):
    return generators.cube_cells(spark, N).select("cell", joined("vtx"))


@query(
    """WITH c AS (SELECT 1 + i + 5 * j + 20 * k AS cell, 1 + i + 6 * j + 30 * k AS u FROM range(0, 5) a(i), range(0, 4) b(j), range(0, 3) c(k)), v AS (SELECT cell, [u, u + 1, u + 7, u + 6, u + 30, u + 31, u + 37, u + 36] AS v FROM c),
    s AS (SELECT cell, unnest([[v[1], v[4], v[3], v[2]], [v[1], v[2], v[6], v[5]], [v[2], v[3], v[7], v[6]], [v[3], v[4], v[8], v[7]], [v[1], v[5], v[8], v[4]], [v[5], v[6], v[7], v[8]]]) AS q FROM v)
    SELECT array_to_string(list_sort(q), ',') AS vtx, min(cell) AS "left", CASE WHEN count(*) > 1 THEN max(cell) ELSE 0 END AS "right" FROM s GROUP BY list_sort(q)"""
)
def cube_faces(spark, sf_dir):
    return generators.cube_faces(spark, N).select(F.array_join(F.array_sort("vtx").cast("array<string>"), ",").alias("vtx"), "left", "right")


@query(_PARTS)
def partition_by_number(spark, sf_dir):
    return parts(spark, sf_dir).withColumn("part", F.col("part").cast("long"))


@query(
    f"""SELECT vertex, part, row_number() OVER (PARTITION BY part ORDER BY vertex) AS lnum FROM (SELECT DISTINCT unnest(v) AS vertex, part FROM ({_CELLS}) JOIN ({_PARTS}) USING (cell))"""
)
def part_vertices(spark, sf_dir):
    d = partition.entity_parts(cells(spark, sf_dir), parts(spark, sf_dir))
    return d.select(F.col("vtx").alias("vertex"), F.col("part").cast("long").alias("part"), "lnum")


@query(
    f"""WITH p AS ({_PARTS}), f AS (SELECT face, a.part AS pa, a.lnum AS la, b.part AS pb, b.lnum AS lb FROM ({_FACES}) JOIN p a ON l = a.cell JOIN p b ON r = b.cell WHERE a.part <> b.part)
    SELECT face, pa AS part, la AS cell_lnum, pb AS donor_part, lb AS donor_lnum FROM f UNION ALL SELECT face, pb, lb, pa, la FROM f"""
)
def part_interfaces(spark, sf_dir):
    d = partition.interfaces(faces(spark, sf_dir), parts(spark, sf_dir))
    return d.select("face", "cell_lnum", "donor_lnum", *[F.col(c).cast("long").alias(c) for c in ("part", "donor_part")])


@query(
    """WITH c AS (SELECT p_partkey + 1 AS cell, p_partkey % 10 AS i, p_partkey // 10 % 10 AS j, p_partkey // 100 AS k, (SELECT max(p_partkey) // 200 + 1 FROM part) AS h FROM part)
    SELECT cell, CASE WHEN k >= h THEN 2 WHEN i < 5 THEN 0 ELSE 1 END + 0 AS part, CASE WHEN k >= h THEN 1 + i + 10 * j + 100 * (k - h) ELSE 1 + i % 5 + 5 * j + 50 * k END AS lnum FROM c"""
)
def partition_by_box(spark, sf_dir):
    # A block of all parts; boxes: the lower half in k cut across i, the upper half whole.
    c = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("cell"))
    half = (c.agg(F.max("cell")).first()[0] - 1) // 200 + 1
    boxes = [((0, 5), (0, 10), (0, half)), ((5, 10), (0, 10), (0, half)), ((0, 10), (0, 10), (half, 2 * half))]
    return partition.in_boxes(c, (10, 10, 2 * half), boxes).withColumn("part", F.col("part").cast("long"))


@query(
    """WITH c AS (SELECT p_partkey + 1 AS cell, p_partkey % 2 AS i, p_partkey // 2 % 3 AS j, p_partkey // 6 AS k, (SELECT max(p_partkey) // 6 + 1 FROM part) AS n FROM part),
    a AS (SELECT *, round_even(n / 4.0, 0)::BIGINT AS low FROM c), b AS (SELECT *, low + round_even((n - low) * 2 / 3.0, 0)::BIGINT AS high FROM a)
    SELECT cell, CASE WHEN k < low THEN 0 WHEN k < high THEN 1 ELSE 2 END::BIGINT AS part, 1 + i + 2 * j + 6 * (k - CASE WHEN k < low THEN 0 WHEN k < high THEN low ELSE high END) AS lnum FROM b"""
)
def partition_block(spark, sf_dir):
    # All parts as a block whose last side grows with the table, in slabs of 1, 2 and 1 quarters.
    c = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("cell"))
    dims = (2, 3, (c.agg(F.max("cell")).first()[0] + 5) // 6)
    return partition.in_boxes(c, dims, partition.split_block(dims, (1, 2, 1))).withColumn("part", F.col("part").cast("long"))


@query(f"SELECT vertex, x, y, z FROM ({_VERTICES})")
def recover_vertices(spark, sf_dir):
    part_map = partition.entity_parts(cells(spark, sf_dir), parts(spark, sf_dir)).withColumnRenamed("vtx", "vertex")
    d = transfer.vertices_to_parts(vertices(spark, sf_dir), part_map)
    return partition.recover(d, "vertex", ["x", "y", "z"])


def _fields(spark, sf_dir):
    c = table(spark, sf_dir, "part")
    row = lambda label, container, name, value: F.struct(F.lit(label).alias("label"), F.lit(container).alias("container"), F.lit(name).alias("name"), value.cast("double").alias("value"))
    f = F.explode(F.array(row("FlowSolution_t", "Flow", "size", F.col("p_size")), row("FlowSolution_t", "Flow", "price", F.col("p_retailprice")), row("DiscreteData_t", "Extra", "size", -F.col("p_size"))))
    return c.select(F.lit("Zone").alias("zone"), F.lit("CellCenter").alias("location"), (F.col("p_partkey") + 1).alias("gnum"), f.alias("f")).select("zone", "location", "gnum", "f.*")


@query(
    f"""SELECT part, lnum, label, name, value FROM (SELECT p_partkey + 1 AS cell, 'FlowSolution_t' AS label, 'size' AS name, p_size::DOUBLE AS value FROM part
    UNION ALL SELECT p_partkey + 1, 'DiscreteData_t', 'size', -p_size::DOUBLE FROM part) JOIN ({_PARTS}) USING (cell)"""
)
def fields_to_parts(spark, sf_dir):
    m = parts(spark, sf_dir).select(F.lit("Zone").alias("zone"), F.lit("CellCenter").alias("location"), F.col("cell").alias("gnum"), F.col("part").cast("long").alias("part"), "lnum")
    d = transfer.to_parts(_fields(spark, sf_dir), m, include={"FlowSolution_t": ["Flow/si*"], "DiscreteData_t": ["*"]})
    return d.select("part", "lnum", "label", "name", "value")


@query(f"SELECT v.vertex, sum(p_size)::BIGINT AS total FROM (SELECT cell, unnest(v) AS vertex FROM ({_CELLS})) v JOIN part ON p_partkey + 1 = cell GROUP BY 1")
def fields_from_parts(spark, sf_dir):
    d = cells(spark, sf_dir).join(table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("cell"), F.col("p_size").alias("value")), "cell")
    d = d.select(F.lit("Zone").alias("zone"), F.lit("FlowSolution_t").alias("label"), F.lit("Flow").alias("container"), F.lit("Vertex").alias("location"), F.explode("vtx").alias("gnum"), F.lit("size").alias("name"), "value")
    return transfer.from_parts(d, "sum").select(F.col("gnum").alias("vertex"), F.col("value").alias("total"))


def _elements(spark, sf_dir):
    v = F.col("vtx")
    some = F.when(F.col("cell") % 3 == 0, F.struct(F.lit("TRI_3").alias("kind"), F.slice(v, 1, 3).alias("vtx"))).otherwise(F.struct(F.lit("HEXA_8").alias("kind"), v.alias("vtx")))
    return cells(spark, sf_dir).select(F.col("cell").alias("element"), some.alias("e")).select("element", "e.*")


@query(
    f"""SELECT cell AS element, coalesce(sum(CASE WHEN cell % 3 = 0 THEN 4 ELSE 9 END) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
    CASE WHEN cell % 3 = 0 THEN concat_ws(',', 5, v[1], v[2], v[3]) ELSE '17,' || array_to_string(v, ',') END AS connectivity FROM ({_CELLS})"""
)
def elements_to_mixed(spark, sf_dir):
    return convert.to_mixed(_elements(spark, sf_dir)).select("element", "start", joined("connectivity"))


@query(f"SELECT cell AS element, CASE WHEN cell % 3 = 0 THEN 'TRI_3' ELSE 'HEXA_8' END AS kind, row_number() OVER (ORDER BY (cell % 3 <> 0)::INT, cell) AS number FROM ({_CELLS})")
def element_sections(spark, sf_dir):
    return convert.sections(convert.from_mixed(convert.to_mixed(_elements(spark, sf_dir)))).select("element", "kind", "number")


@query(f"SELECT cell, 'HEXA_8' AS kind, array_to_string(list_sort(v), ',') AS vtx FROM ({_CELLS})")
def polyhedra_to_elements(spark, sf_dir):
    d = convert.polyhedra_to_elements(faces(spark, sf_dir))
    return d.select("cell", "kind", F.array_join(F.array_sort("vtx").cast("array<string>"), ",").alias("vtx"))


@query("SELECT p_brand AS label, p_name AS path, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS id FROM (SELECT DISTINCT p_brand, p_name FROM part)")
def registry(spark, sf_dir):
    return convert.registry(table(spark, sf_dir, "part").select(F.col("p_brand").alias("label"), F.col("p_name").alias("path")))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS number FROM part WHERE p_size % 4 <> 0")
def remove_ghosts(spark, sf_dir):
    return convert.without_ghosts(table(spark, sf_dir, "part"), "p_partkey", F.col("p_size") % 4 != 0, ["p_partkey"])


_AROUND = f"SELECT cell, vertex, p_size, x, y, z, avg(x) OVER c AS cx, avg(y) OVER c AS cy, avg(z) OVER c AS cz FROM (SELECT cell, unnest(v) AS vertex FROM ({_CELLS})) JOIN ({_VERTICES}) USING (vertex) JOIN part ON p_partkey + 1 = cell WINDOW c AS (PARTITION BY cell)"


@query(f"SELECT vertex, round(sum(p_size / ((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)) / sum(1 / ((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)), 6) AS size FROM ({_AROUND}) GROUP BY vertex")
def centres_to_vertices(spark, sf_dir):
    field = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("cell"), F.col("p_size").alias("size"))
    return interpolation.centres_to_vertices(cells(spark, sf_dir), vertices(spark, sf_dir), field, ["size"], 2).withColumn("size", F.round("size", 6))


@query(f"SELECT cell, round(avg(x + 2 * y + 3 * z), 6) AS f FROM ({_AROUND}) GROUP BY cell")
def vertices_to_centres(spark, sf_dir):
    v = vertices(spark, sf_dir)
    d = interpolation.vertices_to_centres(cells(spark, sf_dir), v, v.select("vertex", F.expr("x + 2 * y + 3 * z").alias("f")), ["f"])
    return d.withColumn("f", F.round("f", 6))


_AT = "(s_suppkey * 613 % 997) / 997 * 6 AS x, (s_suppkey * 389 % 991) / 991 * 8 AS y, (s_suppkey * 211 % 983) / 983 * 10 AS z"


@query(
    f"""SELECT s_suppkey AS target, coalesce(p_partkey + 1, -1) AS cell FROM (SELECT s_suppkey, {_AT} FROM supplier)
    LEFT JOIN part ON x < 5 AND y < 7 AND p_partkey = floor(x) + 5 * floor(y) + 35 * floor(z)"""
)
def locate_points(spark, sf_dir):
    s = F.col("s_suppkey")
    at = [(s * a % b / F.lit(b) * c).alias(n) for n, a, b, c in (("x", 613, 997, 6), ("y", 389, 991, 8), ("z", 211, 983, 10))]
    t = table(spark, sf_dir, "supplier").select(s.alias("target"), *at)
    return interpolation.locate(t, faces(spark, sf_dir), vertices(spark, sf_dir), 0.0)


@query(f"SELECT cell, round(0.5 * sqrt(2), 9) * 2 AS area FROM ({_CELLS}) WHERE (cell - 1) % 5 = (cell - 1) // 5 % 7")
def plane_slice(spark, sf_dir):
    # The plane x = y + 0.00001 cuts the cells on the diagonal, nearly along it.
    points, polygons = surfaces.level_surface(surfaces.tetrahedra(cells(spark, sf_dir), "HEXA_8"), vertices(spark, sf_dir), surfaces.plane((1, -1, 0), 1e-12))
    d = surfaces.polygon_areas(polygons, points)
    return d.filter("area > 1e-6").select("cell", (F.round(F.col("area") / 2, 9) * 2).alias("area"))


@query(f"SELECT id AS face, arg_min(t, (d2, t)) AS donor_face FROM (SELECT id, t, (p.x + 3 - q.x) ** 2 + (p.y - 2 - q.y) ** 2 AS d2 FROM ({_POINTS}) p JOIN ({_TARGETS}) q ON (p.x + 3 - q.x) ** 2 + (p.y - 2 - q.y) ** 2 <= 900) GROUP BY id")
def match_faces(spark, sf_dir):
    a, b = _points(spark, sf_dir)
    as_face = lambda d, c: d.select(F.col(c).alias("face"), "x", "y", F.lit(0.0).alias("z"))
    return zones.match_faces(as_face(a, "id"), as_face(b, "t"), 30.0, shift=(3, -2, 0))


@query("SELECT count(*) AS n_cells, 11 * 5 * 4 AS n_vertices, 11 * 4 * 3 + 10 * 5 * 3 + 10 * 4 * 4 AS n_faces FROM range(0, 120)")
def merge_zones(spark, sf_dir):
    zone = lambda d, z: d.withColumn("zone", F.lit(z))
    two = lambda d, e=None: zone(d, "A").unionByName(zone(d if e is None else e, "B"))
    v, f, side = generators.cube_vertices(spark, N), generators.cube_faces(spark, N), generators.cube_boundaries(spark, N)
    plane = lambda s: side.filter(F.col("name") == s).select("element")
    first = f.select(F.col("face").alias("element"), F.explode("vtx").alias("vertex")).join(v, "vertex").groupBy("element").agg(*[F.avg(c).alias(c) for c in "xyz"])
    centre = lambda s: first.join(plane(s), "element").withColumnRenamed("element", "face")
    pairs = zones.match_faces(centre("Xmax"), centre("Xmin"), 1e-6, shift=(-1, 0, 0))
    joins = pairs.select(F.lit("A").alias("zone"), "face", F.lit("B").alias("donor_zone"), "donor_face")
    ids, g, w = zones.merge(two(generators.cube_cells(spark, N).select("cell")), two(f), two(v, v.withColumn("x", F.col("x") + 1)), joins)
    counted = None
    for name, d in (("n_cells", ids), ("n_vertices", w), ("n_faces", g)):
        d = d.select(*[F.lit(int(name == n)).cast("long").alias(n) for n in ("n_cells", "n_vertices", "n_faces")])
        counted = d if counted is None else counted.unionByName(d)
    return counted.agg(*[F.sum(n).alias(n) for n in counted.columns])
