"""Queries of full trees dealt out, numbers over zones and sections, ranges of parts put together, and centres of blocks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction, full_trees, mesh, structured, transfer, trees, walls, zones
from .catalog import query, table
from .extracts import _DEALT, _W, _nation_windows
from .joins import boxes
from .meshes import _FACES, _VERTICES, BLOCK, faces, joined, vertices
from .more import _split
from .whole_trees import _TREE, whole_tree

PARTS = 7
_SIZES = f"""SELECT *, p * (items // {PARTS}) + least(p, items % {PARTS}) AS first, (p + 1) * (items // {PARTS}) + least(p + 1, items % {PARTS}) AS last
    FROM (SELECT path, CASE WHEN path LIKE '%StartOffset' THEN n - 1 WHEN path LIKE '%ElementConnectivity' THEN n // 4 WHEN path LIKE '%ParentElements' THEN n // 2 ELSE n END AS items FROM (SELECT path, count(*) AS n FROM ({_TREE}) GROUP BY path)), range(0, {PARTS}) r(p)"""


@query(
    f"""WITH t AS MATERIALIZED ({_TREE}), s AS ({_SIZES.replace(_TREE, 'FROM t').replace('(FROM t)', 't')})
    SELECT path, p AS part, pos - first AS pos, value FROM t JOIN s USING (path) WHERE path LIKE '%StartOffset' AND pos BETWEEN first AND last
    UNION ALL SELECT path, p, pos - 4 * first, value FROM t JOIN s USING (path) WHERE path LIKE '%ElementConnectivity' AND pos >= 4 * first AND pos < 4 * last
    UNION ALL SELECT path, p, pos % items - first + CASE WHEN pos >= items THEN last - first ELSE 0 END, value FROM t JOIN s USING (path) WHERE path LIKE '%ParentElements' AND pos % items >= first AND pos % items < last
    UNION ALL SELECT path, p, pos - first, value FROM t JOIN s USING (path) WHERE path NOT LIKE '%/NGon/%' AND pos >= first AND pos < last"""
)
def full_tree_dealt(spark, sf_dir):
    """All arrays of a zone in seven even shares: coordinates, fields, polygons with offsets and parents, a boundary with data."""
    d, _ = full_trees.distributed(whole_tree(spark, sf_dir)[1], PARTS)
    return d.withColumn("part", F.col("part").cast("long"))


@query(_TREE)
def full_tree_back(spark, sf_dir):
    return full_trees.whole(*full_trees.distributed(whole_tree(spark, sf_dir)[1], PARTS))


@query(
    """WITH v AS (SELECT s_nationkey AS zone, s_suppkey AS vertex, row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS id, CASE WHEN s_suppkey % 4 < 3 THEN s_suppkey // 4 ELSE -s_suppkey - 1 END AS tied FROM supplier),
    r AS (SELECT zone, vertex, min(id) OVER (PARTITION BY tied) AS root FROM v) SELECT zone, vertex, dense_rank() OVER (ORDER BY root) AS gnum FROM r"""
)
def shared_vertex_numbers(spark, sf_dir):
    """Suppliers as vertices of their nations; joins tie three of every four, also inside of a zone."""
    v = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("zone"), F.col("s_suppkey").alias("vertex"))
    far = v.select(F.col("zone").alias("donor_zone"), F.col("vertex").alias("donor_vertex"), (F.col("vertex") - 1).alias("_v"))
    pairs = v.filter("vertex % 4 < 2").join(far, F.col("vertex") == F.col("_v")).drop("_v")
    return zones.shared_vertex_numbers(v, pairs)


@query(
    """SELECT 'CellCenter' AS location, p_partkey AS n, p_partkey % 5 + 0.5 AS x, p_partkey // 5 % 7 + 0.5 AS y, p_partkey // 35 + 0.5 AS z FROM part
    UNION ALL SELECT 'IFaceCenter', p_partkey, p_partkey % 6, p_partkey // 6 % 7 + 0.5, p_partkey // 42 + 0.5 FROM part
    UNION ALL SELECT 'JFaceCenter', p_partkey, p_partkey % 5 + 0.5, p_partkey // 5 % 8, p_partkey // 40 + 0.5 FROM part"""
)
def block_centres(spark, sf_dir):
    """Cells and faces of a block; their numbers count the faces of the axes before."""
    from ..functions import index

    before = {"CellCenter": 0, "IFaceCenter": 0, "JFaceCenter": index.face_counts(BLOCK)[0]}
    v, out = vertices(spark, sf_dir), None
    for location, n in before.items():
        items = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1 + F.lit(n)).alias("gnum"))
        d = mesh.block_centres(items, v, BLOCK, location).select(F.lit(location).alias("location"), (F.col("gnum") - 1 - n).alias("n"), "x", "y", "z")
        out = d if out is None else out.unionByName(d)
    return out


@query(f"""SELECT zone, face, l AS "left", r AS "right" FROM ({_FACES}), (VALUES ('after'), ('local')) z(zone)""")
def local_parents(spark, sf_dir):
    """The same faces in two zones, whose cells are counted after the faces in one."""
    f = faces(spark, sf_dir).select("face", "left", "right")
    last = f.agg(F.max("face").alias("last"))
    n = last.first()["last"]
    after = f.select(F.lit("after").alias("zone"), "face", *[F.when(F.col(c) > 0, F.col(c) + n).otherwise(0).alias(c) for c in ("left", "right")])
    sections = last.select(F.explode(F.array(F.lit("after"), F.lit("local"))).alias("zone"), "last")
    return mesh.local_parents(after.unionByName(f.withColumn("zone", F.lit("local"))), sections)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.structured_pieces(_nation_windows(spark, sf_dir), boxes(spark, sf_dir)).drop("oi", "oj", "ok")


@query(f"SELECT zone, 'W' AS name, i0, i1, CASE WHEN odd = 1 THEN j1 ELSE j0 END AS j0, CASE WHEN odd = 1 THEN j0 ELSE j1 END AS j1, k0, k1 FROM {_W}")
def ranges_from_parts(spark, sf_dir):
    """Windows of zones from the pieces of their parts; j runs down in one part of the odd zones."""
    d = _pieces(spark, sf_dir)
    down = (F.col("zone") % 2 == 1) & (F.col("part") == F.min("part").over(_by_zone()))
    d = d.withColumns({"j0": F.when(down, F.col("j1")).otherwise(F.col("j0")), "j1": F.when(down, F.col("j0")).otherwise(F.col("j1"))})
    return structured.ranges_from_parts(d.withColumn("name", F.concat(F.lit("W.P"), F.col("part").cast("string"), F.lit(".P0"))), boxes(spark, sf_dir))


def _by_zone():
    from pyspark.sql import Window

    return Window.partitionBy("zone")  # five parts at most


@query(
    f"""WITH c AS ({_DEALT}), v AS (SELECT DISTINCT zone, part, CASE WHEN flat THEN wi0 ELSE i + a END AS i, j + b AS j, k + d AS k FROM c, range(0, 2) x(a), range(0, 2) y(b), range(0, 2) u(d))
    SELECT zone, part, row_number() OVER (PARTITION BY zone, part ORDER BY k, j, i) AS place, dense_rank() OVER (PARTITION BY zone ORDER BY k, j, i) AS gnum FROM v"""
)
def range_numbers(spark, sf_dir):
    """Vertices of all pieces with their places in the piece and their numbers in the window."""
    d = structured.range_numbers(_pieces(spark, sf_dir).withColumn("name", F.lit("W")), boxes(spark, sf_dir), _nation_windows(spark, sf_dir).withColumn("name", F.lit("W")))
    return d.select("zone", F.col("part").cast("long").alias("part"), "place", "gnum")


@query(f"SELECT face AS gnum, array_to_string(q, ',') AS vtx FROM ({_FACES})")
def elements_from_parts(spark, sf_dir):
    """Faces with local vertices, those between parts in both, put together."""
    f, _, v = _split(spark, sf_dir)
    e = f.select(F.lit("Z").alias("zone"), F.lit("Faces").alias("section"), "part", F.col("face").alias("gnum"), "vtx")
    return transfer.elements_from_parts(e, v.select(F.lit("Z").alias("zone"), "part", "lnum", F.col("vertex").alias("gnum"))).select("gnum", joined("vtx"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_size % 4 ORDER BY p_size, p_partkey) AS number FROM part")
def element_numbers(spark, sf_dir):
    """Parts as elements: a section for each size, zones of every fourth size."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("zone"), F.col("p_size").alias("section"))
    e = extraction._numbered(p, ["section"], "p_partkey", "gnum")
    sections = p.groupBy("zone", "section").agg(F.count("*").alias("size")).withColumn("ord", F.col("section"))
    return transfer.element_numbers(e, sections).select("p_partkey", "number")


@query(
    """SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 8 THEN 'missing_left' WHEN p_partkey % 10 = 9 THEN 'missing_right' ELSE 'changed' END AS status FROM part WHERE p_partkey % 10 >= 8 OR p_partkey % 3 <> 1"""
)
def text_differences(spark, sf_dir):
    """Arrays in text form with a tolerance: of three, one differs by more than it, one by less, and one in the number of values."""
    k, size = F.col("p_partkey"), F.col("p_size")
    d = table(spark, sf_dir, "part")
    a = d.filter(k % 10 != 8).select(k.alias("k"), F.lit("DataArray_t").alias("label"), F.format_string("[%d, %d]", k, size).alias("value"))
    other = F.when(k % 3 == 0, F.format_string("[%d, %d.5]", k, size)).when(k % 3 == 1, F.format_string("[%d, %d.1]", k, size)).otherwise(F.format_string("[%d, %d, 1]", k, size))
    b = d.filter(k % 10 != 9).select(k.alias("k"), F.lit("DataArray_t").alias("label"), other.alias("value"))
    return trees.diff_text(a, b, ["k"], 0.25)


@query(
    """WITH v AS (SELECT s_suppkey, s_acctbal AS x, s_suppkey % 7 AS y, s_nationkey AS z FROM supplier), a AS (SELECT *, y * cos(0.3) - z * sin(0.3) AS y1, y * sin(0.3) + z * cos(0.3) AS z1 FROM v)
    SELECT s_suppkey, round(x * cos(0.5) - y1 * sin(0.5), 6) AS x, round(x * sin(0.5) + y1 * cos(0.5), 6) AS y, round(z1, 6) AS z FROM a"""
)
def rotated_vectors(spark, sf_dir):
    """Vectors of three components turned about x, then z."""
    from ..functions import geometry

    turned = geometry.rotate_vector([F.col("s_acctbal"), (F.col("s_suppkey") % 7).cast("double"), F.col("s_nationkey").cast("double")], (0.3, 0.0, 0.5))
    return table(spark, sf_dir, "supplier").select("s_suppkey", *[F.round(c, 6).alias(n) for n, c in zip("xyz", turned)])


@query(
    f"""SELECT face, string_agg((vertex + n * 1000000000)::VARCHAR, ',' ORDER BY pos) AS vtx, round(sum(x + dx), 9) AS x, round(sum(z + dz), 9) AS z
    FROM (SELECT face, unnest(q) AS vertex, generate_subscripts(q, 1) AS pos FROM ({_FACES}) WHERE r = 0) JOIN ({_VERTICES}) USING (vertex), (VALUES (0, 0.0, 0.0), (1, 5.0, 0.0), (2, -5.0, 0.25)) m(n, dx, dz) GROUP BY face, n"""
)
def wall_images(spark, sf_dir):
    """Outer faces and two periodic images of them, by the sums of their corners."""
    v, f = walls.shifted_walls(vertices(spark, sf_dir), faces(spark, sf_dir).filter("right = 0"), [(5, 0, 0), (-5, 0, 0.25)], 1_000_000_000)
    at = f.select("face", "vtx", F.explode("vtx").alias("vertex")).join(v, "vertex").groupBy("face", "vtx").agg(F.round(F.sum("x"), 9).alias("x"), F.round(F.sum("z"), 9).alias("z"))
    return at.select("face", joined("vtx"), "x", "z")


@query(
    """WITH c AS (SELECT c_nationkey AS zone, c_custkey, 'BC' || c_custkey % 4 AS name, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS gnum FROM customer)
    SELECT CASE WHEN name IN ('BC0', 'BC1') THEN 'F' || zone % 2 ELSE name || '.' || zone END AS name, gnum FROM c"""
)
def merged_by_family(spark, sf_dir):
    """Customers as cells of their nations and items of four subsets, two of which have families, listed twice."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("zone"), F.col("c_custkey").alias("old"))
    ids = zones.global_ids(c, "old").withColumnRenamed("_id", "cell")
    items = c.select("zone", F.concat(F.lit("BC"), (F.col("old") % 4).cast("string")).alias("name"), F.col("old").alias("gnum"))
    families = items.filter("name in ('BC0', 'BC1')").select("zone", "name", F.concat(F.lit("F"), (F.col("zone") % 2).cast("string")).alias("family")).distinct()
    return zones.merge_subsets(items.unionByName(items), ids, "family", families=families)
