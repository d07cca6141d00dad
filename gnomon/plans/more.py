"""Queries of walls, subsets, numbering forms, partitions, interpolation, surfaces, sources and generators, each with its SQL."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import index, sequences
from ..operators import convert, exchange, generators, interpolation, mesh, numbering, partition, spatial, subsets, surfaces, transfer, trees, walls, zones
from ..sources import store, tables, tree_text
from ..storage import fresh_path
from .catalog import _POINTS, _points, query, table
from .forms import _AT, _PARTS, parts
from .inspection import _ARRAYS, _N, _S, arrays, listed, tree
from .meshes import _CELLS, _FACES, _VERTICES, cells, faces, joined, vertices

_T = f"(SELECT s_suppkey AS target, {_AT} FROM supplier)"


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    at = [(s * a % b / F.lit(b) * c).alias(n) for n, a, b, c in (("x", 613, 997, 6), ("y", 389, 991, 8), ("z", 211, 983, 10))]
    return table(spark, sf_dir, "supplier").select(s.alias("target"), *at)


_WALL = f"SELECT face, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM (SELECT face, unnest(q) AS vertex FROM ({_FACES})) JOIN ({_VERTICES}) USING (vertex) GROUP BY face HAVING max(x) = 0"


@query(
    f"""SELECT target, round(min(sqrt(x * x + greatest(y0 - y, y - y1, 0) ** 2 + greatest(z0 - z, z - z1, 0) ** 2)), 9) AS distance FROM {_T}, ({_WALL}) GROUP BY target"""
)
def wall_distance(spark, sf_dir):
    v, f = vertices(spark, sf_dir), faces(spark, sf_dir)
    off = f.select("face", F.explode("vtx").alias("vertex")).join(v.filter("x <> 0"), "vertex").select("face")
    d = walls.distance_to_faces(targets(spark, sf_dir), f.join(off, "face", "left_anti"), v)
    return d.select("target", F.round("distance", 9).alias("distance"))


_ITEMS = f"SELECT face AS gnum, CASE WHEN p_size > 25 THEN 'A' || p_size % 2 ELSE 'B' END AS name, p_size FROM ({_FACES}) JOIN part ON l = p_partkey + 1 WHERE r = 0"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("left"), "p_size")
    d = faces(spark, sf_dir).filter("right = 0").join(p, "left")
    return d.select(F.lit("Z").alias("zone"), F.col("face").alias("gnum"), F.when(F.col("p_size") > 25, F.concat(F.lit("A"), (F.col("p_size") % 2).cast("string"))).otherwise("B").alias("name"), "p_size")


@query(
    f"""WITH k AS (SELECT face AS old, q, p_size FROM ({_FACES}) JOIN ({_ITEMS}) ON face = gnum WHERE name LIKE 'A%'), f AS (SELECT *, row_number() OVER (ORDER BY old) AS face FROM k),
    v AS (SELECT o, row_number() OVER (ORDER BY o) AS n FROM (SELECT DISTINCT unnest(q) AS o FROM k)), e AS (SELECT face, old, p_size, unnest(q) AS o, generate_subscripts(q, 1) AS pos FROM f)
    SELECT face, old, string_agg(n::VARCHAR, ',' ORDER BY pos) AS vtx, any_value(p_size) AS size FROM e JOIN v USING (o) GROUP BY face, old"""
)
def extract_family(spark, sf_dir):
    i = items(spark, sf_dir)
    families = i.select("name").distinct().withColumn("family", F.when(F.col("name").startswith("A"), "WALL").otherwise("FAR"))
    f, _ = subsets.extract_faces(faces(spark, sf_dir), vertices(spark, sf_dir), subsets.named_items(i, families=families, family="WALL"))
    size = subsets.carried(f, i.select("gnum", F.col("p_size").alias("size")), "face", "gnum", ["size"])
    return f.join(size, "face").select("face", "old", joined("vtx"), "size")


@query(f"SELECT row_number() OVER (ORDER BY v.vertex) AS vertex, v.vertex AS old, x, y, z FROM ({_VERTICES}) v JOIN (SELECT DISTINCT unnest(q) AS vertex FROM ({_FACES}) JOIN ({_ITEMS}) ON face = gnum WHERE name = 'B') USING (vertex)")
def extract_boundary(spark, sf_dir):
    return subsets.extract_faces(faces(spark, sf_dir), vertices(spark, sf_dir), subsets.named_items(items(spark, sf_dir), ["B"]))[1]


@query(f"SELECT 'Z' AS zone, name, gnum, row_number() OVER (PARTITION BY name ORDER BY gnum) AS place FROM ({_ITEMS})")
def subset_numbers(spark, sf_dir):
    return subsets.item_numbers(items(spark, sf_dir))


_FACE_PARTS = f"SELECT face, part, row_number() OVER (PARTITION BY part ORDER BY face) AS lnum FROM (SELECT DISTINCT face, part FROM ({_FACES}) JOIN ({_PARTS}) ON cell = l OR cell = r)"


def face_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mesh.parents_to_cells(faces(spark, sf_dir)).select("cell", "faces")
    m = partition.entity_parts(d, parts(spark, sf_dir), "faces")
    return m.select(F.lit("Z").alias("zone"), F.lit("FaceCenter").alias("location"), F.col("faces").alias("gnum"), F.col("part").cast("long").alias("part"), "lnum")


@query(f"SELECT 'Z' AS zone, 'FaceCenter' AS location, name, part, lnum, gnum FROM ({_ITEMS}) JOIN ({_FACE_PARTS}) ON gnum = face")
def subset_to_parts(spark, sf_dir):
    i = items(spark, sf_dir).withColumn("location", F.lit("FaceCenter")).drop("p_size")
    return transfer.subset_to_parts(i, face_map(spark, sf_dir))


@query(f"SELECT 'Z' AS zone, 'FaceCenter' AS location, name, gnum FROM ({_ITEMS})")
def subset_from_parts(spark, sf_dir):
    i = items(spark, sf_dir).withColumn("location", F.lit("FaceCenter")).drop("p_size")
    return transfer.subset_from_parts(transfer.subset_to_parts(i, face_map(spark, sf_dir)))


@query(f"SELECT name, part, lnum, row_number() OVER (PARTITION BY name, part ORDER BY gnum) AS n, p_size AS size FROM ({_ITEMS}) JOIN ({_FACE_PARTS}) ON gnum = face")
def data_to_parts(spark, sf_dir):
    i = items(spark, sf_dir)
    numbers = subsets.item_numbers(i)
    data = i.join(numbers, ["zone", "name", "gnum"]).select("zone", "name", "place", F.col("p_size").alias("size"))
    d = subsets.data_to_parts(data, numbers, face_map(spark, sf_dir), ["size"])
    return partition.local_numbers(d.withColumn("_p", F.concat("name", F.lit("/"), "part")), ["place"], "_p", "n").select("name", "part", "lnum", "n", "size")


@query(f"SELECT 'Z' AS zone, name, row_number() OVER (PARTITION BY name ORDER BY gnum) AS place, p_size AS size FROM ({_ITEMS})")
def data_from_parts(spark, sf_dir):
    i = items(spark, sf_dir)
    numbers = subsets.item_numbers(i)
    data = i.join(numbers, ["zone", "name", "gnum"]).select("zone", "name", "place", F.col("p_size").alias("size"))
    return subsets.data_from_parts(subsets.data_to_parts(data, numbers, face_map(spark, sf_dir), ["size"]), ["size"])


def _split(spark, sf_dir):
    p = parts(spark, sf_dir)
    v = partition.entity_parts(cells(spark, sf_dir), p).withColumnRenamed("vtx", "vertex")
    return subsets.faces_to_parts(faces(spark, sf_dir), p, v), p, v


@query(
    f"""WITH p AS ({_PARTS}), f AS (SELECT DISTINCT face, part, l, r, q FROM ({_FACES}) JOIN p ON cell = l OR cell = r),
    v AS (SELECT vertex, part, row_number() OVER (PARTITION BY part ORDER BY vertex) AS n FROM (SELECT DISTINCT unnest(v) AS vertex, part FROM ({_CELLS}) JOIN p USING (cell))),
    e AS (SELECT face, part, unnest(q) AS vertex, generate_subscripts(q, 1) AS pos FROM f), g AS (SELECT face, part, string_agg(n::VARCHAR, ',' ORDER BY pos) AS vtx FROM e JOIN v USING (vertex, part) GROUP BY face, part)
    SELECT f.part, f.face, coalesce(a.lnum, 0) AS "left", coalesce(b.lnum, 0) AS "right", vtx FROM f JOIN g USING (face, part) LEFT JOIN p a ON a.cell = l AND a.part = f.part LEFT JOIN p b ON b.cell = r AND b.part = f.part"""
)
def faces_to_parts(spark, sf_dir):
    return _split(spark, sf_dir)[0].withColumn("part", F.col("part").cast("long")).select("part", "face", "left", "right", joined("vtx"))


@query(f"""SELECT face, l AS "left", r AS "right", array_to_string(q, ',') AS vtx FROM ({_FACES})""")
def faces_from_parts(spark, sf_dir):
    return subsets.faces_from_parts(*_split(spark, sf_dir)).select("face", "left", "right", joined("vtx"))


@query(
    """SELECT n_name AS name, part, part * (n // 4) + least(part, n % 4) AS first, (part + 1) * (n // 4) + least(part + 1, n % 4) AS last, n AS total
    FROM (SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name), (VALUES (0), (1), (2), (3)) p(part)"""
)
def entity_distributions(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    sizes = n.join(c.groupBy("c_nationkey").count(), n["n_nationkey"] == F.col("c_nationkey"), "left").select(F.col("n_name").alias("name"), F.coalesce("count", F.lit(0)).alias("n"))
    return subsets.distributions(sizes, 4)


@query(f"SELECT face, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z FROM (SELECT face, unnest(q) AS vertex FROM ({_FACES})) JOIN ({_VERTICES}) USING (vertex) GROUP BY face")
def face_centres(spark, sf_dir):
    links = faces(spark, sf_dir).select("face", F.explode("vtx").alias("vertex"))
    d = spatial.cell_centres(links, vertices(spark, sf_dir), "face", "vertex", ["x", "y", "z"])
    return d.select("face", *[F.round(c, 9).alias(c) for c in "xyz"])


@query(
    f"""SELECT a, b, (p.x + q.x) / 2 AS x, (p.y + q.y) / 2 AS y, (p.z + q.z) / 2 AS z FROM (SELECT DISTINCT least(q[i], q[i % 4 + 1]) AS a, greatest(q[i], q[i % 4 + 1]) AS b FROM ({_FACES}), range(1, 5) t(i))
    JOIN ({_VERTICES}) p ON a = p.vertex JOIN ({_VERTICES}) q ON b = q.vertex"""
)
def edge_centres(spark, sf_dir):
    e = mesh.edges(faces(spark, sf_dir)).withColumn("edge", F.struct("a", "b"))
    d = spatial.cell_centres(e.select("edge", F.explode(F.array("a", "b")).alias("vertex")), vertices(spark, sf_dir), "edge", "vertex", ["x", "y", "z"])
    return d.select("edge.*", "x", "y", "z")


@query(
    f"""SELECT face, l AS "left", r AS "right", array_to_string(CASE WHEN r = 0 AND face % 3 = 0 THEN list_reverse(q) ELSE q END, ',') AS vtx FROM ({_FACES})"""
)
def boundary_left(spark, sf_dir):
    # Every third boundary face is given with its cell on the right.
    flip = (F.col("right") == 0) & (F.col("face") % 3 == 0)
    f = faces(spark, sf_dir).withColumns({"_l": F.when(flip, 0).otherwise(F.col("left")), "_r": F.when(flip, F.col("left")).otherwise(F.col("right"))})
    f = f.select("face", F.col("_l").alias("left"), F.col("_r").alias("right"), "vtx")
    return mesh.boundary_left(f).select("face", "left", "right", joined("vtx"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) * 5 // count(*) OVER () AS part FROM orders")
def redistribute_uniform(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return partition.redistribute(o, "uniform", ["o_orderkey"], 5).select("o_orderkey", F.col("part").cast("long").alias("part"))


@query("SELECT o_orderkey, 3 AS part FROM orders")
def redistribute_gather(spark, sf_dir):
    return partition.redistribute(table(spark, sf_dir, "orders").select("o_orderkey"), "gather.3", ["o_orderkey"], 5)


@query("SELECT o_orderkey, o_custkey FROM orders")
def block_to_block(spark, sf_dir):
    return exchange.block_to_block(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 7)


@query("WITH s AS (SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS n FROM s) SELECT r::BIGINT AS rank, n // 4 + (r < n % 4)::BIGINT AS cells FROM t, range(0, 4) a(r)")
def balanced_zones(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").count().collect()  # one row a zone
    sizes = {str(r["c_nationkey"]): r["count"] for r in c}
    dealt = partition.balanced_weights(sizes, 4)
    return spark.createDataFrame([(i, round(sum(sizes[z] * x for z, ws in rank.items() for x in ws))) for i, rank in enumerate(dealt)], "rank long, cells long")


@query("SELECT n_nationkey::BIGINT AS zone, 1.0::DOUBLE AS weight FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def whole_zones(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").count().collect()  # one row a zone
    sizes = {str(r["c_nationkey"]): r["count"] for r in c}
    dealt = partition.whole_zone_weights(sizes, 4)
    return spark.createDataFrame([(int(z), x) for rank in dealt for z, ws in rank.items() for x in ws], "zone long, weight double")


@query(
    """WITH n AS (SELECT count(*) AS n FROM part) SELECT part, round_even(n * c, 0)::BIGINT - round_even(n * b, 0)::BIGINT AS n_cells, round_even(n * c, 0)::BIGINT - round_even(n * b, 0)::BIGINT AS most FROM n, (VALUES (0, 0.0, 0.25), (1, 0.25, 0.5), (2, 0.5, 0.75), (3, 0.75, 1.0)) p(part, b, c)"""
)
def hilbert_parts(spark, sf_dir):
    centres = spatial.cell_centres(cells(spark, sf_dir).select("cell", F.explode("vtx").alias("vertex")), vertices(spark, sf_dir), "cell", "vertex", ["x", "y", "z"])
    d = partition.by_hilbert(centres, [1] * 4)
    return d.groupBy("part").agg(F.count("*").alias("n_cells"), F.max("lnum").alias("most"))


_CENTRES = f"SELECT cell, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM (SELECT cell, unnest(v) AS vertex FROM ({_CELLS})) JOIN ({_VERTICES}) USING (vertex) GROUP BY cell"
_HOLDS = "x < 5 AND y < 7 AND p_partkey = floor(x) + 5 * floor(y) + 35 * floor(z)"


def _interpolated(spark, sf_dir, strategy):
    c, v, f = cells(spark, sf_dir), vertices(spark, sf_dir), faces(spark, sf_dir)
    centres = spatial.cell_centres(c.select("cell", F.explode("vtx").alias("vertex")), v, "cell", "vertex", ["x", "y", "z"])
    mapping = interpolation.source_of(targets(spark, sf_dir), centres, f, v, strategy, 0.0)
    field = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("cell"), F.col("p_retailprice").alias("price"))
    return interpolation.interpolate(mapping, field, ["price"])


@query(f"SELECT target, p_retailprice AS price FROM (SELECT target, arg_min(cell, ((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2, cell)) AS cell FROM {_T}, ({_CENTRES}) GROUP BY target) JOIN part ON cell = p_partkey + 1")
def interpolate_closest(spark, sf_dir):
    return _interpolated(spark, sf_dir, "Closest")


@query(f"SELECT target, coalesce(p_retailprice, 'NaN'::DOUBLE) AS price FROM {_T} LEFT JOIN part ON {_HOLDS}")
def interpolate_location(spark, sf_dir):
    return _interpolated(spark, sf_dir, "Location")


@query(
    f"""SELECT target, coalesce(a.p_retailprice, b.p_retailprice) AS price FROM (SELECT target, x, y, z, arg_min(cell, ((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2, cell)) AS cell FROM {_T}, ({_CENTRES}) GROUP BY target, x, y, z)
    LEFT JOIN part a ON x < 5 AND y < 7 AND a.p_partkey = floor(x) + 5 * floor(y) + 35 * floor(z) JOIN part b ON cell = b.p_partkey + 1"""
)
def interpolate_location_and_closest(spark, sf_dir):
    return _interpolated(spark, sf_dir, "LocationAndClosest")


def _crossed(field: str) -> str:
    return f"SELECT cell FROM (SELECT cell, {field} AS f FROM (SELECT cell, unnest(v) AS vertex FROM ({_CELLS})) JOIN ({_VERTICES}) USING (vertex)) GROUP BY cell HAVING min(f) < 0 AND max(f) >= 0"


def _cut(spark, sf_dir, field):
    return surfaces.level_surface(surfaces.tetrahedra(cells(spark, sf_dir), "HEXA_8"), vertices(spark, sf_dir), field)


@query(_crossed("(x - 2.3) ** 2 + (y - 3.1) ** 2 + (z - 4.2) ** 2 - 4.0"))
def spherical_slice(spark, sf_dir):
    # A cell has polygons where its corners lie on both sides.
    return _cut(spark, sf_dir, surfaces.ellipsoid((2.3, 3.1, 4.2), radius2=4.0))[1].select("cell").distinct()


@query(_crossed("((x - 2.3) / 1.5) ** 2 + ((y - 3.1) / 2) ** 2 + ((z - 4.2) / 3) ** 2 - 1.0"))
def elliptical_slice(spark, sf_dir):
    return _cut(spark, sf_dir, surfaces.ellipsoid((2.3, 3.1, 4.2), (1.5, 2, 3), 1.0))[1].select("cell").distinct()


@query(f"SELECT cell, p_size AS size, 1.0::DOUBLE AS area FROM ({_CENTRES}) JOIN part ON cell = p_partkey + 1 WHERE cz - 0.5 < 2.25 AND cz + 0.5 >= 2.25")
def slice_with_values(spark, sf_dir):
    # The plane z = 2.25 cuts unit squares.
    points, polygons = _cut(spark, sf_dir, surfaces.plane((0, 0, 1), 2.25))
    area = surfaces.polygon_areas(polygons, points)
    field = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("cell"), F.col("p_size").alias("size"))
    return surfaces.parent_values(area, field, ["size"]).select("cell", "size", F.round("area", 9).alias("area"))


@query(f"SELECT c AS copy, vertex + c * 1000000000 AS vertex, round(CASE c WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN -x ELSE y END, 6) + 0.0 AS x, round(CASE c WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN -y ELSE -x END, 6) + 0.0 AS y, z FROM ({_VERTICES}), range(0, 4) t(c)")
def full_turn(spark, sf_dir):
    n = zones.copies_to_full_turn(pi / 2)
    d = zones.rotated_copies(vertices(spark, sf_dir), n, (0, 0, pi / 2), 1_000_000_000)
    return d.select("copy", "vertex", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])


@query(f"SELECT 'A' AS zone, vertex, 'B' AS donor_zone, vertex AS donor_vertex FROM ({_VERTICES}) WHERE vertex IN (SELECT unnest(q) FROM ({_FACES}) WHERE r = 0)")
def join_vertices(spark, sf_dir):
    f, v = faces(spark, sf_dir).filter("right = 0"), vertices(spark, sf_dir)
    both = lambda d, e: d.withColumn("zone", F.lit("A")).unionByName(e.withColumn("zone", F.lit("B")))
    joins = f.select(F.lit("A").alias("zone"), "face", F.lit("B").alias("donor_zone"), F.col("face").alias("donor_face"))
    return zones.vertex_pairs(joins, both(f.select("face", "vtx"), f.select("face", "vtx")), both(v, v.withColumn("z", F.col("z") + 100.0)), shift=(0, 0, 100))


@query(f"SELECT vertex, part::INTEGER AS part, x, y, z FROM ({_VERTICES}) JOIN (SELECT DISTINCT unnest(v) AS vertex, part FROM ({_CELLS}) JOIN ({_PARTS}) USING (cell)) USING (vertex) WHERE part > 0")
def stored_parts(spark, sf_dir):
    # Written by zone and part, and read again in part.
    m = partition.entity_parts(cells(spark, sf_dir), parts(spark, sf_dir)).withColumnRenamed("vtx", "vertex")
    d = transfer.vertices_to_parts(vertices(spark, sf_dir), m).withColumn("zone", F.lit("01"))
    path = fresh_path(spark, "stored-parts")
    tables.write({"vertices": d.drop("lnum")}, path)
    return tables.read_parts(spark, path, "vertices", parts=[1, 2], zones=["01"]).select("vertex", "part", "x", "y", "z")


@query(f"SELECT zone || '/ZoneType' AS path, 'ZoneType_t' AS label, 3 AS depth, CASE WHEN k % 2 = 0 THEN '\"Structured\"' ELSE '\"Unstructured\"' END AS value FROM {_N} UNION ALL SELECT zone || '/Own/PointList', 'IndexArray_t', 4, '[[1, ' || k + 1 || ']]' FROM {_N}")
def tree_as_text(spark, sf_dir):
    # Written as text, one file a tree, and read again.
    t = trees.from_paths(tree(spark, sf_dir).select("path")).select("path", "parent", "name", "depth").join(tree(spark, sf_dir).select("path", "label", "dtype", "size", "value"), "path")
    t = numbering.row_numbers(t, ["path"], "ord").withColumn("ord", F.col("ord").cast("int")).withColumn("file", F.lit("t"))
    path = fresh_path(spark, "tree-text")
    tree_text.write(t, path)
    back = tree_text.read(spark, f"{path}/tree=*/*.txt")
    return back.filter("name = 'ZoneType' or path like '%/Own/PointList'").select("path", "label", "depth", "value")


@query(
    f"""SELECT l_orderkey, len(p) || ',' || array_to_string(p, ',') AS counted, array_to_string(p[2:] || p[1:1], ',') AS rolled, array_to_string(list_reverse(p[1:2]) || list_reverse(p[3:]), ',') AS back,
    array_to_string(p || n, ',') AS merged, true AS ring FROM ({_ARRAYS}) WHERE len(p) > 1"""
)
def jagged_forms(spark, sf_dir):
    d = arrays(spark, sf_dir).filter(F.size("p") > 1)
    m = numbering.jagged_merge(d.select("l_orderkey", F.col("p").alias("a")), d.select("l_orderkey", F.col("n").alias("a")), "l_orderkey", "a")
    p = F.col("p")
    out = {"counted": numbering.interlaced(p), "rolled": numbering.roll_from(p, F.lit(1)), "back": numbering.roll_from(p, F.lit(1), True), "merged": F.col("a")}
    ring = numbering.is_circular_sublist(F.concat(F.slice(p, F.size(p), 1), F.slice(p, 1, 1)), p)
    d = numbering.jagged_extract(d.join(m, "l_orderkey"), d.select("l_orderkey"), "l_orderkey").withColumns(out | {"ring": ring})
    return d.select("l_orderkey", *[listed(c) for c in out], "ring")


@query(
    """SELECT c_custkey, CASE WHEN k <> 0 THEN k + 10 ELSE 0 END AS moved, CASE WHEN k < 0 THEN k - 10 ELSE k + 10 END AS grown, greatest(least(k + 5, 4) - greatest(k, 0), 0) AS overlap
    FROM (SELECT c_custkey, c_custkey % 21 - 10 AS k FROM customer)"""
)
def shifted_values(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 21 - 10).alias("k"))
    k, ten = F.col("k"), F.lit(10)
    return d.select("c_custkey", numbering.shift_nonzeros(k, ten).alias("moved"), numbering.shift_absvalue(k, ten).alias("grown"), numbering.overlap_size(k, k + 5, F.lit(0), F.lit(4)).alias("overlap"))


@query("SELECT l_orderkey, bool_or(l_quantity BETWEEN 10 AND 20) AS some, bool_and(l_quantity > 3 AND l_quantity < 48) AS every FROM lineitem GROUP BY l_orderkey")
def values_in_range(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(numbering.any_in_range(q, F.lit(10), F.lit(20)).alias("some"), numbering.all_in_range(q, F.lit(3), F.lit(48), True).alias("every"))


@query("SELECT p_partkey, unnest(range(p_partkey * 100, p_partkey * 100 + p_size % 5)) AS value FROM part WHERE p_size % 2 = 1")
def ranges_with_jumps(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 100).alias("a"), (F.col("p_partkey") * 100 + F.col("p_size") % 5).alias("b"), (F.col("p_size") % 2 == 0).alias("gone"))
    return numbering.arange_with_jumps(p, "a", "b", "gone").select("p_partkey", "value")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def other_rows(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return numbering.others(table(spark, sf_dir, "customer").select("c_custkey"), ids, "c_custkey")


@query(
    """SELECT p_partkey + 1 AS g, 1 + p_partkey % 6 AS i, 1 + p_partkey // 6 % 7 AS j, 1 + p_partkey // 42 AS k, 1 + p_partkey % 5 AS jface_i, 1 + p_partkey // 5 % 8 AS jface_j, 1 + p_partkey // 40 AS jface_k,
    p_partkey + 1 AS back FROM part"""
)
def index_by_location(spark, sf_dir):
    n = (6, 8, 1 << 20)
    g = F.col("p_partkey") + 1
    i, j, k = index.location_from_index(g, "IFaceCenter", n)
    faces_i = index.face_counts(n)[0]
    a, b, c = index.location_from_index(g + faces_i, "JFaceCenter", n)
    back = index.index_from_location(i, j, k, "IFaceCenter", n)
    d = {"g": g, "i": i, "j": j, "k": k, "jface_i": a, "jface_j": b, "jface_k": c, "back": back}
    return table(spark, sf_dir, "part").select(*[x.cast("long").alias(name) for name, x in d.items()])


@query("SELECT 1 + (i - 1) + 6 * (j - 1) + 6 * 8 * (k - 1) AS element FROM range(2, 5) a(i), range(3, 9) b(j), range(1, 4) c(k)")
def range_points(spark, sf_dir):
    return convert.structured_faces("Vertex", (2, 3, 1), (4, 8, 3), (6, 8, 50), spark.range(1))


@query("SELECT s_suppkey, 10 + s_suppkey % 7 - 1 AS a, 20 - (s_suppkey % 5 - 2) AS b, 30 + s_suppkey % 3 - 3 AS c FROM supplier")
def joined_points(spark, sf_dir):
    s = F.col("s_suppkey")
    a, b, c = index.transform_point((1, 3, -2), [s % 7, s % 3, s % 5], (1, 3, 2), (10, 20, 30))
    return table(spark, sf_dir, "supplier").select("s_suppkey", a.alias("a"), b.alias("b"), c.alias("c"))


@query("SELECT 10 * m * m + 2 AS n_vertices, 20 * m * m AS n_cells, 2.5::DOUBLE AS radius FROM (SELECT count(*) AS m FROM region)")
def sphere(spark, sf_dir):
    m = table(spark, sf_dir, "region").count()
    v, c = generators.sphere_triangles(spark, m, 2.5)
    at = v.agg(F.count("*").alias("n_vertices"), F.round(F.max(F.sqrt(F.expr("x * x + y * y + z * z"))), 9).alias("radius"))
    return at.join(c.agg(F.count("*").alias("n_cells")), F.lit(True)).select("n_vertices", "n_cells", "radius")


@query("SELECT kind, n * 5 * 4 * 3 AS n_cells FROM (VALUES ('HEXA_8', 1), ('PENTA_6', 2), ('TETRA_4', 6)) k(kind, n)")
def block_elements(spark, sf_dir):
    out = None
    for kind in ("HEXA_8", "PENTA_6", "TETRA_4"):
        d = generators.cube_cells(spark, (6, 5, 4), kind).select("cell").distinct().agg(F.lit(kind).alias("kind"), F.count("*").alias("n_cells"))
        out = d if out is None else out.unionByName(d)
    return out.select("kind", "n_cells")


@query("SELECT count(*) AS n, true AS inside, count(*) AS n_distinct FROM customer")
def random_cloud(spark, sf_dir):
    n = table(spark, sf_dir, "customer").count()
    d = generators.random_points(spark, n, (0, 1, 2), (1, 3, 5), 7)
    return d.agg(F.count("*").alias("n"), F.bool_and(F.expr("x >= 0 and x <= 1 and y >= 1 and y <= 3 and z >= 2 and z <= 5")).alias("inside"), F.count_distinct("x", "y", "z").alias("n_distinct"))


@query("SELECT n_nationkey AS value, dense_rank() OVER (ORDER BY n_regionkey) - 1 AS rank FROM nation")
def unique_ranks(spark, sf_dir):
    d = numbering.dense_ids(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey", "g")
    return d.select(F.col("n_nationkey").alias("value"), (F.col("g") - 1).alias("rank"))


@query(f"SELECT id, round(1 + (x - 1) * cos(0.5) - (y - 2) * sin(0.5), 6) AS x, round(x, 6) AS old FROM ({_POINTS})")
def turned_vectors(spark, sf_dir):
    from ..functions import geometry

    a, _ = _points(spark, sf_dir)
    x, *_ = geometry.affine([F.col("x"), F.col("y"), F.lit(0.0)], (0, 0, 0.5), (1, 2, 0), (0, 0, 0))
    return a.select("id", F.round(x, 6).alias("x"), F.round("x", 6).alias("old"))


@query("SELECT [0, 2, 3]::VARCHAR AS found, ['Momentum', 'Velocity']::VARCHAR AS vectors")
def subset_sum(spark, sf_dir):
    # Sizes 5, 9, 12, 3, 4, 8 hold 20 = 5 + 12 + 3.
    found = sequences.subset_with_sum([5, 9, 12, 3, 4, 8], 20)
    names = sequences.vector_names(["VelocityX", "VelocityY", "VelocityZ", "MomentumX", "MomentumY", "MomentumZ", "Density", "FluxX"])
    return spark.createDataFrame([(f"[{', '.join(map(str, found))}]", f"[{', '.join(names)}]")], "found string, vectors string")



_VALUES = "SELECT 'Z/size' AS path, p_partkey AS pos, p_size::DOUBLE AS value FROM part UNION ALL SELECT 'Z/price', p_partkey, p_retailprice FROM part"


def _saved(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    one = lambda name, c: p.select(F.lit(f"Z/{name}").alias("path"), F.col("p_partkey").alias("pos"), F.col(c).cast("double").alias("value"))
    v = one("size", "p_size").unionByName(one("price", "p_retailprice"))
    nodes = v.groupBy("path").agg(F.count("*").alias("size"))
    path = fresh_path(spark, "stored-tree")
    store.save(nodes, v, path)
    return path, nodes, v


@query(f"WITH n AS (SELECT count(*) AS n FROM part) SELECT path, pos, value FROM ({_VALUES}), n WHERE pos >= n // 4 + least(1, n % 4) AND pos < 2 * (n // 4) + least(2, n % 4)")
def stored_share(spark, sf_dir):
    path, nodes, _ = _saved(spark, sf_dir)
    return store.load_slabs(spark, path, store.flat_slabs(store.part_ranges(store.load_sizes(spark, path), 4, 1)))


@query(f"SELECT path, pos, value FROM ({_VALUES}) WHERE path = 'Z/price' AND (pos BETWEEN 20 AND 49 OR pos BETWEEN 120 AND 149)")
def stored_pairs(spark, sf_dir):
    path, *_ = _saved(spark, sf_dir)
    r = spark.createDataFrame([("Z/price", 20, 50, 100)], "path string, first long, last long, total long")
    return store.load_slabs(spark, path, store.pair_slabs(r))


@query(f"SELECT path, pos, value FROM ({_VALUES}) WHERE path = 'Z/size' AND pos BETWEEN 15 AND 29")
def stored_items(spark, sf_dir):
    path, *_ = _saved(spark, sf_dir)
    r = spark.createDataFrame([("Z/size", 5, 10)], "path string, first long, last long")
    return store.load_slabs(spark, path, store.block_slabs(r, 3))


@query("SELECT 'Z/price' AS path, count(*) + 1 AS size, count(*) AS n FROM part")
def size_faults(spark, sf_dir):
    _, nodes, v = _saved(spark, sf_dir)
    return store.size_faults(nodes.withColumn("size", F.col("size") + (F.col("path") == "Z/price").cast("int")), v)


@query(f"SELECT zone || '/Linked' || sub AS path, label FROM {_N}, (VALUES ('', 'ZoneBC_t'), ('/X', 'BC_t')) v(sub, label)")
def resolved_links(spark, sf_dir):
    t = tree(spark, sf_dir)
    z = t.filter("label = 'Zone_t'")
    link = z.select(F.concat("path", F.lit("/Linked")).alias("path"), F.lit('"other:/B/Z/ZoneBC"').alias("value"), F.lit("LK").alias("dtype"), F.lit("Link_t").alias("label"))
    other = spark.createDataFrame([("other", "/B/Z/ZoneBC", "ZoneBC_t"), ("other", "/B/Z/ZoneBC/X", "BC_t"), ("other", "/B/Z/ZoneBC2", "ZoneBC_t")], "file string, path string, label string")
    for c, kind in t.dtypes:
        if c not in other.columns:
            other = other.withColumn(c, F.lit(None).cast(kind))
    d = store.resolved(trees.upsert(t, link), other)
    return d.filter("path like '%/Linked%'").select("path", "label")


@query(f"SELECT bc || '/PointRange' AS path FROM {_S} WHERE k % 2 = 0 UNION ALL SELECT bc || '/PointList' FROM {_S} WHERE k % 2 = 1")
def range_names(spark, sf_dir):
    t = tree(spark, sf_dir)
    odd = t.withColumn("name", F.when(F.col("path").rlike("/BC[0-9]+/Point"), F.lit("ElementRange")).otherwise(F.col("name")))
    odd = odd.withColumn("path", F.when(F.col("parent") == "", F.col("name")).otherwise(F.concat("parent", F.lit("/"), "name")))
    return store.with_range_names(odd).filter("path rlike '/BC[0-9]+/Point'").select("path")


@query(f"SELECT zone AS path FROM {_N} WHERE k % 3 <> 0")
def without_legacy(spark, sf_dir):
    t = tree(spark, sf_dir).filter("label = 'Zone_t'").withColumn("k", F.substring("name", 2, 9).cast("int"))
    old = t.withColumn("path", F.concat("path", F.when(F.col("k") % 3 == 0, F.lit("/:CGNS#Ppart/x")).otherwise(F.lit(""))))
    return store.without_legacy(old).select("path")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'own' || s_suppkey ELSE 'other' || s_suppkey END AS points FROM supplier")
def symmetric_joins(spark, sf_dir):
    # Zones 1 and 2 point at each other with different points; those of zone 1 count.
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 2 == 0).alias("first"), F.floor(F.col("s_suppkey") / 2).cast("string").alias("j"))
    z = lambda c: F.when(c, "z1").otherwise("z2")
    text = lambda t, k: F.concat(F.lit(t), k.cast("string"))
    k = F.col("s_suppkey")
    j = s.select("s_suppkey", z(F.col("first")).alias("zone"), F.col("j").alias("name"), text("own", k).alias("points"), z(~F.col("first")).alias("donor_zone"), F.col("j").alias("donor_name"), F.when(F.col("first"), text("other", k + 1)).otherwise(text("x", k)).alias("donor_points"))
    d = store.symmetric_joins(j.drop("s_suppkey"))
    return d.join(j.select("zone", "name", "s_suppkey"), ["zone", "name"]).select("s_suppkey", "points")


@query("SELECT s_suppkey, 11 - s_suppkey % 4 + 10 AS a0, 11 - s_suppkey % 4 + 8 AS a1, CASE WHEN s_suppkey % 6 = 5 THEN -1 ELSE 0 END AS shift, 2 + s_suppkey % 3 AS size FROM supplier")
def boundary_forms(spark, sf_dir):
    s = F.col("s_suppkey")
    (a, _), (b, _) = index.transform_window((-1, 2), [[s % 4, s % 3], [s % 4 + 2, s % 3]], (1, 1), (20, 5))
    size = index.boundary_size([F.lit(1), 3 + s % 3], 0, "Vertex", "FaceCenter")[1]
    return table(spark, sf_dir, "supplier").select("s_suppkey", a.alias("a0"), b.alias("a1"), index.normal_shift(s % 6 + 1, 6, "Vertex", "CellCenter").alias("shift"), size.alias("size"))


@query("SELECT p_partkey AS g, p_partkey % 5 AS i, p_partkey // 5 % 7 AS j, p_partkey // 35 AS k FROM part")
def places(spark, sf_dir):
    g = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(g.alias("g"), *[c.cast("long").alias(n) for c, n in zip(index.zero_based(g, 5, 35), "ijk")])


@query("WITH n AS (SELECT count(*) AS n FROM part) SELECT count(*) AS n_boxes, 3 AS lowest, n - 1 AS highest, n - 3 AS n_cells FROM n, range(0, CASE WHEN n % 35 = 0 THEN 3 WHEN n % 5 = 0 THEN 4 ELSE 5 END) GROUP BY n")
def interval_slabs(spark, sf_dir):
    n = table(spark, sf_dir, "part").count()
    boxes = index.slabs((5, 7, n // 35 + 1), 3, n)
    cells_of = [[i + 5 * j + 35 * k for k in range(*b[2]) for j in range(*b[1]) for i in range(*b[0])] for b in boxes]
    flat = [c for b in cells_of for c in b]
    assert flat == sorted(set(flat))
    return spark.createDataFrame([(len(boxes), flat[0], flat[-1], len(flat))], "n_boxes long, lowest long, highest long, n_cells long")
