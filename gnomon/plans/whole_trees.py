"""Queries of whole trees in parts and back, on a zone made of the block of all parts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import numbering, tree_parts
from ..storage import stored
from .catalog import query, table
from .forms import _PARTS, parts
from .meshes import _CELLS, _FACES, _VERTICES, faces, vertices

# Vertices are numbered by their places in the block, of which all up to the last are there.
_VTX = f"SELECT vertex, row_number() OVER (ORDER BY vertex) AS v, x, y, z FROM ({_VERTICES})"
_OUTER = f"SELECT face, l AS cell, row_number() OVER (ORDER BY p_size, face) - 1 AS pos, p_retailprice AS price FROM ({_FACES}) JOIN part ON l = p_partkey + 1 WHERE r = 0"
_TREE = f"""SELECT 'Base/Z/GridCoordinates/CoordinateX' AS path, v - 1 AS pos, x AS value FROM ({_VTX}) UNION ALL SELECT 'Base/Z/GridCoordinates/CoordinateZ', v - 1, z FROM ({_VTX})
UNION ALL SELECT 'Base/Z/Fields/price', p_partkey, p_retailprice FROM part
UNION ALL SELECT 'Base/Z/NGon/ElementStartOffset', face, 4 * face FROM ({_FACES}) UNION ALL SELECT 'Base/Z/NGon/ElementStartOffset', 0, 0
UNION ALL SELECT 'Base/Z/NGon/ElementConnectivity', 4 * (face - 1) + i - 1, v FROM (SELECT face, i, q[i] AS vertex FROM ({_FACES}), range(1, 5) t(i)) JOIN ({_VTX}) USING (vertex)
UNION ALL SELECT 'Base/Z/NGon/ParentElements', face - 1, l FROM ({_FACES}) UNION ALL SELECT 'Base/Z/NGon/ParentElements', face - 1 + count(*) OVER (), r FROM ({_FACES})
UNION ALL SELECT 'Base/Z/ZoneBC/Outer/PointList', pos, face FROM ({_OUTER}) UNION ALL SELECT 'Base/Z/ZoneBC/Outer/Set/Data/price', pos, price FROM ({_OUTER})"""


def whole_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = numbering.row_numbers(vertices(spark, sf_dir), ["vertex"], "v")
    f = faces(spark, sf_dir).select("face", "left", "right", F.posexplode("vtx").alias("_i", "vertex")).join(v.select("vertex", "v"), "vertex")
    f = f.repartition("face").groupBy("face", "left", "right").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "v"))), lambda x: x["v"]).alias("vtx"))
    f = stored(f.withColumn("section", F.lit("Base/Z/NGon")), "zone-faces")
    p = table(spark, sf_dir, "part")
    outer = f.filter("right = 0").select("face", F.col("left").alias("cell")).join(p.select((F.col("p_partkey") + 1).alias("cell"), "p_size", "p_retailprice"), "cell")
    outer = numbering.row_numbers(outer, ["p_size", "face"], "at")
    row = lambda d, path, pos, value: d.select(F.lit(f"Base/Z/{path}").alias("path"), pos.cast("long").alias("pos"), value.cast("double").alias("value"))
    values = tree_parts.section_values(f)
    for d, path, pos, value in (
        (v, "GridCoordinates/CoordinateX", F.col("v") - 1, F.col("x")), (v, "GridCoordinates/CoordinateZ", F.col("v") - 1, F.col("z")), (p, "Fields/price", F.col("p_partkey"), F.col("p_retailprice")),
        (outer, "ZoneBC/Outer/PointList", F.col("at") - 1, F.col("face")), (outer, "ZoneBC/Outer/Set/Data/price", F.col("at") - 1, F.col("p_retailprice")),
    ):
        values = values.unionByName(row(d, path, pos, value))
    values = stored(values, "zone-values")
    labels = {"Base": "CGNSBase_t", "Base/Z": "Zone_t", "Base/Z/GridCoordinates": "GridCoordinates_t", "Base/Z/Fields": "FlowSolution_t", "Base/Z/NGon": "Elements_t", "Base/Z/ZoneBC": "ZoneBC_t", "Base/Z/ZoneBC/Outer": "BC_t", "Base/Z/ZoneBC/Outer/Set": "BCDataSet_t", "Base/Z/ZoneBC/Outer/Set/Data": "BCData_t"}
    rows = [(k, x, None) for k, x in labels.items()] + [(f"Base/Z/{k}/GridLocation", "GridLocation_t", f'"{x}"') for k, x in (("Fields", "CellCenter"), ("ZoneBC/Outer", "FaceCenter"))]
    nodes = spark.createDataFrame(rows, "path string, label string, value string").withColumn("size", F.lit(0).cast("long"))
    leaves = values.groupBy("path").agg(F.count("*").alias("size")).withColumns({"label": F.lit("DataArray_t"), "value": F.lit(None).cast("string")})
    nodes = nodes.unionByName(leaves.select(*nodes.columns))
    parent, name = F.regexp_replace("path", "/?[^/]*$", ""), F.substring_index("path", "/", -1)
    return nodes.withColumns({"parent": parent, "name": name, "depth": F.size(F.split("path", "/"))}), values


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, values = whole_tree(spark, sf_dir)
    return tree_parts.partition_tree(nodes, values, parts(spark, sf_dir).withColumn("zone", F.lit("Base/Z")))


@query(_TREE)
def recovered_tree(spark, sf_dir):
    """All arrays of the zone, after three parts were made of it and put together again."""
    return tree_parts.recover_tree(*split(spark, sf_dir))[1]


_SIDES_OF = f"SELECT face, part, max(cell) AS any, bool_or(side = 0) AS has_left, max(CASE WHEN side = 0 THEN lnum END) AS ll, max(CASE WHEN side = 1 THEN lnum END) AS lr FROM (SELECT face, unnest([l, r]) AS cell, unnest([0, 1]) AS side FROM ({_FACES})) JOIN ({_PARTS}) USING (cell) GROUP BY face, part"
_LOCAL = f"SELECT *, row_number() OVER (PARTITION BY part ORDER BY face) AS n, count(*) OVER (PARTITION BY part) AS faces FROM ({_SIDES_OF})"
_POINTS_OF = f"SELECT part, vertex, x, row_number() OVER (PARTITION BY part ORDER BY vertex) AS n FROM (SELECT DISTINCT part, vertex FROM (SELECT part, unnest(v) AS vertex FROM ({_CELLS}) JOIN ({_PARTS}) USING (cell))) JOIN ({_VERTICES}) USING (vertex)"


@query(
    f"""WITH f AS MATERIALIZED ({_LOCAL}), p AS MATERIALIZED ({_POINTS_OF}), o AS MATERIALIZED (SELECT part, n, price, row_number() OVER (PARTITION BY part ORDER BY pos) - 1 AS place FROM ({_OUTER}) JOIN f USING (face)),
    j AS MATERIALIZED (SELECT a.part, b.part AS other, a.n, b.n AS donor, row_number() OVER (PARTITION BY a.part, b.part ORDER BY a.face) - 1 AS place FROM f a JOIN f b ON a.face = b.face AND a.part <> b.part)
    SELECT part, 'Base/Z/Fields/price' AS path, lnum - 1 AS pos, p_retailprice AS value FROM ({_PARTS}) JOIN part ON cell = p_partkey + 1
    UNION ALL SELECT part, 'Base/Z/GridCoordinates/CoordinateX', n - 1, x FROM p
    UNION ALL SELECT part, 'Base/Z/NGon/ParentElements', n - 1, coalesce(ll, 0) FROM f UNION ALL SELECT part, 'Base/Z/NGon/ParentElements', n - 1 + faces, coalesce(lr, 0) FROM f
    UNION ALL SELECT f.part, 'Base/Z/NGon/ElementConnectivity', 4 * (f.n - 1) + i - 1, p.n FROM f JOIN ({_FACES}) g USING (face), range(1, 5) t(i) JOIN p ON p.part = f.part AND p.vertex = g.q[i]
    UNION ALL SELECT part, 'Base/Z/ZoneBC/Outer/PointList', place, n FROM o UNION ALL SELECT part, 'Base/Z/ZoneBC/Outer/Set/Data/price', place, price FROM o
    UNION ALL SELECT part, 'Base/Z/ZoneGridConnectivity/JN.P' || part || '.' || other || '/PointList', place, n FROM j UNION ALL SELECT part, 'Base/Z/ZoneGridConnectivity/JN.P' || part || '.' || other || '/PointListDonor', place, donor FROM j"""
)
def tree_in_parts(spark, sf_dir):
    """Arrays of the parts in local numbers: fields, coordinates, faces with parents, the boundary with data, and the joins between parts."""
    _, values = split(spark, sf_dir)
    wanted = F.col("path").rlike("price$|CoordinateX$|ParentElements$|ElementConnectivity$|PointList$|PointListDonor$")
    return values.filter(wanted).select("part", "path", "pos", "value")
