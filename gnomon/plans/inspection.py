"""Queries of tree search, change and inspection on a tree made of nations (zones) and suppliers (boundaries), and of arrays and names, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences
from ..operators import inspect, trees
from .catalog import query, table


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are bases and nations zones: even ones structured, the others with two sections; suppliers are boundaries."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    other = n.select(F.col("k").alias("k2"), F.col("r").alias("r2"))
    n = n.withColumn("k2", (F.col("k") + 2) % 25).join(other, "k2")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("k"))
    first = s.groupBy("k").agg(F.min("s").alias("s0"))
    n = n.join(first, "k", "left")
    k, even = F.col("k"), F.col("k") % 2 == 0
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    say = lambda fmt, *cs: F.format_string(fmt, *cs)

    def row(path: str, label: str, value: Column, when: Column = F.lit(True), dtype: str = "C1") -> Column:
        return F.when(when, F.struct(F.concat("zone", F.lit(path)).alias("path"), F.lit(label).alias("label"), F.lit(dtype).alias("dtype"), value.alias("value")))

    none = F.lit(None).cast("string")
    donor = F.when(F.col("r") == F.col("r2"), say("Z%d", F.col("k2"))).otherwise(say("R%d/Z%d", F.col("r2"), F.col("k2")))
    turn = F.col("k") % 5 == 0
    z = n.withColumn("zone", say("R%d/Z%d", F.col("r"), k))
    size = F.when(even, say("[[%d,%d,0],[4,3,0],[5,4,0]]", k + 2, k + 1)).otherwise(say("[[%d,%d,%d]]", 100 + k, 50 + k, k))
    rows = [
        row("", "Zone_t", size, dtype="I4"),
        row("/ZoneType", "ZoneType_t", text(F.when(even, "Structured").otherwise("Unstructured"))),
        row("/Family", "FamilyName_t", text(say("FAM%d", k % 3))),
        row("/Hexa", "Elements_t", F.lit("[17, 0]"), ~even, "I4"),
        row("/Hexa/ElementRange", "IndexRange_t", say("[1, %d]", 50 + k), ~even, "I4"),
        row("/Quad", "Elements_t", F.lit("[7, 0]"), ~even, "I4"),
        row("/Quad/ElementRange", "IndexRange_t", say("[%d, %d]", 51 + k, 60 + 2 * k), ~even, "I4"),
        row("/ZoneBC", "ZoneBC_t", none),
        row("/ZoneGridConnectivity", "ZoneGridConnectivity_t", none),
        row("/ZoneGridConnectivity/match", "GridConnectivity1to1_t", text(donor)),
        row("/ZoneGridConnectivity/match/Transform", "int[IndexDimension]", F.lit("[1, -3, 2]"), even, "I4"),
        row("/ZoneGridConnectivity/match/Property", "GridConnectivityProperty_t", none, turn),
        row("/ZoneGridConnectivity/match/Property/Periodic", "Periodic_t", none, turn),
        row("/ZoneGridConnectivity/match/Property/Periodic/RotationCenter", "DataArray_t", F.lit("[0.0, 0.0, 0.0]"), turn, "R4"),
        row("/ZoneGridConnectivity/match/Property/Periodic/RotationAngle", "DataArray_t", F.lit("[0.0, 0.0, 0.0]"), turn, "R4"),
        row("/ZoneGridConnectivity/match/Property/Periodic/Translation", "DataArray_t", say("[%d.000001, 0.0, 0.0]", k % 10), turn, "R4"),
        row("/ZoneGridConnectivity/over", "GridConnectivity_t", text(donor), ~even),
        row("/ZoneGridConnectivity/over/GridConnectivityType", "GridConnectivityType_t", F.lit('"Abutting1to1"'), k % 4 == 1),
        row("/Sub", "ZoneSubRegion_t", none, F.col("s0").isNotNull()),
        row("/Sub/BCRegionName", "Descriptor_t", text(say("BC%d", F.col("s0"))), F.col("s0").isNotNull()),
        row("/Own", "ZoneSubRegion_t", none),
        row("/Own/PointList", "IndexArray_t", say("[[1, %d]]", k + 1), dtype="I4"),
    ]
    d = z.select(F.explode(F.array_compact(F.array(*rows))).alias("x")).select("x.*")
    b = s.join(z.select("k", "zone"), "k").withColumn("zone", F.concat("zone", say("/ZoneBC/BC%d", F.col("s"))))
    of = [
        row("", "BC_t", F.lit('"FamilySpecified"')),
        row("/FamilyName", "FamilyName_t", text(say("WALL%d", F.col("s") % 2))),
        row("/PointList", "IndexArray_t", say("[[%d, %d, %d]]", F.col("s") + 1, F.col("s") + 2, F.col("s") + 3), ~even, "I4"),
        row("/GridLocation", "GridLocation_t", F.lit('"FaceCenter"'), ~even),
        row("/PointRange", "IndexRange_t", say("[[1, 1], [4, 1], [1, %d]]", 2 + F.col("s") % 3), even, "I4"),
    ]
    d = d.unionByName(b.select(F.explode(F.array_compact(F.array(*of))).alias("x")).select("x.*"))
    bases = table(spark, sf_dir, "region").select(say("R%d", F.col("r_regionkey")).alias("path"), F.lit("CGNSBase_t").alias("label"), F.lit("I4").alias("dtype"), F.lit("[3, 3]").alias("value"))
    d = d.unionByName(bases)
    count = F.when(F.col("value").isNull(), 0).when(F.col("dtype") == "C1", F.length("value") - 2).otherwise(F.size(F.split("value", ",")))
    return d.select("path", trees.path_parent(F.col("path")).alias("parent"), trees.path_tail(F.col("path")).alias("name"), "label", F.size(F.split("path", "/")).alias("depth"), F.lit(0).alias("ord"), "dtype", count.cast("long").alias("size"), "value")


_ZONE = "'R' || n_regionkey || '/Z' || n_nationkey"
_N = f"(SELECT n_nationkey AS k, n_regionkey AS r, {_ZONE} AS zone, a.k2, a.r2 FROM nation JOIN (SELECT n_nationkey AS k2, n_regionkey AS r2 FROM nation) a ON a.k2 = (n_nationkey + 2) % 25)"
_S = f"(SELECT s_suppkey AS s, n_nationkey AS k, {_ZONE} AS zone, {_ZONE} || '/ZoneBC/BC' || s_suppkey AS bc FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def listed(c: str) -> Column:
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query(
    f"""SELECT zone AS path, 'R' || r AS base, 'Z' || k AS name, CASE WHEN k % 2 = 0 THEN 'Structured' ELSE 'Unstructured' END AS kind, CASE WHEN k % 2 = 0 THEN 3 ELSE 1 END AS index_dim, 3 AS cell_dim,
    CASE WHEN k % 2 = 0 THEN (k + 2) || ',4,5' ELSE (100 + k)::VARCHAR END AS vertex_size, CASE WHEN k % 2 = 0 THEN (k + 1) || ',3,4' ELSE (50 + k)::VARCHAR END AS cell_size,
    CASE WHEN k % 2 = 0 THEN (k + 2) * 20 ELSE 100 + k END AS n_vtx, CASE WHEN k % 2 = 0 THEN (k + 1) * 12 ELSE 50 + k END AS n_cell, CASE WHEN k % 2 = 0 THEN 0 ELSE k END AS n_vtx_bnd,
    CASE WHEN k % 2 = 0 THEN (k + 2) * 12 + 4 * (k + 1) * 4 + 5 * (k + 1) * 3 END AS n_face, false AS has_ngon, false AS has_nface FROM {_N}"""
)
def zone_report(spark, sf_dir):
    d = inspect.zones(tree(spark, sf_dir)).drop("face_size", "boundary_size")
    return d.withColumns({"vertex_size": listed("vertex_size"), "cell_size": listed("cell_size")})


@query(
    f"""SELECT zone, zone || '/Hexa' AS path, 17 AS number, 'HEXA_8' AS kind, 3 AS dim, 8 AS n_vtx, 1 AS first, 50 + k AS last, 50 + k AS size, 1 AS place FROM {_N} WHERE k % 2 = 1
    UNION ALL SELECT zone, zone || '/Quad', 7, 'QUAD_4', 2, 4, 51 + k, 60 + 2 * k, 10 + k, 2 FROM {_N} WHERE k % 2 = 1"""
)
def section_report(spark, sf_dir):
    return inspect.sections(tree(spark, sf_dir))


@query(
    f"""SELECT zone, d.dim, CASE WHEN d.dim = 3 THEN 1 ELSE 51 + k END AS first, CASE WHEN d.dim = 3 THEN 50 + k ELSE 60 + 2 * k END AS last, false AS interlaced, -1 AS ordering
    FROM {_N}, (VALUES (2), (3)) d(dim) WHERE k % 2 = 1"""
)
def dimension_report(spark, sf_dir):
    t = tree(spark, sf_dir)
    return inspect.dimension_ranges(t).join(inspect.dimension_order(t), "zone").drop("n")


@query(
    f"""SELECT zone || '/ZoneGridConnectivity/match' AS path, zone, 'Abutting1to1' AS kind, true AS is_1to1, k % 5 = 0 AS is_periodic, CASE WHEN k % 5 = 0 THEN (k % 10 + 0.000001)::DOUBLE END AS shift,
    CASE WHEN k % 2 = 0 THEN '1,-3,2' END AS transform, CASE WHEN k % 2 = 0 THEN '1,0,0,0,0,1,0,-1,0' END AS matrix, 'R' || r2 || '/Z' || k2 AS donor FROM {_N}
    UNION ALL SELECT zone || '/ZoneGridConnectivity/over', zone, CASE WHEN k % 4 = 1 THEN 'Abutting1to1' ELSE 'Overset' END, k % 4 = 1, false, NULL, NULL, NULL, 'R' || r2 || '/Z' || k2 FROM {_N} WHERE k % 2 = 1"""
)
def join_report(spark, sf_dir):
    d = inspect.joins(tree(spark, sf_dir)).withColumn("matrix", F.when(F.col("transform").isNotNull(), F.flatten(inspect.transform_matrix(F.col("transform")))))
    return d.select("path", "zone", "kind", "is_1to1", "is_periodic", F.get("translation", 0).alias("shift"), listed("transform"), listed("matrix"), "donor")


@query(f"SELECT '0.0' AS angle, (k % 10)::DOUBLE AS shift, string_agg(zone || '/ZoneGridConnectivity/match', ',' ORDER BY zone) AS paths FROM {_N} WHERE k % 5 = 0 GROUP BY k % 10")
def periodic_groups(spark, sf_dir):
    d = inspect.periodic_groups(tree(spark, sf_dir), 4)
    return d.select(F.get("angle", 0).cast("string").alias("angle"), F.get("translation", 0).alias("shift"), listed("paths"))


@query(
    f"""WITH RECURSIVE e AS (SELECT zone AS a, 'R' || r2 || '/Z' || k2 AS b FROM {_N} WHERE k % 5 <> 0 UNION SELECT zone, 'R' || r2 || '/Z' || k2 FROM {_N} WHERE k % 4 = 1),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c AS (SELECT zone AS z, zone AS m FROM {_N} UNION SELECT u.b, c.m FROM c JOIN u ON u.a = c.z)
    SELECT z AS zone, min(m) AS component FROM c GROUP BY z"""
)
def connected_zones(spark, sf_dir):
    return inspect.connected_zones(tree(spark, sf_dir))


@query(
    f"""SELECT bc AS path, zone, 'BC_t' AS label, CASE WHEN k % 2 = 1 THEN 'PointList' ELSE 'PointRange' END AS patch, CASE WHEN k % 2 = 1 THEN 'FaceCenter' ELSE 'Vertex' END AS location,
    CASE WHEN k % 2 = 1 THEN 3 ELSE 4 * (2 + s % 3) END AS n_elem, CASE WHEN k % 2 = 0 THEN 0 END AS normal_axis FROM {_S}
    UNION ALL SELECT zone || '/Own', zone, 'ZoneSubRegion_t', 'PointList', 'Vertex', 2, NULL FROM {_N}"""
)
def subset_report(spark, sf_dir):
    return inspect.subsets(tree(spark, sf_dir))


@query(f"SELECT bc AS path FROM {_S} WHERE k % 2 = 1")
def subsets_at_faces(spark, sf_dir):
    return inspect.subsets(tree(spark, sf_dir), "FaceCenter").select("path")


@query(f"SELECT zone || '/Sub' AS path, zone || '/ZoneBC/BC' || min(s) AS extent FROM {_S} GROUP BY zone UNION ALL SELECT zone || '/Own', zone || '/Own' FROM {_N}")
def region_extents(spark, sf_dir):
    return inspect.region_extents(tree(spark, sf_dir))


@query(f"SELECT zone AS path FROM {_N} WHERE k % 3 = 1")
def zones_in_family(spark, sf_dir):
    return inspect.in_family(tree(spark, sf_dir), "FAM1").select("path")


@query(f"SELECT bc AS path FROM {_S} WHERE s % 2 = 0")
def boundaries_in_family(spark, sf_dir):
    return inspect.in_family(tree(spark, sf_dir), "WALL0").select("path")


@query(f"SELECT 'R' || r AS p0, zone AS p1, zone || '/ZoneBC' AS p2 FROM {_N}")
def chain_of_predicates(spark, sf_dir):
    return trees.chain_with_ancestors(tree(spark, sf_dir), trees.parse_predicates("CGNSBase_t/Zone_t/ZoneBC"))


@query(f"SELECT bc AS path FROM {_S} WHERE bc LIKE '%/BC1%'")
def concrete_paths(spark, sf_dir):
    return trees.concretise(tree(spark, sf_dir), ["R*/Z*/ZoneBC/BC1*"], ["CGNSBase_t", "Zone_t", "ZoneBC_t", "BC_t"])


@query(f"SELECT 'R' || r_regionkey AS path, 1 AS depth FROM region UNION ALL SELECT zone, 2 FROM {_N} UNION ALL SELECT zone || '/ZoneBC', 3 FROM {_N} WHERE k IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT bc, 4 FROM {_S}")
def tree_of_paths(spark, sf_dir):
    t = tree(spark, sf_dir)
    given = t.filter("label in ('BC_t', 'Zone_t', 'CGNSBase_t')").select("path")
    return trees.from_paths(given).select("path", "depth")


@query(f"SELECT zone || '/ZoneBC' AS path FROM {_N} UNION ALL SELECT zone || '/Sub' FROM {_N} WHERE k IN (SELECT s_nationkey FROM supplier)")
def outermost_matches(spark, sf_dir):
    # B* matches boundaries too, and these lie below a match already.
    t = tree(spark, sf_dir)
    return trees.outermost(t, t.filter("name in ('ZoneBC', 'Sub', 'BCRegionName') or name like 'BC%'")).select("path")


@query(f"SELECT zone || '/ZoneGridConnectivity/match' AS path, 'R' || r2 || '/Z' || k2 AS donor FROM {_N} UNION ALL SELECT zone || '/ZoneGridConnectivity/over', 'R' || r2 || '/Z' || k2 FROM {_N} WHERE k % 2 = 1")
def donors_as_paths(spark, sf_dir):
    d = inspect.donors_as_paths(tree(spark, sf_dir)).filter("label in ('GridConnectivity_t', 'GridConnectivity1to1_t')")
    return d.select("path", inspect.text_of(F.col("value")).alias("donor"))


@query(
    f"""SELECT CASE WHEN k % 4 = 0 THEN 'R' || r || '/New' || k ELSE zone END AS zone, CASE WHEN k2 % 4 = 0 THEN 'R' || r2 || '/New' || k2 ELSE 'R' || r2 || '/Z' || k2 END AS donor,
    (SELECT count(*) FROM supplier WHERE s_nationkey = k) AS n_bc FROM {_N}"""
)
def renamed_zones(spark, sf_dir):
    t = inspect.donors_as_paths(tree(spark, sf_dir))
    z = t.filter("label = 'Zone_t'").withColumn("k", F.substring("name", 2, 9).cast("int")).filter("k % 4 = 0")
    t = trees.rename_zones(t, z.select(F.col("path").alias("old"), F.concat("parent", F.lit("/New"), F.col("k").cast("string")).alias("new")))
    n = inspect.joins(t).filter("path like '%/match'").select("zone", "donor")
    b = t.filter("label = 'BC_t'").groupBy(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("zone")).count()
    return n.join(b, "zone", "left").select("zone", "donor", F.coalesce("count", F.lit(0)).alias("n_bc"))


@query(f"SELECT zone || '/Note' AS path, 'Descriptor_t' AS label, 'Note' AS name, 3 AS depth, '\"k' || k || '\"' AS value FROM {_N} UNION ALL SELECT zone || '/Family', 'FamilyName_t', 'Family', 3, '\"k' || k || '\"' FROM {_N} WHERE k % 2 = 0 UNION ALL SELECT zone || '/Family', 'FamilyName_t', 'Family', 3, '\"FAM' || k % 3 || '\"' FROM {_N} WHERE k % 2 = 1")
def upserted_nodes(spark, sf_dir):
    t = tree(spark, sf_dir)
    z = t.filter("label = 'Zone_t'").withColumn("k", F.substring("name", 2, 9).cast("int")).withColumn("value", F.concat(F.lit('"k'), F.col("k").cast("string"), F.lit('"')))
    t = trees.upsert(t, z.select(F.concat("path", F.lit("/Note")).alias("path"), F.lit("Descriptor_t").alias("label"), "value"))
    t = trees.upsert(t, z.filter("k % 2 = 0").select(F.concat("path", F.lit("/Family")).alias("path"), "value"))
    return t.filter("name in ('Note', 'Family')").select("path", "label", "name", "depth", "value")


@query(f"SELECT zone || '/Hexa' AS path, true AS in_0, false AS in_1 FROM {_N} WHERE k % 2 = 1 UNION ALL SELECT zone || '/ZoneType', true, true FROM {_N}")
def aligned_trees(spark, sf_dir):
    t = tree(spark, sf_dir)
    gone = trees.select_nodes(t, name="Hexa")
    return trees.aligned([t, trees.remove(t, gone)]).filter("path like '%/Hexa' or path like '%/ZoneType'")


@query(f"SELECT zone AS path, count(s) AS n_bc FROM {_N} n LEFT JOIN supplier ON s_nationkey = k CROSS JOIN (SELECT s_suppkey AS s FROM supplier) x WHERE x.s = s_suppkey GROUP BY zone")
def kept_nodes(spark, sf_dir):
    t = trees.keep(tree(spark, sf_dir), include=["R*/Z*/ZoneBC/BC*"]).filter("depth = 4")
    return t.groupBy(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("path")).agg(F.count("*").alias("n_bc"))


@query(f"SELECT zone AS path, 1 + 3 + (CASE WHEN k % 2 = 1 THEN 4 ELSE 0 END) AS n_nodes FROM {_N}")
def removed_subtrees(spark, sf_dir):
    t = tree(spark, sf_dir)
    t = trees.remove(t, t.filter("name in ('ZoneBC', 'ZoneGridConnectivity', 'Sub', 'PointList')").select("path"))
    return trees.table_of_sizes(t).filter("path like '%/Z%' and path not like '%/Z%/%'").select("path", "n_nodes")


@query("SELECT sum(length(name) + length(label) + 8)::BIGINT AS metadata, sum(size * CASE WHEN label = 'CGNSBase_t' THEN 4 ELSE 1 END)::BIGINT AS data FROM (SELECT 'R' || r_regionkey AS name, 'CGNSBase_t' AS label, 2 AS size FROM region UNION ALL SELECT 'Family', 'FamilyName_t', 4 FROM nation)")
def byte_sizes(spark, sf_dir):
    return trees.byte_sizes(tree(spark, sf_dir).filter("label = 'CGNSBase_t' or name = 'Family'"))


_ARRAYS = "SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS p, list(l_linenumber::BIGINT ORDER BY l_linenumber, l_partkey) AS n FROM lineitem GROUP BY l_orderkey"


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(a.alias("a"))
    return d.select("l_orderkey", F.transform("a", lambda x: x["l_partkey"]).alias("p"), F.transform("a", lambda x: x["l_linenumber"].cast("long")).alias("n"))


@query(
    f"""SELECT l_orderkey, array_to_string(flatten(list_transform(list_zip(p, n), lambda x: [x[1], x[2]])), ',') AS woven,
    array_to_string(list_transform(range(0, len(n) + 1), lambda i: coalesce(list_sum(n[1:i]), 0)::BIGINT), ',') AS offsets,
    array_to_string(list_filter(p, lambda x: x % 2 = 0), ',') AS even, array_to_string(list_filter(p, lambda x: x % 2 = 1), ',') AS odd,
    array_to_string(CASE WHEN list_contains(p, 7) THEN p ELSE list_append(p, 7) END, ',') AS once,
    array_to_string(p[2:] || p[1:1], ',') AS turned, len(list_filter(p, lambda x: x > 100)) > 0 AS any_large FROM ({_ARRAYS})"""
)
def array_forms(spark, sf_dir):
    p, n = F.col("p"), F.col("n")
    d = arrays(spark, sf_dir)
    even, odd = sequences.split_by(p, lambda x: x % 2 == 0)
    out = {
        "woven": sequences.interweave(p, n), "offsets": sequences.offsets(n), "even": even, "odd": F.get(sequences.buckets(p, lambda x: (x % 2).cast("int"), 2), 1),
        "once": sequences.appended_once(p, F.lit(7).cast("long")), "turned": sequences.rotated(p, F.lit(1)),
    }
    d = d.withColumns(out).withColumn("any_large", F.exists("p", lambda x: x > 100))
    return d.select("l_orderkey", *[listed(c) for c in out], "any_large")


@query(
    f"""SELECT l_orderkey, len(p) AS same, coalesce(list_position(list_transform(p, lambda x: x % 3 = 0), true) - 1, len(p)) AS first3, array_to_string(p[1:2], ',') AS start2, true AS begins,
    list_position(p, p[1]) < list_position(p, p[len(p)]) AS ordered, array_to_string(p[2:len(p)] || p[1:1], ',') AS circle, p[len(p)] AS last, len(list_distinct(p)) = len(p) AS plain
    FROM ({_ARRAYS}) WHERE len(list_distinct(p)) = len(p)"""
)
def array_search(spark, sf_dir):
    p = F.col("p")
    d = arrays(spark, sf_dir).filter(F.size(F.array_distinct("p")) == F.size("p"))
    start = F.slice("p", 1, 2)
    circle = sequences.ordered_subset(sequences.rotated(p, F.lit(1)), p)
    return d.select(
        "l_orderkey", sequences.mismatch(p, p).alias("same"), sequences.first_place(p, lambda x: x % 3 == 0).alias("first3"), F.array_join(start.cast("array<string>"), ",").alias("start2"),
        sequences.begins_with(p, start).alias("begins"), sequences.is_before(p, F.get("p", 0), F.element_at("p", -1)).alias("ordered"), F.array_join(circle.cast("array<string>"), ",").alias("circle"),
        F.element_at(sequences.gathered(p, F.array(F.size("p")), 1, 1), 1).alias("last"), F.lit(True).alias("plain"),
    )


@query(
    f"""SELECT l_orderkey, array_to_string(list_transform(range(0, len(n)), lambda i: array_to_string(w[1 + coalesce(list_sum(n[1:i]), 0)::BIGINT:coalesce(list_sum(n[1:i + 1]), 0)::BIGINT], '-')), ',') AS pieces
    FROM (SELECT *, range(0, list_sum(n)::BIGINT) AS w FROM ({_ARRAYS}))"""
)
def regrouped_arrays(spark, sf_dir):
    d = arrays(spark, sf_dir)
    whole = F.sequence(F.lit(0), F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x).cast("int") - 1)
    pieces = F.transform(sequences.regrouped(whole, F.col("n")), lambda x: F.array_join(x.cast("array<string>"), "-"))
    return d.select("l_orderkey", F.array_join(pieces, ",").alias("pieces"))


@query(
    """SELECT s_suppkey, s_name || '.P' || s_nationkey || '.N' || s_suppkey % 3 AS part_name, s_nationkey AS rank, s_suppkey % 3 AS part, s_name AS base, s_name || '.' || s_suppkey AS split_name, s_suppkey::VARCHAR AS split,
    'JN.P' || s_nationkey || '.N0.LT.P1.N' || s_suppkey AS internal, true AS is_internal, length(s_name) <= 32 AS valid, s_name AS short, 'X/' || lower(s_name) || '/y' AS path FROM supplier"""
)
def name_forms(spark, sf_dir):
    s, n, k = F.col("s_suppkey"), F.col("s_name"), F.col("s_nationkey")
    named = sequences.with_part(n, k, s % 3)
    joined = sequences.internal_join_name(k, F.lit(0), F.lit(1), s)
    part = sequences.part_of(named)
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", named.alias("part_name"), part["rank"].alias("rank"), part["part"].alias("part"), sequences.without_part(named).alias("base"), sequences.with_split(n, s).alias("split_name"),
        sequences.split_of(sequences.with_split(n, s)).alias("split"), joined.alias("internal"), sequences.is_internal_join(joined).alias("is_internal"), sequences.is_valid_name(n).alias("valid"),
        sequences.shortened(n).alias("short"), sequences.path_with(F.concat(F.lit("X/"), n, F.lit("/y")), 1, F.lower).alias("path"),
    )
