"""Queries of extracted meshes, unstructured ones of the block of all parts and windows of structured zones, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction, partition, transfer
from .catalog import query, table
from .forms import _PARTS, parts
from .joins import _BOXES, SIDE, boxes
from .meshes import _FACES, _VERTICES, faces, joined, vertices
from .meshes import cells as mesh_cells
from .more import _ITEMS, items

_CHOSEN = "SELECT p_partkey + 1 AS cell FROM part WHERE p_size > 25"
_KEPT = f"""cells AS (SELECT cell AS old, row_number() OVER (ORDER BY cell) AS gnum FROM ({_CHOSEN})), kept AS (SELECT * FROM ({_FACES}) WHERE l IN (SELECT old FROM cells) OR r IN (SELECT old FROM cells)),
    fs AS (SELECT face AS old, row_number() OVER (ORDER BY face) AS gnum FROM kept), vs AS (SELECT o AS old, row_number() OVER (ORDER BY o) AS gnum FROM (SELECT DISTINCT unnest(q) AS o FROM kept)),
    ids AS (SELECT 'CellCenter' AS location, * FROM cells UNION ALL SELECT 'FaceCenter', * FROM fs UNION ALL SELECT 'Vertex', * FROM vs)"""


def of_cells(spark: SparkSession, sf_dir: str) -> extraction.Extractor:
    chosen = table(spark, sf_dir, "part").filter("p_size > 25").select((F.col("p_partkey") + 1).alias("gnum"))
    return extraction.Extractor(faces(spark, sf_dir), vertices(spark, sf_dir), chosen, "CellCenter")


@query(
    f"""WITH {_KEPT}, e AS (SELECT face, unnest(q) AS o, generate_subscripts(q, 1) AS pos, a.gnum IS NULL AS turned FROM kept LEFT JOIN cells a ON l = a.old),
    v AS (SELECT face, string_agg(vs.gnum::VARCHAR, ',' ORDER BY CASE WHEN turned THEN -pos ELSE pos END) AS vtx FROM e JOIN vs ON o = old GROUP BY face)
    SELECT fs.gnum AS face, fs.old, coalesce(a.gnum, b.gnum) AS "left", CASE WHEN a.gnum IS NULL THEN 0 ELSE coalesce(b.gnum, 0) END AS "right", vtx
    FROM kept JOIN fs ON fs.old = kept.face JOIN v ON v.face = kept.face LEFT JOIN cells a ON l = a.old LEFT JOIN cells b ON r = b.old"""
)
def extracted_cell_mesh(spark, sf_dir):
    return of_cells(spark, sf_dir).faces().select("face", "old", "left", "right", joined("vtx"))


def _whole_fields(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("gnum"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    cell = p.select(F.lit("state").alias("container"), F.lit("CellCenter").alias("location"), "gnum", F.explode(F.create_map(F.lit("size"), F.col("size"), F.lit("price"), F.col("price"))).alias("name", "value"))
    face = faces(spark, sf_dir).select(F.lit("flux").alias("container"), F.lit("FaceCenter").alias("location"), F.col("face").alias("gnum"), F.lit("sides").alias("name"), (F.col("left") - F.col("right")).cast("double").alias("value"))
    vertex = vertices(spark, sf_dir).select(F.lit("places").alias("container"), F.lit("Vertex").alias("location"), F.col("vertex").alias("gnum"), F.lit("r").alias("name"), (F.col("x") + 10 * F.col("y") + 100 * F.col("z")).alias("value"))
    return cell.unionByName(face).unionByName(vertex)


_WHOLE = f"""SELECT 'state' AS container, 'CellCenter' AS location, p_partkey + 1 AS old, 'size' AS name, p_size::DOUBLE AS value FROM part UNION ALL SELECT 'state', 'CellCenter', p_partkey + 1, 'price', p_retailprice FROM part
    UNION ALL SELECT 'flux', 'FaceCenter', face, 'sides', (l - r)::DOUBLE FROM ({_FACES}) UNION ALL SELECT 'places', 'Vertex', vertex, 'r', x + 10 * y + 100 * z FROM ({_VERTICES})"""


@query(f"WITH {_KEPT} SELECT container, location, gnum, name, value FROM ({_WHOLE}) JOIN ids USING (location, old)")
def extracted_fields(spark, sf_dir):
    """Containers at three locations by the maps of one extractor, in two exchanges."""
    e, f = of_cells(spark, sf_dir), _whole_fields(spark, sf_dir)
    return e.exchange(f.filter("location = 'CellCenter'")).unionByName(e.exchange(f.filter("location <> 'CellCenter'")))


_SUBSETS = f"SELECT name AS subset, 'FaceCenter' AS location, row_number() OVER (PARTITION BY name ORDER BY -gnum) AS place, gnum AS old FROM ({_ITEMS})"


def subset_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundaries, listed from their highest face down."""
    d = extraction._numbered(items(spark, sf_dir).withColumn("_down", -F.col("gnum")), ["name"], "_down", "place")
    return d.select(F.col("name").alias("subset"), F.lit("FaceCenter").alias("location"), "place", "gnum")


@query(
    f"""WITH {_KEPT}, s AS ({_SUBSETS}), c AS (SELECT 'heat' AS container, * FROM s WHERE subset = 'A0' UNION ALL SELECT 'B', * FROM s WHERE subset = 'B'),
    d AS (SELECT container, 'FaceCenter' AS location, gnum, row_number() OVER (PARTITION BY container ORDER BY gnum) AS index, place FROM c JOIN fs USING (old))
    SELECT *, 'q' AS name, place * 2.0::DOUBLE AS value FROM d UNION ALL SELECT *, 'p', place + 0.5::DOUBLE FROM d"""
)
def extracted_partial_fields(spark, sf_dir):
    """Two containers on boundaries, one by a region of another name, by one kept plan and two exchanges."""
    s = subset_items(spark, sf_dir)
    extents = extraction.extents_of(spark.createDataFrame([("heat", "A0"), ("B", None)], "container string, subset string"), s)
    e = of_cells(spark, sf_dir)
    plan = e.intersection(extents)
    data = lambda name, value: extents.select("container", "place", F.lit(name).alias("name"), value.cast("double").alias("value"))
    d = e.exchange_partial(data("q", F.col("place") * 2), plan).unionByName(e.exchange_partial(data("p", F.col("place") + 0.5), plan))
    return d.join(plan, ["container", "location", "gnum", "index"])


@query(
    f"""WITH k AS (SELECT face AS old, row_number() OVER (ORDER BY face) AS gnum, q, l FROM ({_FACES}) WHERE face IN (SELECT gnum FROM ({_ITEMS}) WHERE name LIKE 'A%')),
    v AS (SELECT o AS old, row_number() OVER (ORDER BY o) AS gnum FROM (SELECT DISTINCT unnest(q) AS o FROM k))
    SELECT 'sides' AS container, 'CellCenter' AS location, gnum, l::DOUBLE AS value FROM k UNION ALL SELECT 'places', 'Vertex', v.gnum, x + 10 * y + 100 * z FROM v JOIN ({_VERTICES}) ON old = vertex"""
)
def extracted_subset(spark, sf_dir):
    """Boundaries given in element numbers, extracted together; fields of the parts, vertices of several parts included, come as one value each."""
    cells = table(spark, sf_dir, "part").count()
    s = subset_items(spark, sf_dir).withColumn("gnum", F.col("gnum") + cells)
    s = extraction.from_element_numbers(s, spark.createDataFrame([("FaceCenter", cells + 1)], "location string, first long"))
    f = faces(spark, sf_dir)
    e = extraction.of_subset(f, vertices(spark, sf_dir), s, ["A0", "A1"])
    v = partition.entity_parts(mesh_cells(spark, sf_dir), parts(spark, sf_dir)).withColumnRenamed("vtx", "vertex")
    local = v.join(vertices(spark, sf_dir), "vertex").select(
        F.lit("Z").alias("zone"), F.lit("FlowSolution_t").alias("label"), F.lit("places").alias("container"), F.lit("Vertex").alias("location"), "part", "lnum", F.col("vertex").alias("gnum"), F.lit("r").alias("name"),
        (F.col("x") + 10 * F.col("y") + 100 * F.col("z")).alias("value"),
    )
    whole = transfer.from_parts(local).drop("zone", "label")
    sides = f.select(F.lit("sides").alias("container"), F.lit("FaceCenter").alias("location"), F.col("face").alias("gnum"), F.lit("left").alias("name"), F.col("left").cast("double").alias("value"))
    return e.exchange(whole).unionByName(e.exchange(sides)).drop("name")


@query(
    f"""SELECT container, location, array_to_string(list_sort(list(DISTINCT name)), ',') AS names, bool_or(partial) AS partial, count(DISTINCT part) AS parts FROM (SELECT CASE WHEN part = 0 THEN 'first' ELSE 'rest' END AS container, 'CellCenter' AS location,
    'n' || lnum % (part + 2) AS name, part > 0 AS partial, part FROM ({_PARTS})) GROUP BY ALL"""
)
def discovered_containers(spark, sf_dir):
    """Containers that only some parts know, and their names over all parts."""
    p = parts(spark, sf_dir)
    f = p.select("part", F.when(F.col("part") == 0, "first").otherwise("rest").alias("container"), F.lit("CellCenter").alias("location"), F.concat(F.lit("n"), (F.col("lnum") % (F.col("part") + 2)).cast("string")).alias("name"))
    d = extraction.discovered(f, f.filter("part > 0").select("container"))
    n = f.groupBy("container").agg(F.countDistinct("part").alias("parts"))
    return d.join(n, "container").select("container", "location", F.array_join("names", ",").alias("names"), "partial", "parts")


# Four zones of 5 x 7 x n cells, dealt by part number; windows of each, that of the last flat in i.
_NK = "(SELECT max(p_partkey) // 140 + 3 FROM part)"
_ZONES = f"(SELECT z AS zone, 6 AS ni, 8 AS nj, {_NK} AS nk, CASE WHEN z = 3 THEN 3 ELSE 2 END AS i0, CASE WHEN z = 3 THEN 3 ELSE 5 END AS i1, 1 + z AS j0, 7 AS j1, 1 AS k0, {_NK} - 1 AS k1 FROM range(0, 4) t(z))"
_CONTAINERS = "(VALUES ('points', 'Vertex', 0, 0, 0), ('cells', 'CellCenter', 1, 1, 1), ('sides', 'IFaceCenter', 0, 1, 1), ('tops', 'KFaceCenter', 1, 1, 0)) c(container, location, ci, cj, ck)"
_STRUCTURED = f"""SELECT *, p_partkey // 4 AS q FROM part JOIN {_ZONES} z ON p_partkey % 4 = zone, {_CONTAINERS}"""
_AT = f"SELECT *, q % (ni - ci) + 1 AS i, q // (ni - ci) % (nj - cj) + 1 AS j, q // ((ni - ci) * (nj - cj)) + 1 AS k FROM ({_STRUCTURED})"
_IN = "i >= i0 AND i <= i1 - ci AND j >= j0 AND j <= j1 - cj AND k >= k0 AND k <= k1 - ck"
_GNUM = "i - i0 + 1 + (j - j0) * (i1 - i0 + 1 - ci) + (k - k0) * (i1 - i0 + 1 - ci) * (j1 - j0 + 1 - cj)"


def _zones(spark, sf_dir) -> DataFrame:
    z, nk = F.col("zone"), F.col("nk")
    d = table(spark, sf_dir, "part").agg((F.floor(F.max("p_partkey") / 140) + 3).alias("nk")).select("nk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("zone"))
    i = lambda a, b: F.when(z == 3, a).otherwise(b)
    return d.select("zone", F.lit(6).alias("ni"), F.lit(8).alias("nj"), "nk", i(3, 2).alias("i0"), i(3, 5).alias("i1"), (z + 1).alias("j0"), F.lit(7).alias("j1"), F.lit(1).alias("k0"), (nk - 1).alias("k1"))


def _structured_fields(spark, sf_dir) -> DataFrame:
    p = F.col("p_partkey")
    names = {"points": "Vertex", "cells": "CellCenter", "sides": "IFaceCenter", "tops": "KFaceCenter"}
    of = F.explode(F.array(*[F.struct(F.lit(c).alias("container"), F.lit(l).alias("location")) for c, l in names.items()])).alias("c")
    return table(spark, sf_dir, "part").select((p % 4).alias("zone"), of, (F.floor(p / 4) + 1).alias("gnum"), F.lit("size").alias("name"), F.col("p_size").cast("double").alias("value")).select("zone", "c.*", "gnum", "name", "value")


@query(f"SELECT zone, container, location, ({_GNUM})::BIGINT AS gnum, 'size' AS name, p_size::DOUBLE AS value FROM ({_AT}) WHERE {_IN}")
def extracted_structured_fields(spark, sf_dir):
    z = _zones(spark, sf_dir)
    return extraction.structured_exchange(_structured_fields(spark, sf_dir), z, z)


_RANGES = f"SELECT zone, container, location, ci, cj, ck, 1 AS ri0, ni - 1 AS ri1, 2 AS rj0, nj - 2 AS rj1, 2 AS rk0, nk AS rk1, i0, i1, j0, j1, k0, k1 FROM {_ZONES} z, {_CONTAINERS}"
_COMMON = "greatest(ri0, i0) AS a0, least(ri1, i1 - ci) AS a1, greatest(rj0, j0) AS b0, least(rj1, j1 - cj) AS b1, greatest(rk0, k0) AS c0, least(rk1, k1 - ck) AS c1"


def _ranges(spark, sf_dir) -> DataFrame:
    f = _structured_fields(spark, sf_dir).select("zone", "container", "location").distinct()
    return f.join(_zones(spark, sf_dir).select("zone", F.col("nk").alias("k1")), "zone").select("zone", "container", "location", F.lit(1).alias("i0"), F.lit(5).alias("i1"), F.lit(2).alias("j0"), F.lit(6).alias("j1"), F.lit(2).alias("k0"), "k1")


@query(f"SELECT zone, container, location, a0 - i0 + 1 AS i0, a1 - i0 + 1 AS i1, b0 - j0 + 1 AS j0, b1 - j0 + 1 AS j1, c0 - k0 + 1 AS k0, c1 - k0 + 1 AS k1 FROM (SELECT *, {_COMMON} FROM ({_RANGES})) WHERE a0 <= a1 AND b0 <= b1 AND c0 <= c1")
def extracted_ranges(spark, sf_dir):
    return extraction.structured_intersection(_ranges(spark, sf_dir), _zones(spark, sf_dir))


@query(
    f"""WITH r AS (SELECT *, {_COMMON} FROM ({_RANGES})), d AS (SELECT *, q % 5 + ri0 AS i, q // 5 % 5 + rj0 AS j, q // 25 + rk0 AS k FROM (SELECT p_partkey % 4 AS zone, p_partkey // 4 AS q, p_size FROM part) JOIN r USING (zone))
    SELECT zone, container, location, ({_GNUM})::BIGINT AS gnum, (i - a0 + 1 + (j - b0) * (a1 - a0 + 1) + (k - c0) * (a1 - a0 + 1) * (b1 - b0 + 1))::BIGINT AS index, 'size' AS name, p_size::DOUBLE AS value FROM d WHERE {_IN} AND i <= ri1 AND j <= rj1"""
)
def extracted_structured_partial(spark, sf_dir):
    data = _structured_fields(spark, sf_dir).withColumnRenamed("gnum", "place").drop("location")
    return extraction.structured_partial(data, _ranges(spark, sf_dir), _zones(spark, sf_dir))


# Windows of the zones that are named by nations: every third is flat in i.
_W = f"(SELECT n_nationkey AS zone, n_nationkey % 2 AS odd, 2 + n_nationkey % 4 AS i0, CASE WHEN n_nationkey % 3 = 0 THEN 2 + n_nationkey % 4 ELSE {SIDE - 1} END AS i1, 1 AS j0, {SIDE + 1} - n_nationkey % 5 AS j1, 3 AS k0, {SIDE} AS k1 FROM nation)"
_DEALT = f"""SELECT w.zone, w.odd, c.i, c.j, c.k, w.i0 = w.i1 AS flat, w.i0 AS wi0, w.j0 AS wj0, w.k0 AS wk0, b.part, b.i0 AS bi, b.j0 AS bj, b.k0 AS bk FROM {_W} w
    JOIN (SELECT i, j, k FROM range(1, {SIDE + 1}) x(i), range(1, {SIDE + 1}) y(j), range(1, {SIDE + 1}) u(k)) c ON (CASE WHEN w.i0 = w.i1 THEN i = greatest(w.i0 - 1, 1) ELSE i >= w.i0 AND i < w.i1 END) AND j >= w.j0 AND j < w.j1 AND k >= w.k0 AND k < w.k1
    JOIN {_BOXES} ON b.odd = w.odd AND i > b.i0 AND i <= b.i1 AND j > b.j0 AND j <= b.j1 AND k > b.k0 AND k <= b.k1"""


def _nation_windows(spark, sf_dir) -> DataFrame:
    z = F.col("n_nationkey")
    low = 2 + z % 4
    return table(spark, sf_dir, "nation").select(z.alias("zone"), low.alias("i0"), F.when(z % 3 == 0, low).otherwise(SIDE - 1).alias("i1"), F.lit(1).alias("j0"), (SIDE + 1 - z % 5).alias("j1"), F.lit(3).alias("k0"), F.lit(SIDE).alias("k1"))


@query(
    f"""SELECT zone, part, CASE WHEN flat THEN wi0 - bi ELSE min(i) - bi END AS i0, CASE WHEN flat THEN wi0 - bi ELSE max(i) + 1 - bi END AS i1, min(j) - bj AS j0, max(j) + 1 - bj AS j1, min(k) - bk AS k0, max(k) + 1 - bk AS k1,
    CASE WHEN flat THEN 0 ELSE min(i) - wi0 END AS oi, min(j) - wj0 AS oj, min(k) - wk0 AS ok FROM ({_DEALT}) GROUP BY zone, part, flat, wi0, wj0, wk0, bi, bj, bk"""
)
def extracted_pieces(spark, sf_dir):
    """Windows cut by the parts; the SQL deals every single cell or face."""
    return extraction.structured_pieces(_nation_windows(spark, sf_dir), boxes(spark, sf_dir)).withColumn("part", F.col("part").cast("long"))


@query(
    f"""WITH d AS ({_DEALT}), e AS (SELECT a.*, b.part AS donor_part, s.axis FROM d a, (VALUES ('i', 1, 0, 0), ('j', 0, 1, 0), ('k', 0, 0, 1)) s(axis, di, dj, dk), d b
    WHERE b.zone = a.zone AND b.i = a.i + di AND b.j = a.j + dj AND b.k = a.k + dk AND a.part <> b.part)
    SELECT zone, part, donor_part, axis, CASE WHEN flat THEN 1 WHEN axis = 'i' THEN max(i) + 2 - wi0 ELSE min(i) + 1 - wi0 END AS i0, CASE WHEN flat THEN 1 ELSE max(i) + 2 - wi0 END AS i1,
    CASE WHEN axis = 'j' THEN max(j) + 2 - wj0 ELSE min(j) + 1 - wj0 END AS j0, max(j) + 2 - wj0 AS j1, CASE WHEN axis = 'k' THEN max(k) + 2 - wk0 ELSE min(k) + 1 - wk0 END AS k0, max(k) + 2 - wk0 AS k1
    FROM e GROUP BY zone, part, donor_part, axis, flat, wi0, wj0, wk0"""
)
def extracted_neighbours(spark, sf_dir):
    """Planes between pieces; the SQL looks at every pair of cells side by side."""
    d = extraction.structured_neighbours(extraction.structured_pieces(_nation_windows(spark, sf_dir), boxes(spark, sf_dir)))
    return d.withColumn("part", F.col("part").cast("long")).withColumn("donor_part", F.col("donor_part").cast("long"))
