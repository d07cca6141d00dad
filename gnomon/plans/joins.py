"""Queries of structured joins on zones named by nations, and of components found in rounds, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, partition, structured
from .catalog import query, table

SIDE = 20
#: Zones of even number are cut into three boxes, the others into five.
_CUTS = {k: partition.split_block((SIDE,) * 3, [1.0, 2.0, 1.5, 1.0, 1.0][: 3 + 2 * k]) for k in (0, 1)}
_BOXES = "(VALUES " + ", ".join(f"({k}, {p}, {', '.join(str(v) for r in box for v in r)})" for k, boxes in _CUTS.items() for p, box in enumerate(boxes)) + ") b(odd, part, i0, i1, j0, j1, k0, k1)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, p, *[v for r in box for v in r]) for k, cut in _CUTS.items() for p, box in enumerate(cut)]
    d = spark.createDataFrame(rows, "odd long, part int, " + ", ".join(f"b{a}{s} long" for a in "ijk" for s in "01"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zone"), (F.col("n_nationkey") % 2).alias("odd")).join(d, "odd").drop("odd")


def ring_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last i of every zone meets the zone two on: its first i, straight or turned round by the number, or its last j with axes changed."""
    z, n = F.col("n_nationkey"), SIDE + 1
    kind = z % 3
    pick = lambda a, b, c: F.when(kind == 0, a).when(kind == 1, b).otherwise(c).cast("long")
    columns = {"i0": n, "i1": n, "j0": 1, "j1": n, "k0": 1, "k1": n}
    donors = {"di0": (1, 1, 1), "di1": (1, 1, n), "dj0": (1, n, n), "dj1": (n, 1, n), "dk0": (1, n, 1), "dk1": (n, 1, n), "t1": (1, 1, -2), "t2": (2, -2, 3), "t3": (3, -3, 1)}
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("to"), ((z + 2) % 25).cast("string")).alias("name"), z.alias("zone"), ((z + 2) % 25).alias("donor_zone"), F.concat(F.lit("from"), z.cast("string")).alias("donor_name"),
        *[F.lit(v).cast("long").alias(c) for c, v in columns.items()], *[pick(*v).alias(c) for c, v in donors.items()],
    )


_FACES_OF = f"""SELECT z, z % 3 AS kind, j, k, CASE z % 3 WHEN 2 THEN k ELSE 1 END AS di, CASE z % 3 WHEN 0 THEN j WHEN 1 THEN {SIDE + 1} - j ELSE {SIDE} END AS dj, CASE z % 3 WHEN 0 THEN k WHEN 1 THEN {SIDE + 1} - k ELSE j END AS dk
FROM (SELECT n_nationkey AS z FROM nation), range(1, {SIDE + 1}) a(j), range(1, {SIDE + 1}) c(k)"""
_MET = f"""SELECT f.*, a.part, d.part AS donor_part, a.j0 AS oj, a.k0 AS ok, d.i0 AS fi, d.j0 AS fj, d.k0 AS fk FROM ({_FACES_OF}) f
JOIN {_BOXES.replace(' b(', ' a(')} ON a.odd = z % 2 AND {SIDE} > a.i0 AND {SIDE} <= a.i1 AND j > a.j0 AND j <= a.j1 AND k > a.k0 AND k <= a.k1
JOIN {_BOXES.replace(' b(', ' d(')} ON d.odd = (z + 2) % 25 % 2 AND di > d.i0 AND di <= d.i1 AND dj > d.j0 AND dj <= d.j1 AND dk > d.k0 AND dk <= d.k1"""
_N = SIDE + 2


@query(
    f"""SELECT z AS zone, 'to' || (z + 2) % 25 || '.P' || part || '.P' || donor_part AS name, 'from' || z || '.P' || donor_part || '.P' || part AS donor_name, count(*) AS faces,
    min(j) - oj AS j0, max(j) + 1 - oj AS j1, min(k) - ok AS k0, max(k) + 1 - ok AS k1,
    CASE kind WHEN 0 THEN min(j) - fj WHEN 1 THEN {_N} - min(j) - fj ELSE min(j) - fk END AS a0, CASE kind WHEN 0 THEN max(j) + 1 - fj WHEN 1 THEN {_N} - max(j) - 1 - fj ELSE max(j) + 1 - fk END AS a1,
    CASE kind WHEN 0 THEN min(k) - fk WHEN 1 THEN {_N} - min(k) - fk ELSE min(k) - fi END AS b0, CASE kind WHEN 0 THEN max(k) + 1 - fk WHEN 1 THEN {_N} - max(k) - 1 - fk ELSE max(k) + 1 - fi END AS b1
    FROM ({_MET}) GROUP BY z, kind, part, donor_part, oj, ok, fi, fj, fk"""
)
def split_joins(spark, sf_dir):
    """Pieces of all joins on both sides; the SQL deals every single face of the windows to the boxes of its two cells."""
    d = structured.split_joins(ring_joins(spark, sf_dir), boxes(spark, sf_dir))
    n = structured.window_items(d.withColumn("name", F.concat("zone", F.lit("/"), "name"))).withColumnRenamed("n", "faces")
    d = d.withColumn("_key", F.concat("zone", F.lit("/"), "name")).join(n.withColumnRenamed("name", "_key"), "_key")
    turned = F.col("zone") % 3 == 2
    along = lambda a, b, s: F.when(turned, F.col(f"d{b}{s}")).otherwise(F.col(f"d{a}{s}"))
    return d.select("zone", "name", "donor_name", "faces", "j0", "j1", "k0", "k1", along("j", "k", 0).alias("a0"), along("j", "k", 1).alias("a1"), along("k", "i", 0).alias("b0"), along("k", "i", 1).alias("b1"))


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey + 3 + p_size % 5 AS b FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT u AS node, u AS root FROM b UNION SELECT v, root FROM reach JOIN b ON node = u WHERE root < v)
    SELECT node, min(root) AS component FROM reach GROUP BY node"""
)
def components_in_rounds(spark, sf_dir):
    """Components by star rounds alone, without finishing in one task."""
    k = F.col("p_partkey")
    e = table(spark, sf_dir, "part").filter(k % 7 != 0).select(k.alias("a"), (k + 3 + F.col("p_size") % 5).cast("long").alias("b"))
    return graph.connected_components(e, "a", "b", last=0)
