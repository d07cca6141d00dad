"""Queries of cut blocks: the block of all parts in boxes of given volumes and weights, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import block_cuts, partition
from .catalog import query, table

WEIGHTS = (3.0, 1.0, 2.0, 5.0, 1.0, 4.0, 2.0)


@query(
    """SELECT count(*) AS cells, 7::BIGINT AS parts, 0::BIGINT AS repeated, true AS filled, true AS within_layer, true AS better, (SELECT 35 * (max(p_partkey) // 35 + 1) FROM part) AS volume FROM part"""
)
def cut_volumes(spark, sf_dir):
    """Seven boxes of the block: every cell in one, all boxes full but for the block's last layer, volumes within a layer and nearer than those of cuts that are not refined (where these are not exact already)."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("cell"))
    dims = (5, 7, p.agg(F.max("cell")).first()[0] // 35 + (p.agg(F.max("cell")).first()[0] % 35 > 0))
    boxes = block_cuts.cut_block(dims, WEIGHTS)
    table_ = spark.createDataFrame([("Z", n, *[v for r in b for v in r]) for n, b in enumerate(boxes)], "zone string, part int, " + ", ".join(f"b{a}{s} long" for a in "ijk" for s in "01"))
    v = block_cuts.volumes(table_)
    # The volumes that the cells themselves show: distinct local numbers, up to the box's volume.
    d = partition.in_boxes(p, dims, boxes).groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("lnum").alias("distinct"), F.max("lnum").alias("most")).join(v, "part")
    whole, total = dims[0] * dims[1] * dims[2], sum(WEIGHTS)
    longest = F.greatest(*[F.col(f"b{a}1") - F.col(f"b{a}0") for a in "ijk"])
    share = F.element_at(F.array(*[F.lit(whole * w / total) for w in WEIGHTS]), F.col("part") + 1)
    d = d.join(table_.select("part", longest.alias("longest")), "part").withColumn("off", F.abs(F.col("cells") - share) * F.col("longest") / F.col("cells"))
    plain = max(block_cuts.deviations(partition.split_block(dims, WEIGHTS), WEIGHTS))
    return d.agg(
        F.sum("n").alias("cells"), F.count("*").alias("parts"), F.sum(F.col("n") - F.col("distinct")).alias("repeated"), (F.bool_and(F.col("most") <= F.col("cells")) & (F.sum(F.col("cells") - F.col("n")) < 35)).alias("filled"),
        (F.max("off") <= 1).alias("within_layer"), ((F.max("off") < plain) | (F.max("off") == 0)).alias("better"), F.sum("cells").alias("volume"),
    )


def _cut(name: str, box: str, share: str, before: int, after: int) -> str:
    """CTEs that cut the cells of `box` (with i0, i1, .. of the box) across its longest side."""
    side = "CASE WHEN i1 - i0 >= greatest(j1 - j0, k1 - k0) THEN 'i' WHEN j1 - j0 >= k1 - k0 THEN 'j' ELSE 'k' END"
    pick = lambda a, b, c: f"CASE axis WHEN 'i' THEN {a} WHEN 'j' THEN {b} ELSE {c} END"
    room = pick("(j1 - j0) * (k1 - k0)", "(i1 - i0) * (k1 - k0)", "(i1 - i0) * (j1 - j0)")
    return f"""{name}a AS (SELECT *, {side} AS axis FROM {box}), {name}b AS (SELECT *, {pick('i', 'j', 'k')} AS layer, {pick('i0', 'j0', 'k0')} + ceil({before}.0 / ({room})) AS first, {pick('i1', 'j1', 'k1')} - ceil({after}.0 / ({room})) AS last FROM {name}a),
    {name}p AS (SELECT DISTINCT spot FROM (SELECT unnest(range(min(first)::BIGINT, max(last)::BIGINT + 1)) AS spot FROM {name}b)),
    {name}s AS (SELECT spot, abs(sum(CASE WHEN layer < spot THEN size ELSE 0 END) - {share} * sum(size)) AS off FROM {name}b, {name}p GROUP BY spot), {name}c AS (SELECT arg_min(spot, (off, spot)) AS cut FROM {name}s)"""


@query(
    f"""WITH cells AS (SELECT p_partkey + 1 AS cell, p_partkey % 5 AS i, p_partkey // 5 % 7 AS j, p_partkey // 35 AS k, p_size::DOUBLE AS size, 0 AS i0, 5 AS i1, 0 AS j0, 7 AS j1, 0 AS k0, max(p_partkey) OVER () // 35 + 1 AS k1 FROM part),
    {_cut('x', 'cells', '0.25::DOUBLE', 1, 2)}, low AS (SELECT cell, i, j, k, size, i0, CASE axis WHEN 'i' THEN cut ELSE i1 END AS i1, j0, CASE axis WHEN 'j' THEN cut ELSE j1 END AS j1, k0, CASE axis WHEN 'k' THEN cut ELSE k1 END AS k1, 0 AS part FROM xb, xc WHERE layer < cut),
    high AS (SELECT cell, i, j, k, size, CASE axis WHEN 'i' THEN cut ELSE i0 END AS i0, i1, CASE axis WHEN 'j' THEN cut ELSE j0 END AS j0, j1, CASE axis WHEN 'k' THEN cut ELSE k0 END AS k0, k1 FROM xb, xc WHERE layer >= cut),
    {_cut('y', 'high', '(2::DOUBLE / 3)', 1, 1)}, mid AS (SELECT cell, i, j, k, i0, CASE axis WHEN 'i' THEN cut ELSE i1 END AS i1, j0, CASE axis WHEN 'j' THEN cut ELSE j1 END AS j1, k0, 1 AS part FROM yb, yc WHERE layer < cut),
    top AS (SELECT cell, i, j, k, CASE axis WHEN 'i' THEN cut ELSE i0 END AS i0, i1, CASE axis WHEN 'j' THEN cut ELSE j0 END AS j0, j1, CASE axis WHEN 'k' THEN cut ELSE k0 END AS k0, 2 AS part FROM yb, yc WHERE layer >= cut)
    SELECT cell, part::BIGINT AS part, (1 + i - i0 + (j - j0) * (i1 - i0) + (k - k0) * (i1 - i0) * (j1 - j0))::BIGINT AS lnum
    FROM (SELECT cell, i, j, k, i0, i1, j0, j1, k0, part FROM low UNION ALL SELECT cell, i, j, k, i0, i1, j0, j1, k0, part FROM mid UNION ALL SELECT cell, i, j, k, i0, i1, j0, j1, k0, part FROM top)"""
)
def cut_by_cell_weights(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("cell"), "p_size")
    layers = -(-p.agg(F.max("cell")).first()[0] // 35)
    d = block_cuts.by_cell_weights(p, (5, 7, layers), [1.0, 2.0, 1.0], "p_size")
    return d.withColumn("part", F.col("part").cast("long"))
