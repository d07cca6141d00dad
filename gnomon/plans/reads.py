"""Queries of reads by slabs that overlap, of dependent reads, and of links through several files, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import numbering, trees
from ..sources import store
from ..storage import fresh_path
from .catalog import query, table
from .inspection import _N, tree
from .more import _VALUES, _saved

_SHARE = "pos % 40 >= 3 AND pos % 40 < 25 AND pos >= 3 AND pos < 40 * (SELECT count(*) // 80 FROM part) + 25"


@query(f"SELECT path, pos, value FROM ({_VALUES}) WHERE {_SHARE}")
def stored_overlaps(spark, sf_dir):
    """Slabs of both arrays that overlap and touch each other: every position once."""
    path, nodes, _ = _saved(spark, sf_dir)
    n = F.floor(F.col("size") / 80) + 1
    slab = lambda first, block: F.struct(F.lit(first).cast("long").alias("first"), F.lit(40).cast("long").alias("stride"), F.lit(block).cast("long").alias("block"), n.cast("long").alias("count"))
    return store.load_slabs(spark, path, nodes.select("path", F.inline(F.array(slab(3, 10), slab(8, 12), slab(20, 5), slab(3, 22)))))


_ITEMS = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS item, count(*) OVER () AS n FROM orders"


@query(
    f"""WITH i AS ({_ITEMS}) SELECT 'Z/Polygons' AS path, item, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey), '') AS "values" FROM i LEFT JOIN lineitem ON l_orderkey = o_orderkey
    WHERE item >= n // 3 AND item < n // 3 + n // 4 GROUP BY item"""
)
def stored_polygons(spark, sf_dir):
    """Orders as polygons of differing size, their parts as corners: a share read by its offsets, then by what these say."""
    items = numbering.row_numbers(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "item")
    lines = numbering.row_numbers(table(spark, sf_dir, "lineitem").join(items.select(F.col("o_orderkey").alias("l_orderkey"), "item"), "l_orderkey").select("item", "l_linenumber", "l_partkey"), ["item", "l_linenumber", "l_partkey"], "at")
    sizes = items.select("item").join(lines.groupBy("item").count(), "item", "left").select("item", F.coalesce("count", F.lit(0)).cast("long").alias("n"))
    ends = numbering.exclusive_offsets(sizes, ["item"], "n", "low")
    row = lambda name, pos, value: (F.lit(f"Z/Polygons/{name}").alias("path"), pos.cast("long").alias("pos"), value.cast("double").alias("value"))
    values = lines.select(*row("ElementConnectivity", F.col("at") - 1, F.col("l_partkey")))
    # Item k begins at offset k - 1 and ends at offset k.
    values = values.unionByName(ends.select(*row("ElementStartOffset", F.col("item"), F.col("low") + F.col("n")))).unionByName(ends.filter("item = 1").select(*row("ElementStartOffset", F.lit(0), F.lit(0))))
    path = fresh_path(spark, "stored-polygons")
    store.save(values.groupBy("path").agg(F.count("*").alias("size")), values, path)
    share = items.agg(F.count("*").alias("n")).select(F.lit("Z/Polygons").alias("path"), F.floor(F.col("n") / 3).alias("first"), (F.floor(F.col("n") / 3) + F.floor(F.col("n") / 4)).alias("last"))
    d = store.load_polygons(spark, path, share)
    return d.select("path", "item", F.array_join(F.transform("values", lambda v: v.cast("bigint")), ",").alias("values"))


@query(
    f"""SELECT zone || '/Linked' || sub AS path, label FROM {_N}, (VALUES ('', 'ZoneBC_t'), ('/X:1', 'BC_t'), ('/X:1/Y', 'DataArray_t'), ('/Z', 'Family_t')) v(sub, label) WHERE k % 2 = 0
    UNION ALL SELECT zone || '/Linked', 'Link_t' FROM {_N} WHERE k % 2 = 1"""
)
def linked_chains(spark, sf_dir):
    """Names with colons, a link to a link to a node, one inside of what a link leads to, and links that lead nowhere, which stay."""
    t = tree(spark, sf_dir)
    z = t.filter("label = 'Zone_t'")
    k = F.regexp_extract("path", "Z([0-9]+)$", 1).cast("long")
    value = F.when(k % 2 == 0, F.lit('"first:/B:0/Way"')).otherwise(F.lit('"first:/B:0/Nowhere"'))
    link = z.select(F.concat("path", F.lit("/Linked")).alias("path"), value.alias("value"), F.lit("LK").alias("dtype"), F.lit("Link_t").alias("label"))
    rows = [
        ("first", "/B:0/Way", "Link_t", "LK", '"second:/C:CGNS#1/D:2"'), ("first", "/B:0/Wayside", "ZoneBC_t", None, None), ("second", "/C:CGNS#1/D:2", "ZoneBC_t", None, None),
        ("second", "/C:CGNS#1/D:2/X:1", "BC_t", None, None), ("second", "/C:CGNS#1/D:2/X:1/Y", "DataArray_t", None, None), ("second", "/C:CGNS#1/D:2/Z", "Link_t", "LK", '"third:/F"'), ("second", "/C:CGNS#1/D:20", "BC_t", None, None), ("third", "/F", "Family_t", None, None),
    ]
    others = spark.createDataFrame(rows, "file string, path string, label string, dtype string, value string")
    for c, kind in t.dtypes:
        if c not in others.columns:
            others = others.withColumn(c, F.lit(None).cast(kind))
    return store.resolved(trees.upsert(t, link), others).filter("path like '%/Linked%'").select("path", "label")
