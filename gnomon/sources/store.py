"""Trees with large arrays in Parquet: a node table, and a value table (path, pos, value) sorted by path and position.

Arrays are read in part by slabs, rows (path, first, stride, block, count): of the positions from `first` on, `block`
of every `stride`, `count` times.  The bounds of the slabs reach the scan, whose row groups are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.trees import path_parent, path_tail
from ..storage import stored

SLAB = "path string, first bigint, stride bigint, block bigint, count bigint"
#: Positions of an array that meet slabs in one task, and the most names of arrays that a scan is told.
CHUNK = 1 << 20
SCANNED = 200
#: Names of nodes of former versions that are taken out of a tree.
LEGACY = (":CGNS#Ppart",)
RANGE_NAMES = {"BC_t": "PointRange", "BCDataSet_t": "PointRange", "GridConnectivity1to1_t": "PointRange", "ZoneSubRegion_t": "PointRange"}


def save(nodes: DataFrame, values: DataFrame, path: str, mode: str = "errorifexists") -> None:
    nodes.write.mode(mode).parquet(f"{path}/nodes")
    values.repartitionByRange("path", "pos").sortWithinPartitions("path", "pos").write.mode(mode).parquet(f"{path}/values")


def load_sizes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes with the number of values of each, none of which is read."""
    return spark.read.parquet(f"{path}/nodes")


def load(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """The values of all or some nodes."""
    d = spark.read.parquet(f"{path}/values")
    return d if names is None else d.filter(F.col("path").isin(*names))


def merged_slabs(slabs: DataFrame) -> DataFrame:
    """(path, low, high): half-open stretches of positions that the slabs cover, none touching another of its path.

    Slabs are metadata: as many rows as there are blocks.  A stretch begins where no earlier one reaches, which the
    running maximum of the ends tells.
    """
    starts = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1), lambda k: F.col("first") + k * F.col("stride"))
    d = slabs.filter("count > 0 and block > 0").select("path", "block", F.explode(starts).alias("low")).select("path", "low", (F.col("low") + F.col("block")).alias("high")).distinct()
    w = Window.partitionBy("path").orderBy("low", "high")
    d = d.withColumn("_reach", F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("_run", F.sum((F.col("_reach").isNull() | (F.col("low") > F.col("_reach"))).cast("int")).over(w))
    return d.groupBy("path", "_run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_run")


def load_slabs(spark: SparkSession, path: str, slabs: DataFrame, paths: Sequence[str] | None = None) -> DataFrame:
    """(path, pos, value) of the positions in the slabs, each once, as often as it is stored.

    Overlapping slabs are put together first.  Values and stretches meet on (path, chunk of positions), so a large array
    is many tasks, and a value meets the stretches of its chunk only.  The bounds of the slabs, and the names of the
    arrays if they are given (or SCANNED at most), reach the scan, whose row groups are sorted by both.
    """
    s = merged_slabs(slabs)
    edge = s.agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    v = spark.read.parquet(f"{path}/values")
    if edge["low"] is None:
        return v.limit(0)
    if paths is None:
        some = [r[0] for r in s.select("path").distinct().limit(SCANNED + 1).collect()]
        paths = some if len(some) <= SCANNED else None
    if paths is not None:
        v = v.filter(F.col("path").isin(*paths))
    v = v.filter((F.col("pos") >= edge["low"]) & (F.col("pos") < edge["high"]))
    chunk = lambda c: F.floor(c / CHUNK).cast("bigint")
    s = s.select("path", "low", "high", F.explode(F.sequence(chunk(F.col("low")), chunk(F.col("high") - 1))).alias("_chunk"))
    d = v.withColumn("_chunk", chunk(F.col("pos"))).join(s, ["path", "_chunk"])
    return d.filter((F.col("pos") >= F.col("low")) & (F.col("pos") < F.col("high"))).select("path", "pos", "value")


def dependent_slabs(offsets: DataFrame, ranges: DataFrame, target: str, width: int = 1) -> DataFrame:
    """Slabs of the arrays that offsets point into, for a share of their items: the second read depends on the values of the first.

    offsets are (path, pos, value) of arrays of n + 1 offsets, ranges (path, first, last) of items; the slab of a range
    goes from the offset of its first item to that of its last in the array beside it that is called `target`.
    """
    at = lambda c, name: offsets.select("path", F.col("pos").alias(c), F.col("value").cast("bigint").alias(name))
    d = ranges.filter("last > first").select("path", "first", "last").join(at("first", "_low"), ["path", "first"]).join(at("last", "_high"), ["path", "last"])
    size = (F.col("_high") - F.col("_low")) * width
    other = F.concat(path_parent(F.col("path")), F.lit("/" + target))
    return d.select(other.alias("path"), (F.col("_low") * width).alias("first"), size.alias("stride"), size.alias("block"), F.lit(1).cast("bigint").alias("count")).filter("block > 0")


def load_polygons(spark: SparkSession, path: str, ranges: DataFrame, offset: str = "ElementStartOffset", values: str = "ElementConnectivity") -> DataFrame:
    """(path, item, values) of a share of the items of sections whose items differ in size, ranges being (path of the section, first, last).

    Two reads: the offsets of the share, one more than items, and then what lies between them, for all sections at once.
    Items without values have an empty array.
    """
    r = ranges.filter("last > first").select(F.concat("path", F.lit("/" + offset)).alias("path"), F.col("first").cast("bigint"), F.col("last").cast("bigint"))
    offs = stored(load_slabs(spark, path, flat_slabs(r.select("path", "first", (F.col("last") + 1).alias("last")))), "offsets")
    got = load_slabs(spark, path, dependent_slabs(offs, r, values))
    # An item's values are those from its own offset on: both are dealt by the section and a chunk of positions.
    o = offs.join(r, "path").filter((F.col("pos") >= F.col("first")) & (F.col("pos") <= F.col("last"))).select("path", "pos", F.col("value").cast("bigint").alias("at"), "first", "last").distinct()
    following = o.select("path", (F.col("pos") - 1).alias("pos"), F.col("at").alias("end"))
    items = o.filter(F.col("pos") < F.col("last")).select("path", "pos", "at").distinct().join(following.distinct(), ["path", "pos"]).select(path_parent(F.col("path")).alias("path"), F.col("pos").alias("item"), "at", "end")
    place = items.select("path", "item", F.explode(F.when(F.col("end") > F.col("at"), F.sequence("at", F.col("end") - 1)).otherwise(F.array().cast("array<bigint>"))).alias("pos"))
    d = place.join(got.select(path_parent(F.col("path")).alias("path"), "pos", "value"), ["path", "pos"])
    lists = d.groupBy("path", "item").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))
    kind = dict(lists.dtypes)["values"]
    return items.select("path", "item").join(lists, ["path", "item"], "left").select("path", "item", F.coalesce("values", F.array().cast(kind)).alias("values"))


def flat_slabs(ranges: DataFrame) -> DataFrame:
    """Slabs of plain arrays, from (path, first, last)."""
    return ranges.select("path", F.col("first").cast("bigint"), (F.col("last") - F.col("first")).cast("bigint").alias("stride"), (F.col("last") - F.col("first")).cast("bigint").alias("block"), F.lit(1).cast("bigint").alias("count")).filter("block > 0")


def pair_slabs(ranges: DataFrame) -> DataFrame:
    """Slabs of arrays of two columns, one after the other (parents of faces), from (path, first, last, total)."""
    return ranges.select("path", F.col("first").cast("bigint"), F.col("total").cast("bigint").alias("stride"), (F.col("last") - F.col("first")).cast("bigint").alias("block"), F.lit(2).cast("bigint").alias("count")).filter("block > 0")


def block_slabs(ranges: DataFrame, width: int) -> DataFrame:
    """Slabs of arrays of `width` values an item, from (path, first, last) in items."""
    n = (F.col("last") - F.col("first")) * width
    return ranges.select("path", (F.col("first") * width).cast("bigint").alias("first"), n.cast("bigint").alias("stride"), n.cast("bigint").alias("block"), F.lit(1).cast("bigint").alias("count")).filter("block > 0")


def part_ranges(nodes: DataFrame, parts: int, part: int) -> DataFrame:
    """(path, first, last, total): the even share that one part has of each array."""
    n = F.col("size")
    at = lambda p: (F.floor(n / parts) * p + F.least(F.lit(p), n % parts)).cast("bigint")
    return nodes.filter("size > 0").select("path", at(part).alias("first"), at(part + 1).alias("last"), n.alias("total"))


def links(nodes: DataFrame) -> DataFrame:
    """(path, file, target): nodes that stand for a node of another file; their value is file:target, cut at the first colon (names in a path may hold more)."""
    v = F.regexp_replace("value", '^"|"$', "")
    cut = F.instr(v, ":")
    return nodes.filter("dtype = 'LK'").select("path", F.when(cut > 0, F.substring(v, F.lit(1), cut - 1)).alias("file"), F.when(cut > 0, F.substring(v, cut + 1, F.length(v))).alias("target"))


def _ancestors(path: Column) -> Column:
    """The path itself and all above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def resolved(nodes: DataFrame, others: DataFrame, depth: int = 16) -> DataFrame:
    """The tree with each link replaced by what it points to in the node tables of other files (file, path, ..): the node and all below it.

    A link that leads to a link is followed, up to `depth` times; then, as for a circle, ValueError.  A link without a
    target, or whose target is not there, stays as it is.
    """
    linked = lambda d: F.coalesce(F.col("dtype") == "LK", F.lit(False))
    done, rest = nodes.filter(~linked(nodes)), nodes.filter(linked(nodes))
    dead = rest.limit(0)
    # A node of a file stands below each of its ancestors once, so links meet what they need by equality.
    below = others.withColumnRenamed("path", "_from").withColumn("target", F.explode(_ancestors(F.col("_from"))))
    for _ in range(depth):
        rest = stored(rest, "links")
        if rest.isEmpty():
            return done.unionByName(dead)
        found = links(rest).withColumnRenamed("path", "_at")
        moved = below.join(found, ["file", "target"])
        path = F.concat("_at", F.substring(F.col("_from"), F.length("target") + 1, F.length("_from")))
        moved = moved.withColumn("path", path).withColumns({"parent": path_parent(F.col("path")), "name": path_tail(F.col("path")), "depth": F.size(F.split("path", "/"))})
        moved = stored(moved.select(*nodes.columns), "resolved")
        roots = moved.select("path").join(rest.select("path"), "path", "left_semi").distinct()
        dead = dead.unionByName(rest.join(roots, "path", "left_anti"))
        done, rest = done.unionByName(moved.filter(~linked(moved))), moved.filter(linked(moved))
    if rest.isEmpty():
        return done.unionByName(dead)
    raise ValueError(f"links lead through more than {depth} others, or in a circle")


def without_legacy(nodes: DataFrame, names: Sequence[str] = LEGACY) -> DataFrame:
    """The tree without nodes of the given names and all below them."""
    gone = F.lit(False)
    for n in names:
        gone = gone | F.array_contains(F.split("path", "/"), n)
    return nodes.filter(~gone)


def with_range_names(nodes: DataFrame) -> DataFrame:
    """Index ranges and lists of subsets under the names that the standard gives them, whatever they were called."""
    parents = nodes.filter(F.col("label").isin(*RANGE_NAMES)).select(F.col("path").alias("parent"), F.lit(True).alias("_subset"))
    d = nodes.join(parents, "parent", "left")
    donor = F.col("name").contains("Donor")
    kind = F.when(F.col("label") == "IndexRange_t", "PointRange").when(F.col("label") == "IndexArray_t", "PointList")
    name = F.when(F.col("_subset") & kind.isNotNull() & ~F.col("name").startswith("Inward"), F.concat(kind, F.when(donor, "Donor").otherwise(""))).otherwise(F.col("name"))
    return d.withColumn("name", name).withColumn("path", F.when(F.col("parent") == "", F.col("name")).otherwise(F.concat("parent", F.lit("/"), "name"))).select(*nodes.columns)


def size_faults(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """(path, size, n): nodes whose stated size is not the number of their values."""
    n = values.groupBy("path").agg(F.count("*").alias("n"))
    d = nodes.filter("size is not null").select("path", "size").join(n, "path", "full_outer")
    return d.filter(~F.col("size").eqNullSafe(F.coalesce("n", F.lit(0)))).select("path", "size", F.coalesce("n", F.lit(0)).alias("n"))


def symmetric_joins(joins: DataFrame) -> DataFrame:
    """Joins (zone, name, points, donor_zone, donor_name, donor_points): of two that point at each other, the one of the lesser (zone, name) gives the points of both."""
    back = joins.select(F.col("zone").alias("donor_zone"), F.col("name").alias("donor_name"), F.col("donor_zone").alias("zone"), F.col("donor_name").alias("name"), F.col("points").alias("_p"), F.col("donor_points").alias("_d"))
    d = joins.join(back, ["zone", "name", "donor_zone", "donor_name"], "left")
    later = F.struct("zone", "name") > F.struct("donor_zone", "donor_name")
    pick = lambda own, other: F.when(later & F.col(other).isNotNull(), F.col(other)).otherwise(F.col(own))
    return d.select("zone", "name", pick("points", "_d").alias("points"), "donor_zone", "donor_name", pick("donor_points", "_p").alias("donor_points"))


def oriented_ranges(low: Sequence[Column], high: Sequence[Column], transform: Sequence[Column]) -> list[tuple[Column, Column]]:
    """A donor range whose corners follow the own range, ascending, through the transform: directions of negative sign descend."""
    return [(F.when(t < 0, F.greatest(a, b)).otherwise(F.least(a, b)), F.when(t < 0, F.least(a, b)).otherwise(F.greatest(a, b))) for a, b, t in zip(low, high, transform)]
