"""Fields between the distributed and the partitioned form of a mesh.

Fields are rows (zone, label, container, location, gnum, name, value); a partitioning is (zone, location, part, lnum,
gnum).  Going to parts is an equi-join, going back an aggregation by number, both on (zone, location, gnum).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import trees

LABELS = ("FlowSolution_t", "DiscreteData_t", "ZoneSubRegion_t", "BCDataSet_t")
KEY = ("zone", "location", "gnum")


def _matches(masks: Mapping[str, Sequence[str]]) -> Column:
    """Rows named by the masks: for each label, patterns `container` or `container/name` with wildcards."""
    out = F.lit(False)
    for label, patterns in masks.items():
        for p in patterns:
            container, _, name = p.partition("/")
            hit = (F.col("label") == label) & trees.wildcard(F.col("container"), container)
            out = out | (hit & trees.wildcard(F.col("name"), name) if name else hit)
    return out


def chosen(fields: DataFrame, include: Mapping[str, Sequence[str]] | None = None, exclude: Mapping[str, Sequence[str]] | None = None, labels: Sequence[str] | None = None) -> DataFrame:
    """Fields to move: those included, or all but those excluded (not both), of some labels if given.  The filter reaches the scan."""
    if include is not None and exclude is not None:
        raise ValueError("include and exclude cannot be given together")
    d = fields if labels is None else fields.filter(F.col("label").isin(*labels))
    if include is not None:
        return d.filter(_matches(include))
    return d if not exclude else d.filter(~_matches(exclude))


def to_parts(fields: DataFrame, part_map: DataFrame, **masks) -> DataFrame:
    """(zone, label, container, location, part, lnum, gnum, name, value): every copy of an entity gets its values."""
    d = chosen(fields, **masks).join(part_map.select(*KEY, "part", "lnum"), list(KEY))
    return d.select("zone", "label", "container", "location", "part", "lnum", "gnum", "name", "value")


def from_parts(fields: DataFrame, reduce: str = "one", **masks) -> DataFrame:
    """Distributed fields from partitioned ones: of copies, one is kept (that of the least part), or their sum, min, max or mean."""
    v = {
        "one": F.min_by("value", F.struct("part", "lnum")), "sum": F.sum("value"), "min": F.min("value"), "max": F.max("value"), "mean": F.avg("value"),
    }[reduce]
    return chosen(fields, **masks).groupBy("zone", "label", "container", "location", "gnum", "name").agg(v.alias("value"))


def vertices_to_parts(vertices: DataFrame, part_map: DataFrame) -> DataFrame:
    """(part, lnum, vertex, x, y, z): coordinates of each part."""
    return part_map.select("vertex", "part", "lnum").join(vertices, "vertex").select("part", "lnum", "vertex", "x", "y", "z")


def subset_to_parts(subset: DataFrame, part_map: DataFrame) -> DataFrame:
    """Items (zone, location, name, gnum) of subsets with their part and local number; a part without any has no row."""
    return subset.join(part_map, list(KEY)).select("zone", "location", "name", "part", "lnum", "gnum")


def subset_from_parts(items: DataFrame) -> DataFrame:
    """The subsets of all parts, each item once."""
    return items.select("zone", "location", "name", "gnum").distinct()


def split_joins(joins: DataFrame, part_map: DataFrame) -> DataFrame:
    """Joins (zone, name, gnum, donor_zone, donor_gnum) with part and local number on both sides: one join for each pair of parts."""
    own = part_map.select("zone", "gnum", "part", "lnum")
    donor = part_map.select(F.col("zone").alias("donor_zone"), F.col("gnum").alias("donor_gnum"), F.col("part").alias("donor_part"), F.col("lnum").alias("donor_lnum"))
    return joins.join(own, ["zone", "gnum"]).join(donor, ["donor_zone", "donor_gnum"])


def elements_from_parts(elements: DataFrame, vertex_map: DataFrame) -> DataFrame:
    """(zone, section, gnum, vtx): sections of the whole zone from those of the parts (zone, section, part, gnum, vtx in local numbers): an element that several parts hold comes once, with global vertices."""
    once = elements.groupBy("zone", "section", "gnum").agg(F.min_by(F.struct("part", "vtx"), "part").alias("_e")).select("zone", "section", "gnum", "_e.part", F.posexplode("_e.vtx").alias("_pos", "lnum"))
    of = vertex_map.select("zone", "part", "lnum", F.col("gnum").alias("_v"))
    d = once.join(of, ["zone", "part", "lnum"]).groupBy("zone", "section", "gnum")
    return d.agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_v"))), lambda x: x["_v"]).alias("vtx"))


def element_numbers(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """elements (zone, section, gnum, ..) with `number`, counted over all sections (zone, section, ord, size) of the zone in their order; a zone has few sections."""
    w = Window.partitionBy("zone").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    before = sections.select("zone", "section", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("_before"))
    return elements.join(before, ["zone", "section"]).withColumn("number", F.col("gnum") + F.col("_before")).drop("_before")
