"""Subsets of a mesh: extraction by name or family with fields, data on subset items, and faces between the distributed and the partitioned form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import numbering


def named_items(items: DataFrame, names: Sequence[str] | None = None, families: DataFrame | None = None, family: str | None = None) -> DataFrame:
    """(gnum): the items (name, gnum) of some subsets, given by name or by family (name, family); each once."""
    d = items
    if names is not None:
        d = d.filter(F.col("name").isin(*names))
    if family is not None:
        d = d.join(families.filter(F.col("family") == family).select("name").distinct(), "name", "left_semi")
    return d.select("gnum").distinct()


def extract_faces(faces: DataFrame, vertices: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) of the wanted faces (gnum) as a mesh of its own: (face, old, vtx) and (vertex, old, x, y, z), both numbered in the order of the old numbers."""
    kept = faces.select(F.col("face").alias("old"), "vtx").join(wanted.select(F.col("gnum").alias("old")), "old", "left_semi")
    links = kept.select("old", F.posexplode("vtx").alias("_pos", "_v"))
    ids = numbering.row_numbers(links.select(F.col("_v").alias("old")).distinct(), ["old"], "vertex")
    vtx = links.join(ids.withColumnRenamed("old", "_v"), "_v").groupBy("old").agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "vertex"))), lambda x: x["vertex"]).alias("vtx"))
    out = vtx.join(numbering.row_numbers(kept.select("old"), ["old"], "face"), "old").select("face", "old", "vtx")
    return out, ids.join(vertices.withColumnRenamed("vertex", "old"), "old").select("vertex", "old", "x", "y", "z")


def carried(extracted: DataFrame, field: DataFrame, number: str, key: str, values: Sequence[str]) -> DataFrame:
    """(number, values): a field of the whole mesh on the extracted one, whose rows know their old number; null where there is none."""
    return extracted.select(number, F.col("old").alias(key)).join(field.select(key, *values), key, "left").select(number, *values)


def item_numbers(items: DataFrame) -> DataFrame:
    """(zone, name, gnum, place): items found on any part, each subset's numbered from 1 in the order of gnum; equal ones share a number."""
    d = numbering.row_numbers(items.select("zone", "name", "gnum").distinct(), ["zone", "name", "gnum"], "_rn")
    first = d.groupBy("zone", "name").agg(F.min("_rn").alias("_first"))
    return d.join(first, ["zone", "name"]).select("zone", "name", "gnum", (F.col("_rn") - F.col("_first") + 1).alias("place"))


def data_to_parts(data: DataFrame, items: DataFrame, part_map: DataFrame, values: Sequence[str]) -> DataFrame:
    """(zone, name, part, lnum, place, values): data given by the place in a subset, on every part that holds the item."""
    of = items.join(data.select("zone", "name", "place", *values), ["zone", "name", "place"])
    return of.join(part_map.select("zone", "gnum", "part", "lnum"), ["zone", "gnum"]).select("zone", "name", "part", "lnum", "place", *values)


def data_from_parts(parts: DataFrame, values: Sequence[str]) -> DataFrame:
    """(zone, name, place, values): one row an item; of copies, that of the least part."""
    return parts.groupBy("zone", "name", "place").agg(*[F.min_by(v, "part").alias(v) for v in values])


def faces_to_parts(faces: DataFrame, cell_parts: DataFrame, vertex_parts: DataFrame) -> DataFrame:
    """(part, face, left, right, vtx): the faces of each part's cells, in its local cell and vertex numbers; 0 where the other cell is elsewhere."""
    own = lambda c: cell_parts.select(F.col("cell").alias(c), F.col("part"), F.col("lnum").alias(f"_{c}"))
    sides = faces.select("face", F.explode(F.array_distinct(F.array("left", "right"))).alias("cell")).join(cell_parts.select("cell", "part"), "cell")
    d = sides.select("face", "part").distinct().join(faces, "face")
    for c in ("left", "right"):
        d = d.join(own(c), [c, "part"], "left")
    v = d.select("face", "part", F.posexplode("vtx").alias("_pos", "vertex")).join(vertex_parts.select("vertex", "part", "lnum"), ["vertex", "part"])
    v = v.groupBy("face", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "lnum"))), lambda x: x["lnum"]).alias("_vtx"))
    return d.join(v, ["face", "part"]).select("part", "face", F.coalesce("_left", F.lit(0)).alias("left"), F.coalesce("_right", F.lit(0)).alias("right"), F.col("_vtx").alias("vtx"))


def faces_from_parts(parts: DataFrame, cell_parts: DataFrame, vertex_parts: DataFrame) -> DataFrame:
    """(face, left, right, vtx): the distributed faces of faces_to_parts' rows; the parts on both sides of a face complete each other."""
    own = lambda c: cell_parts.select(F.col("cell").alias(f"_{c}"), "part", F.col("lnum").alias(c))
    d = parts
    for c in ("left", "right"):
        d = d.join(own(c), [c, "part"], "left")
    v = d.select("face", "part", F.posexplode("vtx").alias("_pos", "lnum")).join(vertex_parts.select("vertex", "part", "lnum"), ["lnum", "part"])
    v = v.groupBy("face", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "vertex"))), lambda x: x["vertex"]).alias("vtx"))
    cells = d.groupBy("face").agg(F.coalesce(F.max("_left"), F.lit(0)).alias("left"), F.coalesce(F.max("_right"), F.lit(0)).alias("right"))
    return cells.join(v.groupBy("face").agg(F.min_by("vtx", "part").alias("vtx")), "face")


def distributions(sizes: DataFrame, parts: int) -> DataFrame:
    """(name, part, first, last, total): even splits of each entity's n items into half-open ranges; the first parts have one more."""
    q, r = F.floor(F.col("n") / parts), F.col("n") % parts
    d = sizes.select("name", "n", q.alias("_q"), r.alias("_r"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    at = lambda p: p * F.col("_q") + F.least(p, F.col("_r"))
    return d.select("name", "part", at(F.col("part")).alias("first"), at(F.col("part") + 1).alias("last"), F.col("n").alias("total"))


def read_range(values: DataFrame, first: int, last: int, position: str = "pos") -> DataFrame:
    """The values (pos, ..) with first <= pos < last; the bounds reach the scan, so a sorted table is read in part."""
    return values.filter((F.col(position) >= first) & (F.col(position) < last))
