"""Whole trees through partitioning and back.

A distributed tree is a node table (path, parent, name, label, value, ..) and a value table (path, pos, value), as
gnomon.sources.store keeps it; a partitioned one has a further column `part` in both.  Paths begin with base and zone.
A zone is unstructured, its faces are one section with ElementStartOffset, ElementConnectivity and ParentElements (the
left cells of all faces, then the right ones, 0 outside); cells need no section of their own.

All arrays are treated alike, as rows: an array of a vertex, face or cell container meets the parts of its entities
in one join; arrays of subsets (with a PointList) meet the parts of the subset's items.  A partitioned zone holds the
global numbers of what it got, below :CGNS#GlobalNumbering, and joins to the parts that share faces with it.  From these
numbers the distributed tree is put together again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import numbering
from .partition import local_numbers

NUMBERS = ":CGNS#GlobalNumbering"
SECTION = ("ElementStartOffset", "ElementConnectivity", "ParentElements")
#: The kind of entity that a grid location names.
KINDS = {"Vertex": "Vertex", "CellCenter": "Cell", "FaceCenter": "Face"}
KINDS_OF_ENTITIES = tuple(KINDS.values())
JOIN = "JN.P"
#: Corners of sections that are kept together while faces look them up.
BLOCK = 1_024


def zone_of(path: Column) -> Column:
    return F.substring_index(path, "/", 2)


def _parent(path: Column) -> Column:
    # No pattern: this is done for every value.
    return F.when(path.contains("/"), F.substring(path, F.lit(1), F.length(path) - F.length(_name(path)) - 1)).otherwise(path)


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def arrays(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """(path, zone, kind, owner) of every array: kind is Vertex, Face or Cell; Section for those of faces; Subset with its owner, the
    nearest node above that has a PointList; or Whole for what does not depend on entities and goes to every part."""
    places = nodes.filter("name = 'GridLocation'").select(F.col("parent").alias("owner"), F.regexp_replace("value", '^"|"$', "").alias("location"))
    lists = nodes.filter("name = 'PointList'").select(F.col("parent").alias("owner"), F.lit(True).alias("_list"))
    labels = nodes.select(F.col("path").alias("owner"), "label")
    about = labels.join(places, "owner", "left").join(lists, "owner", "left")
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    # The nodes above an array, nearest first: an array is metadata, so these are few rows.
    paths = values.select("path").distinct()
    above = paths.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - n), "/"))).alias("far", "owner")).join(about, "owner")
    subset = F.min_by(F.when(F.col("_list"), F.col("owner")), F.when(F.col("_list"), F.col("far"))).alias("subset")
    holder = F.col("label").isin("GridCoordinates_t", "FlowSolution_t", "DiscreteData_t")
    kind = F.min_by(F.when(holder, F.when(F.col("label") == "GridCoordinates_t", "Vertex").otherwise(F.coalesce(F.element_at(kinds, F.col("location")), F.lit("Vertex")))), F.when(holder, F.col("far"))).alias("kind")
    section = F.max(F.col("label") == "Elements_t").alias("section")
    d = above.groupBy("path").agg(subset, kind, section)
    kind = F.when(F.col("section"), "Section").when(F.col("subset").isNotNull(), "Subset").otherwise(F.coalesce("kind", F.lit("Whole")))
    return d.select("path", zone_of(F.col("path")).alias("zone"), kind.alias("kind"), F.col("subset").alias("owner"))


def subset_kinds(nodes: DataFrame) -> DataFrame:
    """(owner, zone, kind): what the PointList of a subset lists, by its GridLocation; without one vertices."""
    places = nodes.filter("name = 'GridLocation'").select(F.col("parent").alias("owner"), F.regexp_replace("value", '^"|"$', "").alias("location"))
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    d = nodes.filter("name = 'PointList'").select(F.col("parent").alias("owner")).join(places, "owner", "left")
    return d.select("owner", zone_of(F.col("owner")).alias("zone"), F.coalesce(F.element_at(kinds, F.col("location")), F.lit("Vertex")).alias("kind"))


def section_faces(values: DataFrame, keys: Sequence[str] = (), numbers: DataFrame | None = None) -> DataFrame:
    """(keys, zone, section, face, left, right, vtx) from the values of sections of faces; keys are further columns that tell trees apart.

    With numbers (keys, zone, kind, lnum, gnum) the vertices get their global numbers before they are put together to faces.
    """
    key = [*keys, "section"]
    of = lambda name: values.filter(F.col("path").endswith(f"/{name}")).select(*keys, _parent(F.col("path")).alias("section"), "pos", F.col("value").cast("long").alias("value"))
    offset, corners, parents = (of(name) for name in SECTION)
    if numbers is not None:
        v = numbers.filter("kind = 'Vertex'").select(F.col("lnum").alias("value"), *keys, "zone", "gnum")
        corners = corners.withColumn("zone", zone_of(F.col("section"))).join(v, ["value", *keys, "zone"]).select(*key, "pos", F.col("gnum").alias("value"))
    ends = offset.select(*key, (F.col("pos") - 1).alias("pos"), F.col("value").alias("end"))
    faces = offset.withColumnRenamed("value", "at").join(ends, ["pos", *key])
    # A face takes its corners from the blocks that it lies in, one for most, instead of meeting each by a row; positions of an array have no gaps.
    blocks = corners.withColumn("_b", F.floor(F.col("pos") / BLOCK)).repartition("_b", *key)
    blocks = blocks.groupBy("_b", *key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("_all"))
    pieces = faces.select(*key, (F.col("pos") + 1).alias("face"), "at", "end", F.explode(F.sequence(F.floor(F.col("at") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))).alias("_b"))
    lo, hi = F.greatest(F.col("at") - F.col("_b") * BLOCK, F.lit(0)), F.least(F.col("end") - F.col("_b") * BLOCK, F.lit(BLOCK))
    rings = pieces.filter("at < end").join(blocks.hint("merge"), ["_b", *key]).select("face", *key, "_b", F.slice("_all", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("_some"))
    rings = rings.repartition("face", *key).groupBy("face", *key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_b", "_some"))), lambda x: x["_some"])).alias("vtx"))
    n = faces.groupBy(*key).agg(F.count("*").alias("_n"))
    side = parents.join(F.broadcast(n), key).groupBy((F.col("pos") % F.col("_n") + 1).alias("face"), *key).agg(F.max(F.when(F.col("pos") < F.col("_n"), F.col("value"))).alias("left"), F.max(F.when(F.col("pos") >= F.col("_n"), F.col("value"))).alias("right"))
    return rings.join(side, ["face", *key]).select(*keys, zone_of(F.col("section")).alias("zone"), "section", "face", "left", "right", "vtx")


def section_values(faces: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, path, pos, value): the other way; faces are numbered 1, 2, .. in each section."""
    key = [*keys, "section"]
    # The offsets carry the faces, which are thus made once and not joined to them.
    sized = faces.select(*key, "face", "left", "right", "vtx", F.size("vtx").alias("_n"))
    d = stored(numbering.exclusive_offsets(sized, [*key, "face"], "_n", "_all"), "sections")
    first = d.groupBy(*key).agg(F.min("_all").alias("_first"), F.count("*").alias("_faces"))  # a row a section
    d = d.join(F.broadcast(first), key).withColumn("_at", F.col("_all") - F.col("_first"))
    row = lambda name, pos, value: F.struct(F.concat("section", F.lit(f"/{name}")).alias("path"), pos.cast("long").alias("pos"), value.cast("double").alias("value"))
    zero = lambda x: F.when(F.col("face") == 1, F.array(x)).otherwise(F.array().cast("array<struct<path:string,pos:bigint,value:double>>"))
    offset = F.concat(zero(row(SECTION[0], F.lit(0), F.lit(0))), F.array(row(SECTION[0], F.col("face"), F.col("_at") + F.col("_n"))))
    corners = F.transform("vtx", lambda v, i: row(SECTION[1], F.col("_at") + i, v))
    parents = F.array(row(SECTION[2], F.col("face") - 1, F.col("left")), row(SECTION[2], F.col("face") - 1 + F.col("_faces"), F.col("right")))
    return d.select(*keys, F.inline(F.concat(offset, corners, parents))).select(*keys, "path", "pos", "value")


def entity_numbers(faces: DataFrame, cell_parts: DataFrame) -> DataFrame:
    """(zone, kind, gnum, part, lnum): the cells of each part as given, the faces of its cells and their vertices, numbered in each (zone, part) by global number."""
    cells = cell_parts.select("zone", F.lit("Cell").alias("kind"), F.col("cell").cast("long").alias("gnum"), "part", F.col("lnum").cast("long").alias("lnum"))
    sides = faces.select("zone", "face", "vtx", F.explode(F.array_distinct(F.array("left", "right"))).alias("cell")).filter("cell > 0").join(cell_parts.select("zone", "cell", "part"), ["cell", "zone"])
    held = stored(sides.select("zone", "part", F.col("face").alias("gnum"), "vtx"), "held")
    f = held.select("zone", F.lit("Face").alias("kind"), "part", "gnum").distinct()
    v = held.select("zone", F.lit("Vertex").alias("kind"), "part", F.explode("vtx").alias("gnum")).distinct()
    both = f.unionByName(v).withColumn("_in", F.struct("zone", "kind", "part"))
    d = local_numbers(both, ["gnum"], "_in")
    return cells.unionByName(d.select("zone", "kind", "gnum", "part", "lnum"))


def _subset_items(values: DataFrame, kinds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, owner, zone, kind, idx, item): the places and items of all PointLists."""
    d = values.filter(_name(F.col("path")) == "PointList").select(*keys, _parent(F.col("path")).alias("owner"), F.col("pos").alias("idx"), F.col("value").cast("long").alias("item"))
    return d.join(kinds, "owner")


def partition_tree(nodes: DataFrame, values: DataFrame, cell_parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, values) with a column part: the zones of each part in local numbers, for cell_parts (zone, cell, part, lnum).

    Containers by location, faces with their parents (0 where the other cell is in another part), subsets with their data,
    numbers, and joins JN.P<part>.<other> of shared faces with the other's local numbers as donors.  Nodes go to the parts that
    their zone has; their sizes are those of the part's arrays.  PointListDonor keeps the global numbers of the other zone.
    """
    nodes = stored(nodes, "tree-nodes")
    about = stored(arrays(nodes, values), "tree-arrays")
    faces = stored(section_faces(values), "tree-faces")
    numbers = stored(entity_numbers(faces, cell_parts), "tree-numbers")
    v = values.join(about, "path")
    # Keys begin with the number: the others are alike in most rows, and sorting would compare them first.
    entities = v.filter(F.col("kind").isin(*KINDS_OF_ENTITIES)).select((F.col("pos") + 1).alias("gnum"), "zone", "kind", "path", "value")
    out = entities.join(numbers, ["gnum", "zone", "kind"]).select("part", "path", (F.col("lnum") - 1).alias("pos"), "value")
    # Faces in local numbers.
    of = lambda kind, name, number: numbers.filter(F.col("kind") == kind).select("zone", "part", F.col("gnum").alias(name), F.col("lnum").alias(number))
    f = stored(faces.join(of("Face", "face", "_face"), ["face", "zone"]), "tree-part-faces")
    ring = f.select("zone", "part", "section", "_face", F.posexplode("vtx").alias("_i", "v")).join(of("Vertex", "v", "_v"), ["v", "part", "zone"])
    ring = ring.repartition("_face", "part", "zone", "section").groupBy("_face", "part", "zone", "section").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("vtx"))
    f = f.drop("vtx").join(of("Cell", "left", "_left"), ["left", "part", "zone"], "left").join(of("Cell", "right", "_right"), ["right", "part", "zone"], "left")
    f = f.join(ring, ["_face", "part", "zone", "section"])
    local = f.select("part", "zone", "section", F.col("_face").alias("face"), F.coalesce("_left", F.lit(0)).alias("left"), F.coalesce("_right", F.lit(0)).alias("right"), "vtx")
    out = out.unionByName(section_values(local, ["part"]))
    # Subsets, numbered in each part by their global order.
    items = _subset_items(values, subset_kinds(nodes))
    s = items.join(numbers.withColumnRenamed("gnum", "item"), ["item", "zone", "kind"]).select("owner", "part", "idx", F.col("lnum").alias("item"), F.struct("owner", "part").alias("_in"))
    s = stored(local_numbers(s, ["idx"], "_in").drop("_in").withColumnRenamed("lnum", "_own"), "tree-subsets")
    place = (F.col("_own") - 1).cast("long").alias("pos")
    out = out.unionByName(s.select("part", F.concat("owner", F.lit("/PointList")).alias("path"), place, F.col("item").cast("double").alias("value")))
    out = out.unionByName(s.select("part", F.concat("owner", F.lit(f"/{NUMBERS}/Index")).alias("path"), place, (F.col("idx") + 1).cast("double").alias("value")))
    data = v.filter("kind = 'Subset'").filter(_name(F.col("path")) != "PointList").select("path", "owner", F.col("pos").alias("idx"), "value")
    out = out.unionByName(data.join(s, ["idx", "owner"]).select("part", "path", place, "value"))
    zones = numbers.select("zone", "part").distinct()
    out = out.unionByName(v.filter("kind = 'Whole'").join(zones, "zone").select("part", "path", "pos", "value"))
    out = out.unionByName(numbers.select("part", F.concat("zone", F.lit(f"/{NUMBERS}/"), "kind").alias("path"), (F.col("lnum") - 1).alias("pos"), F.col("gnum").cast("double").alias("value")))
    # Joins to the other parts of a zone.
    own = of("Face", "face", "_mine")
    pairs = own.join(own.select("zone", F.col("part").alias("other"), "face", F.col("_mine").alias("_donor")), ["face", "zone"]).filter("part <> other")
    pairs = pairs.withColumn("_in", F.struct("zone", "part", "other"))
    pairs = stored(local_numbers(pairs, ["face"], "_in"), "tree-joins")
    join = F.concat("zone", F.lit(f"/ZoneGridConnectivity/{JOIN}"), F.col("part").cast("string"), F.lit("."), F.col("other").cast("string"))
    for name, c in (("PointList", "_mine"), ("PointListDonor", "_donor")):
        out = out.unionByName(pairs.select("part", F.concat(join, F.lit(f"/{name}")).alias("path"), (F.col("lnum") - 1).cast("long").alias("pos"), F.col(c).cast("double").alias("value")))
    out = stored(out, "tree-part-values")
    return _part_nodes(nodes, out, zones), out


def _part_nodes(nodes: DataFrame, values: DataFrame, zones: DataFrame) -> DataFrame:
    """Nodes in all parts of their zones, with the nodes above new arrays, and with the sizes of the parts' arrays."""
    sizes = values.groupBy("part", "path").agg(F.count("*").alias("_size"))
    kept = nodes.withColumn("zone", zone_of(F.col("path")))
    inside = kept.join(zones, "zone").drop("zone")
    bases = kept.filter("zone not like '%/%'").drop("zone").join(zones.select("part").distinct(), F.lit(True))  # a row a base
    d = inside.unionByName(bases.select(*inside.columns))
    parts = F.split("path", "/")
    new = sizes.select("part", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")).distinct().join(d.select("part", "path"), ["part", "path"], "left_anti")
    name = _name(F.col("path"))
    label = F.when(name == NUMBERS, "UserDefinedData_t").when(name == "ZoneGridConnectivity", "ZoneGridConnectivity_t").when(name.startswith(JOIN), "GridConnectivity_t").when(name.isin("PointList", "PointListDonor"), "IndexArray_t").otherwise("DataArray_t")
    made = {"parent": _parent(F.col("path")), "name": name, "label": label, "depth": F.size(parts)}
    for c, kind in d.dtypes:
        if c not in ("part", "path"):
            new = new.withColumn(c, made.get(c, F.lit(None)).cast(kind))
    d = d.unionByName(new.select(*d.columns)).join(sizes, ["part", "path"], "left")
    return d.withColumn("size", F.coalesce("_size", F.when(~F.col("label").isin("DataArray_t", "IndexArray_t"), F.col("size")), F.lit(0)).cast("long")).drop("_size")


def recover_tree(nodes: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, values) of the distributed tree whose parts these are: the reverse of partition_tree.

    Copies of an entity in several parts hold the same values, of which the least counts; the parents of a face come from the
    parts that have them.  Numbers and joins between parts are left out, and so is a ZoneGridConnectivity that holds no other joins.
    """
    is_join = F.col("path").contains("/ZoneGridConnectivity/") & F.col("path").rlike(rf"/ZoneGridConnectivity/{JOIN.replace('.', '[.]')}[^/]*(/|$)")
    # What a path is for is found once, not in every pass.
    use = F.when(F.col("path").contains(f"/{NUMBERS}/"), "numbers").when(is_join, "join").otherwise("array")
    values = stored(values.withColumn("_use", use), "part-values")
    n = nodes.filter(~is_join & ~F.col("path").contains(f"/{NUMBERS}"))
    n = n.drop("part").dropDuplicates(["path"])
    # A container that held nothing but such joins goes with them.
    holds = n.select(F.col("parent").alias("path")).distinct()
    bare = nodes.filter(is_join).select(F.regexp_extract("path", "^(.*/ZoneGridConnectivity)/", 1).alias("path")).distinct().join(holds, "path", "left_anti")
    n = stored(n.join(bare, "path", "left_anti"), "whole-nodes")
    name = _name(F.col("path"))
    held = values.filter("_use = 'numbers'")
    owner = F.substring_index("path", f"/{NUMBERS}/", 1)
    numbers = stored(held.filter(name != "Index").select(owner.alias("zone"), name.alias("kind"), "part", (F.col("pos") + 1).alias("lnum"), F.col("value").cast("long").alias("gnum")), "whole-numbers")
    index = stored(held.filter(name == "Index").select(owner.alias("owner"), "part", "pos", (F.col("value") - 1).cast("long").alias("idx")), "whole-index")
    v = values.filter("_use = 'array'").drop("_use")
    about = stored(arrays(n, v), "whole-arrays")
    d = v.join(about, "path")
    whole = lambda x: x.groupBy("pos", "path").agg(F.min("value").alias("value")).select("path", "pos", "value")
    entities = d.filter(F.col("kind").isin(*KINDS_OF_ENTITIES)).select((F.col("pos") + 1).alias("lnum"), "part", "zone", "kind", "path", "value")
    out = whole(entities.join(numbers, ["lnum", "part", "zone", "kind"]).select("path", (F.col("gnum") - 1).alias("pos"), "value"))
    items = _subset_items(v, subset_kinds(n), ["part"]).join(numbers.withColumnRenamed("lnum", "item"), ["item", "part", "zone", "kind"])
    items = items.select("part", "owner", F.col("idx").alias("pos"), "gnum").join(index, ["pos", "part", "owner"])
    out = out.unionByName(whole(items.select(F.concat("owner", F.lit("/PointList")).alias("path"), F.col("idx").alias("pos"), F.col("gnum").cast("double").alias("value"))))
    data = d.filter("kind = 'Subset'").filter(name != "PointList").select("part", "path", "owner", "pos", "value")
    out = out.unionByName(whole(data.join(index, ["pos", "part", "owner"]).select("path", F.col("idx").alias("pos"), "value")))
    out = out.unionByName(whole(d.filter("kind = 'Whole'").select("path", "pos", "value")))
    of = lambda kind, local, number: numbers.filter(F.col("kind") == kind).select("zone", "part", F.col("lnum").alias(local), F.col("gnum").alias(number))
    f = section_faces(v.join(about.filter("kind = 'Section'").select("path"), "path", "left_semi"), ["part"], numbers).join(of("Face", "face", "_face"), ["face", "part", "zone"])
    f = f.join(of("Cell", "left", "_left"), ["left", "part", "zone"], "left").join(of("Cell", "right", "_right"), ["right", "part", "zone"], "left")
    f = f.groupBy(F.col("_face").alias("face"), "zone", "section").agg(F.coalesce(F.max("_left"), F.lit(0)).alias("left"), F.coalesce(F.max("_right"), F.lit(0)).alias("right"), F.min_by("vtx", "part").alias("vtx"))
    out = stored(out.unionByName(section_values(f)), "whole-values")
    sizes = out.groupBy("path").agg(F.count("*").alias("_size"))
    n = n.join(sizes, "path", "left").withColumn("size", F.coalesce(F.col("_size"), F.when(~F.col("label").isin("DataArray_t", "IndexArray_t"), F.col("size")), F.lit(0)).cast("long")).drop("_size")
    return n, out
