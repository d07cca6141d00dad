"""What a node table says of zones, element sections, joins and subsets: one row each, by joins of nodes with their children.

Values are the JSON texts of the node table.  Nothing is collected; a tree of many zones is as good as one of a few.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .convert import ELEMENTS
from .graph import connected_components
from .trees import path_head, path_parent

#: Element types with face and cell lists, beside those of ELEMENTS: number, dimension.
LISTS = {"NGON_n": (22, 2), "NFACE_n": (23, 3)}
SUBSETS = ("BC_t", "BCDataSet_t", "GridConnectivity1to1_t", "GridConnectivity_t", "ZoneSubRegion_t", "FlowSolution_t", "DiscreteData_t")


def text_of(value: Column) -> Column:
    """A text value without its JSON marks."""
    return F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]


def numbers_of(value: Column, kind: str = "array<bigint>") -> Column:
    return F.from_json(value, kind)


def with_children(nodes: DataFrame, parents: DataFrame, wanted: Mapping[str, Column]) -> DataFrame:
    """parents with the value of the child that matches each predicate (the least, if several do), null without one."""
    kids = nodes.select(F.col("parent").alias("path"), "name", "label", "value")
    some = F.lit(False)
    for p in wanted.values():
        some = some | p
    found = kids.filter(some).groupBy("path").agg(*[F.min(F.when(p, F.col("value"))).alias(out) for out, p in wanted.items()])
    return parents.join(found, "path", "left")


def _by_number(column: Column, at: int) -> Column:
    table = {v[0]: v[at] for v in ELEMENTS.values()} | {v[0]: (*v, None)[at] for v in LISTS.values()}
    return F.create_map(*[F.lit(x) for k, v in table.items() if v is not None for x in (k, v)])[column]


def element_name(number: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in (ELEMENTS | LISTS).items() for x in (v[0], k)])[number]


def element_number(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in (ELEMENTS | LISTS).items() for x in (k, v[0])])[name]


def element_dimension(number: Column) -> Column:
    return _by_number(number, 1)


def element_vertices(number: Column) -> Column:
    """Vertices of an element; null for face and cell lists."""
    return _by_number(number, 2)


def sections(nodes: DataFrame) -> DataFrame:
    """(zone, path, number, kind, dim, n_vtx, first, last, size, place): element sections, with their place by range in the zone."""
    d = with_children(nodes, nodes.filter("label = 'Elements_t'").select("path", "parent", "value"), {"_range": F.col("name") == "ElementRange"})
    number, r = F.get(numbers_of(F.col("value")), 0).cast("int"), numbers_of(F.col("_range"))
    d = d.select(F.col("parent").alias("zone"), "path", number.alias("number"), F.get(r, 0).alias("first"), F.get(r, 1).alias("last"))
    n = F.col("number")
    place = F.row_number().over(Window.partitionBy("zone").orderBy("first", "path"))
    return d.select("zone", "path", "number", element_name(n).alias("kind"), element_dimension(n).alias("dim"), element_vertices(n).alias("n_vtx"), "first", "last", (F.col("last") - F.col("first") + 1).alias("size"), place.alias("place"))


def dimension_ranges(nodes: DataFrame) -> DataFrame:
    """(zone, dim, first, last, n, interlaced): the numbers of the elements of a dimension; interlaced where others lie between."""
    s = sections(nodes)
    return s.groupBy("zone", "dim").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("size").alias("n")).withColumn("interlaced", F.col("last") - F.col("first") + 1 != F.col("n"))


def dimension_order(nodes: DataFrame) -> DataFrame:
    """(zone, ordering): 1 where dimensions ascend with the numbers, -1 where they descend, 0 where they do neither."""
    w = Window.partitionBy("zone").orderBy("place")
    s = sections(nodes).withColumn("step", F.signum(F.col("dim") - F.lag("dim").over(w)))
    up, down = F.coalesce(F.min("step"), F.lit(0)) >= 0, F.coalesce(F.max("step"), F.lit(0)) <= 0
    return s.groupBy("zone").agg(F.when(up, 1).when(down, -1).otherwise(0).alias("ordering"))


def _product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1).cast("bigint"), lambda x, y: x * y)


def zones(nodes: DataFrame) -> DataFrame:
    """(path, base, name, kind, index_dim, cell_dim, vertex_size, cell_size, boundary_size, face_size, n_vtx, n_cell, n_vtx_bnd, n_face, has_ngon, has_nface).

    Faces of a structured zone are counted by direction; those of another are the elements of its face list, or null.
    """
    d = with_children(nodes, nodes.filter("label = 'Zone_t'").select("path", "name", "value"), {"_kind": F.col("label") == "ZoneType_t"})
    v = F.from_json("value", "array<array<bigint>>")
    d = d.withColumns({"kind": text_of(F.col("_kind")), "_v": v}).withColumn("_v", F.when(F.size("_v") > 0, F.col("_v")))
    side = lambda k: F.transform("_v", lambda x: F.get(x, k))
    d = d.withColumns({"index_dim": F.size("_v"), "vertex_size": side(0), "cell_size": side(1), "boundary_size": side(2)})
    s = sections(nodes).groupBy(F.col("zone").alias("path")).agg(F.max("dim").alias("_dim"), F.max(F.when(F.col("kind") == "NGON_n", F.col("size"))).alias("_ngon"), F.max((F.col("kind") == "NGON_n").cast("int")).alias("_has_ngon"), F.max((F.col("kind") == "NFACE_n").cast("int")).alias("_has_nface"))
    d = d.join(s, "path", "left")
    structured = F.col("kind") == "Structured"
    by_direction = F.transform("vertex_size", lambda n, i: n * _product(F.filter("cell_size", lambda c, j: j != i)))
    d = d.withColumn("face_size", F.when(structured, by_direction))
    n_face = F.when(structured, F.aggregate("face_size", F.lit(0).cast("bigint"), lambda x, y: x + y)).otherwise(F.col("_ngon"))
    cell_dim = F.when(structured, F.col("index_dim")).otherwise(F.col("_dim"))
    has = lambda c: (F.coalesce(c, F.lit(0)) > 0)
    return d.select(
        "path", path_head(F.col("path")).alias("base"), "name", "kind", "index_dim", cell_dim.alias("cell_dim"), "vertex_size", "cell_size", "boundary_size", "face_size",
        _product(F.col("vertex_size")).alias("n_vtx"), _product(F.col("cell_size")).alias("n_cell"), _product(F.col("boundary_size")).alias("n_vtx_bnd"), n_face.alias("n_face"),
        has("_has_ngon").alias("has_ngon"), has("_has_nface").alias("has_nface"),
    )


def transform_matrix(transform: Column, dim: int = 3) -> Column:
    """The signed permutation matrix of a transform: column a has the sign of transform[a] in row |transform[a]|."""
    cell = lambda r, a: F.when(F.abs(F.get(transform, a)) == r + 1, F.signum(F.get(transform, a)).cast("int")).otherwise(0)
    return F.array(*[F.array(*[cell(r, a) for a in range(dim)]) for r in range(dim)])


def joins(nodes: DataFrame) -> DataFrame:
    """(path, zone, kind, is_1to1, is_periodic, center, angle, translation, transform, donor): donor is the path of the opposite zone."""
    d = nodes.filter("label in ('GridConnectivity_t', 'GridConnectivity1to1_t')").select("path", "parent", "label", "value")
    d = with_children(nodes, d, {"_kind": F.col("label") == "GridConnectivityType_t", "_transform": F.col("name") == "Transform"})
    periodic = nodes.filter("label = 'Periodic_t'").select("path", path_parent(F.col("parent")).alias("_join"))
    names = {"center": "RotationCenter", "angle": "RotationAngle", "translation": "Translation"}
    p = with_children(nodes, periodic, {k: F.col("name") == v for k, v in names.items()})
    p = p.select(F.col("_join").alias("path"), F.lit(True).alias("_periodic"), *[numbers_of(F.col(k), "array<double>").alias(k) for k in names])
    d = d.join(p, "path", "left").withColumn("zone", path_parent(F.col("parent")))
    kind = F.when(F.col("label") == "GridConnectivity1to1_t", "Abutting1to1").otherwise(F.coalesce(text_of(F.col("_kind")), F.lit("Overset")))
    return d.select(
        "path", "zone", kind.alias("kind"), (kind == "Abutting1to1").alias("is_1to1"), F.coalesce("_periodic", F.lit(False)).alias("is_periodic"), *names,
        numbers_of(F.col("_transform"), "array<int>").alias("transform"), donor_path(text_of(F.col("value")), F.col("zone")).alias("donor"),
    )


def donor_path(value: Column, zone: Column) -> Column:
    """The opposite zone as Base/Zone; a bare name lies in the base of the zone itself."""
    return F.when(value.contains("/"), value).otherwise(F.concat(path_head(zone), F.lit("/"), value))


def donors_as_paths(nodes: DataFrame) -> DataFrame:
    """The tree with the donors of all joins as paths."""
    is_join = F.col("label").isin("GridConnectivity_t", "GridConnectivity1to1_t")
    full = F.to_json(F.struct(donor_path(text_of(F.col("value")), path_parent(F.col("parent"))).alias("v")))
    return nodes.withColumn("value", F.when(is_join, F.regexp_extract(full, r'^\{"v":(.*)\}$', 1)).otherwise(F.col("value")))


def connected_zones(nodes: DataFrame) -> DataFrame:
    """(zone, component): zones that 1to1 joins connect which are not periodic; the component is its least path."""
    pairs = joins(nodes).filter("is_1to1 and not is_periodic").select("zone", "donor")
    found = connected_components(pairs, "zone", "donor").withColumnRenamed("node", "zone")
    alone = nodes.filter("label = 'Zone_t'").select(F.col("path").alias("zone"))
    return alone.join(found, "zone", "left").select("zone", F.coalesce("component", "zone").alias("component"))


def periodic_groups(nodes: DataFrame, digits: int = 5) -> DataFrame:
    """(center, angle, translation, paths): periodic joins by their values, taken to so many decimal places."""
    rounded = lambda c: F.transform(c, lambda x: F.round(x, digits) + 0.0)
    d = joins(nodes).filter("is_periodic").select("path", *[rounded(c).alias(c) for c in ("center", "angle", "translation")])
    return d.groupBy("center", "angle", "translation").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def size_per_index(point_range: Column) -> Column:
    """|last - first| + 1 for each direction of a range."""
    return F.transform(point_range, lambda r: F.abs(F.get(r, 1) - F.get(r, 0)) + 1)


def subsets(nodes: DataFrame, location: str | None = None) -> DataFrame:
    """(path, zone, label, patch, location, n_elem, normal_axis) of nodes that hold a point list or range.

    The location is Vertex unless said otherwise; the normal axis (0, 1, 2) is the first along which a range is one
    index thick.
    """
    d = nodes.filter(F.col("label").isin(*SUBSETS)).select("path", "label")
    d = with_children(nodes, d, {"_list": F.col("name") == "PointList", "_range": F.col("name") == "PointRange", "_location": F.col("label") == "GridLocation_t"})
    d = d.filter("_list is not null or _range is not null").withColumn("location", F.coalesce(text_of(F.col("_location")), F.lit("Vertex")))
    if location is not None:
        d = d.filter(F.col("location") == location)
    sides = size_per_index(F.from_json("_range", "array<array<bigint>>"))
    points = F.from_json("_list", "array<array<bigint>>")
    zone = F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")
    axis = F.array_position(sides, F.lit(1).cast("bigint")).cast("int")
    n = F.when(F.col("_list").isNotNull(), F.size(F.get(points, 0)).cast("bigint")).otherwise(_product(sides))
    return d.select("path", zone.alias("zone"), "label", F.when(F.col("_list").isNotNull(), "PointList").otherwise("PointRange").alias("patch"), "location", n.alias("n_elem"), F.when(F.col("_list").isNull() & (axis > 0), axis - 1).alias("normal_axis"))


def region_extents(nodes: DataFrame) -> DataFrame:
    """(path, extent): where a region's points are given: a boundary's or join's path, or its own."""
    d = nodes.filter("label = 'ZoneSubRegion_t'").select("path", F.col("parent").alias("zone"))
    d = with_children(nodes, d, {"_bc": F.col("name") == "BCRegionName", "_gc": F.col("name") == "GridConnectivityRegionName"})
    d = d.withColumn("_name", text_of(F.coalesce("_bc", "_gc"))).withColumn("_under", F.when(F.col("_bc").isNotNull(), "ZoneBC_t").when(F.col("_gc").isNotNull(), "ZoneGridConnectivity_t"))
    groups = nodes.filter("label in ('ZoneBC_t', 'ZoneGridConnectivity_t')").select(F.col("parent").alias("zone"), F.col("label").alias("_under"), F.col("path").alias("_group"))
    held = nodes.select(F.col("path").alias("extent"), F.col("parent").alias("_group"), F.col("name").alias("_name"))
    named = d.filter("_name is not null").join(groups, ["zone", "_under"]).join(held, ["_group", "_name"]).select("path", "extent")
    return named.unionByName(d.filter("_name is null").select("path", F.col("path").alias("extent")))


def in_family(nodes: DataFrame, family: str, additional: bool = False) -> DataFrame:
    """Nodes that have the family as FamilyName, or as one of the additional names."""
    labels = ["FamilyName_t", *(["AdditionalFamilyName_t"] if additional else [])]
    of = nodes.filter(F.col("label").isin(*labels) & (text_of(F.col("value")) == family)).select(F.col("parent").alias("path"))
    return nodes.join(of, "path", "left_semi")
