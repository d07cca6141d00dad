"""Element forms: structured ranges, mixed sections, polyhedra to standard elements, ghosts, registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import index
from . import mesh, numbering

# Fixed values of the CGNS standard: type number, dimension and number of vertices of each element type.
ELEMENTS = {
    "NODE": (2, 0, 1), "BAR_2": (3, 1, 2), "TRI_3": (5, 2, 3), "QUAD_4": (7, 2, 4),
    "TETRA_4": (10, 3, 4), "PYRA_5": (12, 3, 5), "PENTA_6": (14, 3, 6), "HEXA_8": (17, 3, 8),
}


def _by_kind(kind: Column, values: dict) -> Column:
    """The value of an element type, null for an unknown one."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[kind]


def sections(elements: DataFrame) -> DataFrame:
    """Elements (element, kind, vtx) numbered anew as `number`: one section a type, by ascending dimension, then type, then number."""
    dim, code = (_by_kind(F.col("kind"), {k: v[i] for k, v in ELEMENTS.items()}) for i in (1, 0))
    return numbering.row_numbers(elements.withColumns({"_dim": dim, "_code": code}), ["_dim", "_code", "element"], "number").drop("_dim", "_code")


def to_mixed(elements: DataFrame) -> DataFrame:
    """(element, start, connectivity): type number and vertices of each element, and where it starts in the whole array."""
    d = elements.withColumn("connectivity", F.concat(F.array(_by_kind(F.col("kind"), {k: v[0] for k, v in ELEMENTS.items()}).cast("long")), "vtx"))
    d = d.withColumn("_n", F.size("connectivity"))
    return numbering.exclusive_offsets(d, ["element"], "_n", "start").select("element", "start", "connectivity")


def from_mixed(mixed: DataFrame) -> DataFrame:
    """(element, kind, vtx) of a mixed section."""
    c = F.col("connectivity")
    kind = _by_kind(c[0].cast("int"), {v[0]: k for k, v in ELEMENTS.items()})
    return mixed.select("element", kind.alias("kind"), F.slice(c, 2, F.size(c) - 1).alias("vtx"))


def structured_faces(location: str, low: Sequence[int], high: Sequence[int], n_vtx: Sequence[int], df: DataFrame) -> DataFrame:
    """(element): the numbers of an index range (closed, from 1) at a location of a block.  df gives the session only."""
    n = [b - a + 1 for a, b in zip(low, high)]
    at = index.index_to_ijk(F.col("id") + 1, n)
    at = [p + a - 1 for p, a in zip(at, low)]
    return df.sparkSession.range(n[0] * n[1] * n[2]).select(index.index_from_location(*at, location, n_vtx).cast("long").alias("element"))


def polyhedra_to_elements(faces: DataFrame) -> DataFrame:
    """(cell, kind, vtx): cells given by faces as standard elements; another shape gets kind null and its sorted vertices.

    The base is the first triangle (prism) or first quadrangle or triangle; the vertex above one of the base is the other
    end of its edge that leaves the base.
    """
    out = F.struct(F.col("left").alias("cell"), F.col("face"), F.col("vtx"))
    turned = F.struct(F.col("right").alias("cell"), F.col("face"), F.reverse("vtx").alias("vtx"))
    d = faces.select(F.explode(F.array(out, turned)).alias("s")).select("s.*").filter("cell > 0")
    d = d.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("face", "vtx"))).alias("_f"))
    all_vtx = F.array_sort(F.array_distinct(F.flatten(F.col("_f.vtx"))))
    n_face, n_vtx = F.size("_f"), F.size("_all")
    quads = F.size(F.filter("_f", lambda f: F.size(f["vtx"]) == 4))
    kind = (
        F.when((n_face == 4) & (n_vtx == 4), "TETRA_4").when((n_face == 5) & (n_vtx == 5) & (quads == 1), "PYRA_5")
        .when((n_face == 5) & (n_vtx == 6) & (quads == 3), "PENTA_6").when((n_face == 6) & (n_vtx == 8) & (quads == 6), "HEXA_8")
    )
    d = d.withColumn("_all", all_vtx).withColumn("kind", kind)
    corners = F.when(F.col("kind").isin("TETRA_4", "PENTA_6"), 3).otherwise(4)
    d = d.withColumn("_base", F.reverse(F.get(F.filter("_f", lambda f: F.size(f["vtx"]) == corners), F.lit(0))["vtx"]))
    ends = lambda v: F.zip_with(v, F.concat(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    d = d.withColumn("_edges", F.flatten(F.transform("_f", lambda f: ends(f["vtx"]))))
    above = lambda v: F.get(F.filter("_edges", lambda e: (e["a"] == v) & ~F.array_contains("_base", e["b"])), F.lit(0))["b"]
    rest = F.when(F.col("kind").isin("TETRA_4", "PYRA_5"), F.array_except("_all", "_base")).otherwise(F.transform("_base", above))
    return d.select("cell", "kind", F.when(F.col("kind").isNull(), F.col("_all")).otherwise(F.concat("_base", rest)).alias("vtx"))


def mixed_faces(elements: DataFrame) -> DataFrame:
    """(face, left, right, vtx) of cells of several types: elements_to_faces over all of them."""
    sides = None
    for kind in mesh.FACES:
        d = mesh.faces_of(elements.filter(F.col("kind") == kind), kind, "element").withColumnRenamed("element", "cell")
        sides = d if sides is None else sides.unionByName(d)
    return mesh.unique_faces(sides)


def without_ghosts(entities: DataFrame, key: str, owned: Column, order: Sequence[str]) -> DataFrame:
    """The owned rows, numbered anew as `number`."""
    return numbering.row_numbers(entities.filter(owned), list(order), "number").select(key, "number")


def registry(nodes: DataFrame) -> DataFrame:
    """(label, path, id): ids 1, 2, .. of the nodes of each label, by path."""
    d = numbering.row_numbers(nodes.select("label", "path").distinct(), ["label", "path"], "_rn")
    first = d.groupBy("label").agg(F.min("_rn").alias("_first"))
    return d.join(first, "label").select("label", "path", (F.col("_rn") - F.col("_first") + 1).alias("id"))
