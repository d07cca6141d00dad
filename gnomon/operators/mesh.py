"""Meshes as tables: connectivity conversion, extraction, duplication, level sets and point matching.

Cells are rows (cell, vtx array), faces rows (face, left, right, vtx array) with 0 for outside, vertices rows
(vertex, x, y, z).  Every step is an equi-join or a keyed aggregation, so nothing depends on how rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import index
from . import numbering

# Fixed values of the CGNS standard: the faces of each element type, outward, as 1-based positions.
FACES = {
    "TETRA_4": ((1, 3, 2), (1, 2, 4), (2, 3, 4), (3, 1, 4)),
    "PYRA_5": ((1, 4, 3, 2), (1, 2, 5), (2, 3, 5), (3, 4, 5), (4, 1, 5)),
    "PENTA_6": ((1, 2, 5, 4), (2, 3, 6, 5), (3, 1, 4, 6), (1, 3, 2), (4, 5, 6)),
    "HEXA_8": ((1, 4, 3, 2), (1, 2, 6, 5), (2, 3, 7, 6), (3, 4, 8, 7), (1, 5, 8, 4), (5, 6, 7, 8)),
}


def block_vertices(cell: Column, n_vtx: Sequence[int]) -> Column:
    """The eight vertices of a cell of a structured block, in the order of HEXA_8."""
    i, j, k = index.index_to_ijk(cell, [n - 1 for n in n_vtx])
    around = ((0, 0), (1, 0), (1, 1), (0, 1))
    return F.array(*[index.ijk_to_index(i + a, j + b, k + c, n_vtx).cast("long") for c in (0, 1) for a, b in around])


def faces_of(cells: DataFrame, kind: str, cell: str = "cell", vtx: str = "vtx") -> DataFrame:
    """Each face of each cell: (cell, vtx), its vertices outward."""
    v = F.col(vtx)
    return cells.select(cell, F.explode(F.array(*[F.array(*[v[p - 1] for p in f]) for f in FACES[kind]])).alias("vtx"))


def elements_to_faces(cells: DataFrame, kind: str) -> DataFrame:
    """(face, left, right, vtx): each face once, numbered by its sorted vertices; outward of `left`, the smaller cell."""
    return unique_faces(faces_of(cells, kind))


def unique_faces(sides: DataFrame) -> DataFrame:
    """The same from the faces (cell, vtx) of each cell."""
    return numbering.row_numbers(met_sides(sides), ["_key"], "face").select("face", "left", "right", "vtx").hint("merge")  # small files for as many rows


def met_sides(sides: DataFrame) -> DataFrame:
    """(_key, left, right, vtx): each face once, without a number; _key are its sorted vertices."""
    f = sides.withColumn("_key", F.array_sort("vtx"))
    right = F.when(F.count("*") > 1, F.max("cell")).otherwise(F.lit(0)).cast("long").alias("right")
    # Dealt out before they are put together: sides meet in few of the tasks that make them, which would have to sort all they make.
    return f.repartition("_key").groupBy("_key").agg(F.min("cell").cast("long").alias("left"), right, F.min_by("vtx", "cell").alias("vtx"))


def parents_to_cells(faces: DataFrame) -> DataFrame:
    """(cell, faces): the signed faces of each cell, + where it is the left one, by face number."""
    both = F.array(F.struct(F.col("left").alias("cell"), F.col("face")), F.struct(F.col("right").alias("cell"), (-F.col("face")).alias("face")))
    d = faces.select(F.explode(both).alias("p")).select("p.*").filter("cell > 0")
    d = d.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct(F.abs("face").alias("at"), "face"))).alias("_f"))
    return d.select("cell", F.col("_f.face").alias("faces"))


def cells_to_parents(cells: DataFrame) -> DataFrame:
    """(face, left, right) from signed faces; 0 where a side is outside."""
    d = cells.select("cell", F.explode("faces").alias("f"))
    side = lambda c, n: F.coalesce(F.max(F.when(c, F.col("cell"))), F.lit(0)).alias(n)
    return d.groupBy(F.abs("f").alias("face")).agg(side(F.col("f") > 0, "left"), side(F.col("f") < 0, "right"))


def boundary_left(faces: DataFrame) -> DataFrame:
    """Faces without a left cell are turned round."""
    turn = F.col("left") == 0
    return faces.select("face", F.when(turn, F.col("right")).otherwise(F.col("left")).alias("left"), F.when(turn, 0).otherwise(F.col("right")).alias("right"), F.when(turn, F.reverse("vtx")).otherwise(F.col("vtx")).alias("vtx"))


def cell_vertices(faces: DataFrame) -> DataFrame:
    """(cell, vtx): the distinct vertices of each cell, ascending, from its faces."""
    d = faces.select(F.explode(F.array("left", "right")).alias("cell"), "vtx")
    d = d.filter("cell > 0").select("cell", F.explode("vtx").alias("v"))
    return d.groupBy("cell").agg(F.array_sort(F.collect_set("v")).alias("vtx"))


def edges(faces: DataFrame) -> DataFrame:
    """(a, b): each edge once, a < b."""
    v = F.col("vtx")
    follow = F.concat(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, 1))
    d = faces.select(F.explode(F.zip_with(v, follow, lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))).alias("e"))
    return d.select("e.*").distinct()


def face_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(face, nx, ny, nz): half the sum of the cross products of successive vertices, so the length is the area."""
    d = faces.select("face", F.posexplode("vtx").alias("_pos", "vertex")).join(vertices.select("vertex", "x", "y", "z"), "vertex")
    w = Window.partitionBy("face").orderBy("_pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = {f"_{c}": F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in "xyz"}
    d = d.withColumns(after)
    part = lambda p, q: (F.sum(F.col(p) * F.col(f"_{q}") - F.col(q) * F.col(f"_{p}")) / 2)
    return d.groupBy("face").agg(part("y", "z").alias("nx"), part("z", "x").alias("ny"), part("x", "y").alias("nz"))


def extract(cells: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the selected cells: (cell, vtx) with vertices numbered anew in their order, and (vertex, old) of the vertices kept."""
    kept = cells.join(selected.select("cell").distinct(), "cell", "left_semi")
    d = kept.select("cell", F.posexplode("vtx").alias("_pos", "old"))
    ids = numbering.row_numbers(d.select("old").distinct(), ["old"], "vertex")
    d = d.join(ids, "old").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("_pos", "vertex"))).alias("_v"))
    return d.select("cell", F.col("_v.vertex").alias("vtx")), ids


def duplicate(vertices: DataFrame, copies: int, shift: Sequence[float], size: int) -> DataFrame:
    """The vertices and `copies` shifted ones of each; numbers of copy n start after n * size."""
    d = vertices.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies).cast("long"))))
    return d.select("copy", (F.col("vertex") + F.col("copy") * size).alias("vertex"), *[(F.col(c) + F.col("copy") * s).alias(c) for c, s in zip("xyz", shift)])


def level_points(edge_table: DataFrame, field: DataFrame, level: float, values: Sequence[str]) -> DataFrame:
    """(a, b, t, values): where the field crosses the level on each edge, values interpolated; ends at the level count as above it."""
    ends = lambda e: field.select(F.col("vertex").alias(e), F.col("field").alias(f"_f{e}"), *[F.col(c).alias(f"_{i}{e}") for i, c in enumerate(values)])
    d = edge_table.join(ends("a"), "a").join(ends("b"), "b").filter((F.col("_fa") < level) != (F.col("_fb") < level))
    d = d.withColumn("t", (F.lit(level) - F.col("_fa")) / (F.col("_fb") - F.col("_fa")))
    return d.select("a", "b", "t", *[(F.col(f"_{i}a") + F.col("t") * (F.col(f"_{i}b") - F.col(f"_{i}a"))).alias(c) for i, c in enumerate(values)])


#: Points of one side of a block whose pairs are compared in one go, and pairs that a task compares.
BLOCK, TASK_PAIRS = 2_000, 32_000_000


def within(a: DataFrame, b: DataFrame, coords: Sequence[str], radius: float, a_id: str, b_id: str, block: int = BLOCK, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(a_id, b_id, distance2) of points not farther apart than the radius: an equi-join on cells of that width.

    Pairs grow with the product of both sides of a cell, so a cell is cut in blocks of about `block` points of each side, and the
    blocks are dealt out to as many tasks as there are pairs to compare: small tables may have many of them.
    """
    cells = [f"_c{i}" for i in range(len(coords))]
    near = F.explode(F.array(*[F.array(*[F.lit(s) for s in o]) for o in product((-1, 0, 1), repeat=len(coords))]))
    x = a.select(a_id, *[F.col(c).alias(f"_a{i}") for i, c in enumerate(coords)], near.alias("_o"))
    x = x.withColumns({c: F.floor(F.col(f"_a{i}") / radius) + F.col("_o")[i] for i, c in enumerate(cells)}).drop("_o")
    y = b.select(b_id, *[F.col(c).alias(f"_b{i}") for i, c in enumerate(coords)])
    y = y.withColumns({c: F.floor(F.col(f"_b{i}") / radius) for i, c in enumerate(cells)})
    n = x.groupBy(cells).agg(F.count("*").alias("_x")).join(y.groupBy(cells).agg(F.count("*").alias("_y")).hint("merge"), cells)
    pairs = n.agg(F.sum(F.col("_x") * F.col("_y"))).first()[0] or 0
    tasks = -(-pairs // task_pairs)
    d2 = sum(((F.col(f"_a{i}") - F.col(f"_b{i}")) ** 2 for i in range(1, len(coords))), (F.col("_a0") - F.col("_b0")) ** 2)
    if tasks > 1:
        blocks = n.select(*cells, *[F.ceil(F.col(f"_{s}") / block).alias(f"_{s}") for s in "xy"])
        copies = lambda s: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_{s}") - 1)).alias(f"_{s}")
        own = lambda k, s: F.pmod(F.xxhash64(k), F.col(f"_{s}")).alias(f"_{s}")
        cut = [*cells, "_x", "_y"]
        x = x.join(blocks.hint("merge"), cells).select(*cells, a_id, *[f"_a{i}" for i in range(len(coords))], own(a_id, "x"), copies("y")).repartition(tasks, *cut)
        y = y.join(blocks.hint("merge"), cells).select(*cells, b_id, *[f"_b{i}" for i in range(len(coords))], copies("x"), own(b_id, "y")).repartition(tasks, *cut)
        j = x.join(y.hint("merge"), cut)  # a broadcast would leave all pairs to the few tasks that read the points
    else:
        j = x.join(y, cells)
    return j.select(a_id, b_id, d2.alias("distance2")).filter(F.col("distance2") <= radius * radius)


def block_centres(items: DataFrame, vertices: DataFrame, n_vtx: Sequence[int], location: str) -> DataFrame:
    """(gnum, x, y, z): means of the corners of a structured block's cells or of its faces normal to i, j or k (gnum, counted over all locations of faces)."""
    g = F.col("gnum")
    if location == "CellCenter":
        corners = block_vertices(g, n_vtx)
    elif location in ("IFaceCenter", "JFaceCenter", "KFaceCenter"):
        corners = index.face_vertices("IJK".index(location[0]), g, n_vtx)
    else:
        raise ValueError(f"no centres at {location}")
    d = items.select("gnum", F.explode(corners).alias("vertex")).join(vertices, "vertex")
    return d.groupBy("gnum").agg(*[F.avg(c).alias(c) for c in "xyz"])


def local_parents(faces: DataFrame, sections: DataFrame) -> DataFrame:
    """faces (zone, face, left, right, ..) with cells counted from 1, where a zone counts them after the faces of its section (zone, last); zones that count from 1 stay, and so does 0."""
    most = faces.groupBy("zone").agg(F.max(F.greatest("left", "right")).alias("_most"), F.min(F.when(F.col("left") > 0, F.col("left"))).alias("_l"), F.min(F.when(F.col("right") > 0, F.col("right"))).alias("_r"))
    by = F.when(F.least("_l", "_r") > F.col("last"), F.col("last")).otherwise(F.lit(0))
    d = faces.join(most.join(sections.select("zone", "last"), "zone").select("zone", by.alias("_by")), "zone")
    return d.withColumns({c: F.when(F.col(c) > 0, F.col(c) - F.col("_by")).otherwise(F.lit(0)).cast("long") for c in ("left", "right")}).drop("_by")
