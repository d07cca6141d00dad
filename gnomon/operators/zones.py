"""Several zones: pairing of joins, matching by place, merging, copies by rotation or translation.

Faces are (zone, face, left, right, vtx), vertices (zone, vertex, x, y, z), joins (zone, face, donor_zone, donor_face),
one row for each pair of faces (either or both directions).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..storage import stored
from . import graph, mesh, numbering, spatial


def donor_names(joins: DataFrame) -> DataFrame:
    """Joins (zone, name, donor_zone, marks): with donor_name, the join of the other zone that points back with the same marks (a column of comparable values, as sorted face pairs), and `reference`, true on the lesser path of both."""
    back = joins.select(F.col("zone").alias("donor_zone"), F.col("donor_zone").alias("zone"), F.col("name").alias("donor_name"), F.col("marks").alias("donor_marks"))
    d = joins.join(back, ["zone", "donor_zone"]).filter(F.col("marks") == F.col("donor_marks"))
    own, other = F.struct("zone", "name"), F.struct("donor_zone", "donor_name")
    self_join = (F.col("zone") == F.col("donor_zone")) & (F.col("name") == F.col("donor_name"))
    return d.filter(~self_join).select("zone", "name", "donor_zone", "donor_name", (own < other).alias("reference"))


def match_faces(a: DataFrame, b: DataFrame, tolerance: float, angles: Sequence[float] = (0, 0, 0), centre: Sequence[float] = (0, 0, 0), shift: Sequence[float] = (0, 0, 0)) -> DataFrame:
    """(face, donor_face): faces (face, x, y, z: their centres) of a that lie, once moved, on faces of b."""
    moved = geometry.affine([F.col(c) for c in "xyz"], angles, centre, shift)
    m = a.select("face", *[e.alias(c) for e, c in zip(moved, "xyz")])
    # All pairs within the tolerance would grow with the square of the faces where it is wide; each face needs its nearest alone.
    near = spatial.closest_within(b.select(F.col("face").alias("donor_face"), "x", "y", "z"), m, ["x", "y", "z"], "donor_face", "face", tolerance)
    return near.groupBy("face").agg(F.min_by("donor_face", F.struct("distance2", "donor_face")).alias("donor_face"))


def vertex_pairs(joins: DataFrame, faces: DataFrame, vertices: DataFrame, angles: Sequence[float] = (0, 0, 0), centre: Sequence[float] = (0, 0, 0), shift: Sequence[float] = (0, 0, 0)) -> DataFrame:
    """(zone, vertex, donor_zone, donor_vertex): vertices of joined faces, each with the nearest (once moved) of the donor face."""
    corner = faces.select("zone", "face", F.explode("vtx").alias("vertex")).join(vertices, ["zone", "vertex"])
    moved = geometry.affine([F.col(c) for c in "xyz"], angles, centre, shift)
    own = corner.select("zone", "face", "vertex", *[e.alias(f"_{c}") for e, c in zip(moved, "xyz")])
    other = corner.select(F.col("zone").alias("donor_zone"), F.col("face").alias("donor_face"), F.col("vertex").alias("donor_vertex"), "x", "y", "z")
    d = joins.select("zone", "face", "donor_zone", "donor_face").join(own, ["zone", "face"]).join(other, ["donor_zone", "donor_face"])
    d2 = sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("_x")) ** 2)
    return d.groupBy("zone", "vertex", "donor_zone").agg(F.min_by("donor_vertex", F.struct(d2, "donor_vertex")).alias("donor_vertex"))


def connected_zones(joins: DataFrame) -> DataFrame:
    """(node, component): zones linked by joins, named after the least; a zone without joins has no row."""
    return graph.connected_components(joins.select("zone", "donor_zone").distinct(), "zone", "donor_zone")


def global_ids(tables: DataFrame, key: str) -> DataFrame:
    """(zone, key, _id): numbers over all zones, in the order of zones and their own numbers."""
    return numbering.row_numbers(tables.select("zone", key), ["zone", key], "_id")


def merge(cells: DataFrame, faces: DataFrame, vertices: DataFrame, joins: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, faces, vertices) of one zone: (zone, old, cell), (face, left, right, vtx) and (vertex, x, y, z).

    Two joined faces become one inner face and their vertices one vertex each, so the result has no trace of the joins.
    Cells are (zone, cell).  The face of the lesser (zone, face) is kept; its left cell stays left.
    """
    cell_ids, vertex_ids = global_ids(cells, "cell"), global_ids(vertices, "vertex")
    own, other = F.struct(F.col("zone"), F.col("face")), F.struct(F.col("donor_zone").alias("zone"), F.col("donor_face").alias("face"))
    pairs = joins.select(F.least(own, other).alias("k"), F.greatest(own, other).alias("g")).distinct()
    # Vertices that meet get the least number of their group; numbers without gaps follow.
    links = vertex_pairs(joins, faces, vertices)
    mine = vertex_ids.select("zone", "vertex", F.col("_id").alias("_a"))
    donor = vertex_ids.select(F.col("zone").alias("donor_zone"), F.col("vertex").alias("donor_vertex"), F.col("_id").alias("_b"))
    groups = graph.connected_components(links.join(mine, ["zone", "vertex"]).join(donor, ["donor_zone", "donor_vertex"]), "_a", "_b")
    group = vertex_ids.join(groups.withColumnRenamed("node", "_id"), "_id", "left").select("zone", "vertex", F.coalesce("component", "_id").alias("_g"), "_id")
    new_ids = numbering.row_numbers(group.select("_g").distinct(), ["_g"], "new")
    group = group.join(new_ids, "_g")
    kept = group.filter("_g = _id").join(vertices, ["zone", "vertex"]).select(F.col("new").alias("vertex"), "x", "y", "z")
    # Faces: cells and vertices in their new numbers.
    c = cell_ids.select("zone", F.col("cell").alias("_c"), F.col("_id").alias("_n"))
    f = faces
    for s in ("left", "right"):
        f = f.join(c.withColumnRenamed("_c", s), ["zone", s], "left").withColumn(s, F.coalesce("_n", F.lit(0))).drop("_n")
    v = faces.select("zone", "face", F.posexplode("vtx").alias("pos", "vertex")).join(group.select("zone", "vertex", "new"), ["zone", "vertex"])
    v = v.groupBy("zone", "face").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("p")).select("zone", "face", F.col("p.new").alias("vtx"))
    f = f.drop("vtx").join(v, ["zone", "face"])
    dropped = pairs.select(F.col("k.zone").alias("zone"), F.col("k.face").alias("face"), F.col("g.zone").alias("_z"), F.col("g.face").alias("_f"))
    inner = f.select(F.col("zone").alias("_z"), F.col("face").alias("_f"), F.greatest("left", "right").alias("_beyond"))
    beyond = dropped.join(inner, ["_z", "_f"]).select("zone", "face", "_beyond")
    f = f.join(dropped.select(F.col("_z").alias("zone"), F.col("_f").alias("face")), ["zone", "face"], "left_anti").join(beyond, ["zone", "face"], "left")
    open_left = F.col("left") == 0
    f = f.select("zone", "face", F.when(open_left & F.col("_beyond").isNotNull(), F.col("_beyond")).otherwise(F.col("left")).alias("left"), F.when(~open_left & F.col("_beyond").isNotNull(), F.col("_beyond")).otherwise(F.col("right")).alias("right"), "vtx")
    f = numbering.row_numbers(f, ["zone", "face"], "_id").select(F.col("_id").alias("face"), "left", "right", "vtx")
    return cell_ids.select("zone", F.col("cell").alias("old"), F.col("_id").alias("cell")), f, kept


def merge_subsets(items: DataFrame, ids: DataFrame, how: str = "name", number: str = "cell", families: DataFrame | None = None) -> DataFrame:
    """Subset items (zone, name, gnum) in the merged numbers (zone, old, number): those of one name together, those of one family
    (zone, name, family) with those without kept apart, or (`None`) all kept apart as name.zone.  An item that several of them hold comes once."""
    d = items.join(ids.withColumnRenamed("old", "gnum"), ["zone", "gnum"])
    apart = F.concat("name", F.lit("."), F.col("zone").cast("string"))
    if how == "family":
        if families is None:
            raise ValueError("merging by family needs the families of subsets")
        # A subset has one family; the least, if it is given several.
        d = d.join(families.groupBy("zone", "name").agg(F.min("family").alias("_family")), ["zone", "name"], "left")
        name = F.coalesce("_family", apart)
    else:
        name = F.col("name") if how == "name" else apart
    return d.select(name.alias("name"), F.col(number).alias("gnum")).distinct()


def rotated_copies(vertices: DataFrame, copies: int, angles: Sequence[float], size: int, centre: Sequence[float] = (0, 0, 0), shift: Sequence[float] = (0, 0, 0)) -> DataFrame:
    """(copy, vertex, x, y, z): the vertices and `copies` copies, each moved once more than the one before; numbers of copy n start after n * size."""
    moves = []
    for n in range(copies + 1):
        m = geometry.rotation_matrix([a * n for a in angles])
        entries = {f"_m{i}{j}": m[i][j] for i in range(3) for j in range(3)} | {f"_t{i}": centre[i] + shift[i] * n for i in range(3)}
        moves.append(F.struct(F.lit(n).cast("long").alias("copy"), *[F.lit(float(v)).alias(k) for k, v in entries.items()]))
    # One pass over the vertices, whatever the number of copies.
    d = vertices.select("vertex", "x", "y", "z", F.inline(F.array(*moves)))
    off = [F.col(c) - float(o) for c, o in zip("xyz", centre)]
    turned = [off[0] * F.col(f"_m{i}0") + off[1] * F.col(f"_m{i}1") + off[2] * F.col(f"_m{i}2") + F.col(f"_t{i}") for i in range(3)]
    return d.select("copy", (F.col("vertex") + F.col("copy") * size).alias("vertex"), *[F.when(F.col("copy") == 0, F.col(c).cast("double")).otherwise(t).alias(c) for c, t in zip("xyz", turned)])


def copies_to_full_turn(angle: float) -> int:
    """How many further copies of a sector of this angle (radians) complete the circle."""
    from math import isclose, pi

    n = round(2 * pi / abs(angle))
    if not isclose(n * abs(angle), 2 * pi, rel_tol=1e-4):
        raise ValueError("the angle does not divide a full turn")
    return n - 1


def shared_vertex_numbers(vertices: DataFrame, pairs: DataFrame, merge: bool = True) -> DataFrame:
    """(zone, vertex, gnum): numbers 1, 2, .. of the vertices (zone, vertex) of all zones, one for all that joins tie together.

    pairs are (zone, vertex, donor_zone, donor_vertex), in one direction or both; a vertex may be in several joins, and in
    a periodic one with its own zone.  Numbers follow the least (zone, vertex) of each group.  Without `merge` each has its own.
    """
    ids = stored(global_ids(vertices.distinct(), "vertex"), "vertex-ids")
    if not merge:
        return ids.select("zone", "vertex", F.col("_id").alias("gnum"))
    own = pairs.join(ids.withColumnRenamed("_id", "a"), ["zone", "vertex"])
    far = ids.select(F.col("zone").alias("donor_zone"), F.col("vertex").alias("donor_vertex"), F.col("_id").alias("b"))
    groups = graph.connected_components(own.join(far, ["donor_zone", "donor_vertex"]), "a", "b")
    d = ids.join(groups.withColumnRenamed("node", "_id"), "_id", "left").withColumn("_root", F.coalesce("component", "_id"))
    numbers = numbering.row_numbers(d.select("_root").distinct(), ["_root"], "gnum")
    return d.join(numbers, "_root").select("zone", "vertex", "gnum")
