"""Meshes of chosen items with fields that may follow any number of times: the maps are made once and kept.

Unstructured meshes are the tables faces (face, left, right, vtx) and vertices (vertex, x, y, z); fields are rows (container,
location, gnum, name, value).  A container may cover part of a location only: its extent is rows (container, location, place,
gnum), its data rows (container, place, name, value).  Structured zones are windows of vertices i0, i1, j0, .. (closed, from 1,
flat in one direction for faces): there all maps are arithmetic, and each row meets the one row of its zone or container.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import numbering

#: For each location of the chosen items, the locations that the extracted mesh has and what they are called there.
LOCATIONS = {
    "Vertex": {"Vertex": "Vertex"},
    "FaceCenter": {"Vertex": "Vertex", "FaceCenter": "CellCenter"},
    "CellCenter": {"Vertex": "Vertex", "FaceCenter": "FaceCenter", "CellCenter": "CellCenter"},
}
AXES = "ijk"


def _numbered(items: DataFrame, group: Sequence[str], order: str, out: str) -> DataFrame:
    """items with 1, 2, .. inside each group, by the order; no group is one task."""
    d = numbering.row_numbers(items, [*group, order], "_rn")
    first = d.groupBy(*group).agg(F.min("_rn").alias("_first"))
    return d.join(first, list(group)).withColumn(out, F.col("_rn") - F.col("_first") + 1).drop("_rn", "_first")


class Extractor:
    """The mesh of chosen items (gnum) at one location, numbered in the order of the old numbers.

    Items named twice count once, and those that the mesh does not have are left out; so are null ones.  `numbers` is the
    kept map (location, gnum, old), at the locations of the whole mesh.
    """

    def __init__(self, faces: DataFrame, vertices: DataFrame, chosen: DataFrame, location: str):
        if location not in LOCATIONS:
            raise ValueError(f"items at {location} cannot be extracted")
        self.location, self._faces, self._vertices = location, faces, vertices
        wanted = chosen.select(F.col("gnum").cast("long").alias("old")).filter("old > 0").distinct()
        # Each location's numbers are made distinct alone: a task holds numbers, without the names of locations.
        at = lambda d, where: d.select("old").distinct().select(F.lit(where).alias("location"), "old")
        kept = []
        if location == "CellCenter":
            sides = faces.select(F.col("face"), F.explode(F.array("left", "right")).alias("old")).join(wanted, "old")
            kept = [at(sides, "CellCenter"), at(sides.select(F.col("face").alias("old")), "FaceCenter")]
            wanted = sides.select(F.col("face").alias("old")).distinct()
        elif location == "FaceCenter":
            kept = [at(faces.select(F.col("face").alias("old")).hint("merge").join(wanted, "old"), "FaceCenter")]
        if location == "Vertex":
            kept = [at(vertices.select(F.col("vertex").alias("old")).join(wanted, "old"), "Vertex")]
        else:
            kept.append(at(faces.withColumnRenamed("face", "old").join(wanted, "old", "left_semi").select(F.explode("vtx").alias("old")), "Vertex"))
        d = kept[0]
        for k in kept[1:]:
            d = d.unionByName(k)
        self.numbers = stored(_numbered(d, ["location"], "old", "gnum").select("location", F.col("gnum").cast("long").alias("gnum"), F.col("old").cast("long").alias("old")), "extracted").hint("merge")  # small files for as many rows as the mesh

    def _at(self, location: str, number: str = "gnum", old: str = "old") -> DataFrame:
        return self.numbers.filter(F.col("location") == location).select(F.col("gnum").alias(number), F.col("old").alias(old))

    def vertices(self) -> DataFrame:
        """(vertex, old, x, y, z)."""
        return self._at("Vertex", "vertex").join(self._vertices.withColumnRenamed("vertex", "old"), "old").select("vertex", "old", "x", "y", "z")

    def faces(self) -> DataFrame:
        """(face, old, left, right, vtx): of chosen cells, turned round where the left cell is not among them; of chosen faces, without left and right."""
        if self.location == "Vertex":
            raise ValueError("chosen vertices have no faces")
        d = self._at("FaceCenter", "face").join(self._faces.withColumnRenamed("face", "old"), "old")
        ids = self._at("Vertex", "_n", "_v")
        v = d.select("face", F.posexplode("vtx").alias("_pos", "_v")).join(ids, "_v").groupBy("face")
        v = v.agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_n"))), lambda x: x["_n"]).alias("_vtx"))
        if self.location == "FaceCenter":
            return d.select("face", "old").join(v, "face").select("face", "old", F.col("_vtx").alias("vtx"))
        for c in ("left", "right"):
            d = d.join(self._at("CellCenter", f"_{c}", c), c, "left")
        turned = F.col("_left").isNull()
        return d.join(v, "face").select(
            "face", "old", F.coalesce("_left", "_right").alias("left"), F.when(turned, F.lit(0)).otherwise(F.coalesce("_right", F.lit(0))).cast("long").alias("right"),
            F.when(turned, F.reverse("_vtx")).otherwise(F.col("_vtx")).alias("vtx"),
        )

    def _renamed(self) -> Column:
        out = F.lit(None).cast("string")
        for here, there in LOCATIONS[self.location].items():
            out = F.when(F.col("location") == here, there).otherwise(out)
        return out.alias("location")

    def exchange(self, fields: DataFrame) -> DataFrame:
        """(container, location, gnum, name, value) of containers that cover their location, on the extracted mesh; rows at locations that it does not have go."""
        d = fields.withColumnRenamed("gnum", "old").join(self.numbers, ["location", "old"])
        return d.select("container", self._renamed(), "gnum", "name", "value")

    def intersection(self, extents: DataFrame) -> DataFrame:
        """The kept plan of containers that cover part of a location: (container, location, gnum, index, place).

        One row for each item of an extent that the extracted mesh has: its number there, its number 1, 2, .. among the
        container's own, and its place in the container's data (the first one if an extent names an item twice).
        """
        d = extents.groupBy("container", "location", F.col("gnum").cast("long").alias("old")).agg(F.min("place").alias("place"))
        d = _numbered(d.join(self.numbers, ["location", "old"]).drop("old"), ["container", "location"], "gnum", "index")
        return stored(d.select("container", self._renamed(), "gnum", "index", "place"), "intersection")

    @staticmethod
    def exchange_partial(data: DataFrame, plan: DataFrame) -> DataFrame:
        """(container, location, gnum, index, name, value): the data of partial containers by a plan of `intersection`."""
        return data.join(plan, ["container", "place"]).select("container", "location", "gnum", "index", "name", "value")


def of_subset(faces: DataFrame, vertices: DataFrame, subsets: DataFrame, names: Sequence[str]) -> Extractor:
    """The extractor of subsets (subset, location, place, gnum) taken together; they must lie at one location."""
    d = subsets.filter(F.col("subset").isin(*names))
    found = d.agg(F.min("location").alias("a"), F.max("location").alias("b")).first()
    if found["a"] is None:
        raise ValueError(f"no subset of {', '.join(names)}")
    if found["a"] != found["b"]:
        raise ValueError("subsets to extract together must have one location")
    return Extractor(faces, vertices, d.select("gnum"), found["a"])


def extents_of(regions: DataFrame, subsets: DataFrame) -> DataFrame:
    """Extents of containers: `regions` (container, subset) names the boundary or join whose items a container follows; null stands for a subset of its own name."""
    r = regions.select("container", F.coalesce("subset", "container").alias("subset"))
    lost = [x["container"] for x in r.join(subsets.select("subset").distinct(), "subset", "left_anti").select("container").limit(5).collect()]
    if lost:
        raise ValueError(f"containers without items: {', '.join(sorted(lost))}")
    return r.join(subsets, "subset").select("container", "location", "place", "gnum")


def from_element_numbers(items: DataFrame, sections: DataFrame) -> DataFrame:
    """Subsets (.., location, gnum) whose items are counted over all elements, in the numbers of their location: less what lies before the section (location, first); vertices have none."""
    d = items.join(sections.select("location", F.col("first").alias("_first")), "location", "left")
    return d.withColumn("gnum", F.col("gnum") - F.coalesce("_first", F.lit(1)) + 1).drop("_first")


def discovered(fields: DataFrame, extents: DataFrame | None = None) -> DataFrame:
    """(container, location, names, partial): what the parts' fields (container, location, name, ..) hold together; a container that only some parts know is found."""
    d = fields.groupBy("container", "location").agg(F.sort_array(F.collect_set("name")).alias("names"))
    if extents is None:
        return d.withColumn("partial", F.lit(False))
    return d.join(extents.select("container", F.lit(True).alias("partial")).distinct(), "container", "left").withColumn("partial", F.coalesce("partial", F.lit(False))).select("container", "location", "names", "partial")


def _by_vertices(axis: int) -> Column:
    """Whether a row's location counts vertices along the axis (else cells)."""
    return (F.col("location") == "Vertex") | (F.col("location") == f"{AXES[axis].upper()}FaceCenter")


def _lengths(sizes: Sequence[Column]) -> list[Column]:
    """Entities along each axis at a row's location, of numbers of vertices."""
    return [F.when(_by_vertices(a), n).otherwise(F.greatest(n - 1, F.lit(1))) for a, n in enumerate(sizes)]


def _place(number: Column, lengths: Sequence[Column]) -> list[Column]:
    z, plane = number - 1, lengths[0] * lengths[1]
    row = F.pmod(z, plane)
    return [F.pmod(row, lengths[0]) + 1, ((row - F.pmod(row, lengths[0])) / lengths[0]).cast("long") + 1, ((z - row) / plane).cast("long") + 1]


def _number(place: Sequence[Column], lengths: Sequence[Column]) -> Column:
    return (place[0] + (place[1] - 1) * lengths[0] + (place[2] - 1) * lengths[0] * lengths[1]).cast("long")


def _window(prefix: str) -> list[tuple[Column, Column]]:
    return [(F.col(f"{prefix}{a}0"), F.col(f"{prefix}{a}1")) for a in AXES]


def _inside(place: Sequence[Column], window: Sequence[tuple[Column, Column]]) -> Column:
    out = F.lit(True)
    for a, (p, (low, high)) in enumerate(zip(place, window)):
        out = out & (p >= low) & (p <= F.when(_by_vertices(a), high).otherwise(high - 1))
    return out


def _with_window(d: DataFrame, windows: DataFrame, key: Sequence[str], prefix: str, extra: Sequence[str] = ()) -> DataFrame:
    return d.join(windows.select(*key, *extra, *[F.col(f"{a}{s}").cast("long").alias(f"{prefix}{a}{s}") for a in AXES for s in "01"]), list(key))


def structured_exchange(fields: DataFrame, zones: DataFrame, windows: DataFrame, key: Sequence[str] = ("zone",)) -> DataFrame:
    """(key, container, location, gnum, name, value): fields of structured zones inside the window of each, numbered in it.

    `zones` has the vertices ni, nj, nk of each key; numbers run with i fastest at each location of its own (faces normal to
    each axis apart).  A flat window keeps vertices and the faces that lie in it, and has no others.
    """
    d = _with_window(fields, windows, key, "_w").join(zones.select(*key, "ni", "nj", "nk"), list(key))
    place, window = _place(F.col("gnum"), _lengths([F.col(f"n{a}") for a in AXES])), _window("_w")
    inner = _lengths([high - low + 1 for low, high in window])
    d = d.withColumns({f"_p{a}": p for a, p in zip(AXES, place)})
    at = [F.col(f"_p{a}") for a in AXES]
    d = d.filter(_inside(at, window))
    return d.select(*key, "container", "location", _number([p - low + 1 for p, (low, _) in zip(at, window)], inner).alias("gnum"), "name", "value")


def structured_pieces(windows: DataFrame, boxes: DataFrame) -> DataFrame:
    """(zone, part, i0, i1, .. in the part's vertices, oi, oj, ok: vertices of the whole window before the piece): windows cut by the boxes of the parts.

    A flat window goes to the parts whose cells lie below it, or above on the first plane, so no face is in two pieces.
    """
    d = windows.select("zone", *[F.col(f"{a}{s}").cast("long").alias(f"_w{a}{s}") for a in AXES for s in "01"])
    d = d.join(boxes.select("zone", "part", *[f"b{a}{s}" for a in AXES for s in "01"]), "zone")
    keep, out = F.lit(True), []
    for a, (low, high) in zip(AXES, _window("_w")):
        b0, b1 = F.col(f"b{a}0"), F.col(f"b{a}1")
        cell = F.greatest(low - 1, F.lit(1))
        first, last = F.greatest(low, b0 + 1), F.least(high, b1 + 1)
        keep = keep & F.when(low == high, (b0 < cell) & (cell <= b1)).otherwise(first < last)
        out += [(first - b0).alias(f"{a}0"), (last - b0).alias(f"{a}1"), (first - low).alias(f"o{a}")]
    return d.filter(keep).select("zone", "part", *out)


def structured_neighbours(pieces: DataFrame) -> DataFrame:
    """(zone, part, donor_part, axis, i0, i1, ..): planes that two pieces share, in vertices of the extracted zone; joins to parts that have no piece are gone by this.

    Pieces meet by zone, axis and plane.
    """
    whole = {f"{a}{s}": F.col(f"o{a}") + 1 + (F.col(f"{a}1") - F.col(f"{a}0") if s == "1" else 0) for a in AXES for s in "01"}
    d = pieces.select("zone", "part", *[v.cast("long").alias(k) for k, v in whole.items()])
    side = lambda s: d.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"{a}{s}").alias("plane"), (F.col(f"{a}0") < F.col(f"{a}1")).alias("_wide")) for a in AXES])).alias("_x")).select("*", "_x.*").filter("_wide").drop("_x", "_wide")
    far = side("0").select("zone", "axis", "plane", F.col("part").alias("donor_part"), *[F.col(f"{a}{s}").alias(f"_f{a}{s}") for a in AXES for s in "01"])
    d = side("1").join(far, ["zone", "axis", "plane"])
    keep, out = F.lit(True), {}
    for a in AXES:
        low, high = F.greatest(f"{a}0", f"_f{a}0"), F.least(f"{a}1", f"_f{a}1")
        flat = (F.col(f"{a}0") == F.col(f"{a}1")) & (low == high)  # a flat mesh has no width here
        keep = keep & ((F.col("axis") == a) | (low < high) | flat)
        out |= {f"{a}0": low, f"{a}1": high}
    return d.filter(keep).select("zone", "part", "donor_part", "axis", *[v.alias(k) for k, v in out.items()])


def structured_intersection(ranges: DataFrame, windows: DataFrame) -> DataFrame:
    """(zone, container, location, i0, i1, ..): what a container's range of entities has in common with the zone's window, in the extracted zone's own indices; nothing in common, no row.

    Ranges are closed, from 1, in entities of their location.
    """
    d = _with_window(ranges, windows, ["zone"], "_w")
    keep, out = F.lit(True), {}
    for a, (low, high) in enumerate(_window("_w")):
        first = F.greatest(F.col(f"{AXES[a]}0"), low)
        last = F.least(F.col(f"{AXES[a]}1"), F.when(_by_vertices(a), high).otherwise(high - 1))
        keep = keep & (first <= last)
        out |= {f"{AXES[a]}0": first - low + 1, f"{AXES[a]}1": last - low + 1}
    return d.filter(keep).select("zone", "container", "location", *[v.cast("long").alias(k) for k, v in out.items()])


def structured_partial(data: DataFrame, ranges: DataFrame, windows: DataFrame) -> DataFrame:
    """(zone, container, location, gnum, index, name, value): data (zone, container, place, name, value) of containers with a range, inside the window: number in the extracted zone, and in the common range."""
    plan = _with_window(ranges.select("zone", "container", "location", *[F.col(f"{a}{s}").alias(f"_r{a}{s}") for a in AXES for s in "01"]), windows, ["zone"], "_w")
    d = data.join(plan, ["zone", "container"])
    own, window = _window("_r"), _window("_w")
    spread = _place(F.col("place"), [high - low + 1 for low, high in own])
    d = d.withColumns({f"_p{a}": low + p - 1 for a, p, (low, _) in zip(AXES, spread, own)})
    at = [F.col(f"_p{a}") for a in AXES]
    d = d.filter(_inside(at, window))
    first = [F.greatest(low, start) for (low, _), (start, _) in zip(own, window)]
    last = [F.least(high, F.when(_by_vertices(a), stop).otherwise(stop - 1)) for a, ((_, high), (_, stop)) in enumerate(zip(own, window))]
    index = _number([p - f + 1 for p, f in zip(at, first)], [b - f + 1 for f, b in zip(first, last)])
    gnum = _number([p - low + 1 for p, (low, _) in zip(at, window)], _lengths([high - low + 1 for low, high in window]))
    return d.select("zone", "container", "location", gnum.alias("gnum"), index.alias("index"), "name", "value")
