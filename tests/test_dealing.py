"""Full trees dealt out: slices as of lists, with polygons of any size, fewer items than parts, and back; joins of vertices; parents."""

import random

import pytest
from gnomon.operators import full_trees, mesh, structured, transfer, zones

VALUES = "path string, pos long, value double"


def rows(path, xs):
    return [(path, i, float(x)) for i, x in enumerate(xs)]


def even(n, parts):
    q, r = divmod(n, parts)
    return [i * q + min(i, r) for i in range(parts + 1)]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_slices_and_back(spark, parts, monkeypatch):
    monkeypatch.setattr(full_trees, "CHUNK", 4)
    r = random.Random(parts)
    sizes = [r.choice([0, 3, 4, 9]) for _ in range(5)]
    offsets = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    corners, left, right = ([r.randrange(50) for _ in range(n)] for n in (offsets[-1], 5, 5))
    triangles, points, data = ([r.randrange(50) for _ in range(n)] for n in (3 * 4, 2, 2))
    arrays = {
        "B/Z/NGon/ElementStartOffset": offsets, "B/Z/NGon/ElementConnectivity": corners, "B/Z/NGon/ParentElements": left + right, "B/Z/Tri/ElementConnectivity": triangles,
        "B/Z/ZoneBC/W/PointList": points, "B/Z/ZoneBC/W/Set/p": data, "B/Z/None/ElementStartOffset": [0],
    }
    values = spark.createDataFrame([x for p, xs in arrays.items() for x in rows(p, xs)], VALUES)
    dealt, shares = full_trees.distributed(values, parts, spark.createDataFrame([("B/Z/Tri", 3)], "section string, width int"))
    got = {}
    for x in dealt.collect():
        got.setdefault((x["path"], x["part"]), []).append((x["pos"], x["value"]))
    f, t, w = even(5, parts), even(4, parts), even(2, parts)
    for p in range(parts):
        wanted = {
            "B/Z/NGon/ElementStartOffset": offsets[f[p] : f[p + 1] + 1], "B/Z/NGon/ElementConnectivity": corners[offsets[f[p]] : offsets[f[p + 1]]],
            "B/Z/NGon/ParentElements": left[f[p] : f[p + 1]] + right[f[p] : f[p + 1]], "B/Z/Tri/ElementConnectivity": triangles[3 * t[p] : 3 * t[p + 1]],
            "B/Z/ZoneBC/W/PointList": points[w[p] : w[p + 1]], "B/Z/ZoneBC/W/Set/p": data[w[p] : w[p + 1]], "B/Z/None/ElementStartOffset": [0],
        }
        for path, xs in wanted.items():
            assert sorted(got.get((path, p), [])) == [(i, float(x)) for i, x in enumerate(xs)], (path, p)
    assert sorted(map(tuple, full_trees.whole(dealt, shares).collect())) == sorted(map(tuple, values.collect()))


def test_no_parts_and_no_values(spark):
    none = spark.createDataFrame([], VALUES)
    with pytest.raises(ValueError):
        full_trees.distributed(none, 0)
    dealt, shares = full_trees.distributed(none, 3)
    assert dealt.count() == shares.count() == full_trees.whole(dealt, shares).count() == 0


def test_vertices_tied_in_a_ring(spark):
    """A vertex in several joins, a join given twice and one to its own zone end in one number; without joins or merging each has its own."""
    v = spark.createDataFrame([(z, n) for z in "abc" for n in (1, 2)], "zone string, vertex long")
    pair = "zone string, vertex long, donor_zone string, donor_vertex long"
    pairs = spark.createDataFrame([("a", 1, "b", 2), ("b", 2, "a", 1), ("b", 2, "c", 1), ("c", 1, "a", 1), ("c", 2, "c", 2)], pair)
    got = {(r["zone"], r["vertex"]): r["gnum"] for r in zones.shared_vertex_numbers(v, pairs).collect()}
    assert got == {("a", 1): 1, ("a", 2): 2, ("b", 1): 3, ("b", 2): 1, ("c", 1): 1, ("c", 2): 4}
    for p, merge in ((pairs, False), (spark.createDataFrame([], pair), True)):
        assert sorted(r["gnum"] for r in zones.shared_vertex_numbers(v, p, merge).collect()) == [1, 2, 3, 4, 5, 6]


def test_parents_without_cells_and_reversed_ranges(spark):
    f = spark.createDataFrame([("a", 1, 0, 0), ("b", 1, 4, 0), ("b", 2, 0, 5), ("b", 3, 5, 4), ("c", 1, 1, 2)], "zone string, face long, left long, right long")
    got = mesh.local_parents(f, spark.createDataFrame([("a", 1), ("b", 3), ("c", 1)], "zone string, last long"))
    assert sorted((r["zone"], r["face"], r["left"], r["right"]) for r in got.collect()) == [("a", 1, 0, 0), ("b", 1, 1, 0), ("b", 2, 0, 2), ("b", 3, 2, 1), ("c", 1, 1, 2)]
    with pytest.raises(ValueError):
        mesh.block_centres(f, f, (2, 2, 2), "EdgeCenter")
    columns = "zone string, part int, name string, " + ", ".join(f"{a}{s} long" for a in "ijk" for s in "01")
    r = spark.createDataFrame([("z", 0, "m.P0.P3", 1, 1, 4, 2, 1, 5), ("z", 1, "m.P1.P3", 1, 1, 1, 3, 1, 5), ("z", 1, "n", 2, 2, 1, 1, 1, 1)], columns)
    b = spark.createDataFrame([("z", 0, 0, 2, 0, 3, 0, 4), ("z", 1, 0, 2, 3, 6, 0, 4)], "zone string, part int, " + ", ".join(f"b{a}{s} long" for a in "ijk" for s in "01"))
    assert sorted(tuple(x) for x in structured.ranges_from_parts(r, b).collect()) == [("z", "m", 1, 1, 6, 2, 1, 5), ("z", "n", 2, 2, 4, 4, 1, 1)]


def test_elements_of_several_parts_come_once(spark):
    e = spark.createDataFrame([("z", "t", 0, 1, [1, 2, 3]), ("z", "t", 1, 1, [3, 1, 2]), ("z", "t", 1, 2, [2, 2, 1])], "zone string, section string, part int, gnum long, vtx array<long>")
    v = spark.createDataFrame([("z", 0, 1, 7), ("z", 0, 2, 8), ("z", 0, 3, 9), ("z", 1, 1, 8), ("z", 1, 2, 9), ("z", 1, 3, 7)], "zone string, part int, lnum long, gnum long")
    assert sorted(tuple(r) for r in transfer.elements_from_parts(e, v).collect()) == [("z", "t", 1, [7, 8, 9]), ("z", "t", 2, [9, 9, 8])]
    s = spark.createDataFrame([("z", "t", 2, 10), ("z", "u", 1, 4)], "zone string, section string, ord int, size long")
    assert sorted(r["number"] for r in transfer.element_numbers(e, s).collect()) == [5, 5, 6]


def test_merging_by_family(spark):
    """Subsets of one family are one, an item that two of them hold comes once; without a family a subset stays apart."""
    items = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("a", "y", 2), ("b", "x", 1), ("b", "z", 2)], "zone string, name string, gnum long")
    ids = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("b", 1, 12), ("b", 2, 13)], "zone string, old long, cell long")
    families = spark.createDataFrame([("a", "x", "W"), ("a", "y", "W"), ("b", "x", "W"), ("b", "q", "W")], "zone string, name string, family string")
    got = zones.merge_subsets(items, ids, "family", families=families)
    assert sorted(map(tuple, got.collect())) == [("W", 10), ("W", 11), ("W", 12), ("z.b", 13)]
    with pytest.raises(ValueError):
        zones.merge_subsets(items, ids, "family")
