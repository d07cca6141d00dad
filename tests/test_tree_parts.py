"""A tree of two zones through partitioning and back, and what the parts hold."""

import pytest
from gnomon.operators import tree_parts
from pyspark.sql import functions as F

NODE = "path string, parent string, name string, label string, depth int, ord int, dtype string, size long, value string"


def tree(spark):
    """Two zones: a row of three cubes whose faces are polygons, and one cube; fields at all locations, boundaries with data, a whole array."""
    nodes, values = [], []

    def node(path, label, array=None, value=None):
        parts = path.split("/")
        nodes.append((path, "/".join(parts[:-1]), parts[-1], label, len(parts), len(nodes), None, None if array is None else len(array), value))
        values.extend((path, i, float(x)) for i, x in enumerate(array or []))

    node("Base", "CGNSBase_t")
    for zone, n in (("Base/A", 3), ("Base/B:1", 1)):
        at = lambda i, j, k: 1 + i + (n + 1) * (j + 2 * k)
        faces = [(i, i + 1, [at(i, 0, 0), at(i, 0, 1), at(i, 1, 1), at(i, 1, 0)]) for i in range(n + 1)]
        for c in range(n):
            for q in ((0, 0), (1, 0)):
                faces.append((c + 1, 0, [at(c, q[0], 0), at(c + 1, q[0], 0), at(c + 1, q[0], 1), at(c, q[0], 1)]))
                faces.append((0, c + 1, [at(c, 0, q[0]), at(c, 1, q[0]), at(c + 1, 1, q[0]), at(c + 1, 0, q[0])]))
        faces = [(left, right if right <= n else 0, v) for left, right, v in faces]
        places = [(i, j, k) for k in range(2) for j in range(2) for i in range(n + 1)]
        node(zone, "Zone_t", value="[[1]]")
        node(f"{zone}/GridCoordinates", "GridCoordinates_t")
        for a, c in enumerate("XYZ"):
            node(f"{zone}/GridCoordinates/Coordinate{c}", "DataArray_t", [p[a] * 1.5 for p in places])
        node(f"{zone}/NGon", "Elements_t", value="[22, 0]")
        offsets = [0]
        for _, _, v in faces:
            offsets.append(offsets[-1] + len(v))
        node(f"{zone}/NGon/ElementStartOffset", "DataArray_t", offsets)
        node(f"{zone}/NGon/ElementConnectivity", "DataArray_t", [x for f in faces for x in f[2]])
        node(f"{zone}/NGon/ParentElements", "DataArray_t", [f[0] for f in faces] + [f[1] for f in faces])
        for name, location, size in (("AtCells", "CellCenter", n), ("AtVertices", None, len(places)), ("AtFaces", "FaceCenter", len(faces))):
            node(f"{zone}/{name}", "FlowSolution_t")
            if location:
                node(f"{zone}/{name}/GridLocation", "GridLocation_t", value=f'"{location}"')
            node(f"{zone}/{name}/f", "DataArray_t", [x * x + 0.25 for x in range(size)])
        outer = [i + 1 for i, f in enumerate(faces) if 0 in f[:2]]
        node(f"{zone}/ZoneBC", "ZoneBC_t")
        for name, items in (("Wall", outer[::-1]), ("One", outer[:1])):
            node(f"{zone}/ZoneBC/{name}", "BC_t", value='"BCWall"')
            node(f"{zone}/ZoneBC/{name}/GridLocation", "GridLocation_t", value='"FaceCenter"')
            node(f"{zone}/ZoneBC/{name}/PointList", "IndexArray_t", items)
            node(f"{zone}/ZoneBC/{name}/Set", "BCDataSet_t")
            node(f"{zone}/ZoneBC/{name}/Set/Data", "BCData_t")
            node(f"{zone}/ZoneBC/{name}/Set/Data/p", "DataArray_t", [7.0 * x for x in items])
        node(f"{zone}/Region", "ZoneSubRegion_t")
        node(f"{zone}/Region/PointList", "IndexArray_t", [2, 1, len(places)])
        node(f"{zone}/Region/q", "DataArray_t", [5, 6, 7])
        node(f"{zone}/Info", "UserDefinedData_t")
        node(f"{zone}/Info/numbers", "DataArray_t", [3, 1, 4, 1, 5])
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(values, "path string, pos long, value double")


PARTS = {"apart": [("Base/A", 1, 0, 1), ("Base/A", 2, 1, 1), ("Base/A", 3, 0, 2), ("Base/B:1", 1, 1, 1)], "whole": [("Base/A", c, 5, c) for c in (1, 2, 3)] + [("Base/B:1", 1, 5, 1)], "turned": [("Base/A", 3, 0, 1), ("Base/A", 2, 1, 1), ("Base/A", 1, 2, 1), ("Base/B:1", 1, 0, 1)]}


@pytest.mark.parametrize("name", PARTS)
def test_round_trip(spark, name):
    nodes, values = tree(spark)
    pn, pv = tree_parts.partition_tree(nodes, values, spark.createDataFrame(PARTS[name], "zone string, cell long, part int, lnum long"))
    assert pn.groupBy("part", "path").count().filter("count > 1").count() == 0 and pv.groupBy("part", "path", "pos").count().filter("count > 1").count() == 0
    n, v = tree_parts.recover_tree(pn, pv)
    assert {tuple(r) for r in v.collect()} == {tuple(r) for r in values.collect()} and v.count() == values.count()
    keep = ["path", "parent", "name", "label", "depth", "dtype", "value"]
    assert {tuple(r) for r in n.select(keep).collect()} == {tuple(r) for r in nodes.select(keep).collect()} and n.count() == nodes.count()
    assert {(r["path"], r["size"]) for r in n.collect() if r["label"] in ("DataArray_t", "IndexArray_t")} == {(r["path"], r["size"]) for r in nodes.collect() if r["label"] in ("DataArray_t", "IndexArray_t")}


def test_what_parts_hold(spark):
    nodes, values = tree(spark)
    pn, pv = tree_parts.partition_tree(nodes, values, spark.createDataFrame(PARTS["apart"], "zone string, cell long, part int, lnum long"))
    got = {}
    for r in pv.orderBy("part", "path", "pos").collect():
        got.setdefault((r["part"], r["path"]), []).append(r["value"])
    assert got[0, "Base/A/:CGNS#GlobalNumbering/Cell"] == [1, 3] and got[1, "Base/A/:CGNS#GlobalNumbering/Cell"] == [2]
    assert got[0, "Base/A/AtCells/f"] == [0.25, 4.25] and got[1, "Base/A/AtCells/f"] == [1.25]
    assert len(got[1, "Base/A/GridCoordinates/CoordinateX"]) == 8 and len(got[0, "Base/A/GridCoordinates/CoordinateX"]) == 16
    assert set(got[1, "Base/A/GridCoordinates/CoordinateX"]) == {1.5, 3.0}
    # Faces 2 and 3 are shared; the donors of each side are the local numbers of the other.
    face = got[1, "Base/A/:CGNS#GlobalNumbering/Face"]
    own = [face[int(i) - 1] for i in got[1, "Base/A/ZoneGridConnectivity/JN.P1.0/PointList"]]
    other = got[0, "Base/A/:CGNS#GlobalNumbering/Face"]
    assert own == [2, 3] == [other[int(i) - 1] for i in got[1, "Base/A/ZoneGridConnectivity/JN.P1.0/PointListDonor"]]
    assert got[1, "Base/A/ZoneGridConnectivity/JN.P1.0/PointListDonor"] == got[0, "Base/A/ZoneGridConnectivity/JN.P0.1/PointList"]
    n = len(face)
    parents = got[1, "Base/A/NGon/ParentElements"]
    assert len(parents) == 2 * n and sorted(parents) == [0] * n + [1] * n
    wall, index = got[1, "Base/A/ZoneBC/Wall/PointList"], got[1, "Base/A/ZoneBC/Wall/:CGNS#GlobalNumbering/Index"]
    assert [7 * face[int(i) - 1] for i in wall] == got[1, "Base/A/ZoneBC/Wall/Set/Data/p"] and index == sorted(index)
    assert got[1, "Base/A/Info/numbers"] == [3, 1, 4, 1, 5]
    sizes = {(r["part"], r["path"]): r["size"] for r in pn.filter("label in ('DataArray_t', 'IndexArray_t')").collect()}
    assert all(sizes[k] == len(v) for k, v in got.items())


def test_empty_tree(spark):
    nodes, values = tree(spark)
    pn, pv = tree_parts.partition_tree(nodes.limit(0), values.limit(0), spark.createDataFrame([], "zone string, cell long, part int, lnum long"))
    assert pn.count() == 0 == pv.count()
    assert F.col("part") is not None and "part" in pn.columns


def test_faces_longer_than_a_block_of_corners(spark):
    """Faces that begin, end or lie whole in other blocks than their first, one of three corners after one of many."""
    n = 2 * tree_parts.BLOCK + 7
    faces = [(1, 1, 0, list(range(1, n + 1))), (2, 1, 2, [5, 6, 7]), (3, 2, 0, list(range(n, 0, -1)))]
    f = spark.createDataFrame([("Base/Z", "Base/Z/NGon", *x) for x in faces], "zone string, section string, face long, left long, right long, vtx array<long>")
    back = tree_parts.section_faces(tree_parts.section_values(f))
    assert sorted(tuple(r) for r in back.select("face", "left", "right", "vtx").collect()) == faces


def test_section_values_makes_its_faces_once(spark):
    """Beside the sample for the ranges, faces are computed a single time: they were joined to their own offsets before."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    f = spark.range(1, 101).selectExpr("'B/Z/N' AS section", "id AS face", "1L AS left", "0L AS right", "array(id, id + 1, id + 2) AS vtx")
    values = tree_parts.section_values(f.mapInArrow(count, f.schema))
    assert values.filter("path = 'B/Z/N/ElementConnectivity'").count() == 300 and values.filter("path = 'B/Z/N/ElementStartOffset'").count() == 101
    assert seen.value <= 200


def test_row_numbers_are_not_dealt_out_again(spark):
    from gnomon.operators import numbering

    d = numbering.row_numbers(spark.range(50, 0, -1).toDF("k"), ["k"])
    assert [tuple(r) for r in d.orderBy("k").collect()] == [(k, k) for k in range(1, 51)]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" not in plan  # only the ranges, one row each, go through a window
