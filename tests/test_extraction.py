"""Extracted meshes: odd items, errors, geometry that is kept, structured windows against lists of cells."""

import itertools

import pytest
from gnomon.operators import extraction, mesh
from pyspark.sql import functions as F


def block(spark, n):
    m = n + 1
    at = lambda i, j, k: 1 + i + m * j + m * m * k
    vertices = [(at(i, j, k), float(i), float(j), float(k)) for k in range(m) for j in range(m) for i in range(m)]
    cells = []
    for k, j, i in itertools.product(range(n), repeat=3):
        low = [at(i, j, k), at(i + 1, j, k), at(i + 1, j + 1, k), at(i, j + 1, k)]
        cells.append((1 + i + n * j + n * n * k, low + [v + m * m for v in low]))
    faces = mesh.elements_to_faces(spark.createDataFrame(cells, "cell long, vtx array<long>"), "HEXA_8")
    return faces, spark.createDataFrame(vertices, "vertex long, x double, y double, z double")


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "gnum long")


def test_cells_keep_closed_outward_faces(spark):
    """Repeated, null, zero and foreign items count for nothing; each kept cell is closed, of volume one."""
    faces, vertices = block(spark, 3)
    e = extraction.Extractor(faces, vertices, numbers(spark, 14, 15, 27, 14, None, 0, 99), "CellCenter")
    f, v = e.faces().collect(), {r["vertex"]: (r["x"], r["y"], r["z"]) for r in e.vertices().collect()}
    assert sorted(r["face"] for r in f) == list(range(1, len(f) + 1)) and sorted(v) == list(range(1, len(v) + 1))
    assert {r["left"] for r in f} | {r["right"] for r in f} == {0, 1, 2, 3} and all(r["left"] > 0 for r in f)
    volume = dict.fromkeys((1, 2, 3), 0.0)
    for r in f:
        a, b, c, d = (v[x] for x in r["vtx"])
        for p, q, s in ((a, b, c), (a, c, d)):
            det = p[0] * (q[1] * s[2] - q[2] * s[1]) - p[1] * (q[0] * s[2] - q[2] * s[0]) + p[2] * (q[0] * s[1] - q[1] * s[0])
            volume[r["left"]] += det / 6
            if r["right"]:
                volume[r["right"]] -= det / 6
    assert all(abs(x - 1) < 1e-9 for x in volume.values())


def test_empty_vertices_and_errors(spark):
    faces, vertices = block(spark, 2)
    none = extraction.Extractor(faces, vertices, numbers(spark), "FaceCenter")
    assert none.faces().count() == none.vertices().count() == 0
    some = extraction.Extractor(faces, vertices, numbers(spark, 3, 27, 28), "Vertex")
    assert sorted(map(tuple, some.vertices().select("vertex", "old").collect())) == [(1, 3), (2, 27)]
    fields = spark.createDataFrame([("a", "Vertex", 27, "x", 1.5), ("a", "CellCenter", 3, "x", 2.5)], "container string, location string, gnum long, name string, value double")
    assert [tuple(r) for r in some.exchange(fields).collect()] == [("a", "Vertex", 2, "x", 1.5)]
    with pytest.raises(ValueError):
        some.faces()
    with pytest.raises(ValueError):
        extraction.Extractor(faces, vertices, numbers(spark, 1), "EdgeCenter")
    subsets = spark.createDataFrame([("A", "Vertex", 1, 1), ("B", "FaceCenter", 1, 1)], "subset string, location string, place long, gnum long")
    for names in (["C"], ["A", "B"]):
        with pytest.raises(ValueError):
            extraction.of_subset(faces, vertices, subsets, names)
    with pytest.raises(ValueError, match="lost"):
        extraction.extents_of(spark.createDataFrame([("lost", None)], "container string, subset string"), subsets)


def test_partial_containers_with_repeated_and_foreign_items(spark):
    """The first place of an item counts; items outside of the extract go; two containers are numbered apart."""
    faces, vertices = block(spark, 2)
    e = extraction.Extractor(faces, vertices, numbers(spark, 2, 4, 6), "CellCenter")
    extents = spark.createDataFrame([("a", "CellCenter", p, g) for p, g in enumerate([6, 1, 2, 6], 1)] + [("b", "CellCenter", 1, 4)], "container string, location string, place long, gnum long")
    plan = e.intersection(extents)
    data = spark.createDataFrame([("a", p, "t", float(p)) for p in range(1, 5)] + [("b", 1, "t", 9.0)], "container string, place long, name string, value double")
    got = sorted(tuple(r) for r in e.exchange_partial(data, plan).collect())
    assert got == [("a", "CellCenter", 1, 1, "t", 3.0), ("a", "CellCenter", 3, 2, "t", 1.0), ("b", "CellCenter", 2, 1, "t", 9.0)]


@pytest.mark.parametrize("window", [(2, 4, 1, 3, 2, 5), (3, 3, 1, 4, 2, 5), (1, 4, 4, 4, 1, 2), (2, 2, 3, 3, 1, 5)])
def test_structured_windows(spark, window):
    size, zone = (4, 4, 5), "zone long, "
    ranges = [(window[2 * a], window[2 * a + 1]) for a in range(3)]
    windows = spark.createDataFrame([(7, *window)], zone + ", ".join(f"{a}{s} long" for a in "ijk" for s in "01"))
    zones = spark.createDataFrame([(7, *size)], zone + "ni long, nj long, nk long")
    rows, wanted = [], set()
    for loc in ("Vertex", "CellCenter", "IFaceCenter", "JFaceCenter", "KFaceCenter"):
        less = [int(not (loc == "Vertex" or loc[0] == "IJK"[a])) if loc != "CellCenter" else 1 for a in range(3)]
        n = [s - x for s, x in zip(size, less)]
        kept = [p for p in itertools.product(*[range(1, x + 1) for x in n]) if all(r[0] <= q <= r[1] - x for q, r, x in zip(p, ranges, less))]
        kept.sort(key=lambda p: p[::-1])
        for p in itertools.product(*[range(1, x + 1) for x in n]):
            g = p[0] + (p[1] - 1) * n[0] + (p[2] - 1) * n[0] * n[1]
            rows.append((7, "c", loc, g, "v", float(g)))
            if p in kept:
                wanted.add((loc, kept.index(p) + 1, float(g)))
    fields = spark.createDataFrame(rows, "zone long, container string, location string, gnum long, name string, value double")
    got = extraction.structured_exchange(fields, zones, windows)
    assert {(r["location"], r["gnum"], r["value"]) for r in got.collect()} == wanted and got.count() == len(wanted)


def test_plans_are_joins_on_keys(spark):
    """No plan of an exchange has a product of tables."""
    faces, vertices = block(spark, 2)
    e = extraction.Extractor(faces, vertices, numbers(spark, 1), "CellCenter")
    fields = vertices.select(F.lit("a").alias("container"), F.lit("Vertex").alias("location"), F.col("vertex").alias("gnum"), F.lit("x").alias("name"), F.col("x").alias("value"))
    for d in (e.exchange(fields), e.faces(), e.vertices()):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner\n" not in plan and "Cross" not in plan


def test_distinct_numbers_are_found_location_by_location(spark, monkeypatch):
    """A task that makes the numbers of a mesh distinct holds them alone; it held the names of locations and the faces of cells too."""
    seen, plain = [], extraction._numbered
    monkeypatch.setattr(extraction, "_numbered", lambda items, *a: seen.append(items) or plain(items, *a))
    faces = spark.createDataFrame([(1, 1, 2, [1, 2, 3]), (2, 1, 0, [1, 2, 4]), (3, 2, 0, [2, 3, 5]), (4, 3, 0, [6, 7, 8])], "face long, left long, right long, vtx array<long>")
    vertices = spark.range(1, 9).selectExpr("id AS vertex", "0D AS x", "0D AS y", "0D AS z")
    e = extraction.Extractor(faces, vertices, spark.createDataFrame([(1,), (2,), (2,)], "gnum long"), "CellCenter")
    rows = sorted(tuple(r) for r in e.numbers.select("location", "gnum", "old").collect())
    assert rows == [("CellCenter", 1, 1), ("CellCenter", 2, 2), ("FaceCenter", 1, 1), ("FaceCenter", 2, 2), ("FaceCenter", 3, 3), *[("Vertex", n, n) for n in range(1, 6)]]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [location" not in plan and "Aggregate [face" not in plan
