import itertools
import random

import numpy as np
import pytest
from gnomon.functions import geometry, index
from gnomon.operators import exchange, graph, interpolation, numbering, spatial, trees
from pyspark.sql import functions as F

N = (3, 4, 2)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_faces_of_a_structured_block(spark):
    """Every cell has six faces; a face has the parents that hold its vertices."""
    n = sum(index.face_counts(N))
    start = 0
    seen: dict[int, int] = {}
    for axis, count in enumerate(index.face_counts(N)):
        d = spark.range(start + 1, start + count + 1)
        left, right = index.face_parents(axis, F.col("id"), N)
        i, j, k = index.face_ijk(axis, F.col("id"), N)
        for r in d.select("id", left.alias("l"), right.alias("r"), index.face_vertices(axis, F.col("id"), N).alias("v"), index.face_index(axis, i, j, k, N).alias("back")).collect():
            assert r["back"] == r["id"] and len(set(r["v"])) == 4
            for c in (r["l"], r["r"]):
                if c:
                    seen[c] = seen.get(c, 0) + 1
        start += count
    assert start == n and seen == {c: 6 for c in range(1, 7)}


@pytest.mark.parametrize("location", ["Vertex", "CellCenter", "IFaceCenter", "JFaceCenter", "KFaceCenter"])
def test_locations_round_trip(spark, location):
    size = index.entity_size(location, N)
    n = size[0] * size[1] * size[2]
    shift = sum(index.face_counts(N)[: "IJK".find(location[0])]) if "Face" in location else 0
    d = spark.range(shift + 1, shift + n + 1)
    i, j, k = index.location_from_index(F.col("id"), location, N)
    got = d.select("id", i.alias("i"), j.alias("j"), k.alias("k"), index.index_from_location(i, j, k, location, N).alias("b")).collect()
    assert all(r["id"] == r["b"] for r in got)
    assert {(r["i"], r["j"], r["k"]) for r in got} == set(itertools.product(*[range(1, s + 1) for s in size]))


def test_affine_keeps_distances(spark):
    d = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    p = geometry.affine([F.col("x"), F.col("y"), F.col("z")], (0.3, 0.4, 0.5), (1, 1, 1))
    q = [F.lit(1.0)] * 3
    r = d.select(geometry.distance(p, q).alias("a"), geometry.distance([F.col("x"), F.col("y"), F.col("z")], q).alias("b")).first()
    assert abs(r["a"] - r["b"]) < 1e-12


def test_transform_point(spark):
    p = index.transform_point((-2, 1, 3), [F.lit(2), F.lit(5), F.lit(1)], (1, 1, 1), (1, 9, 1))
    assert tuple(spark.range(1).select(*p).first()) == (5, 8, 1)


def test_uniform_bounds():
    assert numbering.uniform_bounds(10, 4) == [0, 3, 6, 8, 10]
    assert numbering.uniform_bounds(2, 4) == [0, 1, 2, 2, 2]


def test_arrays(spark):
    d = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [7])], "k int, a array<int>")
    assert [r[0] for r in d.orderBy("k").select(numbering.roll_from(F.col("a"), F.lit(0)).alias("x")).collect()] == [[1, 2, 3, 4], [7]]
    one = d.filter("k = 1")
    assert one.select(numbering.roll_from(F.col("a"), F.lit(2))).first()[0] == [3, 4, 1, 2]
    assert one.select(numbering.roll_from(F.col("a"), F.lit(2), True)).first()[0] == [3, 2, 1, 4]
    assert one.select(numbering.roll_from_value(F.col("a"), F.lit(4))).first()[0] == [4, 1, 2, 3]
    assert one.select(numbering.interlaced(F.col("a"))).first()[0] == [4, 1, 2, 3, 4]
    assert one.select(numbering.is_circular_sublist(F.array(F.lit(4), F.lit(1)), F.col("a")), numbering.is_circular_sublist(F.array(F.lit(1), F.lit(3)), F.col("a"))).first()[:] == (True, False)
    merged = numbering.jagged_merge(d, d.filter("k = 2"), "k", "a")
    assert rows(merged) == [(1, [1, 2, 3, 4]), (2, [7, 7])]


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(path, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(41)}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_k_closest_far_and_empty(spark):
    src = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1000.0, 1000.0)], "s long, x double, y double")
    tgt = spark.createDataFrame([(1, 5000.0, -300.0), (2, 0.4, 0.0)], "t long, x double, y double")
    got = rows(spatial.k_closest(src, tgt, ["x", "y"], "s", "t", 5).select("t", "rank", "s"))
    assert got == [(1, 1, 3), (1, 2, 2), (1, 3, 1), (2, 1, 1), (2, 2, 2), (2, 3, 3)]
    assert spatial.k_closest(src.limit(0), tgt, ["x", "y"], "s", "t", 2).count() == 0


NODES = [("A", "", "A", "Base_t", 1, 0), ("A/Z1", "A", "Z1", "Zone_t", 2, 1), ("A/Z1/X", "A/Z1", "X", "DataArray_t", 3, 2), ("A/Z2", "A", "Z2", "Zone_t", 2, 3), ("B", "", "B", "Base_t", 1, 4)]


def tree(spark):
    return spark.createDataFrame([(*n, "R8", 3, None) for n in NODES], trees.SCHEMA)


def test_tree_search(spark):
    t = tree(spark)
    assert [r["path"] for r in trees.select_nodes(t, name="Z*", label="Zone_t").orderBy("path").collect()] == ["A/Z1", "A/Z2"]
    assert [r["path"] for r in trees.chain(t, [{"label": "Base_t"}, {"name": "Z1"}, {"label": "DataArray_t"}]).collect()] == ["A/Z1/X"]
    assert trees.first_match(t, label="Zone_t").first()["path"] == "A/Z1"
    assert trees.keep(t, exclude=["A/*"]).count() == 2
    with pytest.raises(ValueError):
        trees.keep(t, ["a"], ["b"])
    assert rows(trees.remove(t, t.filter("path = 'A/Z1'")).select("path")) == [("A",), ("A/Z2",), ("B",)]
    assert rows(trees.rename(t, "A/Z1", "A/W").select("path", "parent", "name").filter("path like 'A/W%'")) == [("A/W", "A", "W"), ("A/W/X", "A/W", "X")]
    assert rows(trees.table_of_sizes(t).filter("path = 'A'")) == [("A", 4, 12)]
    assert trees.merge([t, t.filter("depth = 1")]).count() == 5


def test_diff_with_nulls_and_tolerance(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0000001), (2, None), (4, 3.0)], "k int, v double")
    assert rows(trees.diff(a, b, ["k"], ["v"], 1e-3)) == [(3, "missing_right"), (4, "missing_left")]
    assert (1, "changed") in rows(trees.diff(a, b, ["k"], ["v"]))


def test_is_unique_ignores_order(spark):
    d = spark.createDataFrame([(1, 2, 3), (3, 2, 1), (1, 1, 2)], "a int, b int, c int")
    assert rows(exchange.is_unique_tuple(d, ["a", "b", "c"])) == [(1, 1, 2, True), (1, 2, 3, False), (3, 2, 1, False)]


def test_k_closest_finds_far_targets(spark):
    """Clustered sources and targets far from them, or beside them so that early rings cover a part of their box."""
    r = random.Random(4)
    src = [(i, r.random(), r.random()) for i in range(100)]
    tgt = [(0, 6.0, 6.0), (1, 1000.0, 0.0), (2, -3.0, 0.5), (3, 0.5, 0.5), (4, 1e12, -1e12), (5, 1.4, -40.0), (6, -1e30, 0.0)]
    s, t = spark.createDataFrame(src, "s int, x double, y double"), spark.createDataFrame(tgt, "t int, x double, y double")
    near = lambda k: {a: sorted(((x - p) ** 2 + (y - q) ** 2, i) for i, p, q in src)[:k] for a, x, y in tgt}
    for k, rounds in ((3, 40), (3, 1), (150, 40)):
        got = {a: [] for a, _, _ in tgt}
        for row in spatial.k_closest(s, t, ["x", "y"], "s", "t", k, max_rounds=rounds).orderBy("t", "rank").collect():
            got[row["t"]].append(row["distance2"])
        assert all(np.allclose(got[a], [d for d, _ in n], rtol=1e-12) for a, n in near(k).items())
    centres = s.select(F.col("s").alias("cell"), "x", "y", F.lit(0.0).alias("z"))
    found = interpolation.source_of(t.filter("t < 4").select(F.col("t").alias("target"), "x", "y", F.lit(0.0).alias("z")), centres, None, None).collect()
    assert {row["target"]: row["cell"] for row in found} == {a: n[0][1] for a, n in near(1).items() if a < 4}
