"""Walls, sequences, names, graphs and neighbours on small cases."""

import random

import numpy as np
import pytest
from gnomon.functions import sequences
from gnomon.operators import graph, numbering, spatial, subsets, trees, walls
from pyspark.sql import functions as F


def test_distance_to_faces_against_brute_force(spark):
    """Random polygons of very different sizes, near and far targets, flat and degenerate faces, ties."""
    r = np.random.default_rng(2)
    points = np.concatenate([r.uniform(0, 1, (60, 3)), r.uniform(-50, 50, (6, 3))])
    corners = [list(map(int, r.choice(60, 3, replace=False))) for _ in range(30)] + [[60, 61, 62], [63, 64, 65], [5, 5, 6], [0, 1, 2, 3]]
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "vertex bigint, x double, y double, z double")
    f = spark.createDataFrame(list(enumerate(corners)), "face bigint, vtx array<bigint>")
    at = np.concatenate([r.uniform(0, 1, (40, 3)), r.uniform(-200, 200, (20, 3)), points[:3], [[1e6, 0, 0]]])
    t = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)] + [(999, None, 0.0, 0.0), (998, float("nan"), 0.0, 0.0)], "target bigint, x double, y double, z double")
    got = {x["target"]: x for x in walls.distance_to_faces(t, f, v).collect()}
    assert set(got) == set(range(len(at)))
    steps = [(a / 60, b / 60) for a in range(61) for b in range(61 - a)]
    for i, p in enumerate(at):
        exact = min(float(np.sqrt(walls.nearest_on_triangles(p[None], *[points[[c[0]]], points[[c[k]]], points[[c[k + 1]]]])[0][0])) for c in corners for k in range(1, len(c) - 1))
        assert got[i]["distance"] == pytest.approx(exact, rel=1e-9, abs=1e-9)
        q = np.array([got[i][c] for c in "xyz"])
        assert np.linalg.norm(q - p) == pytest.approx(exact, rel=1e-9, abs=1e-9)
    # The distance to a triangle is the least over a fine sample of it, within the sample's width.
    for c in corners[:6]:
        a, b, d = points[c[:3]]
        sample = np.array([a + s * (b - a) + u * (d - a) for s, u in steps])
        for p in at[:10]:
            found = float(np.sqrt(walls.nearest_on_triangles(p[None], a[None], b[None], d[None])[0][0]))
            near = np.linalg.norm(sample - p, axis=1).min()
            assert found <= near + 1e-12 and near - found < 0.05
    assert walls.distance_to_faces(t, f.limit(0), v).count() == 0


def test_periodic_walls(spark):
    v = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)], "vertex bigint, x double, y double, z double")
    f = spark.createDataFrame([(7, [1, 2, 3])], "face bigint, vtx array<bigint>")
    t = spark.createDataFrame([(1, 9.0, 0.2, 0.2)], "target bigint, x double, y double, z double")
    (r,) = walls.distance_to_faces(t, *reversed(walls.shifted_walls(v, f, [(10, 0, 0), (-10, 0, 0)], 100))).collect()
    assert (r["face"], r["distance"], r["x"]) == (7, 1.0, 10.0)


def test_neighbours_of_odd_points(spark):
    """Null and NaN coordinates have no neighbours and are none; repeated targets count once; k above the number of sources gives all."""
    s = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0), (3, None, 0.0), (4, float("nan"), 1.0)], "s bigint, x double, y double")
    t = spark.createDataFrame([(1, 0.1, 0.0), (1, 0.1, 0.0), (2, None, 0.0), (3, float("nan"), 0.0), (4, 1e7, -1e7)], "t bigint, x double, y double")
    got = sorted((r["t"], r["s"], r["rank"]) for r in spatial.k_closest(s, t, ["x", "y"], "s", "t", 3).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (4, 1, 1), (4, 2, 2)] or got == [(1, 1, 1), (1, 2, 2), (4, 1, 2), (4, 2, 1)]
    assert spatial.k_closest(s.limit(0), t, ["x", "y"], "s", "t").count() == 0


@pytest.mark.parametrize("last", [0, 1_000])
@pytest.mark.parametrize("shape", ["chain", "star", "random", "names"])
def test_components(spark, shape, last, monkeypatch):
    """By rounds alone, with hubs, and finished by one task."""
    monkeypatch.setattr(graph, "HUB_EDGES", 3)
    monkeypatch.setattr(graph, "LAST", last)
    r = random.Random(4)
    edges = {"chain": [(i, i + 1) for i in range(300)], "star": [(0, i) for i in range(1, 200)] + [(500, i) for i in range(150, 400)], "random": [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)]}
    pairs = [(f"n{a}", f"n{b}") for a, b in edges["random"]] if shape == "names" else edges[shape]
    kind = "string" if shape == "names" else "bigint"
    d = spark.createDataFrame(pairs + [(None, pairs[0][0]), (pairs[0][1], None)], f"a {kind}, b {kind}").repartition(5)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert dict(graph.connected_components(d, "a", "b").collect()) == {x: find(x) for x in root}
    assert graph.connected_components(d.limit(0), "a", "b").count() == 0


def test_runs(spark):
    values = [None, None, 1, 1, 2, None, 2, 2, 2, 1]
    d = spark.createDataFrame(list(enumerate(values)), "i bigint, v bigint")
    want = [(0, None, 2, 0), (1, 1, 2, 2), (2, 2, 1, 4), (3, None, 1, 5), (4, 2, 3, 6), (5, 1, 1, 9)]
    for n in (1, 3, 10):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        assert sorted(numbering.run_lengths(d, ["i"], "v").collect(), key=lambda r: r[0]) == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert numbering.run_lengths(d.limit(0), ["i"], "v").count() == 0


def test_plain_sequences():
    assert sequences.flags(3, "all") == [True] * 3 and sequences.flags(2, "last") == [False, True] and sequences.flags(0, "first") == []
    with pytest.raises(ValueError):
        sequences.flags(2, "other")
    assert sequences.vector_names(["aX", "aY", "bX", "bY", "bZ"], 2) == ["a", "b"]
    r = random.Random(1)
    for _ in range(200):
        values = [r.randint(1, 12) for _ in range(r.randint(0, 7))]
        total = r.randint(0, 40)
        found = sequences.subset_with_sum(values, total)
        possible = {sum(v for i, v in enumerate(values) if m >> i & 1) for m in range(1 << len(values))}
        assert (found is not None) == (total in possible)
        if found is not None:
            assert sum(values[i] for i in found) == total and len(set(found)) == len(found)


def test_circular_subsets_and_checked_integers(spark):
    rows = [([4, 1], [1, 2, 3, 4]), ([1, 4], [1, 2, 3, 4]), ([3, 1], [1, 2, 3, 4]), ([2, 3, 4], [1, 2, 3, 4]), ([], [1]), ([3, 2], [1, 2, 3, 4])]
    d = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    got = [r[0] for r in d.select(sequences.ordered_subset(F.col("a"), F.col("b"))).collect()]
    assert got == [[4, 1], [4, 1], None, [2, 3, 4], None, [2, 3]]
    assert [r[0] for r in spark.range(3).select(sequences.checked_int(F.col("id"))).collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="does not fit"):
        spark.range(1).select(sequences.checked_int(F.lit(1 << 40))).collect()
    names = spark.createDataFrame([("",), ("..",), ("a/b",), ("x" * 33,), ("ok",), (None,)], "n string").select(sequences.is_valid_name(F.col("n"))).collect()
    assert [r[0] for r in names] == [False, False, False, False, True, False]


def test_ranges_of_empty_and_small_entities(spark):
    d = subsets.distributions(spark.createDataFrame([("a", 0), ("b", 2), ("c", 7)], "name string, n bigint"), 3)
    got = sorted((r["name"], r["part"], r["first"], r["last"]) for r in d.collect())
    assert got == [("a", 0, 0, 0), ("a", 1, 0, 0), ("a", 2, 0, 0), ("b", 0, 0, 1), ("b", 1, 1, 2), ("b", 2, 2, 2), ("c", 0, 0, 3), ("c", 1, 3, 5), ("c", 2, 5, 7)]


def test_upsert_and_outermost(spark):
    paths = spark.createDataFrame([("a/b/c",), ("a/d",)], "path string")
    t = trees.from_paths(paths)
    assert {r["path"] for r in t.collect()} == {"a", "a/b", "a/b/c", "a/d"}
    new = spark.createDataFrame([("a/d", "X_t"), ("a/e", "Y_t")], "path string, label string")
    u = {r["path"]: (r["label"], r["name"], r["depth"]) for r in trees.upsert(t, new).collect()}
    assert u["a/d"] == ("X_t", "d", 2) and u["a/e"] == ("Y_t", "e", 2) and u["a"][0] == "UserDefined_t"
    assert {r["path"] for r in trees.outermost(t, t.filter("path <> 'a'")).collect()} == {"a/b", "a/d"}


def test_command_lines(spark, tmp_path, capsys):
    from gnomon.__main__ import main

    text = "Base CGNSBase_t [3, 3]:\n  Zone Zone_t [[8, 1, 0]]:\n    size DataArray_t R8 1.0:\n"
    for name, body in (("a", text), ("b", text), ("c", text.replace("1.0", "1.5").replace("[3, 3]", "[3, 2]"))):
        (tmp_path / f"{name}.yaml").write_text(body)
    file = lambda n: str(tmp_path / f"{n}.yaml")
    assert main(["print", file("a"), "--depth", "2"], spark) == 0
    assert [x.strip().split(" ")[0] for x in capsys.readouterr().out.splitlines()] == ["Base", "Zone"]
    assert main(["diff", file("a"), file("b")], spark) == 0 and capsys.readouterr().out == ""
    assert main(["diff", file("a"), file("c")], spark) == 1
    assert [x.split() for x in capsys.readouterr().out.splitlines()] == [["changed", "Base"], ["changed", "Base/Zone/size"]]
    assert main(["diff", file("a"), file("c"), "--tolerance", "0.5"], spark) == 1
    assert [x.split() for x in capsys.readouterr().out.splitlines()] == [["changed", "Base"]]
