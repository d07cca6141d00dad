"""Partitions, balance, transfer between forms."""

from itertools import product

import pytest
from gnomon.functions import hilbert
from gnomon.operators import generators as g
from gnomon.operators import mesh, partition, spatial, transfer
from pyspark.sql import functions as F


@pytest.mark.parametrize("dim", [2, 3])
def test_hilbert_neighbours_are_adjacent(spark, dim):
    cells = list(product(range(8), repeat=dim))
    rows = spark.createDataFrame(cells, [f"c{a}" for a in range(dim)]).select("*", hilbert.hilbert_key([F.col(f"c{a}") for a in range(dim)], 3).alias("key")).orderBy("key").collect()
    assert [r.key for r in rows] == list(range(8**dim))
    assert all(sum(abs(a - b) for a, b in zip(x[:dim], y[:dim])) == 1 for x, y in zip(rows, rows[1:]))


def test_weighted_parts(spark):
    cells = spark.range(1, 101).withColumnRenamed("id", "cell")
    p = partition.by_number(cells, [1, 2, 1]).orderBy("cell").collect()
    assert [r.part for r in p] == [0] * 25 + [1] * 50 + [2] * 25
    assert [r.lnum for r in p] == [*range(1, 26), *range(1, 51), *range(1, 26)]
    assert partition.by_number(cells.limit(0), [1, 1]).count() == 0
    heavy = cells.withColumn("w", F.when(F.col("cell") <= 10, 9.0).otherwise(0.0))
    q = partition.split_ordered(heavy, ["cell"], [1, 1], "w").orderBy("cell").collect()
    assert [r.part for r in q[:10]] == [0] * 5 + [1] * 5


def test_hilbert_parts_and_interfaces(spark):
    n = (5, 5, 5)
    cells, f = g.cube_cells(spark, n), g.cube_faces(spark, n)
    centres = spatial.cell_centres(cells.select("cell", F.explode("vtx").alias("vertex")), g.cube_vertices(spark, n), "cell", "vertex", ["x", "y", "z"])
    p = partition.by_hilbert(centres, [1] * 4, bits=2)
    assert {r["count"] for r in p.groupBy("part").count().collect()} == {16}
    i = partition.interfaces(f, p)
    assert i.groupBy("face").count().filter("count <> 2").count() == 0 and 0 < i.count() < 200
    swapped = i.select("face", F.col("donor_part").alias("part"), F.col("donor_lnum").alias("cell_lnum"), F.col("part").alias("donor_part"), F.col("cell_lnum").alias("donor_lnum"))
    assert sorted(i.collect()) == sorted(swapped.collect())
    v = partition.entity_parts(cells, p)
    assert v.select("vtx").distinct().count() == 125 and v.count() > 125
    top = v.groupBy("part").agg(F.max("lnum").alias("m"), F.count("*").alias("n"))
    assert top.filter("m <> n").count() == 0
    both = v.join(g.cube_vertices(spark, n).withColumnRenamed("vertex", "vtx"), "vtx")
    assert sorted(partition.recover(both, "vtx", ["x", "y", "z"]).collect()) == sorted(g.cube_vertices(spark, n).withColumnRenamed("vertex", "vtx").collect())


@pytest.mark.parametrize("weights", [[1], [1, 1], [3, 1], [1] * 7, [0.5, 0.2, 0.2, 0.1]])
def test_boxes(spark, weights):
    dims = (7, 5, 4)
    boxes = partition.split_block(dims, weights)
    sizes = [(b[0][1] - b[0][0]) * (b[1][1] - b[1][0]) * (b[2][1] - b[2][0]) for b in boxes]
    assert sum(sizes) == 140 and min(sizes) > 0
    cells = spark.range(1, 141).withColumnRenamed("id", "cell")
    p = partition.by_box(cells, dims, weights)
    found = {r.part: (r.n, r.low, r.high) for r in p.groupBy("part").agg(F.count("*").alias("n"), F.min("lnum").alias("low"), F.max("lnum").alias("high")).collect()}
    assert found == {k: (s, 1, s) for k, s in enumerate(sizes)} and p.select("part", "lnum").distinct().count() == 140
    r = spark.createDataFrame([("all", 1, 7, 1, 5, 1, 1)], "name string, i0 int, i1 int, j0 int, j1 int, k0 int, k1 int")
    cut = partition.box_ranges(r, boxes)
    assert cut.agg(F.sum(F.expr("(i1 - i0 + 1) * (j1 - j0 + 1)"))).first()[0] == 35


def test_balance():
    groups = partition.largest_differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in x) for x in groups) == [14, 16] and sorted(sum(groups, [])) == [0, 1, 2, 3, 4]
    assert partition.largest_differencing([], 2) == [[], []] and partition.even_sizes(7, 3) == [3, 2, 2]
    w = partition.balanced_weights({"Large": 768, "Small": 192}, 2)
    assert w[0] == {"Large": [480 / 768]} and w[1] == {"Large": [288 / 768], "Small": [1.0]}
    assert partition.regular_weights(["a"], 2) == [{"a": [0.5]}, {"a": [0.5]}]
    assert sorted(z for r in partition.whole_zone_weights({"a": 5, "b": 3, "c": 2}, 2) for z in r) == ["a", "b", "c"]


def test_redistribute(spark):
    d = spark.range(10)
    assert {r.part for r in partition.redistribute(d, "gather.3", ["id"], 4).collect()} == {3}
    assert {r["count"] for r in partition.redistribute(d, "uniform", ["id"], 5).groupBy("part").count().collect()} == {2}
    with pytest.raises(ValueError):
        partition.redistribute(d, "other", ["id"], 2)


def test_fields_there_and_back(spark):
    rows = [("Z", label, c, "Vertex", v, n, float(v * k)) for label, c, n, k in (("FlowSolution_t", "FS", "p", 1), ("FlowSolution_t", "FS", "q", 2), ("DiscreteData_t", "DD", "r", 3)) for v in (1, 2, 3)]
    fields = spark.createDataFrame(rows, "zone string, label string, container string, location string, gnum bigint, name string, value double")
    pm = spark.createDataFrame([("Z", "Vertex", p, l, v) for p, l, v in ((0, 1, 1), (0, 2, 2), (1, 1, 2), (1, 2, 3))], "zone string, location string, part int, lnum bigint, gnum bigint")
    parts = transfer.to_parts(fields, pm)
    assert parts.count() == 12
    back = transfer.from_parts(parts)
    assert sorted(back.select(fields.columns).collect()) == sorted(fields.collect())
    assert transfer.from_parts(parts, "sum", include={"FlowSolution_t": ["FS/p"]}).filter("gnum = 2").first()["value"] == 4
    assert {r.name for r in transfer.to_parts(fields, pm, exclude={"FlowSolution_t": ["F*/q"]}).collect()} == {"p", "r"}
    assert {r.name for r in transfer.to_parts(fields, pm, labels=["DiscreteData_t"]).collect()} == {"r"}
    with pytest.raises(ValueError):
        transfer.chosen(fields, {}, {})
    items = spark.createDataFrame([("Z", "Vertex", "s", 2), ("Z", "Vertex", "s", 1)], "zone string, location string, name string, gnum bigint")
    cut = transfer.subset_to_parts(items, pm)
    assert cut.count() == 3 and sorted(transfer.subset_from_parts(cut).collect()) == sorted(items.collect())
    joins = spark.createDataFrame([("Z", "j", 2, "Z", 3)], "zone string, name string, gnum bigint, donor_zone string, donor_gnum bigint")
    assert {(r.part, r.donor_part) for r in transfer.split_joins(joins, pm).collect()} == {(0, 1), (1, 1)}


def test_mesh_is_used_whole(spark):
    assert mesh.elements_to_faces(g.cube_cells(spark, (3, 3, 3)), "HEXA_8").count() == 36
