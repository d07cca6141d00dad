"""Slabs, dependent reads and links on made-up trees, and the plans of the reads."""

import pytest
from gnomon.sources import store

NODES = "path string, parent string, name string, label string, depth int, dtype string, value string"
FILES = f"file string, {NODES}"


def saved(spark, tmp_path, arrays):
    rows = [(p, i, float(v)) for p, vs in arrays.items() for i, v in enumerate(vs)]
    v = spark.createDataFrame(rows, "path string, pos long, value double")
    store.save(v.groupBy("path").count(), v, str(tmp_path / "t"))
    return str(tmp_path / "t")


def test_overlapping_and_touching_slabs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "CHUNK", 16)
    path = saved(spark, tmp_path, {"a": range(100), "b": [7] * 90, "c": range(10)})
    slabs = [("a", 0, 10, 3, 4), ("a", 2, 5, 3, 2), ("a", 60, 1, 1, 20), ("b", 5, 50, 40, 1), ("b", 5, 50, 40, 1), ("b", 44, 3, 3, 3), ("c", 0, 1, 0, 5), ("a", 5, 1, 1, 0), ("d", 0, 1, 1, 3)]
    want = sorted({(p, i) for p, f, s, b, n in slabs for k in range(n) for i in range(f + k * s, f + k * s + b) if p != "d"})
    got = store.load_slabs(spark, path, spark.createDataFrame(slabs, store.SLAB))
    rows = [(r["path"], r["pos"]) for r in got.collect()]
    assert sorted(rows) == want
    plan = got._jdf.queryExecution().toString()
    assert "Distinct" not in plan.split("== Physical Plan ==")[1] and "keys=[path" not in plan.split("== Physical Plan ==")[1].split("FileScan")[0].split("SortMergeJoin")[0]
    assert "In(path" in plan and "GreaterThanOrEqual(pos" in plan
    assert store.load_slabs(spark, path, spark.createDataFrame([], store.SLAB)).count() == 0


def test_polygons_by_offsets(spark, tmp_path):
    polygons = [[1, 2, 3], [], [4], [5, 6], [], [], [7, 8, 9, 10]]
    offsets = [0]
    for p in polygons:
        offsets.append(offsets[-1] + len(p))
    flat = [x for p in polygons for x in p]
    path = saved(spark, tmp_path, {"Z/E/ElementStartOffset": offsets, "Z/E/ElementConnectivity": flat, "Z/F/ElementStartOffset": [0, 2], "Z/F/ElementConnectivity": [11, 12]})
    for a, b in ((0, 7), (1, 2), (2, 6), (3, 3), (4, 6)):
        share = spark.createDataFrame([("Z/E", a, b), ("Z/F", 0, 1)], "path string, first long, last long")
        got = {(r["path"], r["item"]): r["values"] for r in store.load_polygons(spark, path, share).collect()}
        assert got == {("Z/E", k): [float(x) for x in polygons[k]] for k in range(a, b)} | {("Z/F", 0): [11.0, 12.0]}


def node(path, dtype=None, value=None, label="X_t"):
    return path, path.rpartition("/")[0], path.rpartition("/")[2], label, path.count("/") + 1, dtype, value


def test_links(spark):
    nodes = spark.createDataFrame([node("/A"), node("/A/L", "LK", '"f:/P:1/Q"'), node("/A/M", "LK", "f:/none"), node("/A/N", "LK", "nothing")], NODES)
    others = spark.createDataFrame([("f", *node("/P:1")), ("f", *node("/P:1/Q")), ("f", *node("/P:1/Q/R:s")), ("f", *node("/P:1/QQ"))], FILES)
    got = {r["path"]: r["dtype"] for r in store.resolved(nodes, others).collect()}
    assert got == {"/A": None, "/A/L": None, "/A/L/R:s": None, "/A/M": "LK", "/A/N": "LK"}


def test_circle_of_links(spark):
    nodes = spark.createDataFrame([node("/A", "LK", "f:/B")], NODES)
    others = spark.createDataFrame([("f", *node("/B", "LK", "g:/C")), ("g", *node("/C", "LK", "f:/B"))], FILES)
    with pytest.raises(ValueError):
        store.resolved(nodes, others, depth=4)
