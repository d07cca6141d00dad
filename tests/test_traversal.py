"""Traversals against plain recursion on random trees."""

import random

import pytest
from gnomon.operators import traversal
from pyspark.sql import functions as F


def random_tree(seed, n=120):
    r = random.Random(seed)
    paths = ["r0", "r1"]
    for i in range(n):
        above = r.choice(paths)
        if above.count("/") < 6:
            paths.append(f"{above}/n{i}")
    order = {p: r.randrange(3) for p in paths}
    return [(p, p.rpartition("/")[0], order[p], r.randrange(10)) for p in paths]


def table(spark, rows):
    return spark.createDataFrame(rows, "path string, parent string, ord int, value int")


@pytest.mark.parametrize("seed", [1, 2])
def test_against_recursion(spark, seed):
    rows = random_tree(seed)
    d = table(spark, rows)
    below, own = {}, {p: v for p, _, _, v in rows}
    for p, above, o, _ in sorted(rows, key=lambda x: (x[2], x[0])):
        below.setdefault(above, []).append(p)
    before, after, shown, size, best = {}, {}, {}, {}, {}

    def go(p, level, state, seen):
        before[p] = len(before)
        state = state * 3 + own[p]
        if seen and own[p] != 5:
            shown[p] = (level, state)
        for q in below.get(p, []):
            go(q, level + 1, state, seen and own[p] != 7)
        after[p] = len(after)
        size[p] = 1 + sum(size[q] for q in below.get(p, []))
        best[p] = own[p] + sum(best[q] for q in below.get(p, []))

    for p in below[""]:
        go(p, 0, 1, True)
    v = F.col("value")
    decide = F.when(v == 7, traversal.STOP).when(v == 5, traversal.SKIP)
    assert {r["path"]: (r["level"], r["state"]) for r in traversal.walk(d, F.lit(1).cast("long"), lambda above: (above * 3 + v, decide)).collect()} == shown
    assert {r["path"]: (r["before"], r["after"], r["size"], r["level"]) for r in traversal.visits(d).collect()} == {p: (before[p], after[p], size[p], p.count("/")) for p in own}
    total = traversal.gather(d, v.cast("long"), lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x))
    assert {r["path"]: r["result"] for r in total.collect()} == best


def test_other_roots_and_nothing(spark):
    d = table(spark, random_tree(3))
    some = traversal.walk(d, F.lit("x"), lambda above: (F.concat(above, F.lit("y")), F.lit(None).cast("string")), roots=F.col("path") == "r1").collect()
    assert all(r["path"].split("/")[0] == "r1" and r["state"] == "x" + "y" * (r["level"] + 1) for r in some)
    empty = d.limit(0)
    assert traversal.walk(empty, F.lit(0), lambda above: (above, F.lit(None).cast("string"))).count() == 0
    assert traversal.visits(empty).count() == 0 and traversal.gather(empty, F.col("value"), F.array_max).count() == 0


def test_circles_are_refused(spark, monkeypatch):
    monkeypatch.setattr(traversal, "MOST_LEVELS", 3)
    d = table(spark, [("a", "a", 0, 1)])
    with pytest.raises(ValueError):
        traversal.walk(d, F.lit(0), lambda above: (above, F.lit(None).cast("string")), roots=F.lit(True))
