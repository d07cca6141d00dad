"""Splitting of structured joins: every face on both sides, and the same pieces seen from the donor."""

import itertools
import random

import pytest
from gnomon.operators import partition, structured

JOIN = "name string, zone string, donor_zone string, donor_name string, i0 long, i1 long, j0 long, j1 long, k0 long, k1 long, di0 long, di1 long, dj0 long, dj1 long, dk0 long, dk1 long, t1 int, t2 int, t3 int"
BOX = "zone string, part int, bi0 long, bi1 long, bj0 long, bj1 long, bk0 long, bk1 long"


def over(join, p):
    """The donor's vertex of own vertex p, and the join as a dictionary."""
    q = [join[f"d{a}0"] for a in "ijk"]
    for a in range(3):
        t = join[f"t{a + 1}"]
        q[abs(t) - 1] += (1 if t > 0 else -1) * (p[a] - join[f"{'ijk'[a]}0"])
    return tuple(q)


def vertices(row, prefix=""):
    return set(itertools.product(*[range(min(row[f"{prefix}{a}0"], row[f"{prefix}{a}1"]), max(row[f"{prefix}{a}0"], row[f"{prefix}{a}1"]) + 1) for a in "ijk"]))


@pytest.mark.parametrize("seed", range(4))
def test_random_transforms(spark, seed):
    r = random.Random(seed)
    dims, far = (6, 7, 8), (9, 9, 9)
    perm = r.sample([1, 2, 3], 3)
    t = [p * r.choice([1, -1]) for p in perm]
    axis = r.randrange(3)
    own = [[1, d] for d in dims]
    own[axis] = [dims[axis]] * 2
    if seed == 1:
        other = (axis + 1) % 3
        own[other] = [2, dims[other] - 2]
    start = [1, 1, 1]
    for a in range(3):
        b = abs(t[a]) - 1
        if a == axis:
            start[b] = r.choice([1, far[b]])
        else:
            start[b] = 1 if t[a] > 0 else 1 + own[a][1] - own[a][0]
    stop = list(start)
    for a in range(3):
        stop[abs(t[a]) - 1] += (1 if t[a] > 0 else -1) * (own[a][1] - own[a][0])
    row = ("x", "A", "B", "y", *[v for w in own for v in w], *[v for s in zip(start, stop) for v in s], *t)
    cuts = {"A": partition.split_block([d - 1 for d in dims], [1, 2, 1, 1]), "B": partition.split_block([d - 1 for d in far], [1, 1, 2])}
    boxes = [(z, p, *[v for b in box for v in b]) for z, c in cuts.items() for p, box in enumerate(c)]
    join = spark.createDataFrame([row], JOIN)
    got = structured.split_joins(join, spark.createDataFrame(boxes, BOX)).collect()
    whole = join.first()
    assert len({g["name"] for g in got}) == len(got)
    faces = 0
    for g in got:
        low, far_low = [b[0] for b in cuts["A"][g["part"]]], [b[0] for b in cuts["B"][g["donor_part"]]]
        assert g["name"] == f"x.P{g['part']}.P{g['donor_part']}" and g["donor_name"] == f"y.P{g['donor_part']}.P{g['part']}"
        for p in vertices(g):  # the piece maps as the whole does
            q = over(whole, tuple(a + b for a, b in zip(p, low)))
            assert over(g, p) == tuple(a - b for a, b in zip(q, far_low))
        assert {over(g, p) for p in vertices(g)} == vertices(g, "d")
        faces += max(1, g["i1"] - g["i0"]) * max(1, g["j1"] - g["j0"]) * max(1, g["k1"] - g["k0"])
        assert all(1 <= g[f"{a}0"] <= g[f"{a}1"] <= cuts["A"][g["part"]][n][1] - low[n] + 1 for n, a in enumerate("ijk"))
        assert all(1 <= min(g[f"d{a}0"], g[f"d{a}1"]) and max(g[f"d{a}0"], g[f"d{a}1"]) <= cuts["B"][g["donor_part"]][n][1] - far_low[n] + 1 for n, a in enumerate("ijk"))
    wanted = 1
    for lo, hi in own:
        wanted *= max(1, hi - lo)
    assert faces == wanted
    # Seen from the other side: start and stop of the donor's window as an ascending one, the transform turned round.
    back = [0, 0, 0]
    for a in range(3):
        back[abs(t[a]) - 1] = (a + 1) * (1 if t[a] > 0 else -1)
    asc = [sorted(p) for p in zip(start, stop)]
    first = [lo if back[b] > 0 else hi for b, (lo, hi) in enumerate(asc)]
    low_corner, high_corner = [None] * 3, [None] * 3
    for b in range(3):
        a = abs(back[b]) - 1
        low_corner[a], high_corner[a] = (own[a][0], own[a][1]) if back[b] > 0 else (own[a][1], own[a][0])
    assert first is not None
    row = ("y", "B", "A", "x", *[v for w in asc for v in w], *[v for s in zip(low_corner, high_corner) for v in s], *back)
    turned = structured.split_joins(spark.createDataFrame([row], JOIN), spark.createDataFrame(boxes, BOX)).collect()
    pieces = {(g["name"], g["donor_name"]): (frozenset(vertices(g)), frozenset(vertices(g, "d"))) for g in got}
    assert {(g["donor_name"], g["name"]): (frozenset(vertices(g, "d")), frozenset(vertices(g))) for g in turned} == pieces


def test_components_in_rounds_equal_those_of_one_task(spark):
    from gnomon.operators import graph

    r = random.Random(1)
    e = spark.createDataFrame([(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(200)], "a long, b long")
    assert set(map(tuple, graph.connected_components(e, "a", "b", last=0).collect())) == set(map(tuple, graph.connected_components(e, "a", "b").collect()))
