"""Graph partitioning and renumbering: balance and cuts, odd graphs, permutations, levels by a plain search."""

from collections import defaultdict

import pytest
from gnomon.operators import graph_partition, renumber

NODE, EDGE = "node long, weight double", "a long, b long, w double"


def grid(nx, ny):
    nodes = [(i + nx * j, 1.0) for i in range(nx) for j in range(ny)]
    edges = [(i + nx * j, i + 1 + nx * j, 1.0) for i in range(nx - 1) for j in range(ny)] + [(i + nx * j, i + nx * (j + 1), 1.0) for i in range(nx) for j in range(ny - 1)]
    return nodes, edges


def cut_and_weights(nodes, edges, labels):
    got = {r["node"]: r["part"] for r in labels.collect()}
    assert sorted(got) == sorted(n for n, _ in nodes) and labels.count() == len(nodes)
    weights = defaultdict(float)
    for n, w in nodes:
        weights[got[n]] += w
    return sum(w for a, b, w in edges if got[a] != got[b]), weights


@pytest.mark.parametrize("targets", [[1, 1], [1, 2, 1]])
def test_grid(spark, targets):
    nodes, edges = grid(40, 20)
    labels = graph_partition.by_graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), targets, coarse=120)
    cut, weights = cut_and_weights(nodes, edges, labels)
    for p, t in enumerate(targets):
        assert abs(weights[p] - 800 * t / sum(targets)) <= 0.03 * 800 * t / sum(targets) + 1
    assert cut <= 30 * (len(targets) - 1)  # straight lines cut 20 edges each


def test_heavy_edges_stay(spark):
    """Pairs tied by heavy edges along a ring: no heavy edge is cut."""
    nodes = [(i, 1.0) for i in range(400)]
    edges = [(i, (i + 1) % 400, 50.0 if i % 2 == 0 else 1.0) for i in range(400)]
    edges = [(min(a, b), max(a, b), w) for a, b, w in edges]
    labels = graph_partition.by_graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), [1, 1], coarse=100)
    cut, weights = cut_and_weights(nodes, edges, labels)
    assert cut < 10 and abs(weights[0] - 200) <= 6


def test_odd_graphs(spark):
    make = lambda n, e, t: graph_partition.by_graph(spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE), t)
    assert make([], [], [1, 1]).count() == 0
    assert {r["part"] for r in make([(5, None), (6, 1.0), (7, -2.0)], [(5, 5, 1.0), (5, 9, 1.0)], [1]).collect()} == {0}
    alone = [(i, 1.0) for i in range(60)]
    _, weights = cut_and_weights(alone, [], make(alone, [], [1, 1, 1]))
    assert sorted(weights.values()) == [20, 20, 20]
    twice = make([(1, 1.0), (2, 1.0)], [(1, 2, 1.0), (2, 1, 1.0), (1, 2, 3.0)], [1, 1])
    assert sorted(r["part"] for r in twice.collect()) == [0, 1]


def test_matching_is_one_to_one(spark):
    nodes, edges = grid(12, 12)
    m = {r["node"]: r["coarse"] for r in graph_partition.matching(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), 2.0).collect()}
    groups = defaultdict(list)
    for n, c in m.items():
        groups[c].append(n)
    near = {(a, b) for a, b, _ in edges}
    assert len(m) == 144 and max(map(len, groups.values())) == 2 and len(groups) < 110
    assert all(len(g) == 1 or (min(g), max(g)) in near for g in groups.values())


def plain_levels(cells, edges, start):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    level, queue = {start: 0}, [start]
    for x in queue:
        for y in near[x]:
            if y in cells and y not in level:
                level[y] = level[x] + 1
                queue.append(y)
    return level


@pytest.mark.parametrize("reverse", [False, True])
def test_renumbering(spark, reverse):
    """Two parts of a grid whose numbers are shuffled, one of them in two pieces, and a cell without neighbours."""
    nodes, edges = grid(6, 11)
    place = {n: (n * 37) % 101 for n, _ in nodes}
    part = {place[n]: 0 if n % 6 < 2 else 1 if n // 6 < 5 else 2 if n // 6 > 6 else 1 - (n // 6 == 6) for n, _ in nodes}
    part[500] = 1
    links = [(place[a], place[b]) for a, b, _ in edges]
    p = spark.createDataFrame([(c, k) for c, k in part.items()], "cell long, part int")
    e = spark.createDataFrame([(min(x), max(x)) for x in links], "a long, b long")
    rows = renumber.renumbered(p, e, reverse=reverse).collect()
    assert {r["cell"]: r["part"] for r in rows} == part and len(rows) == len(part)
    for k in set(part.values()):
        assert sorted(r["lnum"] for r in rows if r["part"] == k) == list(range(1, sum(v == k for v in part.values()) + 1))
    for r in rows:
        if r["level"] == 0:  # the start of a piece: all its levels are distances from there
            inside = {c for c, k in part.items() if k == r["part"]}
            level = plain_levels(inside, links, r["cell"])
            assert {x["cell"]: x["level"] for x in rows if x["cell"] in level} == level
            order = sorted((x for x in rows if x["cell"] in level), key=lambda x: -x["lnum"] if reverse else x["lnum"])
            assert [x["level"] for x in order] == sorted(level.values())
    before = spark.createDataFrame([(c, k, c) for c, k in part.items()], "cell long, part int, lnum long")
    after = spark.createDataFrame([(r["cell"], r["part"], r["lnum"]) for r in rows], "cell long, part int, lnum long")
    wide = {r["part"]: r["bandwidth"] for r in renumber.bandwidths(before, e).collect()}
    narrow = {r["part"]: r["bandwidth"] for r in renumber.bandwidths(after, e).collect()}
    assert all(narrow[k] < wide[k] for k in wide) and max(narrow.values()) <= 9


def test_renumbering_of_nothing(spark):
    p, e = spark.createDataFrame([], "cell long, part int"), spark.createDataFrame([], "a long, b long")
    assert renumber.renumbered(p, e).count() == 0


def test_small_nodes_do_not_stay_around_heavy_ones(spark, monkeypatch):
    """A long block of cells of unequal weight: contraction that follows edge weights alone leaves hubs with many small neighbours."""
    monkeypatch.setattr(graph_partition, "LARGEST", 50)
    at = lambda i, j, k: i + 5 * j + 35 * k
    nodes = [(c, float((c * 7919 + c // 35 * 104729) % 50 + 1)) for c in range(35 * 60)]
    cells = [(i, j, k) for k in range(60) for j in range(7) for i in range(5)]
    edges = [(at(*c), at(*d), 1.0) for c in cells for d in [(c[0] + 1, *c[1:]), (c[0], c[1] + 1, c[2]), (*c[:2], c[2] + 1)] if d[0] < 5 and d[1] < 7 and d[2] < 60]
    labels = graph_partition.by_graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), [1, 2], coarse=40)
    cut, weights = cut_and_weights(nodes, edges, labels)
    assert abs(weights[0] / sum(weights.values()) - 1 / 3) <= 0.03 / 3 + 0.001 and cut <= 70  # a layer is 35


@pytest.mark.parametrize("hub", [True, False])
def test_leaves_are_put_together(spark, monkeypatch, hub):
    """3,000 leaves of one node, and as many nodes without edges, of which pairs take none or one at a time."""
    monkeypatch.setattr(graph_partition, "LARGEST", 400)
    nodes = [(i, 1.0) for i in range(3001)]
    edges = [(0, i, 1.0) for i in range(1, 3001)] if hub else []
    labels = graph_partition.by_graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), [1, 1], coarse=50)
    _, weights = cut_and_weights(nodes, edges, labels)
    assert abs(weights[0] - 1500.5) <= 46


def test_refinement_near_the_boundary_is_that_of_all(spark, monkeypatch):
    nodes, edges = grid(40, 12)
    n, e = spark.createDataFrame(nodes, NODE).cache(), spark.createDataFrame(edges, EDGE).cache()
    start = spark.createDataFrame([(k, int(k % 40 + (k // 40 * 5) % 7 > 17) + (k % 40 > 30)) for k, _ in nodes], "node long, part int").cache()
    got = []
    for many in (100_000, 0):
        monkeypatch.setattr(graph_partition, "MANY", many)
        got.append(sorted(map(tuple, graph_partition.refined(n, e, start, [3, 2, 1], rounds=4).collect())))
    assert got[0] == got[1] != sorted(map(tuple, start.collect())) and len(got[0]) == len(nodes)
