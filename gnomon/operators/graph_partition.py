"""Multilevel partitioning of weighted graphs, as of cells that share faces.

1. Coarsening: every node picks the neighbour behind its heaviest edge, ties by a hash that both ends agree on; nodes
   that pick each other become one.  Pairs much heavier than usual come last, or heavy nodes would grow into hubs, of
   whose many neighbours one in a level finds a mate.  A level is two such handshakes, an aggregation of the edges by their new
   ends.  Where that hardly shrinks a large graph, nodes that pick the same neighbour, and those without any, are put together.
2. When at most `coarse` nodes are left (or a level hardly shrinks the graph any more), these are cut by growing parts,
   in halves of the weights, on the driver: LARGEST bounds what is collected.
3. Back up, each level starts from the parts of the coarser one and is refined: nodes at a boundary move to the part
   they share the most edge weight with.  In a round all moves go to parts of higher, in the next to parts of lower
   number, so neighbours do not swap.  How many of the moves of each gain are made is settled from their sums (rows of
   two parts and a gain class), so that no part leaves its limits; the best labels seen are kept.  Of a large graph
   only the nodes that the moves of all rounds can reach from the boundary, and their edges, are looked at.

Every step is a join or an aggregation by node, and no task sees a whole part.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stored

COARSE = 600
#: More nodes than this are never collected: a graph that cannot be contracted so far is refused.
LARGEST = 100_000
#: Tables of more nodes than this are not broadcast, and only what lies near the boundary is refined.
MANY = 100_000
BALANCE = 0.03
#: Starts that are tried for each halving of the coarsest graph.
TRIES = 3
ROUNDS = 6


def dual_graph(faces: DataFrame) -> DataFrame:
    """(a, b, w) of cells that share faces (left, right), a < b; w is the number of faces."""
    d = faces.filter("left > 0 and right > 0 and left <> right")
    return d.groupBy(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")).agg(F.count("*").cast("double").alias("w"))


def _both(edges: DataFrame) -> DataFrame:
    """(u, v, w) of every edge in both directions."""
    return edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v"), "w"), F.struct(F.col("b").alias("u"), F.col("a").alias("v"), "w"))))


def _handshake(edges: DataFrame, seed: int) -> DataFrame:
    """(a, b), a < b, of nodes that pick each other by the greatest w; too heavy pairs left out."""
    tie = F.xxhash64(F.least("u", "v"), F.greatest("u", "v"), F.lit(seed))
    picks = _both(edges).groupBy("u").agg(F.max_by("v", F.struct("w", tie)).alias("v"))
    return picks.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).count().filter("count = 2").select("a", "b")


def matching(nodes: DataFrame, edges: DataFrame, heaviest: float, seed: int = 0) -> DataFrame:
    """(node, coarse): pairs of nodes, no heavier than `heaviest` together, take the smaller number; the others keep theirs."""
    usual = max(nodes.agg(F.avg("weight")).first()[0] or 0.0, 1e-300)
    weight = lambda k: nodes.select(F.col("node").alias(k), F.col("weight").alias(f"w{k}"))
    # Classes of pairs: up to two and a half usual nodes, twice that, and so on; a logarithm of 0 is null.
    above = F.greatest(F.ceil(F.log2((F.col("wa") + F.col("wb")) / (2.5 * usual))), F.lit(0))
    light = edges.join(weight("a"), "a").join(weight("b"), "b").filter(F.col("wa") + F.col("wb") <= heaviest).select("a", "b", F.struct((-above).alias("class"), "w").alias("w"))
    first = stored(_handshake(light, seed), "match")
    gone = first.select(F.inline(F.array(F.struct(F.col("a").alias("node")), F.struct(F.col("b").alias("node")))))
    left = light.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
    pairs = first.unionByName(_handshake(left, seed + 1))
    merged = pairs.select(F.col("b").alias("node"), F.col("a").alias("coarse"))
    return nodes.select("node").join(merged, "node", "left").select("node", F.coalesce("coarse", "node").alias("coarse"))


def gathered(nodes: DataFrame, edges: DataFrame, heaviest: float) -> DataFrame:
    """(node, coarse): nodes that are tied most to the same neighbour, or have none, in groups of about half of `heaviest`; heavier ones keep their numbers."""
    picks = _both(edges).groupBy("u").agg(F.max_by("v", F.struct("w", "v")).alias("to"))
    d = nodes.filter(F.col("weight") <= heaviest / 2).join(picks, F.col("node") == F.col("u"), "left")
    d = stored(d.select("node", "weight", F.col("to").isNull().alias("alone"), F.coalesce("to", F.lit(0)).alias("to")), "picks")
    groups = d.groupBy("alone", "to").agg(F.greatest(F.ceil(2 * F.sum("weight") / heaviest), F.lit(1)).alias("groups"))
    d = d.join(groups, ["alone", "to"]).withColumn("group", F.pmod(F.xxhash64("node"), F.col("groups")))
    first = d.groupBy("alone", "to", "group").agg(F.min("node").alias("coarse"))
    return nodes.select("node").join(d.join(first, ["alone", "to", "group"]).select("node", "coarse"), "node", "left").select("node", F.coalesce("coarse", "node").alias("coarse"))


def contracted(nodes: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the coarser graph, weights added up."""
    n = nodes.join(mapping, "node").groupBy(F.col("coarse").alias("node")).agg(F.sum("weight").alias("weight"))
    end = lambda k: mapping.select(F.col("node").alias(k), F.col("coarse").alias(f"c{k}"))
    e = edges.join(end("a"), "a").join(end("b"), "b").filter("ca <> cb")
    e = e.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))
    return n, e


def grown(weight: dict[int, float], near: dict[int, dict[int, float]], targets: Sequence[float]) -> dict[int, int]:
    """Parts of a small graph: halves of the targets, each grown from a far node by what it is tied to most, then improved by single moves."""
    out: dict[int, int] = {}

    def ends(nodes: set[int]) -> list[int]:
        """Nodes far from each other: ends of searches, each from the end of the one before."""
        found = [min(nodes)]
        for _ in range(TRIES):
            at = found[-1]
            seen, order = {at}, [at]
            for x in order:
                for y in sorted(near[x]):
                    if y in nodes and y not in seen:
                        seen.add(y)
                        order.append(y)
            found.append(order[-1])
        return list(dict.fromkeys(reversed(found)))

    def improve(side: set[int], nodes: set[int], want: float) -> None:
        total = sum(weight[x] for x in side)
        for _ in range(8):
            moved = False
            for x in sorted(nodes):
                inside = x in side
                own = sum(w for y, w in near[x].items() if y in nodes and (y in side) == inside)
                other = sum(w for y, w in near[x].items() if y in nodes and (y in side) != inside)
                after = total + (-weight[x] if inside else weight[x])
                closer = abs(after - want) < abs(total - want)
                if other > own and abs(after - want) <= max(0.02 * want, abs(total - want)) or other == own and closer:
                    side.symmetric_difference_update([x])
                    total, moved = after, True
            if not moved:
                break

    def grow(nodes: set[int], want: float, start: int) -> set[int]:
        side: set[int] = set()
        heap: list[tuple[float, int, int]] = []
        total, tick, gain = 0.0, 0, defaultdict(float)
        while total < want and len(side) < len(nodes):
            while heap and (heap[0][2] in side or -heap[0][0] != gain[heap[0][2]]):
                heapq.heappop(heap)
            x = heapq.heappop(heap)[2] if heap else ends(nodes - side)[0] if side else start
            if side and total + weight[x] - want > want - total:
                break
            side.add(x)
            total += weight[x]
            for y, w in near[x].items():
                if y in nodes and y not in side:
                    gain[y] += w / max(sum(near[y].values()), 1e-300)
                    tick += 1
                    heapq.heappush(heap, (-gain[y], tick, y))
        return side

    def cut(nodes: set[int], parts: list[int]) -> None:
        if len(parts) == 1 or not nodes:
            out.update((x, parts[0]) for x in nodes)
            return
        half = parts[: len(parts) // 2]
        whole = sum(weight[x] for x in nodes)
        want = whole * sum(targets[p] for p in half) / sum(targets[p] for p in parts)
        tries = []
        for start in ends(nodes):
            side = grow(nodes, want, start)
            improve(side, nodes, want)
            between = sum(w for x in side for y, w in near[x].items() if y in nodes and y not in side)
            tries.append((between, abs(sum(weight[x] for x in side) - want), len(tries), side))
        side = min(tries, key=lambda t: t[:3])[3]
        cut(side, half)
        cut(nodes - side, parts[len(parts) // 2 :])

    cut(set(weight), list(range(len(targets))))
    return out


def _weights(nodes: DataFrame, labels: DataFrame) -> dict[int, float]:
    return {r["part"]: r["weight"] for r in nodes.join(labels, "node").groupBy("part").agg(F.sum("weight").alias("weight")).collect()}


def _touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with an end among the nodes, each once."""
    end = lambda k: nodes.select(F.col("node").alias(k))
    second = edges.join(end("b"), "b", "left_semi").join(end("a"), "a", "left_anti")
    return edges.join(end("a"), "a", "left_semi").select("a", "b", "w").unionByName(second.select("a", "b", "w"))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct(F.col("a").alias("node")), F.struct(F.col("b").alias("node"))))).distinct()


def _near(edges: DataFrame, labels: DataFrame, rounds: int) -> DataFrame:
    """The edges of all nodes that so many rounds can move: a round moves ends of cut edges only, so it takes the boundary on by an edge at most."""
    end = lambda k: labels.select(F.col("node").alias(k), F.col("part").alias(f"p{k}"))
    near = stored(edges.join(end("a"), "a").join(end("b"), "b").filter("pa <> pb").select("a", "b", "w"), "near")
    for _ in range(rounds):
        near = stored(_touching(edges, stored(_ends(near), "band")), "near")
    return near


def _shares(rows: list, weights: dict[int, float], low: Sequence[float], high: Sequence[float]) -> list[tuple[int, int, int, float]]:
    """(own, part, class, share of the moves that are made), best gains first, as far as the limits of both parts allow.

    A move without gain is made only where the part left is too heavy, or the one entered too light.
    """
    now, out = dict(weights), []
    for r in sorted(rows, key=lambda r: (-r["class"], r["own"], r["part"])):
        a, b = r["own"], r["part"]
        room = min(high[b] - now.get(b, 0.0), now[a] - low[a])
        if r["class"] <= 0:
            room = min(room, max(now[a] - high[a], low[b] - now.get(b, 0.0)))
        share = min(1.0, max(0.0, room / r["weight"])) if r["weight"] else 1.0
        if share:
            now[a], now[b] = now[a] - share * r["weight"], now.get(b, 0.0) + share * r["weight"]
            out.append((a, b, r["class"], float(share)))
    return out


def refined(nodes: DataFrame, edges: DataFrame, labels: DataFrame, targets: Sequence[float], *, balance: float = BALANCE, rounds: int = ROUNDS) -> DataFrame:
    """(node, part): labels after moves across the boundaries; of those seen the ones with the least cut, balanced ones first."""
    spark = nodes.sparkSession
    total = nodes.agg(F.sum("weight")).first()[0] or 0.0
    want = [total * t / sum(targets) for t in targets]
    low, high = [w * (1 - 0.9 * balance) for w in want], [w * (1 + 0.9 * balance) for w in want]
    # What no round can reach keeps its labels.
    whole, rest = labels, {}
    if nodes.count() > MANY:
        edges = _near(edges, labels, rounds)
        labels = stored(labels.join(_ends(edges), "node", "left_semi"), "labels")
        rest = _weights(nodes, whole.join(labels.select("node"), "node", "left_anti"))
        nodes = stored(nodes.join(labels.select("node"), "node", "left_semi"), "near-nodes")
    best, start, ties, idle = None, labels, None, False
    for step in range(rounds + 1):
        if ties is None:
            part = lambda k, name: labels.select(F.col("node").alias(k), F.col("part").alias(name))  # noqa: E731, B023
            ties = _both(edges).join(part("u", "own"), "u").join(part("v", "part"), "v").groupBy("u", "own", "part").agg(F.sum("w").alias("w"))
            ties = stored(ties, "ties")
            cut, inside = (ties.filter("own <> part").agg(F.sum("w")).first()[0] or 0.0) / 2, _weights(nodes, labels)
            weights = {p: rest.get(p, 0.0) + inside.get(p, 0.0) for p in {*rest, *inside}}
            off = max([0.0, *(abs(weights.get(p, 0.0) - w) / w for p, w in enumerate(want) if w)])
            mark = (max(0.0, off - balance), cut)
            if best is None or mark < best[0]:
                best = (mark, labels)
        if step == rounds:
            break
        inner = ties.filter("own = part").select("u", F.col("w").alias("inner"))
        up = F.col("part") > F.col("own") if step % 2 == 0 else F.col("part") < F.col("own")
        moves = ties.filter(up).groupBy("u", "own").agg(F.max_by(F.struct("part", "w"), F.struct("w", -F.col("part"))).alias("to")).select("u", "own", "to.part", "to.w").join(inner, "u", "left")
        gain = F.col("w") - F.coalesce("inner", F.lit(0.0))
        # Classes of gains: powers of two on both sides of 0.
        size = F.ceil(F.log2(F.abs(gain) + 1)).cast("int")
        moves = moves.withColumn("class", F.when(gain < 0, -size).otherwise(size)).join(nodes, F.col("u") == F.col("node"))
        sums = moves.groupBy("own", "part", "class").agg(F.sum("weight").alias("weight")).collect()
        shares = _shares(sums, weights, low, high)
        if not shares:
            if idle:
                break  # neither to higher nor to lower parts
            idle = True
            continue
        chosen = F.broadcast(spark.createDataFrame(shares, "own int, part int, class int, share double"))  # a row for two parts and a class
        draw = F.pmod(F.xxhash64("u", F.lit(step)), F.lit(1 << 20)) / (1 << 20)
        moved = moves.join(chosen, ["own", "part", "class"]).filter(draw < F.col("share")).select(F.col("u").alias("node"), F.col("part").alias("_to"))
        labels = stored(labels.join(moved, "node", "left").select("node", F.coalesce("_to", "part").alias("part")), "labels")
        discard(ties)
        ties, idle = None, False
    if best[1] is start:
        return whole
    if start is whole:
        return best[1]
    return stored(whole.join(best[1].withColumnRenamed("part", "_to"), "node", "left").select("node", F.coalesce("_to", "part").alias("part")), "labels")


def by_graph(nodes: DataFrame, edges: DataFrame, targets: Sequence[float], *, coarse: int = COARSE, balance: float = BALANCE, rounds: int = ROUNDS) -> DataFrame:
    """(node, part) for nodes (node, weight) and edges (a, b, w), a < b: parts 0, 1, .. whose weights are in proportion to targets, cutting little edge weight.

    Nodes without edges are dealt with like the others.  Null or negative weights count as 0, loops and edges with an
    unknown end are ignored.  An empty graph gives an empty table.
    """
    spark = nodes.sparkSession
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    n = stored(nodes.select(F.col("node").cast("long").alias("node"), weight.alias("weight")), "graph-nodes")
    e = edges.filter("a <> b").join(n.select(F.col("node").alias("a")), "a", "left_semi").join(n.select(F.col("node").alias("b")), "b", "left_semi")
    e = stored(e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").cast("double").alias("w")), "graph-edges")
    count, total = n.agg(F.count("*"), F.sum("weight")).first()
    limit = max(coarse, 20 * len(targets))
    heaviest = max(1.5 * (total or 0.0) / limit, 1e-300)
    # Small files hold many rows of two numbers.
    kept = lambda d, name, rows: stored(d, name).hint("merge") if rows > MANY else stored(d, name)
    levels, stuck = [], False
    n = n.hint("merge") if count > MANY else n
    while count > limit:
        mapping = gathered(n, e, heaviest) if stuck else matching(n, e, heaviest, 2 * len(levels))
        mapping = kept(mapping, "graph-map", count)
        levels.append((n, e, mapping, count))
        n2, e2 = contracted(n, e, mapping)
        n, e, before = kept(n2, "graph-nodes", count), stored(e2, "graph-edges"), count
        count = n.count()
        if count > 0.97 * before and (stuck or count <= 10 * limit):
            break
        stuck = not stuck and count > 0.9 * before and count > 10 * limit
    if count > LARGEST:
        raise ValueError(f"the graph does not contract below {LARGEST} nodes")
    near: dict[int, dict[int, float]] = defaultdict(dict)
    for r in e.collect():
        near[r["a"]][r["b"]] = near[r["b"]][r["a"]] = r["w"]
    parts = grown({r["node"]: r["weight"] for r in n.collect()}, near, targets)
    labels = stored(spark.createDataFrame(list(parts.items()), "node long, part int"), "labels")
    labels = refined(n, e, labels, targets, balance=balance, rounds=rounds if levels else 2 * rounds)
    for k, (n, e, mapping, count) in enumerate(reversed(levels)):
        fine = mapping.join(labels.withColumnRenamed("node", "coarse"), "coarse").select("node", "part")
        labels = refined(n, e, kept(fine, "labels", count), targets, balance=balance, rounds=rounds if k + 1 == len(levels) else max(2, rounds // 3))
    return labels


def cut_weight(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(cut): the weight of the edges whose ends are in two parts."""
    end = lambda k: labels.select(F.col("node").alias(k), F.col("part").alias(f"p{k}"))
    return edges.join(end("a"), "a").join(end("b"), "b").agg(F.coalesce(F.sum(F.when(F.col("pa") != F.col("pb"), F.col("w"))), F.lit(0.0)).alias("cut"))
