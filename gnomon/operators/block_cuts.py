"""Cutting of structured blocks into boxes of given weights, again and again: by volumes with refined cuts, or by weights of cells.

A cut tree is a part's number, or (axis, shift, left, right): the box is cut across the axis where the weights of both
sides ask for, moved by a shift.  It has a node for each part, and is the only thing that the driver works on.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import index
from ..storage import stored
from .partition import split_block

Box = tuple[tuple[int, int], ...]


def _leaves(tree) -> list[int]:
    return [tree] if isinstance(tree, int) else _leaves(tree[2]) + _leaves(tree[3])


def _first_tree(box: Box, parts: Sequence[int], weights: Sequence[float]):
    """Halves of the parts on both sides, always across the longest side."""
    if len(parts) == 1:
        return parts[0]
    axis = max(range(len(box)), key=lambda a: box[a][1] - box[a][0])
    left, right = parts[: len(parts) // 2], parts[len(parts) // 2 :]
    near, far = _halves(box, axis, 0, left, right, weights)
    return (axis, 0, _first_tree(near, left, weights), _first_tree(far, right, weights))


def _exact_tree(box: Box, parts: Sequence[int], weights: Sequence[float]):
    """The cut, along any side and with any two groups of neighbouring parts, that comes nearest to the weights, long sides and even groups before others."""
    if len(parts) == 1:
        return parts[0]
    longest, found = max(high - low for low, high in box), []
    for k in range(max(1, len(parts) // 3), len(parts) - max(1, len(parts) // 3) + 1):
        left, right = parts[:k], parts[k:]
        near = sum(weights[p] for p in left)
        share = near / (near + sum(weights[p] for p in right) or 1)
        for axis, (low, high) in enumerate(box):
            try:
                at = _halves(box, axis, 0, left, right, weights)
            except ValueError:
                continue
            # Off by so much of the smallest part on either side; thin boxes count as some more.
            off = abs(volume(at[0]) - share * volume(box)) / min(volume(at[0]) / k, volume(at[1]) / len(right))
            found.append((off + 0.02 * longest / (high - low) + 0.01 * abs(2 * k / len(parts) - 1), axis, k, at))
    if not found:
        raise ValueError("no room for a cell of each part")
    _, axis, k, (near_box, far_box) = min(found)
    return (axis, 0, _exact_tree(near_box, parts[:k], weights), _exact_tree(far_box, parts[k:], weights))


def _drawn_tree(box: Box, parts: Sequence[int], weights: Sequence[float], draw: random.Random):
    """Any groups of neighbouring parts, across any side that has room for them."""
    if len(parts) == 1:
        return parts[0]
    k = draw.randint(1, len(parts) - 1)
    for axis in draw.sample(range(len(box)), len(box)):
        try:
            near, far = _halves(box, axis, 0, parts[:k], parts[k:], weights)
        except ValueError:  # no room along that axis
            continue
        return (axis, 0, _drawn_tree(near, parts[:k], weights, draw), _drawn_tree(far, parts[k:], weights, draw))
    raise ValueError("no room for a cell of each part")


def _room(box: Box, axis: int) -> int:
    out = 1
    for a, (low, high) in enumerate(box):
        out *= 1 if a == axis else high - low
    return out


def _halves(box: Box, axis: int, shift: int, left: Sequence[int], right: Sequence[int], weights: Sequence[float]) -> tuple[Box, Box]:
    """The two boxes of a cut; each keeps as many layers as its parts need for a cell each.  ValueError if there are not so many."""
    low, high = box[axis]
    room = _room(box, axis)
    first, last = low + -(-len(left) // room), high - -(-len(right) // room)
    if first > last:
        raise ValueError("no room for a cell of each part")
    near, both = (sum(weights[p] for p in side) for side in (left, [*left, *right]))
    at = low + int((high - low) * (near / both if both else len(left) / (len(left) + len(right))) + 0.5) + shift
    at = min(max(at, first), last)
    return tuple((low, at) if a == axis else r for a, r in enumerate(box)), tuple((at, high) if a == axis else r for a, r in enumerate(box))


def boxes_of(tree, dims: Sequence[int], weights: Sequence[float]) -> list[Box]:
    """The half-open box of each part."""
    out: list = [None] * len(weights)
    todo = [(tree, tuple((0, d) for d in dims))]
    while todo:
        node, box = todo.pop()
        if isinstance(node, int):
            out[node] = box
            continue
        axis, shift, left, right = node
        near, far = _halves(box, axis, shift, _leaves(left), _leaves(right), weights)
        todo += [(left, near), (right, far)]
    return out


def volume(box: Box) -> int:
    return _room(box, -1)


def deviations(boxes: Sequence[Box], weights: Sequence[float]) -> list[float]:
    """How far each part's volume is from its share, in layers of its box across its longest side."""
    whole, total = sum(volume(b) for b in boxes), sum(weights)
    return [abs(volume(b) - whole * w / total) * max(high - low for low, high in b) / max(volume(b), 1) for b, w in zip(boxes, weights)]


def _changed(tree, path: Sequence[int], make):
    if not path:
        return make(tree)
    axis, shift, *sides = tree
    sides[path[0]] = _changed(sides[path[0]], path[1:], make)
    return (axis, shift, *sides)


def _path_to(tree, part: int) -> list[int]:
    out = []
    while not isinstance(tree, int):
        side = int(part in _leaves(tree[3]))
        out.append(side)
        tree = tree[2 + side]
    return out


def _exchanged(tree, a: int, b: int):
    if isinstance(tree, int):
        return b if tree == a else a if tree == b else tree
    return (tree[0], tree[1], _exchanged(tree[2], a, b), _exchanged(tree[3], a, b))


def refined(tree, dims: Sequence[int], weights: Sequence[float], rounds: int = 720):
    """The tree with cuts above the worst part moved, turned to another axis or exchanged, while that brings the largest deviation down; at most about so many trials."""
    score = lambda t: sorted(deviations(boxes_of(t, dims, weights), weights), reverse=True)
    best, trials = score(tree), 0
    while trials < rounds:
        found = deviations(boxes_of(tree, dims, weights), weights)
        path = _path_to(tree, found.index(max(found)))
        moves = [lambda n, a=a: (a, 0, *n[2:]) for a in range(len(dims))] + [lambda n, s=s: (n[0], n[1] + s, *n[2:]) for s in (-1, 1)] + [lambda n: (n[0], 0, n[3], n[2])]
        worst = found.index(max(found))
        better = None
        for other in range(len(weights)):  # another part in the worst one's place
            if other != worst and weights[other] != weights[worst] and trials < rounds:
                trials += 1
                try:
                    t = _exchanged(tree, worst, other)
                    s = score(t)
                except ValueError:
                    continue
                if s < best:
                    best, better = s, t
        for depth in reversed(range(len(path))):
            for move in moves:
                trials += 1
                try:
                    other = _changed(tree, path[:depth], move)
                    s = score(other)
                except ValueError:  # no room along that axis
                    continue
                if s < best:
                    best, better = s, other
        if better is None:
            return tree
        tree = better
    return tree


def cut_block(dims: Sequence[int], weights: Sequence[float], rounds: int = 720) -> list[Box]:
    """Half-open boxes, one a weight, that fill a block; their volumes follow the weights, within a layer of each box wherever the trials find such cuts.

    While these are no nearer than the cuts of split_block, which may be the best of their kind, trees are drawn and
    refined as well: the fewer the more parts there are, 400 for seven.
    """
    whole, given = tuple((0, d) for d in dims), list(range(len(weights)))
    starts, error = [], None
    for make, parts in ((_first_tree, given), (_exact_tree, given), (_exact_tree, sorted(given, key=lambda p: (weights[p], p)))):
        try:
            starts.append(refined(make(whole, parts, weights), dims, weights, rounds // 3))
        except ValueError as e:
            error = e
    if not starts:
        raise error or ValueError("no weights")
    off = lambda b: max(deviations(b, weights))
    best = min((boxes_of(t, dims, weights) for t in starts), key=off)
    try:
        plain = off(split_block(dims, weights))
    except ValueError:
        return best
    draw, left = random.Random(0), min(400, 20_000 // len(weights) ** 2)
    while left and 0 < plain <= off(best):
        left -= 1
        try:
            tree = _drawn_tree(whole, draw.sample(given, len(given)), weights, draw)
            best = min(best, boxes_of(refined(tree, dims, weights, rounds // 6), dims, weights), key=off)
        except ValueError:
            continue
    return best


def volumes(boxes: DataFrame, axes: str = "ijk") -> DataFrame:
    """(zone, part, cells) of boxes (zone, part, bi0, bi1, ..)."""
    n = F.lit(1).cast("long")
    for a in axes:
        n = n * (F.col(f"b{a}1") - F.col(f"b{a}0"))
    return boxes.select("zone", "part", n.alias("cells"))


def by_cell_weights(cells: DataFrame, dims: Sequence[int], weights: Sequence[float], size: str, cell: str = "cell") -> DataFrame:
    """(cell, part, lnum): boxes of a block whose sums of a non-negative column follow the weights; null sizes count as 0.

    All boxes of a level are cut at once, across the longest side, after the layer where the sum comes nearest to the
    weights of the parts below (the first such); each level is one aggregation by box and layer.  Parts are numbered
    in the order of the weights; lnum runs in the part's box with i fastest.
    """
    spark = cells.sparkSession
    axes = dict(zip("ijk", index.index_to_ijk(F.col(cell), dims)))
    d = cells.select(cell, F.coalesce(F.col(size).cast("double"), F.lit(0.0)).alias("_size"), F.lit(1).cast("long").alias("_node"), *[(c - 1).cast("long").alias(f"_{a}") for a, c in axes.items()])
    open_: dict[int, tuple[Box, list[int]]] = {1: (tuple((0, n) for n in dims), list(range(len(weights))))}
    done: dict[int, tuple[Box, int]] = {}
    along = F.element_at(F.array("_i", "_j", "_k"), F.col("_axis"))
    while open_:
        rows = []
        for node, (box, parts) in list(open_.items()):
            if len(parts) == 1:
                done[node] = (box, parts[0])
                del open_[node]
                continue
            axis = max(range(3), key=lambda a: box[a][1] - box[a][0])
            left, right, room = parts[: len(parts) // 2], parts[len(parts) // 2 :], _room(box, axis)
            first, last = box[axis][0] + -(-len(left) // room), box[axis][1] - -(-len(right) // room)
            if first > last:
                raise ValueError("more parts than cells along every side")
            both = sum(weights[p] for p in parts)
            rows.append((node, axis + 1, first, last, float(sum(weights[p] for p in left) / both if both else 0.5)))
        if not rows:
            break
        plan = spark.createDataFrame(rows, "_node long, _axis int, _first long, _last long, _share double")  # a row a part at most
        # Sums by layer, which are few against the cells, and running ones: a cut after each layer, and the first that is allowed.
        layers = stored(d.join(plan, "_node").groupBy("_node", along.alias("_layer")).agg(F.sum("_size").alias("s")), "layers").join(plan, "_node")
        running = F.sum("s").over(Window.partitionBy("_node").orderBy("_layer").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sums = layers.groupBy("_node").agg(F.sum("s").alias("t"), F.sum(F.when(F.col("_layer") < F.col("_first"), F.col("s"))).alias("_below"))
        ends = plan.join(sums, "_node", "left").select("_node", F.col("_first").alias("at"), F.coalesce("_below", F.lit(0.0)).alias("_below"), (F.col("_share") * F.coalesce("t", F.lit(0.0))).alias("_want"))
        after = layers.select("_node", (F.col("_layer") + 1).alias("at"), running.alias("_below"), "_first", "_last").filter("at between _first and _last").drop("_first", "_last")
        places = ends.unionByName(after.join(ends.select("_node", "_want"), "_node"))
        best = places.groupBy("_node").agg(F.min(F.struct(F.abs(F.col("_below") - F.col("_want")).alias("off"), "at")).alias("at"))
        found = {r["_node"]: r["at"] for r in best.select("_node", F.col("at.at").alias("at")).collect()}  # one row a box
        cuts = spark.createDataFrame([(r[0], r[1], found[r[0]]) for r in rows], "_node long, _axis int, _at long")
        d = d.join(cuts, "_node", "left").withColumn("_node", F.when(F.col("_at").isNull(), F.col("_node")).otherwise(F.col("_node") * 2 + (along >= F.col("_at")).cast("long"))).drop("_axis", "_at")
        for node, axis, *_ in rows:
            box, parts = open_.pop(node)
            for side, (low, high) in enumerate(((box[axis - 1][0], found[node]), (found[node], box[axis - 1][1]))):
                half = parts[: len(parts) // 2] if side == 0 else parts[len(parts) // 2 :]
                open_[node * 2 + side] = (tuple((low, high) if a == axis - 1 else r for a, r in enumerate(box)), half)
    ends = [(node, part, *[v for a in range(3) for v in box[a]]) for node, (box, part) in done.items()]
    d = d.join(spark.createDataFrame(ends, "_node long, part int, " + ", ".join(f"_{a}{s} long" for a in "ijk" for s in "01")), "_node")
    width = lambda a: F.col(f"_{a}1") - F.col(f"_{a}0")
    at_: dict[str, Column] = {a: F.col(f"_{a}") - F.col(f"_{a}0") for a in "ijk"}
    return d.select(cell, "part", (1 + at_["i"] + at_["j"] * width("i") + at_["k"] * width("i") * width("j")).cast("long").alias("lnum"))
