"""Partitioning and balancing: weighted splits by number or Hilbert curve, boxes of blocks, interfaces, recovery.

A partitioning is a table (cell, part, lnum).  Order, weights and local numbers come from two-level running sums, so no
task sees a whole zone, and one part may hold most cells.  What runs on the driver has one entry a zone or part only.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from itertools import accumulate, count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hilbert, index
from . import numbering


def local_numbers(df: DataFrame, order: Sequence[str], part: str = "part", out: str = "lnum") -> DataFrame:
    """df with 1, 2, .. inside each part, by the order.  Joins of it merge: its files are small for their rows, and Spark would collect millions of them to broadcast."""
    d = numbering.row_numbers(df, [part, *order], "_rn")
    first = d.groupBy(part).agg(F.min("_rn").alias("_first"))
    return d.join(F.broadcast(first), part).withColumn(out, F.col("_rn") - F.col("_first") + 1).drop("_rn", "_first").hint("merge")


def split_ordered(df: DataFrame, order: Sequence[str], weights: Sequence[float], size: str | None = None) -> DataFrame:
    """df with its part 0..n - 1: stretches of the order whose sizes (rows, or a non-negative column) are in proportion to the weights."""
    value = F.lit(1) if size is None else F.coalesce(F.col(size), F.lit(0))
    d = numbering.exclusive_offsets(df.withColumn("_size", value), order, "_size", "_offset") if size is None else _weighted(df.withColumn("_size", value.cast("double")), order)
    total = df.agg(F.sum(value).alias("t")).first()["t"] or 0
    whole = sum(weights)
    bounds = [float(total) * w / whole for w in accumulate(weights)][:-1]
    # A row belongs to the part where its middle lies.
    middle = F.col("_offset") + F.col("_size") / 2
    part = sum(((middle >= b).cast("int") for b in bounds), F.lit(0)) if len(bounds) <= 64 else F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= middle))
    return d.withColumn("part", part.cast("int")).drop("_offset", "_size")


def _weighted(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """exclusive_offsets for fractional sizes."""
    from pyspark.sql import Window

    d = numbering._ranged(df, order)
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy("_pid").agg(F.sum("_size").alias("n")).select("_pid", F.coalesce(F.sum("n").over(w), F.lit(0.0)).alias("_start"))
    own = F.coalesce(F.sum("_size").over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return d.withColumn("_own", own).join(F.broadcast(before), "_pid").withColumn("_offset", F.col("_own") + F.col("_start")).drop("_pid", "_own", "_start")


def by_number(cells: DataFrame, weights: Sequence[float], cell: str = "cell") -> DataFrame:
    """(cell, part, lnum): stretches of the global numbers."""
    return local_numbers(split_ordered(cells.select(cell), [cell], weights), [cell])


def by_hilbert(centres: DataFrame, weights: Sequence[float], cell: str = "cell", coords: Sequence[str] = ("x", "y", "z"), bits: int = 16, size: str | None = None) -> DataFrame:
    """(cell, part, lnum): stretches of a Hilbert curve through the cell centres, so parts are compact; local numbers follow the curve."""
    edge = centres.agg(*[f(c).alias(f"{k}{c}") for c in coords for k, f in (("low", F.min), ("high", F.max))]).first()
    low, high = [edge[f"low{c}"] or 0.0 for c in coords], [edge[f"high{c}"] or 0.0 for c in coords]
    key = hilbert.hilbert_of_points([F.col(c) for c in coords], low, high, bits)
    d = centres.select(cell, key.alias("_key"), *([size] if size else []))
    d = local_numbers(split_ordered(d, ["_key", cell], weights, size), ["_key", cell])
    return d.select(cell, "part", "lnum")


def split_block(dims: Sequence[int], weights: Sequence[float]) -> list[tuple[tuple[int, int], ...]]:
    """Half-open boxes, one a weight, that fill a block: cut in two again and again across the longest side, by the weights of both halves."""
    out: list = [None] * len(weights)

    def cut(box, parts):
        if len(parts) == 1:
            out[parts[0]] = tuple(box)
            return
        axis = max(range(len(box)), key=lambda a: box[a][1] - box[a][0])
        low, high = box[axis]
        if high - low < 2:
            raise ValueError("more parts than cells along every side")
        half = len(parts) // 2
        share = sum(weights[p] for p in parts[:half]) / sum(weights[p] for p in parts)
        room = 1
        for a, (x, y) in enumerate(box):
            room *= 1 if a == axis else y - x
        need = lambda n: -(-n // room)  # noqa: E731 - planes that hold a cell for each part
        at = min(max(low + round((high - low) * share), low + need(half)), high - need(len(parts) - half))
        cut([*box[:axis], (low, at), *box[axis + 1 :]], parts[:half])
        cut([*box[:axis], (at, high), *box[axis + 1 :]], parts[half:])

    cut([(0, d) for d in dims], list(range(len(weights))))
    return out


def box_of(ijk: Sequence[Column], boxes: Sequence[Sequence[tuple[int, int]]]) -> Column:
    """The box (from 0) that holds a cell (indices from 1); null outside all."""
    inside = lambda b: [(c > lo) & (c <= hi) for c, (lo, hi) in zip(ijk, b)]
    out = F.lit(None).cast("int")
    for n, b in reversed(list(enumerate(boxes))):
        first, *rest = inside(b)
        for r in rest:
            first = first & r
        out = F.when(first, n).otherwise(out)
    return out


def by_box(cells: DataFrame, dims: Sequence[int], weights: Sequence[float], cell: str = "cell") -> DataFrame:
    """(cell, part, lnum) of a structured block: boxes, numbered inside with i fastest.  No row moves: all is arithmetic."""
    return in_boxes(cells, dims, split_block(dims, weights), cell)


def in_boxes(cells: DataFrame, dims: Sequence[int], boxes: Sequence[Sequence[tuple[int, int]]], cell: str = "cell") -> DataFrame:
    """The same with given boxes."""
    ijk = index.index_to_ijk(F.col(cell), dims)
    part = box_of(ijk, boxes)
    edge = lambda a, side: F.array(*[F.lit(b[a][side]) for b in boxes])[F.col("part")]
    at = [ijk[a] - edge(a, 0) for a in range(3)]
    width = [edge(a, 1) - edge(a, 0) for a in range(2)]
    lnum = at[0] + (at[1] - 1) * width[0] + (at[2] - 1) * width[0] * width[1]
    return cells.select(cell).withColumn("part", part).withColumn("lnum", lnum.cast("long"))


def box_ranges(ranges: DataFrame, boxes: Sequence[Sequence[tuple[int, int]]]) -> DataFrame:
    """A subset's index ranges (name, i0, i1, j0, j1, k0, k1; cells, closed, from 1) cut by boxes: (name, part, the same in the box's own indices)."""
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("part"), *[F.lit(v).alias(f"b{c}{s}") for c, b in zip("ijk", box) for s, v in zip("01", b)]) for n, box in enumerate(boxes)]))
    d = ranges.select("name", *[f"{c}{s}" for c in "ijk" for s in "01"], parts.alias("b")).select("*", "b.*").drop("b")
    low = {c: F.greatest(F.col(f"{c}0"), F.col(f"b{c}0") + 1) for c in "ijk"}
    high = {c: F.least(F.col(f"{c}1"), F.col(f"b{c}1")) for c in "ijk"}
    meet = (low["i"] <= high["i"]) & (low["j"] <= high["j"]) & (low["k"] <= high["k"])
    return d.filter(meet).select("name", "part", *[(x[c] - F.col(f"b{c}0")).alias(f"{c}{s}") for c in "ijk" for s, x in (("0", low), ("1", high))])


def entity_parts(cells: DataFrame, cell_parts: DataFrame, entity: str = "vtx") -> DataFrame:
    """(entity, part, lnum): every part that has a cell with the entity (vertex, or the absolute face number) holds it, numbered inside the part."""
    d = cells.select("cell", F.explode(entity).alias("_e")).join(cell_parts.select("cell", "part"), "cell")
    return local_numbers(d.select(F.abs("_e").alias(entity), "part").distinct(), [entity])


def interfaces(faces: DataFrame, cell_parts: DataFrame) -> DataFrame:
    """(face, part, cell_lnum, donor_part, donor_lnum): both sides of the faces between two parts."""
    side = lambda c: cell_parts.select(F.col("cell").alias(c), F.col("part").alias(f"_p{c}"), F.col("lnum").alias(f"_l{c}"))
    d = faces.filter("left > 0 and right > 0").join(side("left"), "left").join(side("right"), "right").filter("_pleft <> _pright")
    both = lambda a, b: F.struct(*[F.col(f"_{k}{s}").alias(n) for k, s, n in (("p", a, "part"), ("l", a, "cell_lnum"), ("p", b, "donor_part"), ("l", b, "donor_lnum"))])
    return d.select("face", F.explode(F.array(both("left", "right"), both("right", "left"))).alias("s")).select("face", "s.*")


def recover(parts: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """The distributed table of partitioned rows: one row for each global number; copies hold the same values."""
    return parts.groupBy(key).agg(*[F.min(v).alias(v) for v in values])


def redistribute(df: DataFrame, policy: str, order: Sequence[str], parts: int) -> DataFrame:
    """Rows dealt out anew: `uniform`, or `gather` / `gather.N` (all in part 0 / N), as a column `part`."""
    kind, _, target = policy.partition(".")
    if kind == "gather":
        return df.withColumn("part", F.lit(int(target or 0)))
    if kind != "uniform":
        raise ValueError(f"unknown policy: {policy}")
    return numbering.uniform_split(df, order, parts, "part").withColumn("part", F.col("part") - 1)


def even_sizes(total: int, parts: int) -> list[int]:
    """A number in nearly equal parts, larger ones first."""
    return [total // parts + (p < total % parts) for p in range(parts)]


def largest_differencing(sizes: Sequence[int], bins: int) -> list[list[int]]:
    """Positions of the sizes dealt into bins of similar sums (the method of Karmarkar and Karp): the two partial dealings that differ most are combined against each other."""
    tick = count()
    heap = []
    for i, s in enumerate(sizes):
        dealt = [(0, ())] * (bins - 1) + [(s, (i,))]
        heap.append((-s, next(tick), dealt))
    heapq.heapify(heap)
    if not heap:
        return [[] for _ in range(bins)]
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = sorted((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b)))
        heapq.heappush(heap, (both[0][0] - both[-1][0], next(tick), both))
    return [sorted(ids) for _, ids in heap[0][2]]


def regular_weights(zones: Sequence[str], ranks: int, parts: int = 1) -> list[dict[str, list[float]]]:
    """For each rank, each zone's weights: every zone in equal parts on every rank."""
    return [{z: [1 / (ranks * parts)] * parts for z in zones} for _ in range(ranks)]


def whole_zone_weights(sizes: dict[str, int], ranks: int) -> list[dict[str, list[float]]]:
    """Zones are not cut: each goes to one rank."""
    names = list(sizes)
    return [{names[i]: [1.0] for i in group} for group in largest_differencing(list(sizes.values()), ranks)]


def balanced_weights(sizes: dict[str, int], ranks: int) -> list[dict[str, list[float]]]:
    """Every rank gets the same number of cells, within one; zones, largest first, fill the ranks in a row, so few are cut."""
    room = even_sizes(sum(sizes.values()), ranks)
    out: list[dict[str, list[float]]] = [{} for _ in room]
    at = 0
    for name in sorted(sizes, key=lambda z: (-sizes[z], z)):
        left = sizes[name]
        while left:
            while not room[at]:
                at += 1
            take = min(left, room[at])
            out[at].setdefault(name, []).append(take / sizes[name])
            room[at] -= take
            left -= take
    return out
