"""Spatial joins: interval overlap, containment, nearest neighbours and inverse-distance weights.

Joins on ranges are made equi-joins by buckets; a pair is reported in one bucket only, so nothing is made twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def interval_overlap(a: DataFrame, b: DataFrame, a_range: tuple[str, str], b_range: tuple[str, str], width: float) -> DataFrame:
    """Pairs of rows whose closed intervals meet.  Every interval is put in all buckets of the width that it touches."""
    al, ah, bl, bh = (F.col(c) for c in (*a_range, *b_range))
    buckets = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    x = a.filter(al <= ah).withColumn("_bucket", buckets(al, ah))
    y = b.filter(bl <= bh).withColumn("_bucket", buckets(bl, bh))
    meet = (al <= bh) & (bl <= ah)
    once = F.col("_bucket") == F.floor(F.greatest(al, bl) / width)
    return x.join(y, "_bucket").filter(meet & once).drop("_bucket")


def localize(points: DataFrame, boxes: DataFrame, value: str, box: tuple[str, str], ident: str, width: float, missing: int = -1) -> DataFrame:
    """points with the box (half-open, disjoint) that holds their value, `missing` where none does."""
    lo, hi = F.col(box[0]), F.col(box[1])
    b = boxes.filter(lo < hi).withColumn("_bucket", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    p = points.withColumn("_bucket", F.floor(F.col(value) / width))
    b = b.select("_bucket", lo.alias("_lo"), hi.alias("_hi"), F.col(ident))
    j = p.join(b, (p["_bucket"] == b["_bucket"]) & (F.col(value) >= F.col("_lo")) & (F.col(value) < F.col("_hi")), "left")
    return j.select(*points.columns, F.coalesce(ident, F.lit(missing)).alias(ident))


def _cell(x: Sequence[Column], size: float) -> list[Column]:
    return [F.floor(c / size) for c in x]


def k_closest(sources: DataFrame, targets: DataFrame, coords: Sequence[str], source_id: str, target_id: str, k: int = 1, size: float | None = None, max_rounds: int | None = None, radius: float | None = None) -> DataFrame:
    """(target, source, distance2, rank): the k nearest sources of every target, ties to the smaller source id.

    Sources lie in a grid of cells.  A target looks at the cells within r rings of its own and is done when it has k
    sources no farther than r cells, or when its rings hold all sources; the others go on with twice as many rings.
    Rings are counted from the first that reaches the sources' box, so a far target is found as soon as a near one.  So
    the work follows the local density.  With max_rounds, the last round looks at all rings at once.  Of the sources found, only the k nearest of a target leave its partition.  With
    no size given, cells are made to hold about k + 1 sources on average.  With a radius, sources farther away do not
    count, cells are no wider than it, and rings that lie beyond it are not looked at.

    A source with a null or NaN coordinate is nobody's neighbour, and a target with one has no row; equal rows of
    targets count once.
    """
    dim = len(coords)
    placed = lambda d: d.filter(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in coords))
    sources, targets = placed(sources), placed(targets)
    box = sources.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(f"w{i}") for i, c in enumerate(coords)]).first()
    n = box["n"]
    if not n:
        return targets.limit(0).select(F.col(target_id), F.lit(None).cast("long").alias(source_id), F.lit(0.0).alias("distance2"), F.lit(0).alias("rank"))
    if size is None:
        spans = [box[f"w{i}"] for i in range(dim) if box[f"w{i}"]]
        volume = 1.0
        for s in spans:
            volume *= s
        size = (volume * (k + 1) / n) ** (1 / max(len(spans), 1)) if spans else 1.0
    size = size if radius is None else min(size, radius)
    # A ring more where cells are less wide than the radius, as quotients are rounded.
    most = None if radius is None else 1 if size == radius else ceil(radius / size) + 1
    cells = [f"_c{i}" for i in range(dim)]
    grid = sources.select(F.col(source_id).alias("_s"), *[F.col(c).alias(f"_s{i}") for i, c in enumerate(coords)])
    grid = stored(grid.withColumns(dict(zip(cells, _cell([F.col(f"_s{i}") for i in range(dim)], size)))), "grid")
    place = ["_t", *[f"_t{i}" for i in range(dim)]]
    todo = stored(targets.select(F.col(target_id).alias("_t"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(coords)]).distinct(), "targets")
    extent = grid.agg(*[F.max(c) for c in cells], *[F.min(c) for c in cells]).first()
    far = F.lit(1 << 50)  # cells beyond count as at this one; their distance check never holds, so they end with all sources
    heres = [F.greatest(F.least(F.floor(F.col(f"_t{i}") / size), far), -far) for i in range(dim)]
    lows, highs = [F.lit(v) for v in extent[dim:]], [F.lit(v) for v in extent[:dim]]
    widest = lambda xs: F.greatest(F.lit(0), *xs)
    reach = widest([x for h, a, b in zip(heres, lows, highs) for x in (a - h, h - b)])
    whole = widest([x for h, a, b in zip(heres, lows, highs) for x in (h - a, b - h)])
    if most is not None:
        todo, whole = todo.filter(reach <= most), F.least(whole, F.lit(most))
    out, rings, turn = None, 1, 0
    while True:  # ends when the rings are as many as the box is wide, at the latest
        turn += 1
        probe = todo.withColumn("_r", whole if turn == max_rounds else F.least(reach + rings, whole))
        for i in range(dim):
            low, high = F.greatest(heres[i] - F.col("_r"), lows[i]), F.least(heres[i] + F.col("_r"), highs[i])
            probe = probe.withColumn(cells[i], F.explode_outer(F.when(low <= high, F.sequence(low, high))))
        d2 = sum(((F.col(f"_t{i}") - F.col(f"_s{i}")) ** 2 for i in range(1, dim)), (F.col("_t0") - F.col("_s0")) ** 2)
        found = probe.join(grid, cells).select(*place, "_r", d2.alias("d"), F.col("_s").alias("s"))
        if radius is not None:
            found = found.filter(F.col("d") <= radius * radius)
        found = found.withColumn("_k", F.row_number().over(Window.partitionBy(*place).orderBy("d", "s"))).filter(F.col("_k") <= k)
        near = found.groupBy(*place).agg(F.max("_r").alias("_r"), F.sort_array(F.collect_list(F.struct("d", "s"))).alias("_near"))
        enough = (F.size("_near") >= min(k, n)) & ((F.col("_r") >= whole) | (F.element_at("_near", -1)["d"] <= (F.col("_r") * size) ** 2))
        near = stored(near.withColumn("_ok", enough).drop("_r"), "near")
        done = near.filter("_ok").select("_t", "_near")
        out = done if out is None else out.unionByName(done)
        todo = todo.join(near.filter("_ok").select(*place).hint("merge"), place, "left_anti")  # as many rows as targets
        if todo.isEmpty() or (most is not None and rings >= most):
            break  # with a radius, a target may be left without a source
        todo = stored(todo, "targets")
        rings *= 2
    return out.select(F.col("_t").alias(target_id), F.posexplode("_near").alias("rank", "_n")).select(target_id, F.col("_n")["s"].alias(source_id), F.col("_n")["d"].alias("distance2"), (F.col("rank") + 1).alias("rank"))


def closest_point(sources: DataFrame, targets: DataFrame, coords: Sequence[str], source_id: str, target_id: str) -> DataFrame:
    return k_closest(sources, targets, coords, source_id, target_id, 1).drop("rank")


def closest_within(sources: DataFrame, targets: DataFrame, coords: Sequence[str], source_id: str, target_id: str, radius: float) -> DataFrame:
    """(target, source, distance2): the nearest source of each target that has one within the radius; points with an infinite coordinate have none."""
    finite = " and ".join(f"abs(`{c}`) < double('infinity')" for c in coords)
    return k_closest(sources.filter(finite), targets.filter(finite), coords, source_id, target_id, 1, radius=radius).drop("rank")


def inverse_distance_mean(df: DataFrame, key: str, value: str, distance: str, power: float = 1.0, floor: float = 1e-20) -> DataFrame:
    """Mean of value by key with weights 1 / max(distance, floor) ** power."""
    w = 1 / F.greatest(F.col(distance), F.lit(floor)) ** power
    return df.groupBy(key).agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value))


def cell_centres(connectivity: DataFrame, vertices: DataFrame, cell: str, vertex: str, coords: Sequence[str]) -> DataFrame:
    """Mean of the coordinates of each cell's vertices (each vertex once).

    Links that repeat a vertex are dropped after the join, in the cell's own partition: grouping by cell and vertex, then
    by cell, needs one exchange.
    """
    d = connectivity.select(cell, vertex).join(vertices.select(vertex, *coords), vertex).repartition(cell)
    return d.groupBy(cell, vertex).agg(*[F.first(c).alias(c) for c in coords]).groupBy(cell).agg(*[F.avg(c).alias(c) for c in coords])


def balanced_parts(total: int, parts: int) -> int:
    return ceil(total / max(parts, 1))


def box_candidates(points: DataFrame, boxes: DataFrame, point: str, box: str, tolerance: float = 0.0, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(point, box) where a point lies in a box (box, low.., high..), or within tolerance of it.

    A box lies on the level of its own size, in a grid whose cells are as wide as the box or wider, so it meets two of
    them at most in each direction, however large it is.  A point has one cell on every level in use, of which there are
    no more than sizes have binary exponents; a huge box among small ones costs nothing more.
    """
    low, high = (lambda c: F.col(f"low{c}") - tolerance), (lambda c: F.col(f"high{c}") + tolerance)
    extent = F.greatest(*[high(c) - low(c) for c in coords], F.lit(1e-300))
    b = boxes.select(box, *[F.col(f"{k}{c}") for c in coords for k in ("low", "high")], F.ceil(F.log2(extent)).cast("int").alias("_level"))
    levels = sorted(r[0] for r in b.select("_level").distinct().collect() if r[0] is not None)  # binary exponents of sizes
    width = F.pow(F.lit(2.0), F.col("_level"))
    p = points.select(point, *[F.col(c).alias(f"_p{c}") for c in coords], F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")).alias("_level"))
    for c in coords:
        b = b.withColumn(f"_{c}", F.explode(F.sequence(F.floor(low(c) / width), F.floor(high(c) / width))))
        p = p.withColumn(f"_{c}", F.floor(F.col(f"_p{c}") / width))
    inside = F.lit(True)
    for c in coords:
        inside = inside & (F.col(f"_p{c}") >= low(c)) & (F.col(f"_p{c}") <= high(c))
    return p.join(b, ["_level", *[f"_{c}" for c in coords]]).filter(inside).select(point, box)
