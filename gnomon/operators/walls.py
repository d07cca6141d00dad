"""Distance to walls: the nearest point of polygonal faces for each target.

The nearest corner bounds a target's distance.  With this bound it looks at one level of a hierarchy of grids, whose
cells are as wide as the bound or wider, so it visits at most three cells in each direction.  Triangles lie on the level
of their own size and the coarser ones that some target uses, in two cells at most in each direction; a target looks on
its own level for those no larger, and on the level of each larger size for the others.  So near and far targets cost
the same, and one huge triangle among small ones is a few rows.  Distances to triangles are taken in numpy, in batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import spatial

XYZ = ("x", "y", "z")
#: Triangles and distances smaller than this share of the largest triangle are on one level.
TINY = 2.0**-30


def nearest_on_triangles(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, nearest points) of points to triangles, a row each; a flat triangle counts as its sides."""
    dot = lambda u, v: (u * v).sum(axis=1)
    best, at = np.full(len(p), np.inf), np.zeros_like(p)

    def offer(q: np.ndarray, ok: np.ndarray | bool) -> None:
        d2 = dot(p - q, p - q)
        better = ok & (d2 < best)
        best[better], at[better] = d2[better], q[better]

    for u, v in ((a, b), (b, c), (c, a)):
        along = v - u
        length = dot(along, along)
        t = np.clip(dot(p - u, along) / np.where(length > 0, length, 1), 0, 1)
        offer(u + t[:, None] * along, True)
    n = np.cross(b - a, c - a)
    nn = dot(n, n)
    foot = p - (dot(p - a, n) / np.where(nn > 0, nn, 1))[:, None] * n
    inside = nn > 0
    for u, v in ((a, b), (b, c), (c, a)):
        inside = inside & (dot(np.cross(v - u, foot - u), n) >= 0)
    offer(foot, inside)
    return best, at


def _nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the candidates (target, face, p0 .. c2) in a batch, the nearest of each target."""
    for b in batches:
        p, *corners = (b[[f"{v}{i}" for i in range(3)]].to_numpy(float) for v in "pabc")
        d2, at = nearest_on_triangles(p, *corners)
        out = pd.DataFrame({"target": b["target"], "face": b["face"], "d2": d2, **{c: at[:, i] for i, c in enumerate(XYZ)}})
        yield out.sort_values(["target", "d2", "face"]).drop_duplicates("target")


def triangles(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(face, a, b, c): polygons as fans of triangles, each corner a struct of coordinates; images of a face may share its number."""
    d = faces.select("face", F.col("vtx").alias("_image"), F.posexplode("vtx").alias("_pos", "vertex")).join(vertices.select("vertex", F.struct(*XYZ).alias("at")), "vertex")
    d = d.groupBy("face", "_image").agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "at"))), lambda v: v["at"]).alias("v")).filter(F.size("v") >= 3)
    fan = F.transform(F.sequence(F.lit(1), F.size("v") - 2), lambda i: F.struct(F.get("v", 0).alias("a"), F.get("v", i).alias("b"), F.get("v", i + 1).alias("c")))
    return d.select("face", F.explode(fan).alias("t")).select("face", "t.*")


def distance_to_faces(targets: DataFrame, faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(target, face, distance, x, y, z): the nearest point of the faces (the least face, if several are as near).

    targets are (target, x, y, z), faces (face, vtx) with three vertices or more.  Every row of targets with a full
    place has one row, also where rows share a number or are repeated.  Without faces there is no row; a target with a
    null or NaN coordinate has none.
    """
    t = stored(triangles(faces, vertices), "wall-triangles")
    places = targets.select(*XYZ).distinct().withColumn("_at", F.xxhash64(*XYZ))
    corners = t.select(F.explode(F.array("a", "b", "c")).alias("p")).select("p.*").distinct().withColumn("corner", F.xxhash64(*XYZ))
    bound = spatial.closest_point(corners, places, list(XYZ), "corner", "_at").select("_at", F.sqrt("distance2").alias("_d"))
    box = {f"{k}{c}": f(*[F.col(f"{v}.{c}") for v in "abc"]) for c in XYZ for k, f in (("low", F.least), ("high", F.greatest))}
    t = t.select("face", "a", "b", "c", *[e.alias(k) for k, e in box.items()])
    extent = F.greatest(*[F.col(f"high{c}") - F.col(f"low{c}") for c in XYZ])
    # Levels are binary exponents of widths, from TINY of the largest extent on.
    largest = t.agg(F.max(extent)).first()[0]
    if largest is None:
        return targets.limit(0).select("target", F.lit(0).cast("long").alias("face"), *[F.lit(0.0).alias(c) for c in ("distance", *XYZ)])
    level = lambda size: F.ceil(F.log2(F.greatest(size, F.lit((float(largest) or 1.0) * TINY)))).cast("int")
    t = stored(t.withColumn("_own", level(extent)), "wall-levels")
    d = stored(places.join(bound, "_at").withColumn("_own", level(F.col("_d"))), "wall-targets")
    some = lambda x: sorted(r[0] for r in x.select("_own").distinct().collect())  # noqa: E731 - as many as sizes have binary exponents
    of_targets, of_triangles = some(d), some(t)
    listed = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    slot = lambda x, larger: F.struct(x.alias("_level"), F.lit(larger).alias("_larger"))
    t = t.select("face", "a", "b", "c", *box, F.inline(F.concat(F.transform(F.filter(listed(of_targets), lambda x: x >= F.col("_own")), lambda x: slot(x, False)), F.array(slot(F.col("_own"), True)))))
    d = d.select("_at", *XYZ, "_d", F.inline(F.concat(F.array(slot(F.col("_own"), False)), F.transform(F.filter(listed(of_triangles), lambda x: x > F.col("_own")), lambda x: slot(x, True)))))
    width = F.pow(F.lit(2.0), F.col("_level"))
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))
    for c in XYZ:
        t = t.withColumn(f"_{c}", cells(F.col(f"low{c}"), F.col(f"high{c}")))
        d = d.withColumn(f"_{c}", cells(F.col(c) - F.col("_d"), F.col(c) + F.col("_d")))
    j = d.join(t.select("face", "a", "b", "c", "_level", "_larger", *[f"_{c}" for c in XYZ]), ["_level", "_larger", *[f"_{c}" for c in XYZ]])
    flat = [F.col(c if v == "p" else f"{v}.{c}").alias(f"{v}{i}") for v in "pabc" for i, c in enumerate(XYZ)]
    near = j.select(F.col("_at").alias("target"), "face", *flat).mapInPandas(_nearest, f"target bigint, face {dict(j.dtypes)['face']}, d2 double, x double, y double, z double")
    best = near.groupBy(F.col("target").alias("_at")).agg(F.min(F.struct("d2", "face", *XYZ)).alias("m"))
    found = best.select("_at", "m.face", F.sqrt("m.d2").alias("distance"), *[F.col(f"m.{c}").alias(c) for c in XYZ])
    return targets.select("target", F.xxhash64(*XYZ).alias("_at")).join(found, "_at").drop("_at")


def shifted_walls(vertices: DataFrame, faces: DataFrame, shifts: Sequence[Sequence[float]], size: int) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of walls and their periodic images: copy n is moved by shifts[n - 1], its vertices start after n * size; faces keep their numbers."""
    copies = [(0, (0.0, 0.0, 0.0)), *enumerate(shifts, 1)]
    moves = F.inline(F.array(*[F.struct(F.lit(n * size).cast("long").alias("_by"), *[F.lit(float(x)).alias(f"_{c}") for c, x in zip(XYZ, s)]) for n, s in copies]))
    v = vertices.select("vertex", *XYZ, moves).select((F.col("vertex") + F.col("_by")).alias("vertex"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in XYZ])
    f = faces.select("face", "vtx", F.explode(F.array(*[F.lit(n * size).cast("long") for n, _ in copies])).alias("_by"))
    return v, f.select("face", F.transform("vtx", lambda x: x + F.col("_by")).alias("vtx"))
