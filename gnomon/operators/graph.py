"""Graph operators on edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import discard, stored

#: Fewer than this many nodes can have more than a HUBS-th of all edges each; a node below HUB_EDGES is none in any case.
HUBS, HUB_EDGES = 1_000, 1_000
#: Edges that a worker contracts at once.
CHUNK = 1_000_000
#: So few edges (some megabytes) are finished by one task; more go through rounds.  The result is the same.
LAST = 250_000


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members, their least connected member) of a graph on 0..n-1 where these differ, by label propagation with pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def contracted(e: DataFrame) -> DataFrame:
    """Stars (u, v) that connect what the edges connect, v being the least: each worker contracts its rows, CHUNK at a time, so long paths that lie together vanish before anything is shuffled."""

    def stars(a: list, b: list) -> pd.DataFrame:
        names, at = np.unique(np.concatenate(a + b), return_inverse=True)
        u, v = forest(len(names), *np.split(at, 2))
        return pd.DataFrame({"u": names[u], "v": names[v]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, n = [], [], 0
        for batch in batches:
            a.append(batch["u"].values), b.append(batch["v"].values)
            n += len(batch)
            if n >= CHUNK:
                yield stars(a, b)
                a, b, n = [], [], 0
        if n:
            yield stars(a, b)

    return e.mapInPandas(run, e.schema)


def _with_least(e: DataFrame, n: int) -> DataFrame:
    """Edges (u, v), at most n, with m: the least v of each u.

    Edges of hubs take it from a broadcast of fewer than HUBS rows, so that no task gets all edges of one node.
    """
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_c"))
    hub = F.col("_c") > max(HUB_EDGES, n // HUBS)
    marked = e.join(F.broadcast(least.filter(hub).select("u", F.col("m").alias("_m"))), "u", "left")
    some = marked.filter("_m is not null").select("u", "v", F.col("_m").alias("m"))
    return some.unionByName(marked.filter("_m is null").select("u", "v").join(least.filter(~hub).select("u", "m"), "u"))


def _round(e: DataFrame) -> tuple[DataFrame, tuple]:
    """e, stored, and its mark: the number of edges and a sum of hashes, taken while it is written."""
    seen = Observation()
    out = stored(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "cc")
    return out, (seen.get["n"], seen.get["h"])


def connected_components(edges: DataFrame, a: str, b: str, last: int | None = None) -> DataFrame:
    """(node, component) for every end of an edge; the component is its least node.

    Alternates the large-star and small-star steps, whose rounds grow with the logarithm of the size and which keep
    the number of edges bounded.  The loop ends when a round leaves the edge set as it was, or when what is left is few
    enough for one task: `last` edges, LAST if it is not given.  Edges with a null end and loops are ignored, loops giving no row.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    e, mark = _round(contracted(e).distinct())
    while mark[0]:
        if mark[0] <= min(LAST if last is None else last, CHUNK):
            now, _ = _round(contracted(e.coalesce(1)))
            discard(e)
            e = now
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour of a node is tied to the node's least neighbour (or itself).
        large = _with_least(both, 2 * mark[0]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # Small star: a node's smaller neighbours and itself are tied to the least of them.
        small = _with_least(large, 2 * mark[0])
        tied = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now, after = _round(tied.filter("u <> v").distinct())
        discard(e)
        e, before, mark = now, mark, after
        if mark == before:
            break
    roots = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return roots.unionByName(roots.select("component").distinct().select(F.col("component").alias("node"), "component"))
