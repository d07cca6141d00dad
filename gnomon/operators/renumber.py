"""Renumbering of cells and faces inside parts, so that what is joined lies close together.

Cells are numbered in the manner of Cuthill and McKee: from a start cell by levels of the breadth-first search, in a
level by the number of the first neighbour in the level before, then by the number of neighbours.

Levels are found by chunks of cells that lie together by piece and number: in a round every chunk that was told of a
shorter way goes on as far as it reaches inside, and tells its neighbours.  Then bands of levels are numbered one after
the other, each in one go.  A chunk and a band hold so many cells and neighbours at most (and those of one cell or level
more; a level that is wider is numbered by all workers), so rounds are as many as the largest piece has of them, not as it has
levels; where numbers say nothing about places, finding levels may take as many rounds as there are levels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import fresh_path, stored
from . import numbering
from .graph import connected_components
from .partition import local_numbers

#: Cells and neighbours of them that a worker takes at once.
CHUNK = 1_000_000
#: Tables of so many rounds are put together in one.
TOGETHER = 40
FAR = np.iinfo(np.int64).max


def _inner(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, part) of the edges inside parts."""
    end = lambda k: parts.select(F.col("cell").alias(k), F.col("part").alias(f"p{k}"))
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(end("a"), "a").join(end("b"), "b").filter("pa = pb").select("a", "b", F.col("pa").alias("part"))


def _split(df: DataFrame, by: str, name: str) -> DataFrame:
    """df stored in a folder for each value of a column, so that rounds read what they need."""
    path = fresh_path(df.sparkSession, name)
    df.repartition(by).write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for d in tables[1:]:
        out = out.unionByName(d)
    return out


def _reach(key: tuple, edges: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The levels that become lower in a chunk (own), and those that its neighbours in other chunks (chunk) are told."""
    (here,) = key
    u, v, to = (edges[c].values for c in ("u", "v", "to"))
    names, at = np.unique(u, return_inverse=True)
    inner = to == here
    order = np.argsort(at[inner], kind="stable")
    tails, first = np.searchsorted(names, v[inner])[order], np.searchsorted(at[inner][order], np.arange(len(names) + 1))
    place, given, told = np.searchsorted(names, rows["cell"].values), rows["level"].values, rows["told"].values
    level = np.full(len(names), FAR)
    np.minimum.at(level, place[~told], given[~told])
    was = level.copy()
    np.minimum.at(level, place[told], given[told])
    begin = np.flatnonzero(level < was)
    begin = begin[np.argsort(level[begin], kind="stable")]
    due, done, reached, k = level[begin], 0, begin[:0], 0
    while done < len(begin) or len(reached):
        if not len(reached):
            k = due[done]
        upto = np.searchsorted(due, k, "right")
        now = begin[done:upto]
        now, done = np.concatenate([reached, now[level[now] == k]]), upto
        n = first[now + 1] - first[now]
        near = tails[np.repeat(first[now] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        k += 1
        reached = np.unique(near[level[near] > k])
        level[reached] = k
    lower = level < was
    out = ~inner & lower[at]
    own = pd.DataFrame({"chunk": here, "cell": names[lower], "level": level[lower], "own": True})
    other = pd.DataFrame({"chunk": to[out], "cell": v[out], "level": level[at[out]] + 1, "own": False})
    return pd.concat([own, other.groupby(["chunk", "cell"], as_index=False).min()[list(own.columns)]])


def _levels(places: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(cell, level) from the start cell of each piece; places is (cell, chunk), edges (u, v, chunk, to) with the chunks of both ends."""
    news = stored(starts.select("cell").join(places, "cell").select("chunk", "cell", F.lit(0).cast("long").alias("level"), F.lit(False).alias("own")), "levels")
    known: list[DataFrame] = []
    while active := [r[0] for r in news.filter("not own").select("chunk").distinct().collect()]:
        here = F.col("chunk").isin(active)
        rows = _union([news.filter("not own").withColumn("told", ~F.col("own")), *[d.filter(here).withColumn("told", F.lit(False)) for d in known]])
        news = stored(edges.filter(here).groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInPandas(_reach, "chunk long, cell long, level long, own boolean"), "levels")
        known.append(news.filter("own"))
        if len(known) == TOGETHER:
            known = [stored(_union(known).groupBy("chunk", "cell").agg(F.min("level").alias("level"), F.first("own").alias("own")), "levels")]
    return _union(known or [news]).groupBy("cell").agg(F.min("level").alias("level"))


def _numbered(key: tuple, cells: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Numbers of the cells of a band of levels of one or several pieces; edges lead from a level to the next."""
    cell, piece, level, degree, before, came = (cells[c].values for c in ("cell", "piece", "level", "degree", "before", "came"))
    came, num = np.where(came == 0, FAR, came), np.zeros(len(cell), "int64")
    order = np.argsort(cell)
    u, v = (order[np.searchsorted(cell[order], edges[c].values)] for c in "uv")
    by = np.argsort(level[u], kind="stable")
    u, v = u[by], v[by]
    rows = np.argsort(level, kind="stable")
    each, at = np.unique(level[rows], return_index=True)
    ends, low, high = [*at[1:], len(rows)], np.searchsorted(level[u], each), np.searchsorted(level[u], each, "right")
    for a, b, x, y in zip(at, ends, low, high):
        g = rows[a:b]
        g = g[np.lexsort((cell[g], degree[g], came[g], piece[g]))]
        num[g] = before[g] + 1 + np.arange(len(g)) - np.searchsorted(piece[g], piece[g])
        np.minimum.at(came, v[x:y], num[u[x:y]])
    return pd.DataFrame({"cell": cell, "piece": piece, "level": level, "num": num})


def _swept(cells: DataFrame, near: DataFrame, places: DataFrame, edges: DataFrame, starts: DataFrame, chunk: int) -> DataFrame:
    """(cell, piece, level, num) from the start cell of each piece; near is (u, v)."""
    one = F.lit(1).cast("long")
    alone = cells.filter("degree = 0").select("cell", "piece", F.lit(0).cast("long").alias("level"), one.alias("num"))
    level = stored(_levels(places, edges, starts).join(cells.select("cell", "piece", "degree"), "cell"), "levels")
    n = level.groupBy("piece", "level").agg(F.count("*").alias("_n"), F.sum(F.col("degree") + 1).alias("_size"))
    n = numbering.exclusive_offsets(numbering.exclusive_offsets(n, ["piece", "level"], "_n", "before"), ["piece", "level"], "_size", "_at")
    first = n.groupBy("piece").agg(F.min("before").alias("_before"), F.min("_at").alias("_first"))
    # Of the levels that begin in a stretch only the last may be wider than it.  Pieces that begin in a stretch are done together.
    wide = F.col("_size") > chunk
    n = n.join(first, "piece").select("piece", "level", (F.col("before") - F.col("_before")).alias("before"), wide.alias("wide"), F.floor(F.col("_first") / chunk).alias("pack"), (2 * F.floor((F.col("_at") - F.col("_first")) / chunk) + wide.cast("int")).alias("_band"))
    n = stored(n, "bands")
    steps = n.select("piece", "_band").distinct().withColumn("step", F.row_number().over(Window.partitionBy("piece").orderBy("_band")))
    n = stored(n.join(steps, ["piece", "_band"]).drop("_band"), "bands")
    last, wides = n.agg(F.max("step")).first()[0] or 0, {r[0] for r in n.filter("wide").select("step").distinct().collect()}
    c = _split(level.join(n.hint("merge"), ["piece", "level"]), "step", "banded")
    of = lambda k, *more: c.select(F.col("cell").alias(k), F.col("level").alias(f"_l{k}"), F.col("step").alias(f"_s{k}"), *more).hint("merge")
    e = near.join(of("u"), "u").join(of("v", "pack", "wide"), "v").filter("_lu = _lv - 1")
    e = _split(e.select("u", "v", "pack", "wide", (F.col("_su") < F.col("_sv")).alias("_outer"), F.col("_sv").alias("step")), "step", "banded")
    done: list[DataFrame] = []
    before = None
    for k in range(1, last + 1):
        now, ways = c.filter(F.col("step") == k), e.filter(F.col("step") == k)
        if before is None:
            now = now.withColumn("came", F.lit(0).cast("long"))
        else:
            came = ways.filter("_outer").join(before.select(F.col("cell").alias("u"), "num").hint("merge"), "u").groupBy(F.col("v").alias("cell")).agg(F.min("num").alias("came"))
            now = now.join(came.hint("merge"), "cell", "left").withColumn("came", F.coalesce("came", F.lit(0).cast("long")))
        got = now.filter("not wide").drop("step", "wide").groupBy("pack").cogroup(ways.filter("not wide and not _outer").select("u", "v", "pack").groupBy("pack")).applyInPandas(_numbered, "cell long, piece long, level long, num long")
        if k in wides:
            w = local_numbers(now.filter("wide"), ["came", "degree", "cell"], "piece", "_own")
            got = got.unionByName(w.select("cell", "piece", "level", (F.col("before") + F.col("_own")).alias("num")))
        before = stored(got, "numbered")
        done.append(before)
        if len(done) == TOGETHER:
            done = [stored(_union(done), "numbered")]
    return _union([alone, *done]).select("cell", "piece", F.col("level").cast("int").alias("level"), "num")


def renumbered(parts: DataFrame, edges: DataFrame, *, sweeps: int = 2, reverse: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(cell, part, lnum, level) for parts (cell, part) and edges (a, b): local numbers 1, 2, .. in every part, and the cell's level.

    The search starts at the cell of fewest neighbours in each connected piece (ties: the least number); each further
    sweep starts anew at the last cell of the one before, which lies far off.  Pieces of a part follow one another by
    their least cell.  reverse turns the order of every part round.  Edges between parts do not count; a cell without
    edges is a piece of its own; cells are taken to be distinct, and an empty table gives an empty one.  chunk is what a worker takes at once.
    """
    p = stored(parts.select("cell", "part"), "parts")
    e = stored(_inner(p, edges), "inner")
    near = stored(e.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))), "near")
    # In the order of their numbers, so that what lies together is contracted before the rounds.
    pieces = connected_components(e.repartitionByRange("a"), "a", "b").select(F.col("node").alias("cell"), F.col("component").alias("piece"))
    degree = near.groupBy(F.col("u").alias("cell")).agg(F.count("*").alias("degree"))
    cells = p.join(pieces, "cell", "left").join(degree, "cell", "left")
    cells = stored(cells.select("cell", "part", F.coalesce("piece", "cell").alias("piece"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree")), "cells")
    starts = cells.groupBy("piece").agg(F.min_by("cell", F.struct("degree", "cell")).alias("cell"))
    sized = cells.filter("degree > 0").select("cell", "piece", (F.col("degree") + 1).alias("_size"))
    places = stored(numbering.exclusive_offsets(sized, ["piece", "cell"], "_size", "_at").select("cell", F.floor(F.col("_at") / chunk).alias("chunk")), "places")
    end = lambda k, n: places.select(F.col("cell").alias(k), F.col("chunk").alias(n)).hint("merge")
    chunks = _split(near.join(end("u", "chunk"), "u").join(end("v", "to"), "v").select("u", "v", "to", "chunk"), "chunk", "chunks")
    swept = _swept(cells, near, places, chunks, starts, chunk)
    for _ in range(sweeps - 1):
        swept = _swept(cells, near, places, chunks, swept.groupBy("piece").agg(F.max_by("cell", "num").alias("cell")), chunk)
    d = cells.select("cell", "part").join(swept, "cell")
    order = [-F.col("piece"), -F.col("num")] if reverse else [F.col("piece"), F.col("num")]
    d = d.select("cell", "part", "level", order[0].alias("_piece"), order[1].alias("_num"))
    return local_numbers(d, ["_piece", "_num"]).select("cell", "part", "lnum", "level")


def faces_by_cells(faces: DataFrame, numbers: DataFrame) -> DataFrame:
    """(face, part, lnum) for faces (face, left, right; 0 outside) and numbers (cell, part, lnum): the faces of each part by the lower and then the higher local number of their cells there.

    A face between two parts is in both.
    """
    sides = faces.select("face", F.explode(F.array_distinct(F.array("left", "right"))).alias("cell")).filter("cell > 0")
    d = sides.join(numbers.select("cell", "part", "lnum"), "cell").groupBy("face", "part").agg(F.min("lnum").alias("_low"), F.max("lnum").alias("_high"))
    return local_numbers(d, ["_low", "_high", "face"]).select("face", "part", "lnum")


def bandwidths(numbers: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, bandwidth): the largest difference of local numbers across an edge inside each part, 0 without one."""
    side = lambda k: numbers.select(F.col("cell").alias(k), F.col("part").alias(f"p{k}"), F.col("lnum").alias(f"l{k}"))
    d = edges.join(side("a"), "a").join(side("b"), "b").filter("pa = pb").groupBy(F.col("pa").alias("part")).agg(F.max(F.abs(F.col("la") - F.col("lb"))).alias("bandwidth"))
    return numbers.select("part").distinct().join(d, "part", "left").select("part", F.coalesce("bandwidth", F.lit(0)).cast("long").alias("bandwidth"))
