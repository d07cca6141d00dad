"""Traversals of node tables (path, parent, ..): states handed down, results handed up, orders of visits.

All nodes of a level are visited at once, so a traversal has as many rounds as the tree has levels, whatever its width.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: What a visit may decide: go on below the node, show it but not what is below, or go on without showing it.
GO_ON, STOP, SKIP = "go on", "stop", "skip"
MOST_LEVELS = 100


def _levels(frontier: DataFrame, grow: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    out = []
    while not (frontier := stored(frontier, "level")).isEmpty():
        out.append(frontier)
        if len(out) > MOST_LEVELS:
            raise ValueError(f"more than {MOST_LEVELS} levels: is a node its own ancestor?")
        frontier = grow(frontier)
    return out or [frontier]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def walk(nodes: DataFrame, start: Column, visit: Callable[[Column], tuple[Column, Column]], *, roots: Column | None = None) -> DataFrame:
    """nodes that a walk from the roots (by default those with an empty or null parent) shows, with level, from 0, and state.

    visit gets the state of the parent (for roots start) as a column beside the node's own columns, and returns the node's
    state and a decision, GO_ON, STOP or SKIP (null: GO_ON).  The state has the type of start.  Nodes whose parent is
    not reached are not visited; below a node with STOP nothing is; nodes with SKIP hand their state on unseen.
    """
    top = roots if roots is not None else F.coalesce("parent", F.lit("")) == ""
    columns = nodes.columns

    def seen(d: DataFrame, level: Column) -> DataFrame:
        state, decision = visit(F.col("_above"))
        kind = dict(d.dtypes)["_above"]
        return d.withColumns({"state": state.cast(kind), "_decision": F.coalesce(decision, F.lit(GO_ON)), "level": level.cast("int")}).select(*columns, "level", "state", "_decision")

    def grow(frontier: DataFrame) -> DataFrame:
        above = frontier.filter(F.col("_decision") != STOP).select(F.col("path").alias("parent"), F.col("state").alias("_above"), F.col("level").alias("_level"))
        return seen(nodes.join(above, "parent"), F.col("_level") + 1)

    shown = _union(_levels(seen(nodes.filter(top).withColumn("_above", start), F.lit(0)), grow))
    return shown.filter(F.col("_decision") != SKIP).drop("_decision")


def gather(nodes: DataFrame, own: Column, merge: Callable[[Column], Column]) -> DataFrame:
    """nodes with result: own for a leaf, else merge of the array of own and the results of the children, from the deepest level up.

    merge is to be indifferent to the order of the array's elements after the first, which is own.
    """
    columns = nodes.columns
    deep = stored(nodes.withColumns({"_level": F.size(F.split("path", "/")), "_own": own}), "deep")
    levels = sorted((r[0] for r in deep.select("_level").distinct().collect()), reverse=True)  # a row a level
    below: DataFrame | None = None
    out = []
    for n in levels:
        d = deep.filter(F.col("_level") == n)
        if below is None:
            d = d.withColumn("_all", F.array("_own"))
        else:
            d = d.join(below.groupBy("parent").agg(F.collect_list("result").alias("_below")).withColumnRenamed("parent", "path"), "path", "left")
            d = d.withColumn("_all", F.concat(F.array("_own"), F.coalesce("_below", F.array().cast(f"array<{dict(d.dtypes)['_own']}>"))))
        below = stored(d.withColumn("result", F.when(F.size("_all") == 1, F.col("_own")).otherwise(merge(F.col("_all")))).select(*columns, "result"), "results")
        out.append(below)
    return _union(out) if out else deep.select(*columns, F.col("_own").alias("result"))


def visits(nodes: DataFrame, order: str = "ord") -> DataFrame:
    """nodes with level, size (nodes below and the node), before and after: their places, from 0, among the visits before and after their children.

    Brothers follow one another by `order`.  A node comes before its brothers' subtrees and after its own: the place before is
    the parent's, one, and the sizes of earlier brothers; that after is the place before, what is below, less the level.
    """
    ancestors = lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, "/"))), lambda n: F.array_join(F.slice(F.split(p, "/"), 1, n), "/"))
    sizes = nodes.select(F.explode(ancestors(F.col("path"))).alias("path")).groupBy("path").agg(F.count("*").alias("size"))
    d = stored(nodes.withColumn("_up", F.coalesce("parent", F.lit(""))).join(sizes, "path"), "sizes")
    # Sums over the brothers before: a group is the children of one node.
    w = Window.partitionBy("_up").orderBy(order, "path").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_earlier", F.coalesce(F.sum("size").over(w), F.lit(0)))

    def grow(frontier: DataFrame) -> DataFrame:
        above = frontier.select(F.col("path").alias("_up"), F.col("before").alias("_before"), F.col("level").alias("_level"))
        return d.join(above, "_up").withColumns({"before": F.col("_before") + 1 + F.col("_earlier"), "level": F.col("_level") + 1}).drop("_before", "_level")

    first = d.filter("_up = ''").withColumns({"before": F.col("_earlier"), "level": F.lit(0)})
    out = _union(_levels(first, grow))
    return out.withColumn("after", F.col("before") + F.col("size") - 1 - F.col("level")).drop("_up", "_earlier")
