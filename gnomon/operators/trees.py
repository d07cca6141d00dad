"""Trees as node tables: (path, parent, name, label, depth, ord, dtype, size, value).  Search is a filter on paths, comparison a full outer join."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "path string, parent string, name string, label string, depth int, ord int, dtype string, size bigint, value string"


def wildcard(column: Column, pattern: str) -> Column:
    """A shell pattern match."""
    return column.rlike(r"\A" + fnmatch.translate(pattern).replace("\\Z", "").replace("\\z", "") + r"\z")


def path_head(path: Column, n: int = 1) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), F.lit(1), F.lit(n)), "/")


def path_tail(path: Column, n: int = 1) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), "/")


def path_parent(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def select_nodes(nodes: DataFrame, *, name: str | None = None, label: str | None = None, depth: int | None = None, where: Column | None = None) -> DataFrame:
    """Nodes that match all given predicates; names and labels may have wildcards."""
    d = nodes
    if name is not None:
        d = d.filter(wildcard(F.col("name"), name))
    if label is not None:
        d = d.filter(wildcard(F.col("label"), label))
    if depth is not None:
        d = d.filter(F.col("depth") == depth)
    return d if where is None else d.filter(where)


def chain(nodes: DataFrame, predicates: Sequence[dict]) -> DataFrame:
    """Nodes reached from the top by one child step for each predicate (keywords of select_nodes)."""
    level = select_nodes(nodes.filter("depth = 1"), **predicates[0])
    for p in predicates[1:]:
        level = select_nodes(nodes, **p).join(level.select(F.col("path").alias("parent")), "parent", "left_semi")
    return level


def children(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("parent") == path).orderBy("ord")


def descendants(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("path").startswith(path + "/"))


def first_match(nodes: DataFrame, **predicate) -> DataFrame:
    """The first match in depth-first order of insertion."""
    return select_nodes(nodes, **predicate).orderBy("ord").limit(1)


def keep(nodes: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Nodes whose path matches an include pattern or no exclude pattern; only one of the two may be given."""
    if include and exclude:
        raise ValueError("include and exclude cannot be combined")
    match = F.lit(False)
    for p in include or exclude:
        match = match | wildcard(F.col("path"), p)
    return nodes.filter(match) if include else nodes.filter(~match)


def remove(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The tree without the given nodes (column path) and all below them."""
    gone = paths.select(F.col("path").alias("_gone"))
    above = nodes.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("_gone"))
    return nodes.join(above.join(gone, "_gone", "left_semi").select("path").distinct(), "path", "left_anti")


def rename(nodes: DataFrame, old: str, new: str) -> DataFrame:
    """The tree with the subtree at path old moved to path new."""
    moved = (F.col("path") == old) | F.col("path").startswith(old + "/")
    path = F.when(moved, F.concat(F.lit(new), F.substring(F.col("path"), F.lit(len(old) + 1), F.length("path")))).otherwise(F.col("path"))
    return nodes.withColumn("path", path).withColumns({"parent": path_parent(F.col("path")), "name": path_tail(F.col("path")), "depth": F.size(F.split("path", "/"))})


def merge(trees: Sequence[DataFrame]) -> DataFrame:
    """The union of trees; where a path occurs more than once, the first tree's node stays."""
    tagged = None
    for i, t in enumerate(trees):
        t = t.withColumn("_i", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t)
    w = Window.partitionBy("path").orderBy("_i", "ord")
    return tagged.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_i", "_r")


def table_of_sizes(nodes: DataFrame) -> DataFrame:
    """(path, size): nodes and summed sizes of what is below each node, itself included."""
    up = nodes.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("path"), "size")
    return up.groupBy("path").agg(F.count("*").alias("n_nodes"), F.sum(F.coalesce("size", F.lit(0))).alias("total_size"))


def diff(a: DataFrame, b: DataFrame, key: Sequence[str], values: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Rows that differ: key, status (missing_left, missing_right, changed).  Numbers may differ by the tolerance; nulls are equal."""
    x = a.select(*key, F.lit(True).alias("_a"), *[F.col(v).alias(f"_a_{v}") for v in values])
    y = b.select(*key, F.lit(True).alias("_b"), *[F.col(v).alias(f"_b_{v}") for v in values])
    types = dict(a.dtypes)

    def other(v: str) -> Column:
        p, q = F.col(f"_a_{v}"), F.col(f"_b_{v}")
        if tolerance and types[v] in ("double", "float"):
            return ~F.coalesce(F.abs(p - q) <= tolerance, p.eqNullSafe(q))
        return ~p.eqNullSafe(q)

    changed = F.lit(False)
    for v in values:
        changed = changed | other(v)
    j = x.join(y, list(key), "full_outer")
    status = F.when(F.col("_a").isNull(), "missing_left").when(F.col("_b").isNull(), "missing_right").when(changed, "changed")
    return j.withColumn("status", status).filter("status is not null").select(*key, "status")


#: Numbers in the text form of values.
NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def text_values_differ(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """Whether two values in text form differ: text by its letters, numbers and arrays of any shape number by number, by more than the tolerance.

    Whole numbers of up to 38 digits are compared exactly, others as doubles (1 and 1.0 are equal).  Nulls are equal.
    """
    shape = lambda v: F.regexp_replace(v, NUMBER, "#")
    numbers = lambda v: F.regexp_extract_all(v, F.lit(NUMBER), F.lit(0))
    whole = lambda v: v.try_cast("decimal(38,0)")
    plain = lambda v: v.rlike("^[-+]?[0-9]{1,38}$")

    def off(p: Column, q: Column) -> Column:
        x, y = p.try_cast("double"), q.try_cast("double")
        exact = (whole(p) != whole(q)) & (F.abs(whole(p) - whole(q)).cast("double") > F.lit(float(tolerance)))
        return (p != q) & F.when(plain(p) & plain(q), F.coalesce(exact, F.lit(True))).otherwise((x != y) & (F.abs(x - y) > F.lit(float(tolerance))))

    text = a.contains('"') | b.contains('"')
    arrays = (shape(a) != shape(b)) | F.exists(F.zip_with(numbers(a), numbers(b), off), lambda x: x)
    return ~a.eqNullSafe(b) & F.coalesce(F.when(text, F.lit(True)).otherwise(arrays), F.lit(True))


def diff_text(a: DataFrame, b: DataFrame, key: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """(key, status) of nodes (key, label, value) in text form that differ, as `diff` has it."""
    side = lambda d, s: d.select(*key, F.lit(True).alias(f"_{s}"), F.col("label").alias(f"_{s}l"), F.col("value").alias(f"_{s}v"))
    changed = ~F.col("_al").eqNullSafe(F.col("_bl")) | text_values_differ(F.col("_av"), F.col("_bv"), tolerance)
    status = F.when(F.col("_a").isNull(), "missing_left").when(F.col("_b").isNull(), "missing_right").when(changed, "changed")
    return side(a, "a").join(side(b, "b"), list(key), "full_outer").withColumn("status", status).filter("status is not null").select(*key, "status")


def relative_norm(df: DataFrame, value: str, reference: str) -> DataFrame:
    """(relative_norm): the norm of value - reference over that of reference, absolute where the latter is 0."""
    d, r = F.col(value) - F.col(reference), F.col(reference)
    sums = df.agg(F.sum(d * d).alias("d"), F.sum(r * r).alias("r"))
    return sums.select(F.when(F.col("r") > 0, F.sqrt(F.col("d") / F.col("r"))).otherwise(F.sqrt("d")).alias("relative_norm"))


def balance_stats(df: DataFrame, group: str, weight: str) -> DataFrame:
    """Mean, least, most and imbalance of the groups' total weights."""
    per = df.groupBy(group).agg(F.sum(weight).alias("w"))
    out = per.agg(F.avg("w").alias("mean"), F.min("w").alias("least"), F.max("w").alias("most"), F.count("*").alias("n"))
    return out.withColumn("imbalance", F.col("most") / F.col("mean") - 1)


def prefixes(path: Column) -> Column:
    """The path's ancestors and itself, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def outermost(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Of the found nodes, those without a found ancestor: what a search gives that does not look below a match."""
    above = found.select("path", F.explode(F.filter(prefixes(F.col("path")), lambda p: p != F.col("path"))).alias("_above"))
    inner = above.join(found.select(F.col("path").alias("_above")), "_above", "left_semi").select("path").distinct()
    return found.join(inner, "path", "left_anti")


def chain_with_ancestors(nodes: DataFrame, predicates: Sequence[dict]) -> DataFrame:
    """(p0, p1, ..): the paths of every chain of matches, one child step for each predicate."""
    out = select_nodes(nodes.filter("depth = 1"), **predicates[0]).select(F.col("path").alias("p0"))
    for i, p in enumerate(predicates[1:], 1):
        out = out.join(select_nodes(nodes, **p).select(F.col("path").alias(f"p{i}"), F.col("parent").alias(f"p{i - 1}")), f"p{i - 1}")
    return out.select(*[f"p{i}" for i in range(len(predicates))])


def parse_predicates(text: str, is_label=lambda x: x.endswith("_t")) -> list[dict]:
    """Keywords of select_nodes for each step of a/b/c: a label if it ends in _t, else a name."""
    return [{"label" if is_label(x) else "name": x} for x in text.split("/")]


def concretise(nodes: DataFrame, wanted: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """(path): the existing paths that match a wildcard path element by element, the nodes on the way having the given labels."""
    out = None
    for path in wanted:
        steps = [{"name": n, "label": lab} for n, lab in zip(path.split("/"), labels)]
        found = chain(nodes, steps).select("path")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def from_paths(paths: DataFrame, label: str = "UserDefined_t") -> DataFrame:
    """The tree of all paths and their ancestors, as a node table without values."""
    d = paths.select(F.explode(prefixes(F.col("path"))).alias("path")).distinct()
    none = lambda t: F.lit(None).cast(t)
    return d.select("path", path_parent(F.col("path")).alias("parent"), path_tail(F.col("path")).alias("name"), F.lit(label).alias("label"), F.size(F.split("path", "/")).alias("depth"), none("int").alias("ord"), none("string").alias("dtype"), none("bigint").alias("size"), none("string").alias("value"))


def upsert(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The tree with rows (path, and any of label, dtype, size, value) put in: a new path is added, of one that exists only the given columns change."""
    given = [c for c in ("label", "dtype", "size", "value") if c in rows.columns]
    new = rows.select("path", F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in given])
    d = nodes.join(new, "path", "full_outer")
    pick = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) if c in given else F.col(c)
    known = F.col("name").isNotNull()
    label = F.when(F.col("_new"), F.col("_label")).otherwise(F.col("label")) if "label" in given else F.coalesce("label", F.lit("UserDefined_t"))
    return d.select(
        "path", F.when(known, F.col("parent")).otherwise(path_parent(F.col("path"))).alias("parent"), F.when(known, F.col("name")).otherwise(path_tail(F.col("path"))).alias("name"),
        label.alias("label"), F.when(known, F.col("depth")).otherwise(F.size(F.split("path", "/"))).alias("depth"), "ord", *[pick(c).alias(c) for c in ("dtype", "size", "value")],
    )


def rename_zones(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """The tree with zones renamed by (old, new) paths: all below them moves, and joins that name them as donor (by path) follow."""
    zone = F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")
    d = nodes.withColumn("_zone", zone).join(names.select(F.col("old").alias("_zone"), F.col("new").alias("_new")), "_zone", "left")
    path = F.when(F.col("_new").isNotNull(), F.concat("_new", F.substring("path", F.length("_zone") + 1, F.length("path")))).otherwise(F.col("path"))
    is_join = F.col("label").isin("GridConnectivity_t", "GridConnectivity1to1_t")
    d = d.withColumn("path", path).withColumn("_donor", F.when(is_join, F.regexp_replace("value", '"', "")))
    d = d.join(names.select(F.col("old").alias("_donor"), F.col("new").alias("_to")), "_donor", "left")
    d = d.withColumn("value", F.when(F.col("_to").isNotNull(), F.concat(F.lit('"'), "_to", F.lit('"'))).otherwise(F.col("value")))
    return d.withColumns({"parent": path_parent(F.col("path")), "name": path_tail(F.col("path"))}).select(*nodes.columns)


def aligned(trees: Sequence[DataFrame]) -> DataFrame:
    """(path, in_0, in_1, ..): all paths of some trees and which tree has them."""
    out = None
    for i, t in enumerate(trees):
        p = t.select("path", F.lit(True).alias(f"in_{i}"))
        out = p if out is None else out.join(p, "path", "full_outer")
    return out.select("path", *[F.coalesce(f"in_{i}", F.lit(False)).alias(f"in_{i}") for i in range(len(trees))])


def byte_sizes(nodes: DataFrame) -> DataFrame:
    """(metadata, data): bytes of names, labels and links of all nodes, and of their values by type."""
    width = F.when(F.col("dtype").endswith("8"), 8).when(F.col("dtype").endswith("4"), 4).otherwise(1)
    return nodes.agg(F.sum(F.length("name") + F.length("label") + 8).alias("metadata"), F.sum(F.coalesce(F.col("size") * width, F.lit(0))).alias("data"))
