"""Numbering: dense ids, even splits, offsets, runs, ranges and jagged arrays.

Global running values are computed in two levels, so no task sees all rows: rows are range-partitioned by the order,
each partition is numbered on its own, and the partitions' totals (one row each) give its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def _ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with _pid, which ascends with the order.  A written column, as the partitioning must not change after it."""

    return stored(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "ranged")


def _offsets(totals: DataFrame, value: str) -> DataFrame:
    """(_pid, _before): sums of earlier partitions; one row a partition."""
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_pid", F.coalesce(F.sum(value).over(w), F.lit(0)).alias("_before"))


def row_numbers(df: DataFrame, order: Sequence[str], out: str = "rn") -> DataFrame:
    """df with its place 1..n in the given order.

    Ranges are written in order with the place that a row has in its task, so they are not dealt out and sorted a second time.
    """
    d = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    d = d.withColumns({"_pid": F.shiftright("_at", 33), "_own": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = _offsets(d.groupBy("_pid").agg(F.count("*").alias("n")), "n")
    return d.join(F.broadcast(before), "_pid").withColumn(out, (F.col("_own") + F.col("_before") + 1).cast("long")).drop("_at", "_pid", "_own", "_before")


def exclusive_offsets(df: DataFrame, order: Sequence[str], size: str, out: str = "offset") -> DataFrame:
    """df with the sum of size over all rows before, in the given order."""
    d = _ranged(df, order)
    before = _offsets(d.groupBy("_pid").agg(F.sum(size).alias("n")), "n")
    own = F.coalesce(F.sum(size).over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_own", own).join(F.broadcast(before), "_pid").withColumn(out, (F.col("_own") + F.col("_before")).cast("long")).drop("_pid", "_own", "_before")


def dense_ids(df: DataFrame, key: str, out: str = "gnum") -> DataFrame:
    """df with ids 1..K of its distinct keys, in their order; equal keys share one."""
    ids = row_numbers(df.select(key).distinct(), [key], out)
    return df.join(ids, key)


def hashed_gnum(df: DataFrame, key: Column, out: str = "gnum") -> DataFrame:
    """df with dense ids of arbitrary objects: equal objects share an id, the order is that of a digest."""
    d = df.withColumn("_digest", F.md5(key))
    return dense_ids(d, "_digest", out).drop("_digest")


def uniform_bounds(n: int, parts: int) -> list[int]:
    """Bounds 0..n of an even split; the first n mod parts intervals have one more."""
    q, r = divmod(n, parts)
    return [i * q + min(i, r) for i in range(parts + 1)]


def uniform_split(df: DataFrame, order: Sequence[str], parts: int, out: str = "part") -> DataFrame:
    """df dealt in order to parts 1..parts, evenly, the first ones taking the remainder."""
    d = row_numbers(df, order, "_rn")
    n = d.count()
    q, r = divmod(n, parts)
    i = F.col("_rn") - 1
    big = r * (q + 1)
    part = F.when(i < big, F.floor(i / (q + 1))).otherwise(r + F.floor((i - big) / max(q, 1)))
    return d.withColumn(out, (part + 1).cast("int")).drop("_rn")


def run_lengths(df: DataFrame, order: Sequence[str], value: str) -> DataFrame:
    """(run, value, n, first): runs of equal values in the given order, run counted from 0.

    Rows are compared inside each range of the order; only the ends of ranges, one row each, look beyond.
    """
    columns = list(dict.fromkeys([*order, value]))
    d = _ranged(df.select(*columns), order)
    w, between = Window.partitionBy("_pid").orderBy(*order), Window.orderBy("_pid")
    ranges = d.groupBy("_pid").agg(F.count("*").alias("_n"), F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_end"))
    edges = ranges.select("_pid", F.coalesce(F.sum("_n").over(between.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lag("_end").over(between).alias("_last"), F.sum("_n").over(between.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    own = F.row_number().over(w)
    e = d.select("_pid", F.col(value), own.alias("_own"), F.lag(F.struct(F.col(value).alias("v"))).over(w).alias("_prev")).join(F.broadcast(edges), "_pid")
    prev = F.coalesce("_prev", "_last")
    starts = e.filter(prev.isNull() | ~prev["v"].eqNullSafe(F.col(value))).select("_pid", value, (F.col("_own") + F.col("_before")).alias("_rn"), "_total")
    counts = starts.groupBy("_pid").agg(F.count("*").alias("_c"), F.min("_rn").alias("_first"))
    counts = counts.select("_pid", F.coalesce(F.sum("_c").over(between.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_runs"), F.lead("_first").over(between).alias("_next"))
    r = Window.partitionBy("_pid").orderBy("_rn")
    d = starts.withColumns({"_i": F.row_number().over(r) - 1, "_to": F.lead("_rn").over(r)}).join(F.broadcast(counts), "_pid")
    end = F.coalesce("_to", "_next", F.col("_total") + 1)
    return d.select((F.col("_i") + F.col("_runs")).cast("long").alias("run"), value, (end - F.col("_rn")).cast("long").alias("n"), (F.col("_rn") - 1).cast("long").alias("first"))


def multi_arange(df: DataFrame, start: str, stop: str, out: str = "value") -> DataFrame:
    """One row for each value of [start, stop); empty ranges give none."""
    return df.filter(F.col(stop) > F.col(start)).withColumn(out, F.explode(F.sequence(F.col(start), F.col(stop) - 1)))


def arange_with_jumps(df: DataFrame, start: str, stop: str, dropped: str, out: str = "value") -> DataFrame:
    """multi_arange without the ranges flagged in dropped."""
    return multi_arange(df.filter(~F.col(dropped)), start, stop, out)


def shifted_to_local(df: DataFrame, gid: str, offsets: Sequence[int]) -> DataFrame:
    """df with the 1-based interval that holds a global id in offsets[i] + 1 .. offsets[i + 1], and the id in it.

    The offsets are a short list of the caller's, so the search is an expression.
    """
    bounds = F.array(*[F.lit(o) for o in offsets])
    interval = F.size(F.filter(bounds, lambda o: o < F.col(gid)))
    return df.withColumn("interval", interval).withColumn("local", F.col(gid) - F.get(bounds, F.col("interval") - 1))


def reverse_connectivity(df: DataFrame, parent: str, child: str) -> DataFrame:
    """(child, parents): the transposed adjacency of (parent, child) rows, parents ascending."""
    return df.groupBy(child).agg(F.sort_array(F.collect_list(parent)).alias("parents"))


def jagged_extract(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of a jagged table (key, array) with the wanted keys, duplicates kept."""
    return ids.join(df, key)


def jagged_merge(a: DataFrame, b: DataFrame, key: str, array: str) -> DataFrame:
    """Row-wise concatenation of two jagged tables; a row that one lacks is empty there."""
    right = b.select(key, F.col(array).alias("_b"))
    j = a.join(right, key, "full_outer")
    empty = F.slice(F.coalesce(array, "_b"), F.lit(1), F.lit(0))
    return j.select(key, F.concat(F.coalesce(array, empty), F.coalesce("_b", empty)).alias(array))


def interlaced(array: Column) -> Column:
    """An array with its length in front."""
    return F.concat(F.array(F.size(array)), array)


def roll_from(array: Column, start: Column, reverse: bool = False) -> Column:
    """The array rotated to begin at a 0-based place; reversed, it runs backwards from there."""
    n = F.size(array)
    if reverse:
        flipped = F.reverse(array)
        return roll_from(flipped, n - 1 - start)
    return F.concat(F.slice(array, start + 1, n), F.slice(array, F.lit(1), start))


def roll_from_value(array: Column, value: Column, reverse: bool = False) -> Column:
    return roll_from(array, (F.array_position(array, value) - 1).cast("int"), reverse)


def shift_nonzeros(x: Column, shift: Column) -> Column:
    return F.when(x != 0, x + shift).otherwise(x)


def shift_absvalue(x: Column, shift: Column) -> Column:
    """|x| + shift with the sign of x; 0 counts as positive."""
    return F.when(x < 0, x - shift).otherwise(x + shift)


def any_in_range(x: Column, low: Column, high: Column, strict: bool = False) -> Column:
    return F.coalesce(F.bool_or((x > low) & (x < high) if strict else (x >= low) & (x <= high)), F.lit(False))


def all_in_range(x: Column, low: Column, high: Column, strict: bool = False) -> Column:
    return F.coalesce(F.bool_and((x > low) & (x < high) if strict else (x >= low) & (x <= high)), F.lit(True))


def overlap_size(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def others(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in ids."""
    return df.join(ids.select(key), key, "left_anti")


def is_circular_sublist(sub: Column, array: Column) -> Column:
    """sub appears contiguously in array, which is taken as a ring."""
    n, m = F.size(array), F.size(sub)
    doubled = F.concat(array, array)
    return F.when(m == 0, True).when(m > n, False).otherwise(F.exists(F.sequence(F.lit(1), n), lambda i: F.slice(doubled, i, m) == sub))
