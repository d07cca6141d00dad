"""Exchange kernels: lookups, keyed reductions and set predicates between tables that share a global number.

A block is a table with one row per key; a part is a bag of keys, with a place (such as part and local number) that
fixes the order of a request.  All are plain joins and aggregations: Catalyst picks the strategy, and adaptive
execution splits skewed keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REDUCERS = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg}


def block_to_block(block: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """The block in ranges of its key, sorted inside each."""
    dealt = block.repartitionByRange(partitions, key) if partitions else block.repartitionByRange(key)
    return dealt.sortWithinPartitions(key)


def block_to_part(block: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Each request with the block's columns at its key; duplicates stay, a key that is absent gives nulls."""
    return requests.join(block, key, "left")


def block_to_part_strided(block: DataFrame, requests: DataFrame, key: str, array: str, out: str = "value") -> DataFrame:
    """A lookup of variable-length values in flat form: one row a value with its place in the list, from 0."""
    joined = requests.join(block.select(key, array), key)
    return joined.select(*requests.columns, F.posexplode(array).alias("pos", out))


def multi_block_to_part(blocks: Sequence[DataFrame], requests: DataFrame, block_id: str, key: str) -> DataFrame:
    """A lookup over several blocks; a request names its block."""
    joined = None
    for i, b in enumerate(blocks):
        b = b.withColumn(block_id, F.lit(i))
        joined = b if joined is None else joined.unionByName(b)
    return requests.join(joined, [block_id, key], "left")


def part_to_block(part: DataFrame, key: str, values: Sequence[str], reduce: str = "sum") -> DataFrame:
    """One row a key, each value column reduced over all copies of the key."""
    return part.groupBy(key).agg(*[REDUCERS[reduce](v).alias(v) for v in values])


def part_to_block_with(part: DataFrame, key: str, **reducers: Column) -> DataFrame:
    """One row a key with own aggregate expressions."""
    return part.groupBy(key).agg(*[c.alias(n) for n, c in reducers.items()])


def keep_one(part: DataFrame, key: str, values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the copy that comes first in order, so the choice does not depend on the partitioning."""
    first = F.min_by(F.struct(*values), F.struct(*order))
    return part.groupBy(key).agg(first.alias("_v")).select(key, *[F.col("_v")[v].alias(v) for v in values])


def keep_all(part: DataFrame, key: str, value: str) -> DataFrame:
    """One row a key with all its values, ascending, and their number."""
    return part.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(value)).withColumn("stride", F.size(value))


def part_to_part(sent: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """Every received place with what was sent under its key."""
    return received.join(sent, key)


def set_difference(ids: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    """Distinct keys of ids that are in none of the others."""
    out = ids.select(key)
    for o in others:
        out = out.join(o.select(key), key, "left_anti")
    return out.distinct()


def is_in(source: DataFrame, target: DataFrame, key: str, out: str = "found") -> DataFrame:
    """Source rows with a flag: the key is in target."""
    mark = target.select(key).distinct().withColumn(out, F.lit(True))
    return source.join(mark, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def is_unique_tuple(df: DataFrame, columns: Sequence[str], out: str = "is_unique") -> DataFrame:
    """Rows with a flag: no other row has the same values, in any order."""
    d = df.withColumn("_bag", F.array_sort(F.array(*columns)))
    # An aggregation and a join, not a window: both are combined before the shuffle or split where a value is frequent.
    more = d.groupBy("_bag").count().filter("count > 1").select("_bag", F.lit(False).alias(out))
    return d.join(more, "_bag", "left").withColumn(out, F.coalesce(out, F.lit(True))).select(*df.columns, out)


def spread_then_collect(part: DataFrame, key: str, value: str, reduce: str = "sum", out: str = "total") -> DataFrame:
    """Every copy of a key with the reduction over all its copies; rows without key are left out."""
    return part.join(part.groupBy(key).agg(REDUCERS[reduce](value).alias(out)), key).select(*part.columns, out)


def discover(parts: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Distinct values found on any part."""
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out.distinct()


def exists_everywhere(df: DataFrame, group: str, value: str) -> DataFrame:
    """Values present in every group."""
    groups = df.select(group).distinct().agg(F.count("*").alias("_n"))
    return df.groupBy(value).agg(F.count_distinct(group).alias("_m")).join(F.broadcast(groups), F.col("_m") == F.col("_n")).select(value)
