"""Queries of traversals on the tree of regions, nations, customers and orders, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traversal
from .catalog import query, table


def sales_tree(spark: SparkSession, sf_dir: str, orders: bool = True) -> DataFrame:
    """(path, parent, ord, kind, value): R/N/C/O by their keys."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"), F.floor("c_acctbal").alias("b")).join(n, "n")
    at = lambda *ks: F.concat_ws("/", *[F.concat(F.lit(k.upper()), F.col(k).cast("string")) for k in ks])
    row = lambda d, ks, kind, value: d.select(at(*ks).alias("path"), (at(*ks[:-1]) if len(ks) > 1 else F.lit("")).alias("parent"), F.col(ks[-1]).cast("long").alias("ord"), F.lit(kind).alias("kind"), value.cast("long").alias("value"))
    d = row(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r")), "r", "region", F.col("r")).unionByName(row(n, "rn", "nation", F.col("n"))).unionByName(row(c, "rnc", "customer", F.col("b")))
    if orders:
        o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"), F.floor("o_totalprice").alias("p")).join(c, "c")
        d = d.unionByName(row(o, "rnco", "order", F.col("p")))
    return d


_C = "SELECT r_regionkey AS r, n_nationkey AS n, c_custkey AS c, floor(c_acctbal)::BIGINT AS b FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey"
_PATH = "'R' || r || '/N' || n || '/C' || c"


@query(
    f"""SELECT 'R' || r_regionkey AS path, 0 AS level, r_regionkey::BIGINT AS state FROM region
    UNION ALL SELECT 'R' || n_regionkey || '/N' || n_nationkey, 1, 10 * n_regionkey + n_nationkey FROM nation WHERE n_nationkey % 2 = 0
    UNION ALL SELECT {_PATH}, 2, 10 * (10 * r + n) + b FROM ({_C})
    UNION ALL SELECT {_PATH} || '/O' || o_orderkey, 3, 10 * (10 * (10 * r + n) + b) + floor(o_totalprice)::BIGINT FROM ({_C}) JOIN orders ON o_custkey = c WHERE b >= 0"""
)
def walked_tree(spark, sf_dir):
    """Ten times the state above and the own value; odd nations are passed unseen, and nothing is seen below customers in debt."""
    kind, value = F.col("kind"), F.col("value")
    decide = F.when((kind == "nation") & (value % 2 == 1), traversal.SKIP).when((kind == "customer") & (value < 0), traversal.STOP)
    return traversal.walk(sales_tree(spark, sf_dir), F.lit(0).cast("long"), lambda above: (above * 10 + value, decide)).select("path", "level", "state")


@query(
    f"""WITH c AS (SELECT {_PATH} AS path, r, n, greatest(b, coalesce(max(floor(o_totalprice)::BIGINT), b)) AS m FROM ({_C}) LEFT JOIN orders ON o_custkey = c GROUP BY r, n, c, b),
    n AS (SELECT n_regionkey AS r, n_nationkey AS n, greatest(n_nationkey, coalesce(max(m), n_nationkey)) AS m FROM nation LEFT JOIN c ON c.n = n_nationkey GROUP BY n_regionkey, n_nationkey)
    SELECT path, m AS result FROM c UNION ALL SELECT 'R' || r || '/N' || n, m FROM n UNION ALL SELECT 'R' || r_regionkey, greatest(r_regionkey, coalesce(max(m), r_regionkey)) FROM region LEFT JOIN n ON r = r_regionkey GROUP BY r_regionkey
    UNION ALL SELECT {_PATH} || '/O' || o_orderkey, floor(o_totalprice)::BIGINT FROM ({_C}) JOIN orders ON o_custkey = c"""
)
def gathered_tree(spark, sf_dir):
    """The largest value at or below every node, handed up level by level."""
    return traversal.gather(sales_tree(spark, sf_dir), F.col("value"), F.array_max).select("path", "result")


@query(
    f"""WITH t AS (SELECT 'R' || r_regionkey AS path, 0 AS level, r_regionkey AS r, NULL AS n, NULL AS c FROM region UNION ALL SELECT 'R' || n_regionkey || '/N' || n_nationkey, 1, n_regionkey, n_nationkey, NULL FROM nation UNION ALL SELECT {_PATH}, 2, r, n, c FROM ({_C}))
    SELECT path, level, row_number() OVER (ORDER BY r, n NULLS FIRST, c NULLS FIRST) - 1 AS before, row_number() OVER (ORDER BY r, n NULLS LAST, c NULLS LAST) - 1 AS after,
    CASE level WHEN 2 THEN 1 WHEN 1 THEN count(*) OVER (PARTITION BY r, n) ELSE count(*) OVER (PARTITION BY r) END AS size FROM t"""
)
def visit_orders(spark, sf_dir):
    """Places of all nodes among the visits before and after their children."""
    return traversal.visits(sales_tree(spark, sf_dir, orders=False)).select("path", "level", "before", "after", "size")
