"""Queries of the operators on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, index
from ..operators import exchange, graph, numbering, spatial, trees

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities summed by part, then looked up for every line item."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    totals = exchange.part_to_block(items, "l_partkey", ["l_quantity"]).withColumnRenamed("l_quantity", "part_quantity")
    return exchange.block_to_part(totals, items.select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey")


query("SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER (PARTITION BY l_partkey) AS part_quantity FROM lineitem")(flagship)


def _reduce(how: str, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = exchange.part_to_block(table(spark, sf_dir, "lineitem"), "l_partkey", ["l_quantity"], how)
        return out.withColumn("l_quantity", F.round("l_quantity", 6))

    query(f"SELECT l_partkey, round({sql}(l_quantity), 6) AS l_quantity FROM lineitem GROUP BY l_partkey", f"part_to_block_{how}")(run)


for _how, _sql in (("sum", "sum"), ("min", "min"), ("max", "max"), ("mean", "avg")):
    _reduce(_how, _sql)


@query(
    """SELECT l_orderkey, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1"""
)
def part_to_block_keep_one(spark, sf_dir):
    return exchange.keep_one(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_partkey", "l_quantity"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])


@query("SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS parts, count(*) AS stride FROM lineitem GROUP BY l_orderkey")
def part_to_block_strided(spark, sf_dir):
    d = exchange.keep_all(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    return d.select("l_orderkey", F.array_join(F.col("l_partkey").cast("array<string>"), ",").alias("parts"), F.col("stride").cast("long").alias("stride"))


@query("SELECT o_orderkey, o_custkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def block_to_part(spark, sf_dir):
    block = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal")
    return exchange.block_to_part(block, table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@query(
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_partkey) - 1 AS pos, l_partkey AS value
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""
)
def block_to_part_strided(spark, sf_dir):
    block = exchange.keep_all(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey").withColumnRenamed("l_orderkey", "o_orderkey")
    return exchange.block_to_part_strided(block, table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "l_partkey").withColumn("pos", F.col("pos").cast("long"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def part_to_part(spark, sf_dir):
    sent = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return exchange.part_to_part(sent, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey")


@query(
    """SELECT b.block_id, b.key, n.name FROM (SELECT 0 AS block_id, r_regionkey AS key FROM region UNION ALL SELECT 1, n_nationkey FROM nation) b
    JOIN (SELECT 0 AS block_id, r_regionkey AS key, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation) n USING (block_id, key)"""
)
def multi_block_to_part(spark, sf_dir):
    blocks = [table(spark, sf_dir, t).select(F.col(f"{t[0]}_{t}key").alias("key"), F.col(f"{t[0]}_name").alias("name")) for t in ("region", "nation")]
    requests = blocks[0].select(F.lit(0).alias("block_id"), "key").unionByName(blocks[1].select(F.lit(1).alias("block_id"), "key"))
    return exchange.multi_block_to_part(blocks, requests, "block_id", "key")


@query("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_difference(spark, sf_dir):
    return exchange.set_difference(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), [table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))], "k")


@query("SELECT o_orderkey AS k, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS found FROM orders")
def gnum_isin(spark, sf_dir):
    return exchange.is_in(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("SELECT l_partkey, l_suppkey, count(*) OVER (PARTITION BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey)) = 1 AS is_unique FROM lineitem")
def is_unique_tuple(spark, sf_dir):
    return exchange.is_unique_tuple(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"])


@query("SELECT l_orderkey, l_quantity, round(sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS total FROM lineitem")
def spread_then_collect(spark, sf_dir):
    return exchange.spread_then_collect(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", "l_quantity").withColumn("total", F.round("total", 6))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def discover_distinct(spark, sf_dir):
    return exchange.discover([table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))], ["k"])


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def exists_everywhere(spark, sf_dir):
    return exchange.exists_everywhere(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_orderkey")


@query("SELECT o_orderkey, o_custkey, dense_rank() OVER (ORDER BY o_custkey) AS gnum FROM orders")
def dense_gnum(spark, sf_dir):
    return numbering.dense_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY md5(o_orderpriority || ':' || o_custkey)) AS gnum FROM orders")
def compute_gnum(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return numbering.hashed_gnum(d, F.concat("o_orderpriority", F.lit(":"), F.col("o_custkey").cast("string"))).select("o_orderkey", "gnum")


@query("SELECT c_custkey, ntile(7) OVER (ORDER BY c_custkey) AS part FROM customer")
def uniform_distribution(spark, sf_dir):
    return numbering.uniform_split(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 7).withColumn("part", F.col("part").cast("long"))


@query(
    """SELECT l_orderkey, n, coalesce(sum(n) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
    FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)"""
)
def exclusive_offsets(spark, sf_dir):
    return numbering.exclusive_offsets(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")), ["l_orderkey"], "n")


@query(
    """WITH a AS (SELECT event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, lag(event_type) OVER (ORDER BY ts, event_id) AS p FROM events),
    b AS (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER (ORDER BY i) - 1 AS run FROM a)
    SELECT run::BIGINT AS run, event_type, count(*) AS n, min(i) AS first FROM b GROUP BY run, event_type"""
)
def run_length(spark, sf_dir):
    return numbering.run_lengths(table(spark, sf_dir, "events").select("ts", "event_id", "event_type"), ["ts", "event_id"], "event_type")


@query("SELECT l_suppkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS parents FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY 1")
def reverse_connectivity(spark, sf_dir):
    d = numbering.reverse_connectivity(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct(), "l_partkey", "l_suppkey")
    return d.withColumn("parents", F.array_join(F.col("parents").cast("array<string>"), ","))


@query("SELECT p_partkey, unnest(range(p_size, p_size + p_partkey % 4)) AS value FROM part")
def multi_arange(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("a"), (F.col("p_size") + F.col("p_partkey") % 4).cast("long").alias("b"))
    return numbering.multi_arange(d, "a", "b").select("p_partkey", "value")


@query(
    """SELECT p_partkey + 1 AS gid, interval_no AS "interval", p_partkey + 1 - lo AS local FROM part
    JOIN (VALUES (1, 0, 10), (2, 10, 75), (3, 75, 75), (4, 75, 100000000)) v(interval_no, lo, hi) ON p_partkey + 1 > lo AND p_partkey + 1 <= hi"""
)
def shifted_to_local(spark, sf_dir):
    d = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("gid"))
    d = numbering.shifted_to_local(d, "gid", [0, 10, 75, 75, 100_000_000])
    return d.withColumn("interval", F.col("interval").cast("long"))


@query(
    """SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM (SELECT s_suppkey, s_suppkey * 3 AS lo, s_suppkey * 3 + s_suppkey % 9 AS hi FROM supplier) a
    JOIN (SELECT s_suppkey, s_suppkey * 2 AS lo, s_suppkey * 2 + 5 AS hi FROM supplier) b ON a.lo <= b.hi AND b.lo <= a.hi"""
)
def interval_overlap(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a = s.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") * 3).alias("al"), (F.col("s_suppkey") * 3 + F.col("s_suppkey") % 9).alias("ah"))
    b = s.select(F.col("s_suppkey").alias("b"), (F.col("s_suppkey") * 2).alias("bl"), (F.col("s_suppkey") * 2 + 5).alias("bh"))
    return spatial.interval_overlap(a, b, ("al", "ah"), ("bl", "bh"), 8.0).select("a", "b")


@query(
    """SELECT e.event_id, coalesce(b.id, -1) AS box FROM events e LEFT JOIN (SELECT i AS id, i * 10.0 AS lo, i * 10.0 + 7 AS hi FROM range(0, 60) t(i)) b
    ON e.value >= b.lo AND e.value < b.hi"""
)
def localize(spark, sf_dir):
    boxes = spark.range(60).select(F.col("id").alias("box"), (F.col("id") * 10.0).alias("lo"), (F.col("id") * 10.0 + 7).alias("hi"))
    return spatial.localize(table(spark, sf_dir, "events").select("event_id", "value"), boxes, "value", ("lo", "hi"), "box", 10.0).select("event_id", "box")


_POINTS = "SELECT p_partkey AS id, (p_partkey * 7919 % 1009)::DOUBLE AS x, (p_partkey * 104729 % 1013)::DOUBLE AS y FROM part"
_TARGETS = "SELECT s_suppkey AS t, (s_suppkey * 613 % 997)::DOUBLE AS x, (s_suppkey * 389 % 991)::DOUBLE AS y FROM supplier"


def _points(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    a = table(spark, sf_dir, "part").select(k.alias("id"), (k * 7919 % 1009).cast("double").alias("x"), (k * 104729 % 1013).cast("double").alias("y"))
    b = table(spark, sf_dir, "supplier").select(s.alias("t"), (s * 613 % 997).cast("double").alias("x"), (s * 389 % 991).cast("double").alias("y"))
    return a, b


def _nearest(k: int) -> str:
    return f"""SELECT t, id, (p.x - q.x) ** 2 + (p.y - q.y) ** 2 AS distance2, row_number() OVER w AS rank FROM ({_TARGETS}) q, ({_POINTS}) p
    WINDOW w AS (PARTITION BY t ORDER BY (p.x - q.x) ** 2 + (p.y - q.y) ** 2, id) QUALIFY row_number() OVER w <= {k}"""


@query(_nearest(1).replace(", row_number() OVER w AS rank", "", 1))
def closest_point(spark, sf_dir):
    a, b = _points(spark, sf_dir)
    return spatial.closest_point(a, b, ["x", "y"], "id", "t")


@query(_nearest(4))
def k_closest(spark, sf_dir):
    a, b = _points(spark, sf_dir)
    return spatial.k_closest(a, b, ["x", "y"], "id", "t", 4).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT t, round(sum(id / greatest(sqrt(distance2), 1e-20)) / sum(1 / greatest(sqrt(distance2), 1e-20)), 6) AS id FROM ({_nearest(4)}) GROUP BY t")
def idw_mean(spark, sf_dir):
    a, b = _points(spark, sf_dir)
    near = spatial.k_closest(a, b, ["x", "y"], "id", "t", 4).withColumn("d", F.sqrt("distance2"))
    return spatial.inverse_distance_mean(near, "t", "id", "d").withColumn("id", F.round("id", 6))


@query(
    f"""SELECT cell, round(avg(x), 9) AS x, round(avg(y), 9) AS y FROM (SELECT DISTINCT l_orderkey AS cell, l_partkey AS id FROM lineitem) c JOIN ({_POINTS}) p USING (id) GROUP BY cell"""
)
def cell_center(spark, sf_dir):
    a, _ = _points(spark, sf_dir)
    con = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("id"))
    d = spatial.cell_centres(con, a, "cell", "id", ["x", "y"])
    return d.withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})


@query(
    f"""SELECT id, round(1 + (x - 1) * cos(0.5) - (y - 2) * sin(0.5) + 3, 6) AS x, round(2 + (x - 1) * sin(0.5) + (y - 2) * cos(0.5) + 4, 6) AS y FROM ({_POINTS})"""
)
def affine(spark, sf_dir):
    a, _ = _points(spark, sf_dir)
    x, y, _ = geometry.affine([F.col("x"), F.col("y"), F.lit(0.0)], (0, 0, 0.5), (1, 2, 0), (3, 4, 0))
    return a.select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("SELECT p_partkey + 1 AS g, p_partkey % 5 + 1 AS i, p_partkey // 5 % 7 + 1 AS j, p_partkey // 35 + 1 AS k, p_partkey + 1 AS back FROM part")
def ijk_roundtrip(spark, sf_dir):
    g = F.col("g")
    i, j, k = index.index_to_ijk(g, (5, 7, 1000))
    d = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("g"))
    d = d.select("g", i.cast("long").alias("i"), j.cast("long").alias("j"), k.cast("long").alias("k"))
    return d.withColumn("back", index.ijk_to_index(F.col("i"), F.col("j"), F.col("k"), (5, 7, 1000)))


@query(
    """WITH a AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 11 <> 0),
    b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 13 <> 0)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'missing_left' WHEN b.k IS NULL THEN 'missing_right' ELSE 'changed' END AS status
    FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v"""
)
def diff_report(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = c.filter("k % 13 <> 0").withColumn("v", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return trees.diff(c.filter("k % 11 <> 0"), b, ["k"], ["v"])


@query("SELECT round(sqrt(sum((l_extendedprice * 1.01 - l_extendedprice) ** 2) / sum(l_extendedprice ** 2)), 6) AS relative_norm FROM lineitem")
def relative_norm(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") * 1.01).alias("v"), F.col("l_extendedprice").alias("r"))
    return trees.relative_norm(d, "v", "r").withColumn("relative_norm", F.round("relative_norm", 6))


@query(
    """SELECT round(avg(w), 4) AS mean, round(min(w), 4) AS least, round(max(w), 4) AS most, count(*) AS n, round(max(w) / avg(w) - 1, 6) AS imbalance
    FROM (SELECT l_suppkey, sum(l_quantity) AS w FROM lineitem GROUP BY 1)"""
)
def balance_stats(spark, sf_dir):
    d = trees.balance_stats(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity")
    return d.select(F.round("mean", 4).alias("mean"), F.round("least", 4).alias("least"), F.round("most", 4).alias("most"), "n", F.round("imbalance", 6).alias("imbalance"))


@query(
    """SELECT o_orderkey AS node, -1000000000 - c_nationkey AS component FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT -1 - c_custkey, -1000000000 - c_nationkey FROM customer
    UNION ALL SELECT DISTINCT -1000000000 - c_nationkey, -1000000000 - c_nationkey FROM customer"""
)
def connected_groups(spark, sf_dir):
    # Orders to customers to nations: hubs of very different degrees.
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    e = o.select(F.col("o_orderkey").alias("a"), (-1 - F.col("o_custkey")).alias("b")).unionByName(c.select((-1 - F.col("c_custkey")).alias("a"), (-1_000_000_000 - F.col("c_nationkey")).alias("b")))
    return graph.connected_components(e, "a", "b")


@query("SELECT p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_partkey % 7) AS component FROM part")
def connected_chains(spark, sf_dir):
    # Seven chains of about n / 7 nodes.
    p = table(spark, sf_dir, "part").select("p_partkey")
    e = p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 7).alias("b"))
    return graph.connected_components(e.join(p, F.col("b") == F.col("p_partkey"), "left_semi"), "a", "b")


@query("SELECT p_partkey, p_name FROM part WHERE p_name GLOB '*a?*'")
def wildcard_select(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").filter(trees.wildcard(F.col("p_name"), "*a?*"))


@query(
    """SELECT page_id, string_split(url, '/')[-1] AS tail, array_to_string(string_split(url, '/')[1:3], '/') AS head,
    array_to_string(string_split(url, '/')[1:len(string_split(url, '/')) - 1], '/') AS parent FROM pages"""
)
def path_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", trees.path_tail(u).alias("tail"), trees.path_head(u, 3).alias("head"), trees.path_parent(u).alias("parent"))
