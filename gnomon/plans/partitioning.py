"""Queries of graph partitioning and renumbering on the block of all parts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph_partition, mesh, numbering, partition, renumber, spatial
from ..storage import stored
from .catalog import query, table
from .forms import _PARTS, parts
from .meshes import _CELLS, _FACES, cells, faces, vertices

_INNER = f"SELECT l AS a, r AS b, p.part FROM ({_FACES}) JOIN ({_PARTS}) p ON l = p.cell JOIN ({_PARTS}) q ON r = q.cell AND p.part = q.part"
_NEAR = f"(SELECT a AS u, b AS v, part FROM ({_INNER}) UNION ALL SELECT b, a, part FROM ({_INNER}))"


def dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of faces; the faces need no numbers for that."""
    return graph_partition.dual_graph(mesh.met_sides(mesh.faces_of(cells(spark, sf_dir), "HEXA_8")))


@query(f"SELECT l AS a, r AS b, 1.0::DOUBLE AS w FROM ({_FACES}) WHERE r > 0")
def cell_graph(spark, sf_dir):
    return dual(spark, sf_dir)


@query(f"SELECT count(*) AS cells, sum(p_size)::DOUBLE AS weight, 4::BIGINT AS parts, 0::BIGINT AS repeated, true AS balanced, true AS below_curve, (SELECT count(*) FROM ({_FACES}) WHERE r > 0) AS edges FROM part")
def graph_parts(spark, sf_dir):
    """Cells weighted by p_size in four unequal parts: all cells once, weights within the balance, less cut than along a Hilbert curve."""
    edges, targets = stored(dual(spark, sf_dir), "dual"), [1, 2, 3, 4]
    nodes = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("node"), F.col("p_size").cast("double").alias("weight")).hint("merge")
    labels = stored(graph_partition.by_graph(nodes, edges, targets), "parts").hint("merge")
    centres = spatial.cell_centres(cells(spark, sf_dir).select("cell", F.explode("vtx").alias("vertex")), vertices(spark, sf_dir), "cell", "vertex", ["x", "y", "z"])
    curve = partition.by_hilbert(centres.join(nodes.withColumnRenamed("node", "cell"), "cell"), targets, size="weight").select(F.col("cell").alias("node"), "part")
    share = F.element_at(F.array(*[F.lit(t / sum(targets)) for t in targets]), F.col("part") + 1)
    weights = labels.join(nodes, "node").groupBy("part").agg(F.sum("weight").alias("weight"), F.count("*").alias("rows"), F.countDistinct("node").alias("cells"))
    total = nodes.agg(F.sum("weight")).first()[0]
    d = weights.withColumn("total", F.lit(total)).agg(
        F.sum("cells").alias("cells"), F.sum("weight").alias("weight"), F.count("*").alias("parts"), F.sum(F.col("rows") - F.col("cells")).alias("repeated"),
        # The heaviest cell may be more than the balance allows in small tables.
        F.min(F.abs(F.col("weight") / (F.col("total") * share) - 1) <= graph_partition.BALANCE + 50 / (F.col("total") * share)).alias("balanced"),
    )
    own, other, n = (x.first()[0] for x in (graph_partition.cut_weight(edges, labels), graph_partition.cut_weight(edges, curve), edges.agg(F.count("*"))))
    return d.withColumn("below_curve", F.lit(own < other)).withColumn("edges", F.lit(n).cast("long"))


@query(
    f"""WITH RECURSIVE near AS MATERIALIZED {_NEAR}, d AS (SELECT p.cell, p.part, count(u) AS degree FROM ({_PARTS}) p LEFT JOIN near ON u = p.cell GROUP BY ALL),
    s AS (SELECT part, arg_min(cell, degree * 1000000000 + cell) AS cell FROM d GROUP BY part),
    walk AS (SELECT cell, 0 AS level FROM s UNION SELECT v, level + 1 FROM walk JOIN near ON u = cell WHERE level < 4 * (SELECT count(*) FROM part) / 35 / 3 + 30),
    t AS (SELECT cell, min(level) AS level FROM walk GROUP BY cell)
    SELECT part, cell, level, count(*) OVER (PARTITION BY part) AS size, count(*) OVER (PARTITION BY part ORDER BY level) AS upto, true AS inside FROM t JOIN d USING (cell)"""
)
def renumbered_parts(spark, sf_dir):
    """Levels of the search in every part; inside: the local numbers of a level are those that follow the levels below."""
    r = stored(renumber.renumbered(parts(spark, sf_dir).select("cell", "part"), dual(spark, sf_dir), sweeps=1), "renumbered")
    n = r.groupBy("part", "level").agg(F.count("*").alias("n"), F.countDistinct("lnum").alias("distinct"), F.min("lnum").alias("least"), F.max("lnum").alias("most"))
    # A row for each part and level: sums over the levels below, not over pairs of levels.
    n = numbering.exclusive_offsets(n, ["part", "level"], "n", "_all")
    whole = n.groupBy("part").agg(F.min("_all").alias("_first"), F.sum("n").alias("size"))
    sums = n.join(whole, "part").withColumn("upto", F.col("_all") - F.col("_first") + F.col("n"))
    inside = (F.col("distinct") == F.col("n")) & (F.col("most") == F.col("upto")) & (F.col("least") == F.col("upto") - F.col("n") + 1)
    return r.join(sums.select("part", "level", "size", "upto", inside.alias("inside")), ["part", "level"]).select("part", "cell", "level", "size", "upto", "inside")


_IN = f"SELECT face, x.part, min(x.lnum) AS low, max(x.lnum) AS high FROM (SELECT face, unnest([l, r]) AS cell FROM ({_FACES})) JOIN ({_PARTS}) x USING (cell) GROUP BY face, x.part"


@query(f"SELECT face, part, row_number() OVER (PARTITION BY part ORDER BY low, high, face) AS lnum FROM ({_IN})")
def faces_by_cells(spark, sf_dir):
    return renumber.faces_by_cells(faces(spark, sf_dir), parts(spark, sf_dir))
