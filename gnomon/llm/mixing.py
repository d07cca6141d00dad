"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only).

Every source gets a target in words by water filling.  A source whose target is r times its size first contributes
floor(r) certain whole copies of each document.  The rest, f = r - floor(r) of its words, is a fixed-size sample with
unequal inclusion probabilities: document i has p_i = f * S * m_i / sum(m_j * s_j), where s are word counts, S their
sum, and the measure m_i is the bit length of s_i, so the expected words are f * S.  Documents whose p_i would be one
or more are certain, and the rest is shared among the others anew until none is.  These are ranked by
Q_i = (u_i / (1 - u_i)) / (p_i / (1 - p_i)), random odds over inclusion odds, and taken in that order until the words
reach the target; the document on the boundary is taken if that brings the total nearer.  So a source misses its
target by at most half a document.

The rank is never computed by sorting a source: words are summed per rank bin, the bin holding the boundary is split
again, and only the documents of one fine bin (about a millionth of a source) are ordered.  A source with a third of
all rows thus costs partial sums, not one long task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import row_numbers
from .common import materialise, read_table, small, word_count

#: Random numbers have 52 bits, from the first 13 hexadecimal digits of an MD5.
UNIT = 1 << 52
MAX_BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """Targets from a table (skey, source, source_size, ...), one row a source.

    Sources in code point order, null last, take the weights in turn and share the total of all sizes; no target is
    above max_repeat times its source's size, and what exceeds that is shared anew by weight until none is above.
    Sources are numbered in two levels and each sharing is one aggregation, so a table of very many sources works.
    """
    t = row_numbers(sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "position").drop("_last")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("position") - 1, F.lit(len(weights))).cast("int") + 1)
    t = materialise(t.withColumn("weight", weight).drop("position"))
    cap = (F.col("source_size") * F.lit(max_repeat)).cast("double")
    level, over = None, -1
    while True:
        # A source is over when its share at this level is above its cap.
        above = F.lit(False) if level is None else cap < F.col("weight") * F.lit(level)
        row = t.agg(
            F.count_if(above).alias("n"),
            F.sum("source_size").alias("total"),
            F.sum(F.when(above, cap).otherwise(0.0)).alias("capped"),
            F.sum(F.when(~above, F.col("weight")).otherwise(0.0)).alias("left"),
        ).first()
        if row["n"] == over or not row["left"]:
            break
        level, over = (row["total"] - row["capped"]) / row["left"], row["n"]
    return t.withColumn("target", F.least(cap, F.col("weight") * F.lit(level or 0.0))).drop("weight")


def inclusion(classes: DataFrame) -> DataFrame:
    """(skey, certain, rate, left) from (skey, measure, words, rest): one row a source.

    Documents of measure certain or more have a probability of one; that of others is rate * measure, below one.  left
    is what remains of rest for these.  A source has at most 64 measures, so its classes fit in an array.
    """
    parts = F.sort_array(F.collect_list(F.struct("measure", "words")), asc=False)
    c = classes.groupBy("skey").agg(parts.alias("parts"), F.first("rest").alias("rest"), F.sum(F.col("measure") * F.col("words")).cast("double").alias("measured"))
    first = F.struct(F.col("rest").alias("rest"), F.col("measured").alias("measured"), F.lit(1 << 20).cast("long").alias("certain"))

    def take(acc: Column, x: Column) -> Column:
        sure = (acc["measured"] > 0) & (acc["rest"] * x["measure"] >= acc["measured"])
        less = F.struct((acc["rest"] - x["words"]).alias("rest"), (acc["measured"] - x["measure"] * x["words"]).alias("measured"), x["measure"].alias("certain"))
        return F.when(sure, less).otherwise(acc)

    c = c.select("skey", F.aggregate("parts", first, take).alias("a"))
    rate = F.when((F.col("a.measured") > 0) & (F.col("a.rest") > 0), F.col("a.rest") / F.col("a.measured")).otherwise(0.0)
    return c.select("skey", F.col("a.certain").alias("certain"), rate.alias("rate"), F.col("a.rest").alias("left"))


def pareto_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    max_repeat: int = 3,
    seed: str = "mix",
    bins: int = 1024,
) -> DataFrame:
    """One row per input row: id, size, source, source_size, target, copies, taken.

    A null text has size 0; size 0 takes 0 words.  A null source is a source of its own.  Repeated rows are sampled
    as separate documents with equal rank.  An empty table gives an empty result.  The random number of a document is
    an MD5 of seed and id, so reruns agree.  Other columns of docs are ignored, whatever their names.
    """
    size = word_count(F.col(text_col))
    d = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("skey"),
            size.alias("size"),
        ).withColumn("measure", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0).cast("long"))
    )
    classes = materialise(d.groupBy("skey", "measure").agg(F.first("source").alias("source"), F.sum("size").alias("words")))
    per_source = classes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = source_targets(per_source, weights, max_repeat)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = (
        targets.withColumn("whole", F.floor(share))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .drop("source")
    )
    targets = materialise(targets)
    n_sources = targets.count()
    rates = inclusion(classes.join(targets.select("skey", "rest"), "skey").select("skey", "measure", "words", "rest"))
    targets = materialise(targets.drop("rest").join(rates, "skey").withColumnRenamed("left", "rest"))

    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(UNIT))
    p = F.col("rate") * F.col("measure")
    q = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    placed = d.join(small(targets, n_sources, MAX_BROADCAST_SOURCES), "skey")
    sure = placed.filter(F.col("measure") >= F.col("certain")).withColumn("sampled", F.lit(True))
    ranked = (
        placed.filter(F.col("measure") < F.col("certain"))
        .withColumn("u", u)
        .withColumn("p", p)
        .withColumn("rank", F.when(F.col("p") > 0, q / (1 + q)).otherwise(1.0))
        .withColumn("bin", F.least(F.floor(F.col("rank") * bins), F.lit(bins - 1)))
        .withColumn("fine", F.floor((F.col("rank") * bins - F.col("bin")) * bins))
        .drop("u", "p", "rate", "certain", "measure")
    )

    def boundary(rows: DataFrame, level: str, base: str | None) -> DataFrame:
        """For each source, the first bin of this level whose running sum exceeds the rest, and the sum before it."""
        sums = rows.groupBy("skey", level).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), *([F.first(base).alias(base)] if base else []))
        run = Window.partitionBy("skey").orderBy(level)
        sums = sums.withColumn("run", F.sum("words").over(run) + (F.col(base) if base else F.lit(0)))
        return sums.filter(F.col("run") > F.col("rest")).groupBy("skey").agg(F.min(F.struct(F.col(level), (F.col("run") - F.col("words")).alias("before"))).alias("cut")).select("skey", F.col(f"cut.{level}").alias(f"cut_{level}"), F.col("cut.before").alias(f"before_{level}"))

    coarse = boundary(ranked, "bin", None)
    ranked = ranked.join(small(coarse, n_sources, MAX_BROADCAST_SOURCES), "skey", "left")
    fine = boundary(ranked.filter(F.col("bin") == F.col("cut_bin")), "fine", "before_bin")
    ranked = ranked.join(small(fine, n_sources, MAX_BROADCAST_SOURCES), "skey", "left")
    in_cut = F.coalesce((F.col("bin") == F.col("cut_bin")) & (F.col("fine") == F.col("cut_fine")), F.lit(False))
    clear = ranked.filter(~in_cut).withColumn(
        "sampled",
        F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (F.col("fine") < F.coalesce(F.col("cut_fine"), F.lit(bins)))),
    )
    order = Window.partitionBy("skey").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    close = ranked.filter(in_cut).withColumn("gone", F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("before_fine"))
    close = close.withColumn("sampled", 2 * F.col("gone") + F.col("size") <= 2 * F.col("rest")).drop("gone")
    drawn = ["doc_id", "size", "source", "source_size", "target", "whole", (F.col("sampled") & (F.col("rest") > 0)).alias("sampled")]
    d = clear.select(*drawn).unionByName(close.select(*drawn)).unionByName(sure.select(*drawn[:-1], "sampled"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("sampled").cast("int")).otherwise(F.least(F.col("whole"), F.lit(1)))
    return d.select("doc_id", "size", "source", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), m AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS measure FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
  [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM m GROUP BY source),
r AS (
  SELECT 0 AS step, source, weight, source_size, false AS capped,
    (weight * (SELECT sum(source_size) FROM s) / (SELECT sum(weight) FROM s))::DOUBLE AS target FROM s
  UNION ALL
  SELECT step + 1, source, weight, source_size, capped OR target > 3 * source_size,
    CASE WHEN capped OR target > 3 * source_size THEN 3.0 * source_size
      ELSE weight * (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (capped OR target > 3 * source_size) OVER (), 0))::DOUBLE
        / (sum(weight) FILTER (NOT (capped OR target > 3 * source_size)) OVER ()) END::DOUBLE
  FROM r WHERE step < 40
), t AS (SELECT s.*, r.target FROM r JOIN s ON s.source IS NOT DISTINCT FROM r.source WHERE step = 40),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
x AS (SELECT *, target - whole * source_size AS rest FROM w),
k AS (
  SELECT x.source, x.rest, m.measure, sum(m.size) AS words, sum(m.size * m.measure) AS measured FROM m JOIN x ON m.source IS NOT DISTINCT FROM x.source GROUP BY ALL
), kk AS (
  SELECT *, rest - (sum(words) OVER (PARTITION BY source ORDER BY measure DESC) - words) AS r, sum(measured) OVER (PARTITION BY source ORDER BY measure) AS z FROM k
), kb AS (SELECT *, bool_and(z > 0 AND r * measure >= z) OVER (PARTITION BY source ORDER BY measure DESC) AS sure FROM kk),
kc AS (
  SELECT source, coalesce(min(measure) FILTER (sure), 1 << 20) AS certain, (rest - coalesce(sum(words) FILTER (sure), 0))::DOUBLE AS rest,
    coalesce(sum(measured) FILTER (NOT sure), 0) AS measured FROM kb GROUP BY source, kb.rest
), p AS (
  SELECT m.doc_id, m.size, x.source, x.source_size, x.target, x.whole, kc.rest, m.measure >= kc.certain AS sure,
    (('0x' || substr(md5('mix:' || m.doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u,
    CASE WHEN measured > 0 AND kc.rest > 0 THEN kc.rest / measured * measure ELSE 0 END AS p
  FROM m JOIN x ON m.source IS NOT DISTINCT FROM x.source JOIN kc ON m.source IS NOT DISTINCT FROM kc.source
), q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) ELSE 1e300 END AS odds FROM p),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, sure ORDER BY odds, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM q)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN sure OR (rest > 0 AND 2 * gone + size <= 2 * rest) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""
