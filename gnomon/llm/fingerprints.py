"""Document fingerprints by consistent weighted sampling (DataFrame operations only).

A text is a bag of words weighted by their counts.  For each of SAMPLES samples and each word, gamma variates r and c
(shape 2) and a uniform b come from a hash of word and sample; with weight S, t = floor(ln S / r + b) and
ln a = ln c - r * (t - b + 1).  The word with the least a is the sample, together with t.  Two texts agree in a sample
with a probability equal to their generalised Jaccard similarity, sum(min) / sum(max) of their word counts.

The gamma variates are drawn by inversion: 12 bits of the hash choose one of 4,096 equally likely quantiles from a
table, so a sample costs one hash and no logarithm.  A sample is one 64-bit number, ln a in the upper half and a hash
of (word, t) in the lower, and a fingerprint is the minimum of these over the words.

Work goes by rows: words are exploded and counted, each count gives GROUPS rows of WIDE samples, and these are reduced
by minima.  Texts are dealt by their document once, and all of this stays in that dealing.  (Rows of few samples, as
the JVM does not compile a generated method above 8,000 bytes of bytecode.)

The next document in descending order of id is found on narrow rows: documents are numbered, and a document sends its
successor's share of text to it by key.  Only these heads are shuffled a second time.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import row_numbers
from ..storage import stored
from .common import SPACE, read_table

SAMPLES = 64
WIDE = 4
GROUPS = SAMPLES // WIDE
QUANTILES = 1 << 12
LOW = 0xFFFFFFFF
#: Copies of one row that are put out from one array.
COPIES = 10_000
#: ln a is between -2 ** 9 and 2 ** 9 for every count below 2 ** 63; 20 bits follow the point.
SHIFT, POINT = 512.0, float(1 << 20)


@lru_cache(1)
def gamma_quantiles() -> list[float]:
    """Quantiles of the gamma distribution of shape 2 in the middle of QUANTILES equal shares: the solutions of 1 - (1 + x) exp(-x) = p, by Newton's method in ln x."""
    out, x = [], 0.01
    for i in range(QUANTILES):
        p = (i + 0.5) / QUANTILES
        for _ in range(60):
            step = (1 - (1 + x) * math.exp(-x) - p) / (x * x * math.exp(-x))
            x *= math.exp(max(-1.0, min(1.0, -step)))
            if abs(step) < 1e-14:
                break
        out.append(x)
    return out


def samples(seed: Column, count_log: Column) -> list[Column]:
    """WIDE packed samples of a word, from a hash of word and group, and the logarithm of the word's count."""
    table = lambda xs: F.expr(f"array({','.join(f'{x!r}D' for x in xs)})")
    r_table, c_table = table(gamma_quantiles()), table([math.log(x) for x in gamma_quantiles()])
    out = []
    for k in range(WIDE):
        h = F.xxhash64(seed.bitwiseXOR(F.lit(k)))
        bits = lambda at: F.shiftrightunsigned(h, at).bitwiseAND(F.lit(QUANTILES - 1)).cast("int")
        r, c = F.get(r_table, bits(0)), F.get(c_table, bits(12))
        b = F.shiftrightunsigned(h, 24).cast("double") * F.lit(2.0**-40)
        t = F.floor(count_log / r + b)
        rank = ((c - r * (t - b + F.lit(1.0)) + F.lit(SHIFT)) * F.lit(POINT)).cast("long")
        out.append(F.shiftleft(rank, 32).bitwiseOR(F.xxhash64(h.bitwiseXOR(t)).bitwiseAND(F.lit(LOW))))
    return out


def signatures(texts: DataFrame, key: list[str], variants: dict[str, Column]) -> DataFrame:
    """(key, one array of SAMPLES 32-bit numbers for each variant of a row's text, null where it has no words).

    texts must be dealt by key already, with one row a key; nothing is shuffled then.
    """
    d = texts.select(*key, F.explode(F.array(*[F.struct(F.lit(i).alias("v"), t.alias("t")) for i, t in enumerate(variants.values())])).alias("x"))
    d = d.select(*key, F.col("x.v").alias("v"), F.explode(F.split("x.t", SPACE)).alias("w")).filter("w <> ''")
    d = d.select(*key, "v", F.xxhash64("w").alias("w")).groupBy(*key, "v", "w").agg(F.count(F.lit(1)).alias("n"))
    d = d.select(*key, "v", "w", F.log(F.col("n").cast("double")).alias("n"), F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("g"))
    d = d.select(*key, "v", "g", "n", F.xxhash64("w", "g").alias("h"))
    d = d.select(*key, "v", "g", *[s.alias(f"s{k}") for k, s in enumerate(samples(F.col("h"), F.col("n")))])
    d = d.groupBy(*key, "v", "g").agg(*[F.min(f"s{k}").alias(f"s{k}") for k in range(WIDE)])
    low = F.array(*[F.shiftright(F.shiftleft(f"s{k}", 32), 32).cast("int") for k in range(WIDE)])
    # GROUPS rows a document and variant.
    d = d.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("v", "g", low.alias("s")))).alias("a"))
    part = lambda i: F.flatten(F.transform(F.filter("a", lambda x: x["v"] == i), lambda x: x["s"]))
    return d.select(*key, *[F.when(F.size(part(i)) > 0, part(i)).alias(name) for i, name in enumerate(variants)])


def likeness(a: str, b: str) -> Column:
    """Share of agreeing samples; two texts without words are alike (1), one without words is like no other (0)."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(SAMPLES))
    return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(same)


def as_hex(sig: str) -> Column:
    """The fingerprint as text, 8 hexadecimal digits a sample; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.right(F.concat(F.lit("0000000"), F.lower(F.hex(x))), F.lit(8))), ""), F.lit(""))


KEY = ["ka", "kb"]


def neighbours(keys: DataFrame) -> DataFrame:
    """(ka, kb, doc_id, m, n_chars, last_a, last_b, last_chars) from the first five, one row a distinct document.

    last is the document before it in descending order of id, null ids last and going round at the ends.
    """
    d = stored(row_numbers(keys, ["doc_id", "kb"], "rn"), "fingerprint-order")
    n = d.count()
    before = F.when(F.col("rn") == 1, n).otherwise(F.col("rn") - 1)
    return d.join(d.select(before.alias("rn"), F.col("ka").alias("last_a"), F.col("kb").alias("last_b"), F.col("n_chars").alias("last_chars")), "rn").drop("rn")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty.  Rows that share an id are ordered by a hash of their text; a null id comes last.  Of
    equal rows, each but one has its copy as next document.  A single document is its own next one.  Ids may be of any
    type with an order.  An empty table gives an empty result.  Other columns are ignored.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # A document is known by two hashes, of its id and its text; both would have to clash.
    d = d.select("doc_id", "text", F.xxhash64("doc_id").alias("ka"), F.xxhash64("text").alias("kb"))
    keys = d.select(*KEY, "doc_id", F.length("text").alias("n_chars")).groupBy(*KEY).agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("m"), F.first("n_chars").alias("n_chars"))
    order = stored(neighbours(keys), "fingerprint-neighbours")
    # Every text is dealt by its key once; all uses below read that one exchange.
    texts = d.select(*KEY, "text").groupBy(*KEY).agg(F.first("text").alias("text"))
    third = lambda n: F.floor(n / 3).cast("int")
    heads = texts.join(order.select(*KEY, "m", "last_a", "last_b", "last_chars"), KEY)
    heads = heads.select(F.col("last_a").alias("ka"), F.col("last_b").alias("kb"), F.substring("text", F.lit(1), third(F.col("last_chars"))).alias("head"))
    both = texts.join(heads, KEY)
    cut = third(F.length("text"))
    body, own = F.substring("text", F.lit(1), F.length("text") - cut), F.substring("text", F.lit(1), cut)
    edited, copied = F.concat(body, F.col("head")), F.concat(body, own)
    both = both.join(order.filter("m > 1").select(*KEY, F.lit(True).alias("several")), KEY, "left")
    signed = signatures(both, KEY, {"text_sig": F.col("text"), "edited_sig": edited, "copied_sig": F.when(F.col("several"), copied)})
    digest = lambda t: F.unhex(F.sha2(t, 256))
    digests = both.select(*KEY, digest(edited).alias("edited_sha"), F.when(F.col("several"), digest(copied)).alias("copied_sha"))
    d = order.join(digests, KEY).join(signed, KEY, "left")
    d = stored(d.drop("last_chars"), "fingerprint-signatures")
    d = d.drop("last_a", "last_b").join(d.select(F.col("last_a").alias("ka"), F.col("last_b").alias("kb"), F.col("text_sig").alias("next_sig")), KEY)
    # A copy's next document is a copy, but for one; long runs of copies come in bounded arrays.
    d = d.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / COPIES))))
    d = d.withColumn("_copy", F.explode(F.sequence(F.col("_run") * COPIES, F.least((F.col("_run") + 1) * COPIES, F.col("m")) - 1)))
    pick = lambda a, b: F.when(F.col("_copy") > 0, F.col(a)).otherwise(F.col(b))
    d = d.withColumns({"edited_sig": pick("copied_sig", "edited_sig"), "next_sig": pick("text_sig", "next_sig"), "edited_sha256": F.lower(F.hex(pick("copied_sha", "edited_sha")))})
    return d.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", as_hex("text_sig").alias("fingerprint"), as_hex("edited_sig").alias("edited_fingerprint"), likeness("text_sig", "edited_sig").alias("near_edited"), likeness("text_sig", "next_sig").alias("near_next"))


def op6_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
