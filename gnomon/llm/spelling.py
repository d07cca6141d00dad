"""Spelling variant grouping: words one edit apart, by bands of letter-parity bitmasks.

Every letter has one of LETTER_BITS bits, and a word's mask holds the parity of each bit's count.  One inserted or
deleted letter flips one bit, a replaced one two at most.  The mask is split into three bands, so near words agree in
one band at least (in one of the first two, if their lengths differ).  Words are joined on a band's value and the
length, where a word also stands as the shorter partner of the next length.  Masks of words are far from even, and such
groups would grow with the square of the vocabulary; they are split by half words: one edit leaves the first or the
last half of a word as it is, so a word is in a group's part of each of its halves.  Pairs that flip more than two bits
are dropped on numbers alone, and the rest is verified by the edit distance.  A pair is taken in the first band and half
in which it agrees, so no pair comes twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .common import read_table

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
DROP_ONE_IN = 31
RUN = r"[A-Za-zÀ-ÿ]{%d,}+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters by how often they occur in the languages of Latin script; dealing them by turns gives bands of like entropy.
BY_USE = "etaoinsrhldcumfpgwybvkxjqz"
BANDS = 3
LETTER_BITS = 26 + 32
#: Forms have RATIO times their words' counts, so 2**PATH steps reach the end of any path (counts are below 10**19).
PATH = 5


def letter_bits() -> dict[str, int]:
    """Bit of each letter: those of a-z dealt by use, those of Latin-1 by code point, an upper-case one as its lower-case form 32 above."""
    bits = {c: i for i, c in enumerate(BY_USE)}
    return bits | {chr(c): 26 + (c - 0xC0) % 32 for c in range(0xC0, 0x100)}


def band_masks(n: int = BANDS, bits: int = LETTER_BITS) -> list[int]:
    """The bits of each band: bit b is in band b mod n."""
    return [sum(1 << b for b in range(bits) if b % n == k) for k in range(n)]


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def parity_mask(word: Column) -> Column:
    """The parity of each letter bit; letters without a bit count for nothing."""
    at = letter_bits()
    alphabet = "".join(at)
    codes = F.array(*[_long(1 << at[c]) for c in alphabet])
    return F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), _long(0), lambda acc, c: acc.bitwiseXOR(F.coalesce(F.get(codes, F.call_function("locate", c, F.lit(alphabet)) - 1), _long(0))))


def edited_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(word) for each occurrence of a maximal run of letters with at least min_length code points, A-Z in lower case.

    With h = crc32("<id>:<run>"), runs with h divisible by DROP_ONE_IN lose the code point h mod length; what is then
    shorter than min_length goes.  A null text has no runs; a null id counts as an empty one.
    """
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(f"`{text_col}`", F.lit(RUN % min_length), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % DROP_ONE_IN == 0, cut).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= min_length)


def word_table(occurrences: DataFrame, *, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words with at least min_count occurrences; null words are left out."""
    return occurrences.filter("word is not null").groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _half(word: Column, size: Column, side: int) -> Column:
    """The first (side 0) or last half of a word that takes part in pairs of this length."""
    n = F.floor((size - 1) / 2).cast("int")
    return F.substring(word, F.length(word) - n + 1 if side else F.lit(1), n)


def _slots(word: Column, mask: Column, shorter: int) -> Column:
    """(slot, key) of each group that a word is in: slot says which band and half, key is a digest of all that the group shares."""
    size = F.length(word) + shorter
    out = []
    for k, bits in enumerate(band_masks()[: BANDS - shorter]):
        for side in (0, 1):
            key = F.xxhash64(F.lit(2 * k + side), mask.bitwiseAND(_long(bits)), size, _half(word, size, side))
            out.append(F.struct(F.lit(2 * k + side).alias("slot"), F.lit(shorter).alias("shorter"), key.alias("key")))
    return F.array(*out)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for each pair of words (word, n) that differ by one inserted, deleted or replaced code point; each pair once.

    Words are taken to be distinct and not null.
    """
    word, mask = F.col("word"), F.col("mask")
    d = stored(words.withColumn("mask", parity_mask(word)), "spelling-masks")
    own, next_ = _slots(word, mask, 0), _slots(word, mask, 1)
    left = d.select("word", "n", "mask", F.inline(own)).drop("shorter")
    right = d.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("mask").alias("other_mask"), F.inline(F.concat(own, next_)))
    right = right.withColumnRenamed("slot", "other_slot").withColumnRenamed("key", "other_key")
    flips = mask.bitwiseXOR(F.col("other_mask"))
    order = (F.col("shorter") == 1) | (word < F.col("other"))
    # Keys are digests: whether the pair agrees in this slot, and in none before, is told by masks and words.
    size = F.length(word)
    bands = [flips.bitwiseAND(_long(bits)) == 0 for bits in band_masks()]
    halves = [_half(word, size, side) == _half(F.col("other"), size, side) for side in (0, 1)]
    first = F.coalesce(*[F.when(b & h, 2 * k + side) for k, b in enumerate(bands) for side, h in enumerate(halves)])
    # One expression, so that texts are compared only where the numbers allow it.
    near = F.when((F.bit_count(flips) > 2) | ~order | (F.col("slot") != F.col("other_slot")), False).when(F.col("slot") != first, False).otherwise(F.levenshtein("word", "other", 1) == 1)
    # Dealt by number: the rows are few bytes, but each meets its whole group, so small partitions must not be put together.
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(parts, "key"), right.repartition(parts, "other_key")
    return left.join(right, (F.col("key") == F.col("other_key")) & near).select("word", "n", "other", "other_n")


def variants(words: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """One row per word of (word, n): word, form, root, n, n_near, form_n.

    n_near counts the words one edit apart.  form is the one of them with the largest n (ties: the smallest in
    code-point order) if it has at least `ratio` times the word's n, else null; root is the end of the path of forms.
    An empty table gives an empty result.
    """
    words = stored(words, "spelling-words")
    pairs = near_pairs(words)
    found = _both(pairs).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    large = -F.col("best.less") >= F.col("n") * ratio
    d = words.join(found, "word", "left")
    d = d.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.other")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n"))
    d = stored(d, "spelling-forms")
    step = d.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(PATH):
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = stored(step.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        step = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            break
    return d.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _both(pairs: DataFrame) -> DataFrame:
    """Each pair from both sides, without computing the join twice."""
    sides = F.array(F.struct("word", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return pairs.select(F.inline(sides))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of documents, repeated rows counted as often as they occur."""
    return variants(word_table(edited_runs(read_table(spark, sf_dir, "documents"))))
