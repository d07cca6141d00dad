"""Quality rules by distribution divergence (DataFrame operations only).

Language references are learned from all documents: for every language, the share of each character class and of each
common word.  A word is common when it makes up at least COMMON_SHARE of its language's words, so a language has at
most 1 / COMMON_SHARE of them, by arithmetic and not by a cut.  A document's two histograms are compared with the
reference of its language by the Jensen-Shannon distance (base 2, from 0 to 1).  A document is dropped when either
distance is above its limit.  Short texts have noisy histograms: below MIN_CHARS or MIN_WORDS the respective
comparison is not made.  A language with fewer than MIN_REFERENCE_WORDS words has no reference of its own: its character
classes are compared with those of all documents, and its words with nothing, as every other language's words are far
from them.  A document without a language is compared by its words with the nearest learned reference (with none, if no
language is learned) and by its character classes with all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .common import materialise, read_table, small, words_of

COMMON_SHARE = 0.004
MIN_WORDS = 50
MIN_CHARS = 200
MIN_HISTOGRAM_WORDS = 50
MIN_REFERENCE_WORDS = 5_000
CLASS_LIMIT = 0.28
WORD_LIMIT = 0.4
CLASSES = ("upper", "letter", "digit", "space", "stop", "symbol", "other")
SYMBOLS = "#*$%&|<>"
STOPS = ".,;:!?'\"()-"
BLANKS = " \t\n\x0b\x0c\r"
MAX_BROADCAST_LANGUAGES = 1_000
POOLED = "*"


#: Stands for a run of lower-case (or caseless) letters in a skeleton.
RUN = "\x01"
LOWER_RUN = r"[\p{L}&&[^\p{Lu}]]+"
#: Lists by hash in which a word is sought among the common ones.
SLOTS = 256


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def skeleton(text: Column) -> Column:
    """The text with each run of letters that are not upper case put as one RUN; what is counted below needs no more, and it is short."""
    return F.regexp_replace(text, LOWER_RUN, RUN)


def with_classes(df: DataFrame, text: str) -> DataFrame:
    """Adds _n (code points), _bones (the skeleton) and _<class> counts; a RUN that stood in the text counts as a letter.

    Every step is a column of its own, so that later ones read it instead of computing it again.
    """
    df = df.withColumn("_n", F.length(text)).withColumn("_bones", skeleton(F.col(text)))
    df = df.withColumn("_plain", F.translate("_bones", RUN, "")).withColumn("_rest", F.translate("_plain", BLANKS, ""))
    m = F.length("_rest")
    upper = m - F.length(F.regexp_replace("_rest", r"\p{Lu}+", ""))
    digit, stop, symbol = (m - without(F.col("_rest"), chars) for chars in ("0123456789", STOPS, SYMBOLS))
    letter = F.col("_n") - F.length("_plain")
    df = df.withColumns({"_upper": upper, "_digit": digit, "_stop": stop, "_symbol": symbol, "_letter": letter, "_space": F.length("_plain") - m, "_m": m})
    return df.withColumn("_other", F.col("_m") - F.col("_upper") - F.col("_digit") - F.col("_stop") - F.col("_symbol")).drop("_plain", "_rest", "_m")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.size(lines) - F.size(F.array_distinct(lines))


def with_repeats(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words in three-word windows found twice or more in their text.

    Only where windows (as 64-bit hashes) are fewer when distinct, they are sorted with their positions; windows with an
    equal neighbour are repeated, and the words they cover are counted from their sorted positions.  No rows are made
    and nothing is shuffled.
    """
    at = lambda a, i: F.get(F.col(a), i)
    n = F.size(words)
    three = F.transform(F.slice(F.col(words), F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, at(words, i + 1), at(words, i + 2)))
    df = df.withColumn("_h", three).withColumn("_any", F.size(F.array_distinct("_h")) < F.size("_h"))
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_w", F.when(F.col("_any"), placed))
    twice = lambda x, i: F.coalesce(at("_w", i + 1)["h"] == x["h"], F.lit(False)) | ((i > 0) & (at("_w", i - 1)["h"] == x["h"]))
    df = df.withColumn("_f", F.sort_array(F.filter("_w", twice)["i"]))
    gap = lambda x, i: F.when(i < F.size("_f") - 1, F.least(F.lit(3), at("_f", i + 1) - x)).otherwise(F.lit(3))
    return df.withColumn(out, F.coalesce(F.aggregate(F.transform("_f", gap), F.lit(0), lambda a, x: a + x), F.lit(0))).drop("_h", "_any", "_w", "_f")


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, class_ref array, words array, word_ref array): one row a language, and one for all documents together.

    words are in order; word_ref has their shares, then the share of all other words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    totals = (
        with_classes(docs.select(F.col(lang_col).alias("lang"), text.alias("_text")), "_text")
        .select("lang", *[F.col(f"_{k}").alias(k) for k in CLASSES])
        .groupBy("lang")
        .agg(*[F.sum(k).alias(k) for k in CLASSES])
    )
    words = docs.select(F.col(lang_col).alias("lang"), F.explode(words_of(F.lower(text))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("c"))
    words = stored(words, "quality-words")
    # Words are counted already; a language may have none.
    counted = words.groupBy(F.col("lang").alias("_l")).agg(F.sum("c").alias("n"))
    languages = totals.join(counted, F.col("lang").eqNullSafe(F.col("_l")), "left")
    languages = materialise(languages.select("lang", F.coalesce("n", F.lit(0)).cast("long").alias("n"), *CLASSES))
    n_languages = languages.count()
    of = small(languages.select(F.col("lang").alias("_l"), "n"), n_languages, MAX_BROADCAST_LANGUAGES)
    kept = materialise(words.join(of, F.col("lang").eqNullSafe(F.col("_l"))).filter(F.col("c") >= F.col("n") * COMMON_SHARE).select("lang", "word", "c"))
    # A word that is common in all documents is so in one language at least; its count is that of all languages.
    everywhere = words.join(kept.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.sum("c").alias("c"))
    everywhere = everywhere.join(F.broadcast(languages.agg(F.sum("n").alias("n"))), F.col("c") >= F.col("n") * COMMON_SHARE)
    pooled = languages.agg(F.lit(POOLED).alias("lang"), F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in CLASSES])
    own = languages.filter(F.col("lang").isNotNull() & (F.col("n") >= MIN_REFERENCE_WORDS) & (F.col("lang") != POOLED))
    both = own.unionByName(pooled)
    sums = kept.filter(F.col("lang") != POOLED).unionByName(everywhere.select(F.lit(POOLED).alias("lang"), "word", "c"))
    lists = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("word", "c"))).alias("ws"))
    n = F.greatest(F.col("n"), F.lit(1))
    chars = F.greatest(sum((F.col(k) for k in CLASSES[1:]), F.col(CLASSES[0])), F.lit(1))
    return (
        both.join(lists, "lang", "left")
        .withColumn("ws", F.coalesce("ws", F.array().cast("array<struct<word:string,c:bigint>>")))
        .select(
            "lang",
            F.array(*[F.col(k) / chars for k in CLASSES]).alias("class_ref"),
            F.col("ws")["word"].alias("words"),
            F.concat(F.transform("ws", lambda x: x["c"] / n), F.array(1 - F.aggregate("ws", F.lit(0).cast("bigint"), lambda a, x: a + x["c"]) / n)).alias("word_ref"),
        )
    )


def with_slots(refs: DataFrame) -> DataFrame:
    """Adds slots: SLOTS lists of (hash, place) of the words, a word being in the list of its hash's last bits."""
    held = F.transform("words", lambda w, i: F.struct(F.xxhash64(w).alias("h"), (i + 1).alias("c")))
    d = refs.withColumn("_held", held)
    return d.withColumn("slots", F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.filter("_held", lambda x: x["h"].bitwiseAND(F.lit(SLOTS - 1)) == k))).drop("_held")


def js_distance(pairs: Column) -> Column:
    """Jensen-Shannon distance, base 2, from an array of (p, q) for the values with p > 0.

    A value with p = 0 adds q to twice the divergence, and all q sum to 1, so such values need not be listed.
    """
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    terms = F.transform(pairs, lambda v: F.when(v["p"] > 0, part(v["p"], v["q"]) + part(v["q"], v["p"]) - v["q"]).otherwise(0.0))
    return F.sqrt(F.greatest((F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) + 1) / 2, F.lit(0.0)))


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", references: DataFrame | None = None) -> DataFrame:
    """One row per input row: id, the rule counts, both distances, base_failed and kept.

    A null text counts as empty: no words, base_failed.  A distance whose length guard is not met, or that has no
    reference, is null and passes.
    Rows repeated in the input are repeated in the output; columns other than the three named are ignored.
    """
    refs = materialise(with_slots(language_references(docs, text_col, lang_col) if references is None else references))
    n_refs = refs.count()
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.col(lang_col).alias("_lang"))
    own = refs.filter(F.col("lang") != POOLED)
    learned = small(own.select(F.col("lang").alias("_own"), F.col("class_ref").alias("_oc"), F.col("slots").alias("_ow"), F.col("word_ref").alias("_or")), n_refs, MAX_BROADCAST_LANGUAGES)
    pooled = F.broadcast(refs.filter(F.col("lang") == POOLED).select(F.col("class_ref").alias("_pc")).limit(1))
    every = F.broadcast(own.agg(F.collect_list(F.struct("words", "word_ref")).alias("_refs")))
    d = d.join(learned, F.col("_lang") == F.col("_own"), "left").join(pooled, F.lit(True), "left").join(every, F.col("_lang").isNull(), "left")
    d = d.select("doc_id", "_text", "_refs", F.coalesce("_oc", "_pc").alias("class_ref"), F.col("_ow").alias("slots"), F.col("_or").alias("word_ref"))
    d = d.withColumn("_words", words_of(F.col("_text")))
    d = with_repeats(d, "_words", "n_repeat_words")
    # Sorted positions in the reference (0: not common); the ends of its runs give the counts.
    n = F.size("_words")
    d = d.withColumn("_wh", F.when(F.col("slots").isNotNull(), F.transform("_words", lambda w: F.xxhash64(F.lower(w)))))
    place = lambda h: F.get(F.filter(F.get("slots", h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")), lambda x: x["h"] == h), 0)["c"]
    d = d.withColumn("_codes", F.sort_array(F.transform("_wh", lambda h: F.coalesce(place(h), F.lit(0)))))
    ends = F.filter(F.transform("_codes", lambda c, i: F.struct(c.alias("c"), (i + 1).alias("e"))), lambda x: ~F.get("_codes", x["e"]).eqNullSafe(x["c"]))
    d = d.withColumn("_ends", ends)
    q = lambda c: F.element_at("word_ref", F.when(c > 0, c).otherwise(F.lit(-1)))
    run = lambda x, i: F.struct(((x["e"] - F.when(i > 0, F.get("_ends", i - 1)["e"]).otherwise(0)) / n).alias("p"), q(x["c"]).alias("q"))
    d = d.withColumn("_hist", F.transform("_ends", run))
    # Without a language: the word counts by each learned reference.
    times = lambda r: F.transform(r["words"], lambda w: n - F.size(F.array_remove("_lower", w)))
    d = d.withColumn("_lower", F.when(F.col("_refs").isNotNull() & (n >= MIN_HISTOGRAM_WORDS), F.transform("_words", F.lower)))
    d = d.withColumn("_times", F.when(F.col("_lower").isNotNull(), F.transform("_refs", lambda r: F.struct(times(r).alias("c"), r["word_ref"].alias("q")))))
    other = lambda t: n - F.aggregate(t["c"], F.lit(0), lambda a, x: a + x)
    pairs = lambda t: F.zip_with(F.concat(t["c"], F.array(other(t))), t["q"], lambda c, q: F.struct((c / n).alias("p"), q.alias("q")))
    nearest = F.array_min(F.transform("_times", lambda t: js_distance(pairs(t))))
    d = with_classes(d, "_text")
    d = d.withColumns({"n_words": n.cast("long"), "n_dup_lines": duplicate_lines(F.col("_text")).cast("long"), "n_repeat_words": F.col("n_repeat_words").cast("long")})
    classes = F.array(*[F.struct((F.col(f"_{c}") / F.greatest(F.col("_n"), F.lit(1))).alias("p"), F.get("class_ref", F.lit(i)).alias("q")) for i, c in enumerate(CLASSES)])
    d = d.withColumn("class_distance", F.when(F.col("_n") >= MIN_CHARS, js_distance(classes))).withColumn("word_distance", F.when(F.col("_times").isNotNull(), nearest).when((F.col("n_words") >= MIN_HISTOGRAM_WORDS) & F.col("word_ref").isNotNull(), js_distance(F.col("_hist"))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.coalesce("class_distance", F.lit(0.0)) <= CLASS_LIMIT) & (F.coalesce("word_distance", F.lit(0.0)) <= WORD_LIMIT)
    return d.select(
        "doc_id", "n_words", (F.col("_n") - F.col("_space")).cast("long").alias("word_chars"), F.col("_symbol").cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), kept.alias("kept"), "class_distance", "word_distance",
    )


def op10_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")
