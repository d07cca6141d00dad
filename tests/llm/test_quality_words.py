"""What op10_quality_divergence learns, with texts split to words once."""

from gnomon.llm import quality
from pyspark.sql import functions as F


def test_references_split_texts_once(spark, monkeypatch):
    """The number of a language's words is the sum of its counted ones; a language without words has none."""
    calls, plain = [], quality.words_of
    monkeypatch.setattr(quality, "words_of", lambda text: calls.append(1) or plain(text))
    rows = [(1, "aa Bb aa " * 3000, "x"), (2, " \n", "y"), (3, None, None), (4, "bb", None)]
    refs = quality.language_references(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r["lang"]: (r["words"], [round(v, 6) for v in r["word_ref"]]) for r in refs.collect()}
    assert len(calls) == 1
    assert got == {"x": (["aa", "bb"], [round(2 / 3, 6), round(1 / 3, 6), 0.0]), quality.POOLED: (["aa", "bb"], [round(6000 / 9001, 6), round(3001 / 9001, 6), 0.0])}


def test_repeats_are_found_where_they_are(spark):
    rows = [(1, "a b c d e f"), (2, "a b c x a b c"), (3, "a a a a"), (4, "a b"), (5, "")]
    d = spark.createDataFrame(rows, "k long, text string").withColumn("w", quality.words_of(F.col("text")))
    assert {r["k"]: r["n"] for r in quality.with_repeats(d, "w", "n").collect()} == {1: 0, 2: 6, 3: 4, 4: 0, 5: 0}
