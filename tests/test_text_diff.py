"""Values in text form: whole numbers exactly, arrays number by number, text by its letters."""

import pytest
from gnomon.operators import trees
from pyspark.sql import functions as F

CASES = [
    ("9007199254740992", "9007199254740993", 0.0, True),
    ("9007199254740992", "9007199254740993", 1.0, False),
    ("1", "1.0", 0.0, False),
    ("[1, 2.5, 3]", "[1, 2.50, 3]", 0.0, False),
    ("[1, 2.5, 3]", "[1, 2.6, 3]", 0.2, False),
    ("[1, 2.5, 3]", "[1, 2.6, 3]", 0.05, True),
    ("[[1, 2], [3, 4]]", "[1, 2, 3, 4]", 9.0, True),
    ("[1, 2]", "[1, 2, 3]", 9.0, True),
    ("[-1e-3, 4]", "[-0.001, 4]", 0.0, False),
    ('"a1"', '"a2"', 5.0, True),
    ('"a1"', '"a1"', 0.0, False),
    ('"1"', "1", 0.0, True),
    ("[9007199254740992, 1]", "[9007199254740993, 1]", 0.0, True),
    (None, None, 0.0, False),
    (None, "1", 5.0, True),
    ("", "", 0.0, False),
]


@pytest.mark.parametrize("tolerance", sorted({c[2] for c in CASES}))
def test_text_values(spark, tolerance):
    rows = [(n, a, b, d) for n, (a, b, t, d) in enumerate(CASES) if t == tolerance]
    d = spark.createDataFrame(rows, "n int, a string, b string, differs boolean")
    got = d.select("n", trees.text_values_differ(F.col("a"), F.col("b"), tolerance).alias("got"), "differs").collect()
    assert [(r["n"], r["got"]) for r in got] == [(r["n"], r["differs"]) for r in got]


def test_diff_text(spark):
    a = spark.createDataFrame([("x", "L", "[1, 2]"), ("y", "L", "1"), ("z", "L", None)], "path string, label string, value string")
    b = spark.createDataFrame([("x", "L", "[1, 2.1]"), ("y", "M", "1"), ("w", "L", None)], "path string, label string, value string")
    assert sorted(map(tuple, trees.diff_text(a, b, ["path"]).collect())) == [("w", "missing_left"), ("x", "changed"), ("y", "changed"), ("z", "missing_right")]
    assert sorted(map(tuple, trees.diff_text(a, b, ["path"], 0.2).collect())) == [("w", "missing_left"), ("y", "changed"), ("z", "missing_right")]
