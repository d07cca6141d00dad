"""Command lines on trees in text form: `python -m gnomon print FILE` and `python -m gnomon diff A B [--tolerance X]` (exit code 1 if they differ)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import trees
from .sources import tree_text


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gnomon")
    commands = parser.add_subparsers(dest="command", required=True)
    show = commands.add_parser("print", help="names, labels and sizes of a tree")
    show.add_argument("file")
    show.add_argument("--depth", type=int, help="the deepest level to show")
    compare = commands.add_parser("diff", help="nodes that differ between two trees")
    compare.add_argument("a")
    compare.add_argument("b")
    compare.add_argument("--tolerance", type=float, default=0.0, help="for numbers, alone and in arrays")
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("gnomon").config("spark.ui.enabled", "false").getOrCreate()
    if given.command == "print":
        nodes = tree_text.read(spark, given.file)
        nodes = nodes if given.depth is None else nodes.filter(F.col("depth") <= given.depth)
        for row in tree_text.outline(nodes).orderBy("file", "ord").toLocalIterator():
            print(row["line"])
        return 0
    a, b = (tree_text.read(spark, f) for f in (given.a, given.b))
    n = 0
    for row in trees.diff_text(a, b, ["path"], given.tolerance).orderBy("path").toLocalIterator():
        print(f"{row['status']:13} {row['path']}")
        n += 1
    return int(n > 0)


if __name__ == "__main__":
    sys.exit(main())
