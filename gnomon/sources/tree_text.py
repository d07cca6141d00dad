"""Node trees as text: one line `name label [type] value:` a node, children indented (YAML mappings).

Reading takes whole files through Spark's own text source, so any store works, and parses each in a task; writing makes
one text row a node, in order.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("I4", "I8", "U4", "U8", "R4", "R8", "C1", "X4", "X8")
SCHEMA = "file string, path string, parent string, name string, label string, depth int, ord int, dtype string, size bigint, value string"


def _flat(value) -> int:
    return sum(map(_flat, value)) if isinstance(value, list) else 1


def _head(text: str) -> tuple[str, str, str | None, object]:
    """Name, label, type and value of a node's line; no type is an integer, real or text by the value itself."""
    name, _, rest = text.partition(" ")
    label, _, rest = rest.strip().partition(" ")
    rest = rest.strip()
    if not rest:
        return name, label, None, None
    kind = rest[:2] if rest[:2] in TYPES else None
    value = ast.literal_eval(rest[2:].strip() if kind else rest)
    return name, label, kind or _kind(value), value


def _kind(value) -> str:
    while isinstance(value, list) and value:
        value = value[0]
    return "C1" if isinstance(value, str) else "R8" if isinstance(value, float) else "I4"


def parse(text: str, file: str = "") -> list[tuple]:
    """Rows of the nodes of one text, in order; an empty text has none."""
    import yaml

    rows: list[tuple] = []

    def walk(entries, parent: str, depth: int) -> None:
        for head, below in (entries or {}).items():
            name, label, kind, value = _head(str(head))
            below = dict(below or {})
            for t in TYPES:
                if t in below:
                    if value is not None:
                        raise ValueError(f"two values of node {name}")
                    kind, value = t, below.pop(t)
            path = f"{parent}/{name}" if parent else name
            rows.append((file, path, parent, name, label, depth, len(rows), kind, None if value is None else _flat(value), None if value is None else json.dumps(value)))
            walk(below, path, depth + 1)

    walk(yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)), "", 1)
    return rows


def read(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of all files at the path (a file, folder or pattern)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, text in zip(b["file"], b["value"]):
                yield pd.DataFrame(parse(text, file), columns=names)

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return texts.mapInPandas(parsed, SCHEMA)


def sizes_only(nodes: DataFrame, limit: int = 8) -> DataFrame:
    """The tree without values of more than `limit` items: names, labels, types and sizes."""
    return nodes.withColumn("value", F.when(F.col("size") <= limit, F.col("value")))


def line(nodes: DataFrame) -> Column:
    """The text line of a node; values of nodes with one stand after label and type."""
    kind = F.when(F.col("dtype") == "C1", "").otherwise(F.concat(F.lit(" "), "dtype"))
    value = F.when(F.col("value").isNull(), "").otherwise(F.concat(kind, F.lit(" "), "value"))
    return F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("? '"), F.regexp_replace(F.concat("name", F.lit(" "), "label", value), "'", "''"), F.lit("'"))


def to_lines(nodes: DataFrame) -> DataFrame:
    """(file, ord, line): the text of each tree, a row a node."""
    body = F.concat(line(nodes), F.lit("\n"), F.repeat(F.lit("  "), F.col("depth") - 1), F.lit(":"))
    return nodes.select("file", "ord", body.alias("line"))


def write(nodes: DataFrame, path: str) -> None:
    """One folder a tree; each tree, being metadata and small, is one text file in order."""
    d = to_lines(nodes).repartition("file").sortWithinPartitions("file", "ord")
    key = F.md5("file").alias("tree")
    d.select(key, F.col("line").alias("value")).write.partitionBy("tree").text(path)


def outline(nodes: DataFrame) -> DataFrame:
    """(file, ord, line): names, labels and sizes, indented."""
    size = F.when(F.col("size").isNull(), "").otherwise(F.concat(F.lit(" "), "dtype", F.lit("("), F.col("size").cast("string"), F.lit(")")))
    return nodes.select("file", "ord", F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), "name", F.lit(" "), "label", size).alias("line"))
