"""Meshes as Parquet: a folder a table, partitioned by zone (and part), so that filters on them prune files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("nodes", "zones", "vertices", "cells", "faces", "subset_items", "joins", "fields", "part_map")
PREFIX = "z."  # in folder names, so that a zone called 01 is not read as a number


def write(tables: Mapping[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Each table at path/name, in folders by zone and part where it has them.  Rows stay in their tasks, so a large zone is written by many."""
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown table: {name}")
        by = []
        if "zone" in df.columns:
            df, by = df.withColumn("_zone", F.concat(F.lit(PREFIX), "zone")).drop("zone"), ["_zone"]
        by += [c for c in ("part",) if c in df.columns]
        w = df.write.mode(mode)
        (w.partitionBy(*by) if by else w).parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, tables: Sequence[str]) -> dict[str, DataFrame]:
    """The named tables; filters on zone and part select folders before anything is read."""
    out = {}
    for name in tables:
        d = spark.read.parquet(f"{path}/{name}")
        out[name] = d.withColumn("zone", F.substring("_zone", len(PREFIX) + 1, 1 << 20)).drop("_zone") if "_zone" in d.columns else d
    return out


def read_parts(spark: SparkSession, path: str, name: str, parts: Sequence[int] | None = None, zones: Sequence[str] | None = None) -> DataFrame:
    """Some parts and zones of a table."""
    d = read(spark, path, [name])[name]
    if parts is not None:
        d = d.filter(F.col("part").isin(*parts))
    return d if zones is None else d.filter(F.col("zone").isin(*zones))
