"""Tables kept in the shared folder, so that lineage is cut and lost executors lose nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, the context's checkpoint folder, or a temporary one.

    The last is for a single machine only: with any other master than local, one of the first two must be set.
    """
    root, jsc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not root and spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="gnomon-checkpoint-"))
    return (root or jsc.getCheckpointDir().get()).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back (column pruning for later passes)."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files behind a stored table that nothing reads any more."""
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    plain = lambda p: p.split(":", 1)[-1].lstrip("/") if ":" in p.split("/", 1)[0] else p.lstrip("/")
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if plain(folder).startswith(plain(root)):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
