"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import shared_folder

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the reliable checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """names, with underscores put after them until no column of df has them, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df with a broadcast hint when its counted rows are within limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    """The words of a text as an array (null: empty)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


#: Rows that a worker's function gets at once.
SLICE = 500


def mapped(df: DataFrame, takes: list[str], adds: str, work: Callable[..., list], *, claim_as: str = "", clear: Callable[[], None] = lambda: None, rows: int = SLICE, keep: bool = True, forget: bool = False) -> DataFrame:
    """df with the columns adds (as DDL), which replace columns of those names, computed by work from the values of takes.

    work gets a list of Python values for each column of takes, and returns a list or array for each of adds.  All
    other columns pass as Arrow data, unchanged: numbers beside nulls never become floating point.  Without keep, the
    columns of takes are left out.  claim_as and clear give the worker's memory for memos to this operator; with forget
    they are cleared at the end.
    """
    added = StructType.fromDDL(adds)
    new = {f.name.lower() for f in added}
    at = [next(i for i, f in enumerate(df.schema.fields) if f.name.lower() == t.lower()) for t in takes]
    kept = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in new and (keep or i not in at)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        if claim_as:
            claim(claim_as, clear)
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                found = work(*[part.column(i).to_pylist() for i in at])
                arrays = [part.column(i) for i in kept] + [pa.array(x, to_arrow_type(f.dataType)) for x, f in zip(found, added)]
                yield pa.RecordBatch.from_arrays(arrays, [b.schema.field(i).name for i in kept] + [f.name for f in added])
        give_back() if forget else trim()

    return df.mapInArrow(run, StructType([df.schema.fields[i] for i in kept] + added.fields))


_claimed: dict[str, object] = {}


def claim(name: str, clear) -> None:
    """Gives a worker's memory for memos to one operator: those of the others are cleared (workers outlive a stage)."""
    others = [n for n in _claimed if n != name]
    for other in others:
        _claimed.pop(other)()
    _claimed[name] = clear
    if others:
        trim()


def trim() -> None:
    """Returns a worker's freed memory to the system: it lives on beside the stages that follow, and beside the JVM."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if give is not None:
        give(0)


def give_back() -> None:
    """trim(), with the memos cleared first."""
    for clear in _claimed.values():
        clear()
    trim()
