"""Place of a grid cell on a Hilbert curve as a column expression."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _steps(dim: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """For each orientation and each sub-cell: its place among the sub-cells, and the orientation inside it.

    An orientation is the corner where the curve enters a cell and the direction in which it leaves.  Within a cell the
    sub-cells follow a Gray code, turned so that it starts and ends there.
    """
    n, full = 1 << dim, (1 << dim) - 1
    gray = lambda x: x ^ (x >> 1)
    turn = lambda x, k: ((x << k % dim) | (x >> (dim - k % dim))) & full
    place = {gray(w): w for w in range(n)}
    flipped = lambda w: ((gray(w) ^ gray(w + 1)).bit_length() - 1) % dim  # noqa: E731 - the bit that changes after w
    places, inner = [], []
    for entry in range(n):
        for axis in range(dim):
            for cell in range(n):
                w = place[turn(cell ^ entry, -(axis + 1) % dim)]
                start = gray((w - 1) // 2 * 2) if w else 0
                along = 0 if w == 0 else flipped(w - 1 if w % 2 == 0 else w)
                places.append(w)
                inner.append((entry ^ turn(start, axis + 1)) * dim + (axis + along + 1) % dim)
    return tuple(places), tuple(inner)


def hilbert_key(at: Sequence[Column], bits: int) -> Column:
    """The place (from 0) on the curve of the cell with the given coordinates, each from 0 to 2 ** bits - 1; dim * bits must stay below 64."""
    dim = len(at)
    places, inner = (F.array(*[F.lit(x) for x in t]) for t in _steps(dim))
    bit = lambda c, level: F.expr("0L") + F.call_function("shiftright", c, level) % 2
    sub = lambda level: sum((bit(c, level) * (1 << a) for a, c in enumerate(at[1:], 1)), bit(at[0], level))
    cells = F.array(*[sub(F.lit(level)).cast("int") for level in range(bits - 1, -1, -1)])
    start = F.struct(F.lit(0).cast("long").alias("key"), F.lit(0).alias("turn"))
    step = lambda s, c: F.struct((s["key"] * (1 << dim) + places[s["turn"] * (1 << dim) + c]).alias("key"), inner[s["turn"] * (1 << dim) + c].alias("turn"))
    return F.aggregate(cells, start, step, lambda s: s["key"])


def hilbert_of_points(at: Sequence[Column], low: Sequence[float], high: Sequence[float], bits: int = 16) -> Column:
    """The same for points in a box; points outside count as on its border."""
    top = (1 << bits) - 1
    cell = lambda c, a, b: F.greatest(F.least(F.floor((c - a) * ((1 << bits) / ((b - a) or 1.0))), F.lit(top)), F.lit(0)).cast("long")
    return hilbert_key([cell(c, a, b) for c, a, b in zip(at, low, high)], bits)
