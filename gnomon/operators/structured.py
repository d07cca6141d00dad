"""Joins of structured zones, cut on both sides at once by the boxes that the zones were partitioned into.

A join is a row: name, zone, donor_zone, donor_name, its window of vertices i0, i1, j0, j1, k0, k1 (closed, ascending, flat
in one direction), the donor's di0, di1, .. (from the vertex that the window's first corner meets to the one its last
corner meets) and the transform t1, t2, t3: own axis a runs along the donor's axis |t_a|, backwards if t_a is negative.
Boxes are rows: zone, part, and half-open ranges of cells bi0, bi1, bj0, .. from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = "ijk"


def _by_axis(number: Column, of: list[Column]) -> Column:
    """of[|number| - 1]."""
    return F.when(F.abs(number) == 1, of[0]).when(F.abs(number) == 2, of[1]).otherwise(of[2])


def _source(axis: int) -> Column:
    """The own axis, 1 to 3, that runs along the donor's."""
    return F.when(F.abs("t1") == axis, 1).when(F.abs("t2") == axis, 2).otherwise(3)


def _clipped(d: DataFrame, low: list[Column], high: list[Column], box: str, names: str) -> DataFrame:
    """Windows low..high met with the vertices of boxes whose columns begin with `box`, as columns names0i, names1i, ..; what has no area goes."""
    out, keep = {}, F.lit(True)
    for a, lo, hi in zip(AXES, low, high):
        first, last = F.greatest(lo, F.col(f"{box}{a}0") + 1), F.least(hi, F.col(f"{box}{a}1") + 1)
        out |= {f"{names}0{a}": first, f"{names}1{a}": last}
        keep = keep & ((first < last) | ((lo == hi) & (first == last)))
    return d.filter(keep).withColumns(out)


def split_joins(joins: DataFrame, boxes: DataFrame) -> DataFrame:
    """A row for each join, part of its zone and part of the donor's that meet in it: name, zone, part, donor_zone, donor_name, donor_part, windows as of joins in the vertices of the parts, transform.

    Windows are cut by the zone's boxes, carried over to the donor, cut by its boxes and carried back, so both sides have the
    same pieces.  Two boxes share one piece of a join at most: it is called name.P<part>.P<donor_part>, and its donor
    donor_name.P<donor_part>.P<part>.  Equi-joins on the zone; all else is arithmetic.
    """
    of = lambda zone, box, part: boxes.select(F.col("zone").alias(zone), F.col("part").alias(part), *[F.col(f"b{a}{s}").alias(f"{box}{a}{s}") for a in AXES for s in "01"])
    d = joins.join(of("zone", "_own", "part"), "zone")
    own = lambda s: [F.col(f"{a}{s}") for a in AXES]
    d = _clipped(d, own(0), own(1), "_own", "_w")
    # Donor's axis b at own place p: its start, and on by what p is from the window's start, forth or back.
    sign = lambda b: F.signum(_by_axis(_source(b), [F.col("t1"), F.col("t2"), F.col("t3")])).cast("long")
    over = lambda b, side: F.col(f"d{AXES[b - 1]}0") + sign(b) * (_by_axis(_source(b), [F.col(f"_w{side}{a}") for a in AXES]) - _by_axis(_source(b), own(0)))
    d = d.withColumns({f"_o{side}{AXES[b - 1]}": over(b, side) for b in (1, 2, 3) for side in "01"})
    d = d.join(of("donor_zone", "_far", "donor_part"), "donor_zone")
    d = _clipped(d, [F.least(f"_o0{a}", f"_o1{a}") for a in AXES], [F.greatest(f"_o0{a}", f"_o1{a}") for a in AXES], "_far", "_d")
    out: dict[str, Column] = {}
    for n, a in enumerate(AXES, 1):
        t = F.col(f"t{n}")
        start, low, high = (_by_axis(t, [F.col(c.format(b)) for b in AXES]) for c in ("d{}0", "_d0{}", "_d1{}"))
        back = lambda at: F.col(f"{a}0") + F.signum(t).cast("long") * (at - start)  # noqa: B023, E731
        out |= {f"{a}0": F.least(back(low), back(high)) - F.col(f"_own{a}0"), f"{a}1": F.greatest(back(low), back(high)) - F.col(f"_own{a}0")}
    for b, a in enumerate(AXES, 1):
        ends = (F.col(f"_d0{a}") - F.col(f"_far{a}0"), F.col(f"_d1{a}") - F.col(f"_far{a}0"))
        out |= {f"d{a}0": F.when(sign(b) < 0, ends[1]).otherwise(ends[0]), f"d{a}1": F.when(sign(b) < 0, ends[0]).otherwise(ends[1])}
    piece = lambda name, p, q: F.concat(name, F.lit(".P"), F.col(p).cast("string"), F.lit(".P"), F.col(q).cast("string")).alias(name)
    return d.select(piece("name", "part", "donor_part"), "zone", "part", "donor_zone", piece("donor_name", "donor_part", "part"), "donor_part", *[c.cast("long").alias(k) for k, c in out.items()], "t1", "t2", "t3")


def window_items(joins: DataFrame) -> DataFrame:
    """(name, n): the faces of each window."""
    n = F.lit(1)
    for a in AXES:
        n = n * F.greatest(F.lit(1), F.col(f"{a}1") - F.col(f"{a}0"))
    return joins.select("name", n.cast("long").alias("n"))


def ranges_from_parts(ranges: DataFrame, boxes: DataFrame) -> DataFrame:
    """(zone, name, i0, i1, ..): the ranges of whole zones from those of their parts (zone, part, name, i0, i1, .. in the part's own indices).

    A direction that runs down in any part runs down in the whole; pieces of a join (name.P..) are given their first name.
    """
    d = ranges.join(boxes.select("zone", "part", *[F.col(f"b{a}0").alias(f"_{a}") for a in AXES]), ["zone", "part"])
    low = {a: F.min(F.least(f"{a}0", f"{a}1") + F.col(f"_{a}")) for a in AXES}
    high = {a: F.max(F.greatest(f"{a}0", f"{a}1") + F.col(f"_{a}")) for a in AXES}
    down = {a: F.bool_or(F.col(f"{a}0") > F.col(f"{a}1")) for a in AXES}
    d = d.withColumn("name", F.regexp_replace("name", r"(\.P[0-9]+)+$", ""))
    out = [F.when(down[a], one).otherwise(other).cast("long").alias(f"{a}{s}") for a in AXES for s, one, other in (("0", high[a], low[a]), ("1", low[a], high[a]))]
    return d.groupBy("zone", "name").agg(*out)


def range_numbers(ranges: DataFrame, boxes: DataFrame, whole: DataFrame) -> DataFrame:
    """(zone, part, name, place, gnum): the items of each part's range (ascending) in its own order from 1, with their numbers among those of the whole range (zone, name, i0, ..)."""
    d = ranges.join(boxes.select("zone", "part", *[F.col(f"b{a}0").alias(f"_{a}") for a in AXES]), ["zone", "part"])
    d = d.join(whole.select("zone", "name", *[F.col(f"{a}{s}").alias(f"_w{a}{s}") for a in AXES for s in "01"]), ["zone", "name"])
    for a in reversed(AXES):
        d = d.withColumn(f"_p{a}", F.explode(F.sequence(F.col(f"{a}0").cast("long"), F.col(f"{a}1").cast("long"))))
    place, gnum, step, wide = F.lit(1), F.lit(1), F.lit(1), F.lit(1)
    for a in AXES:
        place = place + (F.col(f"_p{a}") - F.col(f"{a}0")) * step
        gnum = gnum + (F.col(f"_p{a}") + F.col(f"_{a}") - F.least(f"_w{a}0", f"_w{a}1")) * wide
        step, wide = step * (F.col(f"{a}1") - F.col(f"{a}0") + 1), wide * (F.abs(F.col(f"_w{a}1") - F.col(f"_w{a}0")) + 1)
    return d.select("zone", "part", "name", place.cast("long").alias("place"), gnum.cast("long").alias("gnum"))
