"""Full trees dealt out evenly to parts, and put together again.

A full tree's arrays are rows (path, pos, value).  Each array is cut by items: values of plain arrays, points of a
subset (so its list and its data stay together), elements of a section.  A section's elements keep what is theirs:
polygons the stretch of ElementConnectivity that their offsets tell, with one more offset than there are elements,
elements of one kind as many values each as the kind has vertices, and ParentElements the left and the right cell.
Where a value goes is arithmetic, but for polygons: their values meet the stretches on (path, chunk of positions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

OFFSET, CORNERS, PARENTS = "ElementStartOffset", "ElementConnectivity", "ParentElements"
#: Positions of an array that meet the stretches of parts in one task.
CHUNK = 1 << 20


def _first(part: Column, items: Column, parts: int) -> Column:
    """The first of a part's items in an even split; the first parts have one more."""
    q, r = F.floor(items / parts), items % parts
    return (part * q + F.least(part.cast("long"), r)).cast("long")


def _owner(item: Column, items: Column, parts: int) -> Column:
    q, r = F.floor(items / parts), items % parts
    more = r * (q + 1)
    return F.when(item < more, F.floor(item / (q + 1))).otherwise(r + F.floor((item - more) / F.greatest(q, F.lit(1)))).cast("int")


def arrays(values: DataFrame, widths: DataFrame | None = None) -> DataFrame:
    """(path, kind, size, items, width): how each array is cut; one row an array.

    Kinds are offset, parents, polygons (connectivity beside offsets), elements (connectivity of sections with a row
    (section, width) in `widths`) and plain.
    """
    name, section = F.substring_index("path", "/", -1), F.regexp_replace("path", "/[^/]*$", "")
    d = values.groupBy("path").agg((F.max("pos") + 1).alias("size")).withColumns({"_name": name, "section": section})
    offsets = d.filter(F.col("_name") == OFFSET).select("section", (F.col("size") - 1).alias("_polygons"))
    d = d.join(offsets, "section", "left")
    d = d.join(widths.select("section", F.col("width").cast("long")), "section", "left") if widths is not None else d.withColumn("width", F.lit(None).cast("long"))
    corner, n = F.col("_name") == CORNERS, F.col("size")
    kind = F.when(F.col("_name") == OFFSET, "offset").when(F.col("_name") == PARENTS, "parents").when(corner & F.col("_polygons").isNotNull(), "polygons").when(corner & F.col("width").isNotNull(), "elements").otherwise("plain")
    d = d.withColumn("kind", kind)
    kind = F.col("kind")
    items = F.when(kind == "offset", n - 1).when(kind == "polygons", F.col("_polygons")).when(kind == "parents", F.floor(n / 2)).when(kind == "elements", F.floor(n / F.col("width"))).otherwise(n)
    return d.select("path", "kind", "size", items.cast("long").alias("items"), F.when(kind == "elements", F.col("width")).otherwise(F.lit(1)).cast("long").alias("width"))


def distributions(values: DataFrame, parts: int, widths: DataFrame | None = None) -> DataFrame:
    """(path, kind, part, first, last, total, low, high): each part's items of each array, and the positions of their values, both half-open.

    One row an array and part.  An offset array of n + 1 values has n items; parents go by item, left cells and right ones.
    """
    d = arrays(values, widths).select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    d = d.withColumns({"first": _first(F.col("part"), F.col("items"), parts), "last": _first(F.col("part") + 1, F.col("items"), parts)})
    section = F.regexp_replace("path", "/[^/]*$", "")
    at = lambda item, out: values.filter(F.col("path").endswith(f"/{OFFSET}")).select(section.alias("_section"), F.col("pos").alias(item), F.col("value").cast("long").alias(out))
    polygons = d.filter("kind = 'polygons'").withColumn("_section", section).join(at("first", "low"), ["_section", "first"]).join(at("last", "high"), ["_section", "last"])
    out = lambda d, low, high: d.select("path", "kind", "part", "first", "last", F.col("items").alias("total"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    rest = d.filter("kind <> 'polygons'")
    high = F.when(F.col("kind") == "offset", F.col("last") + 1).otherwise(F.col("last") * F.col("width"))
    return out(rest, F.col("first") * F.col("width"), high).unionByName(out(polygons, F.col("low"), F.col("high")))


def distributed(values: DataFrame, parts: int, widths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((path, part, pos, value), distributions): the full arrays dealt out, positions counted in the part from 0.

    Parts without items have no values, but for the one offset that an empty list of polygons has.
    """
    if parts < 1:
        raise ValueError("a tree needs a part at least")
    shares = stored(distributions(values, parts, widths), "distributions")
    a = arrays(values, widths)
    d = values.join(a, "path")
    pos, n, w, kind = F.col("pos"), F.col("items"), F.col("width"), F.col("kind")
    plain = d.filter(kind.isin("plain", "elements", "parents"))
    item = F.when(kind == "parents", pos % F.greatest(n, F.lit(1))).otherwise(F.floor(pos / w))
    plain = plain.withColumn("_item", item.cast("long")).withColumn("part", _owner(F.col("_item"), n, parts))
    first, last = _first(F.col("part"), n, parts), _first(F.col("part") + 1, n, parts)
    local = F.when(kind == "parents", F.col("_item") - first + F.when(pos >= n, last - first).otherwise(0)).otherwise(pos - first * w)
    plain = plain.select("path", "part", local.cast("long").alias("pos"), "value")
    # An offset ends one item and begins the next, so it may be needed by two parts, the last one by all empty parts.
    low = F.when((pos == 0) | (n == 0), F.lit(0)).otherwise(_owner(pos - 1, n, parts))
    high = F.when(pos < n, _owner(pos, n, parts)).otherwise(F.lit(parts - 1))
    offsets = d.filter(kind == "offset").withColumn("part", F.explode(F.sequence(low, high)))
    offsets = offsets.select("path", "part", (pos - _first(F.col("part"), n, parts)).cast("long").alias("pos"), "value")
    chunk = lambda c: F.floor(c / CHUNK).cast("long")
    stretches = shares.filter("kind = 'polygons' and low < high").select("path", "part", "low", "high", F.explode(F.sequence(chunk(F.col("low")), chunk(F.col("high") - 1))).alias("_chunk"))
    corners = d.filter(kind == "polygons").select("path", "pos", "value", chunk(pos).alias("_chunk")).join(stretches, ["path", "_chunk"]).filter((pos >= F.col("low")) & (pos < F.col("high")))
    corners = corners.select("path", "part", (pos - F.col("low")).alias("pos"), "value")
    return plain.unionByName(offsets).unionByName(corners), shares


def whole(values: DataFrame, shares: DataFrame) -> DataFrame:
    """(path, pos, value): the full arrays of distributed ones; what two parts hold, shared offsets, comes once."""
    d = values.join(shares, ["path", "part"])
    pos, first, last, total = (F.col(c) for c in ("pos", "first", "last", "total"))
    n = last - first
    at = F.when(F.col("kind") == "parents", first + pos % F.greatest(n, F.lit(1)) + F.when(pos >= n, total).otherwise(0)).otherwise(F.col("low") + pos)
    d = d.withColumn("_at", at.cast("long"))
    ends = (F.col("_at") == total) & ((first < total) | ((total == 0) & (F.col("part") == 0)))
    return d.filter((F.col("kind") != "offset") | (F.col("_at") < last) | ends).select("path", F.col("_at").alias("pos"), "value")
