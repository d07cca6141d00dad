"""Arrays and names as column expressions: interlacing, regrouping, circular order, searching, suffixes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def interweave(*arrays: Column) -> Column:
    """a1, b1, a2, b2, .. of arrays of one length."""
    n = F.size(arrays[0])
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(*[F.get(a, i) for a in arrays])))


def unwoven(array: Column, n: int) -> list[Column]:
    """The n arrays that were interwoven."""
    return [F.filter(array, _every(n, k)) for k in range(n)]


def _every(n: int, k: int) -> Callable:
    return lambda x, i: i % n == k


def offsets(sizes: Column) -> Column:
    """0 and the running sums of an array of sizes."""
    return F.aggregate(sizes, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def regrouped(array: Column, counts: Column) -> Column:
    """The array cut into pieces of the given counts."""
    at = offsets(counts)
    return F.transform(counts, lambda n, i: F.slice(array, (F.get(at, i) + 1).cast("int"), n.cast("int")))


def buckets(array: Column, key: Callable[[Column], Column], n: int) -> Column:
    """n arrays: the elements by their key 0..n - 1, in order."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.filter(array, lambda x: key(x) == k))


def appended_once(array: Column, item: Column) -> Column:
    """The array with the item at its end, unless it has it."""
    return F.when(F.array_contains(array, item), array).otherwise(F.concat(array, F.array(item)))


def rotated(array: Column, i: Column) -> Column:
    """The circular array from place i (0-based) on."""
    return F.concat(F.slice(array, i + 1, F.size(array)), F.slice(array, F.lit(1), i))


def ordered_subset(subset: Column, array: Column) -> Column:
    """The rotation of subset, or of its reverse, that stands in the circular array without gaps; null if none does."""
    n = F.size(subset)
    # Lambdas evaluate what they close over for every element, so arrays that they share are made once, as fields of a struct.
    once = lambda value, body: F.get(F.transform(F.array(value), body), 0)
    both = F.struct(subset.alias("s"), F.reverse(subset).alias("r"), F.concat(array, array).alias("twice"), F.sequence(F.lit(0), n - 1).alias("places"))
    turned = lambda b: F.concat(F.transform(b["places"], lambda i: rotated(b["s"], i)), F.transform(b["places"], lambda i: rotated(b["r"], i)))
    windows = lambda b: F.transform(F.sequence(F.lit(1), F.size(array)), lambda i: F.slice(b["twice"], i, F.size(b["s"])))
    found = once(both, lambda b: once(windows(b), lambda w: F.get(F.filter(turned(b), lambda t: F.array_contains(w, t)), 0)))
    return F.when((n > 0) & (n <= F.size(array)), found)


def is_before(array: Column, a: Column, b: Column) -> Column:
    """Whether a is found before b; false if a is missing, true if only b is."""
    i, j = F.array_position(array, a), F.array_position(array, b)
    return (i > 0) & ((j == 0) | (i < j))


def first_place(array: Column, predicate: Callable[[Column], Column]) -> Column:
    """0-based place of the first element that matches, or the array's length."""
    at = F.array_position(F.transform(array, lambda x: F.coalesce(predicate(x), F.lit(False))), F.lit(True)).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(array))


def mismatch(a: Column, b: Column) -> Column:
    """0-based place of the first difference, or the shorter length."""
    n = F.least(F.size(a), F.size(b))
    at = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    return F.when(at > 0, at - 1).otherwise(n)


def begins_with(array: Column, start: Column) -> Column:
    return (F.size(start) <= F.size(array)) & (mismatch(array, start) == F.size(start))


def split_by(array: Column, predicate: Callable[[Column], Column]) -> tuple[Column, Column]:
    """The elements that match, and the others."""
    return F.filter(array, predicate), F.filter(array, lambda x: ~F.coalesce(predicate(x), F.lit(False)))


def gathered(array: Column, places: Column, stride: int = 1, shift: int = 0) -> Column:
    """The items of `stride` values at the given places, which count from shift."""
    return F.flatten(F.transform(places, lambda p: F.slice(array, ((p - shift) * stride + 1).cast("int"), stride)))


def checked_int(value: Column) -> Column:
    """value as a 32-bit integer; an error where it does not fit."""
    return F.when(value.between(-(1 << 31), (1 << 31) - 1) | value.isNull(), value).otherwise(F.raise_error(F.lit("value does not fit in 32 bits"))).cast("int")


def flags(size: int, key: str) -> list[bool]:
    """A mask from a keyword: all, none, or the place (first, last) alone."""
    wanted = {"all": range(size), "none": (), "first": range(min(1, size)), "last": range(max(0, size - 1), size)}
    if key not in wanted:
        raise ValueError(f"unknown key: {key}")
    return [i in wanted[key] for i in range(size)]


def vector_names(names: Iterable[str], dim: int = 3) -> list[str]:
    """The sorted base names for which all of nameX, nameY (and nameZ) are given."""
    have = set(names)
    return sorted(n[:-1] for n in have if n[-1:] == "X" and all(n[:-1] + c in have for c in "XYZ"[:dim]))


def subset_with_sum(values: Sequence[int], total: int, most: int = 1 << 24) -> list[int] | None:
    """Places of values (positive) that add up to total, or None; the search keeps one bit for each sum up to total, which `most` bounds."""
    if not 0 <= total <= most:
        return None
    reach = [1]
    for v in values:
        reach.append((reach[-1] | reach[-1] << v) & ((1 << total + 1) - 1))
    if not reach[-1] >> total & 1:
        return None
    out = []
    for i in range(len(values) - 1, -1, -1):
        if not reach[i] >> total & 1:
            out.append(i)
            total -= values[i]
    return out[::-1]


PART = r"\.P([0-9]+)\.N([0-9]+)$"


def with_part(name: Column, rank: Column, part: Column) -> Column:
    return F.concat(name, F.lit(".P"), rank.cast("string"), F.lit(".N"), part.cast("string"))


def without_part(name: Column) -> Column:
    return F.regexp_replace(name, PART, "")


def part_of(name: Column) -> Column:
    """struct(rank, part) from a name's suffix; null without one."""
    get = lambda k: F.regexp_extract(name, PART, k).cast("int")
    return F.when(name.rlike(PART), F.struct(get(1).alias("rank"), get(2).alias("part")))


def with_split(name: Column, count: Column) -> Column:
    return F.concat(name, F.lit("."), count.cast("string"))


def without_split(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def split_of(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def internal_join_name(rank: Column, part: Column, other_rank: Column, other_part: Column) -> Column:
    return F.concat(F.lit("JN"), *[c for p, n, s in ((rank, part, ""), (other_rank, other_part, ".LT")) for c in (F.lit(f"{s}.P"), p.cast("string"), F.lit(".N"), n.cast("string"))])


def is_internal_join(name: Column) -> Column:
    return name.rlike(r"^JN\.P[0-9]+\.N[0-9]+\.LT\.P[0-9]+\.N[0-9]+")


def is_valid_name(name: Column, longest: int | None = 32) -> Column:
    """Not empty, not . or .., without a slash, and not above the longest length."""
    ok = (F.length(name) > 0) & ~name.isin(".", "..") & ~name.contains("/")
    return F.coalesce(ok if longest is None else ok & (F.length(name) <= longest), F.lit(False))


def shortened(name: Column, longest: int = 32) -> Column:
    """Names above the longest length keep upper-case letters and at most three characters after each."""
    return F.when(F.length(name) > longest, F.regexp_replace(name, "([^A-Z]{3})[^A-Z]+", "$1")).otherwise(name)


def path_with(path: Column, i: int, change: Callable[[Column], Column]) -> Column:
    """The path with its i-th element (0-based, or from the end if negative) changed."""
    parts = F.split(path, "/")
    at = F.lit(i) if i >= 0 else F.size(parts) + i
    return F.array_join(F.transform(parts, lambda x, k: F.when(k == at, change(x)).otherwise(x)), "/")


def is_label(label: Column) -> Column:
    return label.rlike(r"^[A-Za-z0-9]+_t$")

