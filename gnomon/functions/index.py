"""Index arithmetic of structured blocks as column expressions: (i, j, k) and linear numbers count from 1, i runs fastest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]
Size = Sequence[int]


def _cells(n_vtx: Size) -> tuple[int, ...]:
    return tuple(max(n - 1, 1) for n in n_vtx)


def ijk_to_index(i: Column, j: Column, k: Column, n: Size) -> Column:
    return i + (j - 1) * n[0] + (k - 1) * (n[0] * n[1])


def index_to_ijk(index: Column, n: Size) -> Triple:
    z = index - 1
    plane = n[0] * n[1]
    return F.pmod(z, F.lit(n[0])) + 1, F.pmod(F.floor(z / n[0]), F.lit(n[1])) + 1, F.floor(z / plane) + 1


def face_counts(n_vtx: Size) -> tuple[int, int, int]:
    """Faces normal to i, j and k."""
    (a, b, c), (x, y, z) = n_vtx, _cells(n_vtx)
    return a * y * z, x * b * z, x * y * c


def face_index(axis: int, i: Column, j: Column, k: Column, n_vtx: Size) -> Column:
    """Number of a face normal to the axis (0, 1, 2), after all faces of the axes before."""
    n = [v if a == axis else c for a, (v, c) in enumerate(zip(n_vtx, _cells(n_vtx)))]
    return ijk_to_index(i, j, k, n) + sum(face_counts(n_vtx)[:axis])


def face_ijk(axis: int, index: Column, n_vtx: Size) -> Triple:
    n = [v if a == axis else c for a, (v, c) in enumerate(zip(n_vtx, _cells(n_vtx)))]
    return index_to_ijk(index - sum(face_counts(n_vtx)[:axis]), n)


def face_parents(axis: int, index: Column, n_vtx: Size) -> tuple[Column, Column]:
    """Cells on both sides of a face; 0 outside.  On a face at the low end the inner cell comes first."""
    n_cell = _cells(n_vtx)
    ijk = list(face_ijk(axis, index, n_vtx))
    here = ijk_to_index(*ijk, n_cell)
    step = (1, n_cell[0], n_cell[0] * n_cell[1])[axis]
    low, high = ijk[axis] == 1, ijk[axis] == n_vtx[axis]
    return F.when(low, here).otherwise(here - step), F.when(low | high, F.lit(0)).otherwise(here)


def face_vertices(axis: int, index: Column, n_vtx: Size) -> Column:
    """The four vertices of a face, in a cycle; its normal points to the higher cell, and outwards on the low end."""
    i, j, k = face_ijk(axis, index, n_vtx)
    u, v = {0: ((0, 1, 0), (0, 0, 1)), 1: ((0, 0, 1), (1, 0, 0)), 2: ((1, 0, 0), (0, 1, 0))}[axis]
    at = lambda *d: ijk_to_index(i + d[0], j + d[1], k + d[2], n_vtx)
    both = tuple(a + b for a, b in zip(u, v))
    forward = F.array(at(0, 0, 0), at(*u), at(*both), at(*v))
    backward = F.array(at(0, 0, 0), at(*v), at(*both), at(*u))
    return F.when((i, j, k)[axis] == 1, backward).otherwise(forward)


def entity_size(location: str, n_vtx: Size) -> tuple[int, ...]:
    n_cell = _cells(n_vtx)
    axis = {"IFaceCenter": 0, "JFaceCenter": 1, "KFaceCenter": 2}.get(location)
    if location == "Vertex":
        return tuple(n_vtx)
    if location == "CellCenter":
        return n_cell
    if axis is None:
        raise ValueError(f"unknown location {location}")
    return tuple(v if a == axis else c for a, (v, c) in enumerate(zip(n_vtx, n_cell)))


def index_from_location(i: Column, j: Column, k: Column, location: str, n_vtx: Size) -> Column:
    axis = "IJK".find(location[0]) if location.endswith("FaceCenter") else -1
    return face_index(axis, i, j, k, n_vtx) if axis >= 0 else ijk_to_index(i, j, k, entity_size(location, n_vtx))


def location_from_index(index: Column, location: str, n_vtx: Size) -> Triple:
    axis = "IJK".find(location[0]) if location.endswith("FaceCenter") else -1
    return face_ijk(axis, index, n_vtx) if axis >= 0 else index_to_ijk(index, entity_size(location, n_vtx))


def transform_point(transform: Sequence[int], point: Sequence[Column], start: Sequence[int], donor_start: Sequence[int]) -> list[Column]:
    """A point's image through a signed axis permutation: axis a of the point goes to axis |transform[a]|."""
    out: list[Column] = [F.lit(d) for d in donor_start]
    for a, t in enumerate(transform):
        out[abs(t) - 1] = F.lit(donor_start[abs(t) - 1]) + (1 if t > 0 else -1) * (point[a] - start[a])
    return out


def transform_window(transform: Sequence[int], corners: Sequence[Sequence[Column]], start: Sequence[int], donor_start: Sequence[int]) -> list[list[Column]]:
    """Both corners of a window through a signed axis permutation; a reversed axis gives a descending pair."""
    return [transform_point(transform, c, start, donor_start) for c in corners]


def normal_shift(first: Column, n_vtx: int, source: str, target: str) -> Column:
    """What is added to the normal index of a boundary range when its location changes: the last vertex layer is one beyond the last cell layer."""
    vertex = lambda x: x not in ("CellCenter", "Cell")
    if vertex(source) == vertex(target):
        return F.lit(0)
    return F.when(first == n_vtx, -1).otherwise(0) if vertex(source) else F.when(first == n_vtx - 1, 1).otherwise(0)


def boundary_size(sizes: Sequence[Column], axis: int, source: str, target: str) -> list[Column]:
    """The size of a boundary range in another location: one less in each tangential direction from vertices to faces or cells, one more back."""
    by = (target == "Vertex") - (source == "Vertex")
    return [s if a == axis else s + by for a, s in enumerate(sizes)]


def slabs(shape: Sequence[int], first: int, last: int) -> list[list[tuple[int, int]]]:
    """Half-open boxes, at most 2 * len(shape) - 1, that hold places first..last - 1 of an array (the first axis fastest), in order."""
    if first >= last:
        return []
    if len(shape) == 1:
        return [[(first, last)]]
    *inner, _ = shape
    plane = 1
    for n in inner:
        plane *= n
    a, b = first // plane, (last - 1) // plane
    whole = [(0, n) for n in inner]
    if a == b:
        return [[*s, (a, a + 1)] for s in slabs(inner, first - a * plane, last - a * plane)]
    out = []
    low, high = a, b + 1
    if first % plane:
        out += [[*s, (a, a + 1)] for s in slabs(inner, first % plane, plane)]
        low += 1
    tail = []
    if last % plane:
        tail = [[*s, (b, b + 1)] for s in slabs(inner, 0, last % plane)]
        high -= 1
    if low < high:
        out.append([*whole, (low, high)])
    return out + tail


def zero_based(index: Column, line: int, plane: int) -> Triple:
    """(i, j, k) from 0 of a 0-based place."""
    return F.pmod(index, F.lit(line)), F.floor(F.pmod(index, F.lit(plane)) / line), F.floor(index / plane)
