"""Geometry as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from math import cos, sin

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotation_matrix(angles: Sequence[float]) -> list[list[float]]:
    """Rotations about x, then y, then z."""
    (a, b, c) = angles
    x = [[1, 0, 0], [0, cos(a), -sin(a)], [0, sin(a), cos(a)]]
    y = [[cos(b), 0, sin(b)], [0, 1, 0], [-sin(b), 0, cos(b)]]
    z = [[cos(c), -sin(c), 0], [sin(c), cos(c), 0], [0, 0, 1]]
    mul = lambda p, q: [[sum(p[i][k] * q[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    return mul(z, mul(y, x))


def affine(point: Sequence[Column], angles: Sequence[float] = (0, 0, 0), centre: Sequence[float] = (0, 0, 0), shift: Sequence[float] = (0, 0, 0)) -> list[Column]:
    """Rotation about the centre, then a shift."""
    m = rotation_matrix(angles)
    d = [p - c for p, c in zip(point, centre)]
    return [sum((d[j] * m[i][j] for j in range(1, 3)), d[0] * m[i][0]) + (centre[i] + shift[i]) for i in range(3)]


def rotate_vector(vector: Sequence[Column], angles: Sequence[float]) -> list[Column]:
    """Vectors turn with the axes, whatever the centre."""
    return affine(vector, angles)


def norm(vector: Sequence[Column]) -> Column:
    return F.sqrt(sum((v * v for v in vector[1:]), vector[0] * vector[0]))


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return norm([x - y for x, y in zip(a, b)])
