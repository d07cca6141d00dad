"""Generated meshes and point clouds: one range of numbers, every value an expression of its own number.

Nothing is shuffled: a cell, face or vertex of a generated mesh is computed from its number alone, in any partition.
Tables are those of the mesh module: vertices (vertex, x, y, z), cells (cell, vtx), faces (face, left, right, vtx),
subset items (name, element).
"""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import index
from . import mesh

SIDES = ("Xmin", "Xmax", "Ymin", "Ymax", "Zmin", "Zmax")

# A hexahedron as other elements, by 1-based positions in HEXA_8 (9 is the centre of the block, for pyramids).
CUTS = {
    "HEXA_8": ((1, 2, 3, 4, 5, 6, 7, 8),),
    "PENTA_6": ((1, 2, 4, 5, 6, 8), (2, 3, 4, 6, 7, 8)),
    "TETRA_4": ((1, 2, 3, 7), (1, 3, 4, 7), (1, 4, 8, 7), (1, 8, 5, 7), (1, 5, 6, 7), (1, 6, 2, 7)),
    "PYRA_5": ((1, 2, 3, 4, 9), (1, 5, 6, 2, 9), (2, 6, 7, 3, 9), (3, 7, 8, 4, 9), (1, 4, 8, 5, 9), (5, 8, 7, 6, 9)),
    "QUAD_4": ((1, 2, 3, 4),),
    "TRI_3": ((1, 2, 3), (1, 3, 4)),
}


def _numbered(spark: SparkSession, n: int, name: str) -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", name)


def cartesian_points(spark: SparkSession, n_vtx: Sequence[int], low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """(vertex, x, y, z) of an even grid in one, two or three dimensions; x runs fastest.  A direction of one point lies at `low`."""
    n = [*n_vtx, 1, 1][:3]
    d = _numbered(spark, n[0] * n[1] * n[2], "vertex")
    step = [(b - a) / (m - 1) if m > 1 else 0.0 for a, b, m in zip(low, high, n_vtx)]
    at = index.index_to_ijk(F.col("vertex"), n)
    return d.select("vertex", *[(F.lit(float(a)) + (p - 1) * F.lit(s)).alias(c) for c, p, a, s in zip("xyz", at, low, step)])


def random_points(spark: SparkSession, n: int, low: Sequence[float], high: Sequence[float], seed: int = 0) -> DataFrame:
    """(vertex, x, y, z) even in a box.  Values are hashes of number and seed, so they do not depend on partitions."""
    part = lambda i: F.shiftrightunsigned(F.xxhash64(F.col("vertex"), F.lit(seed), F.lit(i)), 11) / F.lit(float(1 << 53))
    return _numbered(spark, n, "vertex").select("vertex", *[(F.lit(float(a)) + part(i) * float(b - a)).alias(c) for i, (c, a, b) in enumerate(zip("xyz", low, high))])


def cube_vertices(spark: SparkSession, n_vtx: Sequence[int], origin: Sequence[float] = (0, 0, 0), edge: float = 1.0) -> DataFrame:
    return cartesian_points(spark, n_vtx, origin, [o + (edge if n > 1 else 0) for o, n in zip(origin, n_vtx)])


def cube_faces(spark: SparkSession, n_vtx: Sequence[int]) -> DataFrame:
    """(face, left, right, vtx) of a block: faces normal to i, then j, then k; 0 where a side is outside."""
    counts = index.face_counts(n_vtx)
    d = _numbered(spark, sum(counts), "face")
    g = F.col("face")
    left, right = zip(*[index.face_parents(a, g, n_vtx) for a in range(3)])
    vtx = [index.face_vertices(a, g, n_vtx) for a in range(3)]
    pick = lambda x: F.when(g <= counts[0], x[0]).when(g <= counts[0] + counts[1], x[1]).otherwise(x[2])
    return d.select("face", pick(left).cast("long").alias("left"), pick(right).cast("long").alias("right"), pick(vtx).cast("array<long>").alias("vtx"))


def cube_boundaries(spark: SparkSession, n_vtx: Sequence[int]) -> DataFrame:
    """(name, element): the faces of a block on each of its six sides, numbered as in cube_faces."""
    n = [max(v - 1, 1) for v in n_vtx]
    out = None
    for s, name in enumerate(SIDES):
        axis, upper = divmod(s, 2)
        a, b = [x for x in range(3) if x != axis]
        d = spark.range(n[a] * n[b])
        at: list[Column] = [F.lit(1)] * 3
        at[axis] = F.lit(n_vtx[axis] if upper else 1)
        at[a], at[b] = F.col("id") % n[a] + 1, F.floor(F.col("id") / n[a]) + 1
        d = d.select(F.lit(name).alias("name"), index.face_index(axis, *at, n_vtx).cast("long").alias("element"))
        out = d if out is None else out.unionByName(d)
    return out


def cube_cells(spark: SparkSession, n_vtx: Sequence[int], kind: str = "HEXA_8") -> DataFrame:
    """(cell, vtx) of a block cut into elements of one kind, those of a block cell in a row.

    For pyramids, vertices n + 1.. are the centres of the block cells (see cube_centres).  The six tetrahedra share the
    same diagonals across neighbours, so the mesh is conforming.  With one vertex in z, QUAD_4 and TRI_3 fill the plane.
    """
    cuts = CUTS[kind]
    n_cell = [max(v - 1, 1) for v in n_vtx]
    total = n_cell[0] * n_cell[1] * n_cell[2]
    block = F.col("block")
    if kind in ("QUAD_4", "TRI_3"):
        i, j, k = index.index_to_ijk(block, n_cell)
        corners = F.array(*[index.ijk_to_index(i + a, j + b, k, n_vtx).cast("long") for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    else:
        corners = F.concat(mesh.block_vertices(block, n_vtx), F.array((block + n_vtx[0] * n_vtx[1] * n_vtx[2]).cast("long")))
    d = _numbered(spark, total, "block").select("block", corners.alias("c"))
    c = F.col("c")
    d = d.select("block", F.posexplode(F.array(*[F.array(*[c[p - 1] for p in cut]) for cut in cuts])).alias("pos", "vtx"))
    return d.select(((block - 1) * len(cuts) + F.col("pos") + 1).cast("long").alias("cell"), "vtx")


def cube_centres(spark: SparkSession, n_vtx: Sequence[int], origin: Sequence[float] = (0, 0, 0), edge: float = 1.0) -> DataFrame:
    """(vertex, x, y, z): the centres of the cells of a block, numbered after its vertices."""
    n = [v - 1 for v in n_vtx]
    step = [edge / m for m in n]
    d = cartesian_points(spark, n, [o + s / 2 for o, s in zip(origin, step)], [o + edge - s / 2 for o, s in zip(origin, step)])
    return d.withColumn("vertex", F.col("vertex") + n_vtx[0] * n_vtx[1] * n_vtx[2])


def plane_polygons(spark: SparkSession, nx: int, ny: int, jitter: float = 0.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(vertices, cells) of a plane of nx x ny points on the unit square, every other cell cut in two triangles; inner points may be moved by up to `jitter` steps."""
    v = cartesian_points(spark, (nx, ny), (0, 0), (1, 1))
    i, j, _ = index.index_to_ijk(F.col("vertex"), (nx, ny, 1))
    inner = (i > 1) & (i < nx) & (j > 1) & (j < ny)
    moved = lambda a, n: (F.shiftrightunsigned(F.xxhash64(F.col("vertex"), F.lit(seed), F.lit(a)), 11) / F.lit(float(1 << 53)) - 0.5) * (2 * jitter / (n - 1))
    v = v.select("vertex", *[F.when(inner, F.col(c) + moved(a, n)).otherwise(F.col(c)).alias(c) for a, (c, n) in enumerate((("x", nx), ("y", ny)))], F.lit(0.0).alias("z"))
    q = cube_cells(spark, (nx, ny, 1), "QUAD_4")
    ci, cj, _ = index.index_to_ijk(F.col("cell"), (nx - 1, ny - 1, 1))
    c = F.col("vtx")
    both = F.array(F.array(c[0], c[1], c[2]), F.array(c[0], c[2], c[3]))
    q = q.select(F.col("cell").alias("_cell"), F.posexplode(F.when((ci + cj) % 2 == 0, F.array(c)).otherwise(both)).alias("_pos", "vtx"))
    # Cells before: each earlier one counts one, every cut one two; cut ones alternate along a row.
    z = F.col("_cell") - 1
    row, col = F.floor(z / (nx - 1)), z % (nx - 1)
    odd_rows = F.floor(row / 2)
    cut_even, cut_odd = (nx - 1) // 2, nx // 2
    before = z + (row - odd_rows) * cut_even + odd_rows * cut_odd + F.when(row % 2 == 0, F.floor(col / 2)).otherwise(F.floor((col + 1) / 2))
    return v, q.select((before + F.col("_pos") + 1).cast("long").alias("cell"), "vtx")


def _icosahedron() -> tuple[list[tuple[float, float, float]], list[tuple[int, int, int]]]:
    g = (1 + sqrt(5)) / 2
    r = sqrt(1 + g * g)
    corners = [(a / r, b / r, 0.0) for a in (-1, 1) for b in (-g, g)]
    corners += [(0.0, a / r, b / r) for a in (-1, 1) for b in (-g, g)] + [(b / r, 0.0, a / r) for a in (-1, 1) for b in (-g, g)]
    dot = lambda p, q: sum(x * y for x, y in zip(p, q))
    near = [[dot(p, q) > 0.4 and p != q for q in corners] for p in corners]
    out = []
    for a in range(12):
        for b in range(a + 1, 12):
            for c in range(b + 1, 12):
                if near[a][b] and near[b][c] and near[a][c]:
                    p, q, s = corners[a], corners[b], corners[c]
                    u, v = [y - x for x, y in zip(p, q)], [y - x for x, y in zip(p, s)]
                    n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
                    out.append((a, b, c) if dot(n, p) > 0 else (a, c, b))
    return corners, out


def sphere_triangles(spark: SparkSession, m: int, radius: float = 1.0, origin: Sequence[float] = (0, 0, 0)) -> tuple[DataFrame, DataFrame]:
    """(vertices, cells) of a sphere: each face of an icosahedron cut in m * m triangles, 10 * m * m + 2 vertices.

    Vertices are numbered without a shuffle: the 12 corners, then m - 1 for each of the 30 edges, then those inside the
    20 faces, so a face knows the number of each of its points.
    """
    corners, faces = _icosahedron()
    edges = sorted({tuple(sorted((f[i], f[(i + 1) % 3]))) for f in faces for i in range(3)})
    edge_no = {e: n for n, e in enumerate(edges)}
    inside = (m - 1) * (m - 2) // 2
    rows = []
    for f, (a, b, c) in enumerate(faces):
        e = [edge_no[tuple(sorted(p))] for p in ((a, b), (b, c), (a, c))]
        rows.append((f, a, b, c, *e, a < b, b < c, a < c, *corners[a], *corners[b], *corners[c]))
    names = "f a b c ab bc ac ab_up bc_up ac_up ax ay az bx by bz cx cy cz".split()
    table = F.broadcast(spark.createDataFrame(rows, names))  # 20 rows
    # Point (i, j) of a face: i steps from a towards b, j towards c; the rest of m is the share of a.
    i, j = F.col("i"), F.col("j")
    along = lambda e, up, s: F.lit(13) + F.col(e) * (m - 1) + F.when(F.col(up), s - 1).otherwise(m - 1 - s)

    def number(i: Column, j: Column) -> Column:
        k = F.lit(m) - i - j
        inner = F.lit(13 + 30 * (m - 1)) + F.col("f") * inside + (j - 1) * (m - 1) - F.floor(j * (j - 1) / 2) + i - 1
        return (
            F.when(k == m, F.col("a") + 1).when(i == m, F.col("b") + 1).when(j == m, F.col("c") + 1)
            .when(j == 0, along("ab", "ab_up", i)).when(k == 0, along("bc", "bc_up", j)).when(i == 0, along("ac", "ac_up", j)).otherwise(inner).cast("long")
        )

    grid = spark.range(20 * (m + 1) * (m + 1)).select((F.col("id") % 20).alias("f"), (F.floor(F.col("id") / 20) % (m + 1)).alias("i"), F.floor(F.col("id") / (20 * (m + 1))).alias("j")).join(table, "f")
    share = lambda c: (F.lit(m) - i - j) * F.col(f"a{c}") + i * F.col(f"b{c}") + j * F.col(f"c{c}")
    v = grid.filter(i + j <= m).select(number(i, j).alias("vertex"), *[share(c).alias(c) for c in "xyz"])
    # A point on an edge or corner comes from two to five faces, with values that differ in the last digits at most.
    v = v.groupBy("vertex").agg(*[F.min(c).alias(c) for c in "xyz"])
    long = F.sqrt(sum((F.col(c) * F.col(c) for c in "yz"), F.col("x") * F.col("x")))
    v = v.select("vertex", *[(F.lit(float(o)) + F.col(c) * radius / long).alias(c) for c, o in zip("xyz", origin)])
    up = F.struct(F.array(number(i, j), number(i + 1, j), number(i, j + 1)).alias("vtx"), (i + j < m).alias("on"))
    down = F.struct(F.array(number(i + 1, j), number(i + 1, j + 1), number(i, j + 1)).alias("vtx"), (i + j < m - 1).alias("on"))
    cells = grid.filter(i + j < m).select("f", "i", "j", F.posexplode(F.array(up, down)).alias("s", "t")).filter("t.on")
    place = F.col("f") * (m * m) + j * (2 * m) - j * j + 2 * i + F.col("s") + 1
    return v, cells.select(place.cast("long").alias("cell"), F.col("t.vtx").alias("vtx"))


def shells(vertices: DataFrame, cells: DataFrame, n_vtx: int, n_cell: int, radii: Sequence[float], origin: Sequence[float] = (0, 0, 0)) -> tuple[DataFrame, DataFrame]:
    """A surface around the origin (of radius 1) as layers of prisms between the given radii, innermost first: PENTA_6 of a surface of triangles."""
    r = F.array(*[F.lit(float(x)) for x in radii])
    layer = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_k")
    v = vertices.select("*", layer(len(radii)))
    v = v.select((F.col("vertex") + F.col("_k") * n_vtx).alias("vertex"), *[(F.lit(float(o)) + (F.col(c) - o) * r[F.col("_k")]).alias(c) for c, o in zip("xyz", origin)])
    shifted = lambda k: F.transform("vtx", lambda x: x + k * n_vtx)
    c = cells.select("*", layer(len(radii) - 1))
    return v, c.select((F.col("cell") + F.col("_k") * n_cell).alias("cell"), F.concat(shifted(F.col("_k")), shifted(F.col("_k") + 1)).alias("vtx"))


def filled(vertices: DataFrame, cells: DataFrame, n_vtx: int, origin: Sequence[float] = (0, 0, 0)) -> tuple[DataFrame, DataFrame]:
    """A closed surface of triangles as tetrahedra to one more vertex at the origin."""
    centre = vertices.sparkSession.range(1).select(F.lit(n_vtx + 1).cast("long").alias("vertex"), *[F.lit(float(o)).alias(c) for c, o in zip("xyz", origin)])
    inward = F.array(F.col("vtx")[0], F.col("vtx")[1], F.col("vtx")[2])
    return vertices.unionByName(centre), cells.select("cell", F.concat(F.reverse(inward), F.array(F.lit(n_vtx + 1).cast("long"))).alias("vtx"))


def geometric_radii(inner: float, outer: float, layers: int, ratio: float = 1.0) -> list[float]:
    """Bounds of layers whose thickness grows by `ratio`."""
    sizes = [ratio**k for k in range(layers)]
    total, out = sum(sizes), [inner]
    for s in sizes:
        out.append(out[-1] + (outer - inner) * s / total)
    return out
