"""Plans and figures that must hold while tables grow."""

from gnomon.operators import interpolation, mesh, surfaces
from gnomon.plans import meshes
from gnomon.storage import stored as _stored
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_cells_and_vertices_are_not_broadcast(spark):
    """None of these tables is small when the input is large, though Spark sees one narrow column of it."""
    c, v = meshes.cells(spark, FOLDER), meshes.vertices(spark, FOLDER)
    field = spark.range(9).select(F.col("id").alias("cell"), F.col("id").alias("size"))
    for d in (
        mesh.block_centres(field.select(F.col("cell").alias("gnum")), v, meshes.BLOCK, "CellCenter"), c.select("cell", F.explode("vtx").alias("vertex")).join(field, "cell"),
        field.join(v, F.col("cell") == F.col("vertex")), surfaces.parent_values(field.select("cell"), field, ["size"]),
    ):
        assert "Broadcast" not in _plan(d) and "SortMergeJoin" in _plan(d)
    assert _plan(interpolation._moved(field.select("cell", F.col("cell").alias("vertex"), *[F.lit(0.0).alias(f"_{s}{x}") for s in "ab" for x in "xyz"]), field, "cell", "vertex", ["size"], 1.0)).count("Broadcast") == 0


def test_cuts_are_nearer_where_the_plain_ones_are_hard_to_beat():
    """The blocks of 120,000 and of some other numbers of cells, for which no tree of halves is better than the plain cuts."""
    from gnomon.operators import block_cuts, partition
    from gnomon.plans.blocks import WEIGHTS

    for layers in (3429, 182972, 173982):
        off = [max(block_cuts.deviations(b, WEIGHTS)) for b in (block_cuts.cut_block((5, 7, layers), WEIGHTS), partition.split_block((5, 7, layers), WEIGHTS))]
        assert off[0] < off[1]


def test_sides_are_dealt_out_before_they_are_grouped(spark, monkeypatch):
    """A task that reads a small file of many cells makes six sides of each; it must not sort them."""
    monkeypatch.setattr(mesh.numbering, "row_numbers", lambda d, *_: d.withColumn("face", F.lit(0)))
    plan = _plan(meshes.faces(spark, FOLDER))
    assert plan.rindex("Aggregate") < plan.index("Exchange")


def test_cuts_by_weights_look_at_each_layer_once(spark):
    """20,000 layers, of which every third is empty: seconds, where sums over all layers for each place of a cut took minutes."""
    import time

    from gnomon.operators import block_cuts

    cells = spark.range(20_000).filter("id % 3 > 0").select((F.col("id") + 1).alias("cell"), (F.col("id") % 5).alias("size"))
    began = time.time()
    got = block_cuts.by_cell_weights(cells, (1, 1, 20_000), [1.0, 2.0], "size").groupBy("part").agg(F.min("cell"), F.max("cell")).collect()
    assert time.time() - began < 60
    sizes = [(k % 5 if k % 3 else 0) for k in range(20_000)]
    below, places = 0, []
    for at in range(20_000):
        places.append((abs(below - sum(sizes) / 3), at))
        below += sizes[at]
    cut = min(places[1:])[1]
    assert all((low > cut) == (high > cut) == (part == 1) for part, low, high in got)


def test_windows_of_an_array_are_made_once(spark):
    """A lambda that makes them anew for every rotation takes a power more of the array's length."""
    from gnomon.functions import sequences

    d = spark.createDataFrame([([2, 3, 1], [1, 2, 3]), ([1, 3, 2], [1, 2, 3]), ([1, 1, 2], [1, 2, 3]), ([], [1])], "a array<long>, b array<long>").select(sequences.ordered_subset(F.col("a"), F.col("b")).alias("c"))
    assert "array_contains(transform(" not in _plan(d) and "array_contains(" in _plan(d)
    assert [r["c"] for r in d.collect()] == [[2, 3, 1], [2, 3, 1], None, None]


def test_numbered_tables_are_not_broadcast(spark):
    """Faces, local numbers and extracted items: as many rows as the mesh has, in small files."""
    from gnomon.plans import forms

    few = spark.range(9).select(F.col("id").alias("cell"), F.col("id").alias("face"), F.lit(1.0).alias("price"))
    f, p = meshes.faces(spark, FOLDER), forms.parts(spark, FOLDER)
    for d in (few.join(f, "face"), few.join(p, "cell"), interpolation.interpolate(few.select("cell", F.col("face").alias("target")), few.select("cell", "price"), ["price"])):
        top = _plan(d).split("SortMergeJoin")
        assert len(top) > 1 and "BroadcastExchange" not in top[0] and "BroadcastHashJoin" not in top[0]


def test_faces_match_without_all_pairs(spark, monkeypatch):
    """The nearest within the tolerance as from all pairs, without making them: they grow with the square of the faces where the tolerance is wide."""
    import random

    from gnomon.operators import zones

    r = random.Random(5)
    point = lambda k: (k, float(r.randint(0, 40)), float(r.randint(0, 40)), 0.0)
    odd = [(900, None, 1.0, 0.0), (901, float("nan"), 1.0, 0.0), (902, float("inf"), 1.0, 0.0), (903, 5e6, 5e6, 0.0)]
    a, b = [point(k) for k in range(120)] + odd, [point(k) for k in range(60)] + odd[:3]
    table = lambda rows: spark.createDataFrame(rows, "face long, x double, y double, z double")
    monkeypatch.setattr(mesh, "within", None)
    for far, tolerance in (([], 3.0), ([(950, 1e7, 0.0, 0.0)], 3.0), ([], 25.0)):
        donors = b + far
        want = {}
        for k, *p in a[:120]:
            near = [(d2, j) for j, *q in donors if None not in q for d2 in [sum((s - t) ** 2 for s, t in zip(p, q))] if d2 <= tolerance**2]
            if near:
                want[k] = min(near)[1]
        assert {x["face"]: x["donor_face"] for x in zones.match_faces(table(a), table(donors), tolerance).collect()} == want


def plain_numbers(cells, links):
    """(cell: (level, num)) of each piece by the definition, a cell at a time."""
    near = {c: set() for c in cells}
    for a, b in links:
        if a != b:
            near[a].add(b), near[b].add(a)
    out, seen = {}, set()
    for c in sorted(cells):
        if c in seen:
            continue
        piece, queue = {c}, [c]
        for x in queue:
            queue += [y for y in near[x] if y not in piece]
            piece |= near[x]
        seen |= piece
        now, level, num = [min(piece, key=lambda x: (len(near[x]), x))], 0, 0
        while now:
            for x in now:
                num += 1
                out[x] = (level, num)
            level += 1
            now = sorted({y for x in now for y in near[x] if y not in out}, key=lambda y: (min(out[x][1] for x in near[y] if x in out and out[x][0] == level - 1), len(near[y]), y))
    return out


def test_renumbering_by_chunks_and_bands(spark):
    """Chunks and bands of any size give the numbers of the definition; a star has a level wider than any of them."""
    import random

    from gnomon.operators import renumber

    r = random.Random(3)
    grid = [(i + 5 * j, i + 1 + 5 * j) for i in range(4) for j in range(20)] + [(i + 5 * j, i + 5 * j + 5) for i in range(5) for j in range(19)]
    place = list(range(100))
    r.shuffle(place)
    links = grid + [(200 + place[a], 200 + place[b]) for a, b in grid] + [(400, 400 + k) for k in range(1, 40)] + [(500 + 2 * k, 501 + 2 * k) for k in range(12)] + [(400, 530), (530, 531), (7, 7)]
    cells = sorted({x for p in links for x in p} | {600, 601})
    want = plain_numbers(cells, links)
    p, e = spark.createDataFrame([(c, 0) for c in cells], "cell long, part int"), spark.createDataFrame(links, "a long, b long")
    for chunk in (150, renumber.CHUNK):
        rows = renumber.renumbered(p, e, sweeps=1, chunk=chunk).collect()
        assert {x["cell"]: x["level"] for x in rows} == {c: v[0] for c, v in want.items()}
        for low in (0, 200):  # two pieces as a whole
            own = sorted((x["lnum"], x["cell"]) for x in rows if low <= x["cell"] < low + 100)
            assert [c for _, c in own] == sorted((c for c in want if low <= c < low + 100), key=lambda c: want[c][1])
        star = [x["cell"] for x in sorted(rows, key=lambda x: x["lnum"]) if 400 <= x["cell"] < 440 or x["cell"] in (530, 531)]
        assert star == sorted(star, key=lambda c: want[c][1]) and sorted(x["lnum"] for x in rows) == list(range(1, len(cells) + 1))


def test_renumbering_takes_no_round_for_each_level(spark, monkeypatch):
    """A path of 2,000 levels."""
    from gnomon.operators import renumber

    tables = []
    monkeypatch.setattr(renumber, "stored", lambda d, name: tables.append(name) or _stored(d, name))
    p = spark.range(2000).select(F.col("id").alias("cell"), F.lit(0).alias("part"))
    e = spark.range(1999).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert renumber.renumbered(p, e, sweeps=1).filter("lnum = cell + 1 and level = cell").count() == 2000
    assert len(tables) < 20


def test_points_within_a_radius_are_dealt_out_by_pairs(spark):
    """Two thousand points in one cell: their pairs go to many tasks, and are those of all pairs."""
    a = spark.range(900).select(F.col("id").alias("a"), (F.col("id") * 7 % 31 / 10).alias("x"), (F.col("id") * 11 % 37 / 10).alias("y"))
    b = spark.range(300).select(F.col("id").alias("b"), (F.col("id") * 5 % 29 / 10).alias("x"), (F.col("id") * 3 % 41 / 10).alias("y"))
    few, many = mesh.within(a, b, ["x", "y"], 2.0, "a", "b"), mesh.within(a, b, ["x", "y"], 2.0, "a", "b", block=50, task_pairs=10_000)
    assert many.rdd.getNumPartitions() == 27 and "Broadcast" not in _plan(many).split("SortMergeJoin")[0]
    sizes = many.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[1] > 20 and sizes[0] < many.count() / 4
    want = {(p["a"], q["b"], (p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2) for p in a.collect() for q in b.collect()}
    for d in (few, many):
        rows = [tuple(r) for r in d.collect()]
        assert len(rows) == len(set(rows)) and {r[:2] for r in rows} == {w[:2] for w in want if w[2] <= 4.0}
