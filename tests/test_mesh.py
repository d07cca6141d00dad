from gnomon.operators import mesh


def test_each_kind_is_closed(spark):
    """Every edge of a closed cell is walked once in each direction."""
    for kind, faces in mesh.FACES.items():
        walks = [(f[i], f[(i + 1) % len(f)]) for f in faces for i in range(len(f))]
        assert len(set(walks)) == len(walks) and {(b, a) for a, b in walks} == set(walks), kind


def test_two_tetrahedra(spark):
    cells = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [2, 3, 4, 5])], "cell long, vtx array<long>")
    faces = mesh.elements_to_faces(cells, "TETRA_4")
    rows = {tuple(sorted(r["vtx"])): (r["left"], r["right"]) for r in faces.collect()}
    assert len(rows) == 7 and rows[(2, 3, 4)] == (1, 2) and rows[(1, 2, 3)] == (1, 0)
    assert {r["cell"]: len(r["faces"]) for r in mesh.parents_to_cells(faces).collect()} == {1: 4, 2: 4}
    assert mesh.edges(faces).count() == 9


def test_boundary_left(spark):
    d = spark.createDataFrame([(1, 0, 4, [1, 2, 3]), (2, 3, 4, [4, 5, 6])], "face long, left long, right long, vtx array<long>")
    got = {r["face"]: (r["left"], r["right"], r["vtx"]) for r in mesh.boundary_left(d).collect()}
    assert got == {1: (4, 0, [3, 2, 1]), 2: (3, 4, [4, 5, 6])}


def test_empty(spark):
    none = spark.createDataFrame([], "cell long, vtx array<long>")
    assert mesh.elements_to_faces(none, "HEXA_8").count() == 0
