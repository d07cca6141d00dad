import pytest
from gnomon.plans import blocks, catalog, cuts, dealing, extracts, forms, inspection, joins, meshes, more, partitioning, reads, walks, whole_trees  # noqa: F401
from oracle import same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    same(catalog.QUERIES[name](spark, FOLDER), catalog.ORACLE_SQL[name], FOLDER)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_imports_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['gnomon.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 20 and e.llm is None"
    subprocess.run([sys.executable, "-c", code], check=True)


@pytest.mark.parametrize("name", ["partition_block", "connected_chains"])
def test_whole_tables_are_worked_on(spark, name):
    """Every part is in the result, at two sizes; the components are those of a union-find."""
    for folder in (FOLDER, "/root/testdata/sf0.01"):
        got = catalog.QUERIES[name](spark, folder).toPandas()
        keys = sorted(r[0] for r in spark.read.parquet(f"{folder}/part.parquet").select("p_partkey").collect())
        assert sorted(got.iloc[:, 0]) == [k + (name == "partition_block") for k in keys]
        if name == "partition_block":
            assert got.groupby("part").size().min() >= len(keys) // 4 - 6
            continue
        root = {k: k for k in keys}

        def find(k):
            while root[k] != k:
                k = root[k] = root[root[k]]
            return k

        for k in keys:
            if k + 7 in root:
                a, b = find(k), find(k + 7)
                root[max(a, b)] = min(a, b)
        assert dict(zip(got.node, got.component)) == {k: find(k) for k in keys}
