"""The pipeline's rows against a plain version of its stages, one document at a time, with exact duplicates by all pairs."""

import re
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from gnomon.llm import langid, mixing, pieces, pii
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def shingles(text):
    w = text.encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each(rows):
    """Of documents connected by a similarity of 0.8 the one of least id; documents without words stay."""
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i, s in sets.items() if s)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def mixed(rows):
    import pandas as pd

    documents = pd.DataFrame(rows, columns=COLUMNS)  # noqa: F841 - the SQL reads it
    c = duckdb.connect()
    c.register("documents", documents)
    taken = {r[0]: (r[1], r[2]) for r in c.sql(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE_SQL})").fetchall()}
    return [r for r in rows for _ in range(taken[r["doc_id"]][1] // max(1, taken[r["doc_id"]][0]))]


def test_rows_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [r.asDict() for r in docs.select(*COLUMNS).collect()]
    assert all(r["text"] and re.search(r"\S", r["text"]) for r in rows)
    model = langid.train(docs)
    for r in rows:
        r["lang"] = model.predict([r["text"]])[0][0]
    rows = one_of_each([r for r in rows if r["lang"] != langid.UNKNOWN])
    assert len(rows) < docs.count()
    for r in rows:
        r["text"] = pii.redacted(r["text"], pii.find_spans([r["text"]])[0][1])
        r["n_chars"] = len(r["text"])
    rows = mixed(rows)
    c = pieces.codec()
    want = Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], tuple(c.encode(r["text"]).tolist())) for r in rows)
    got = Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], tuple(r["piece_ids"])) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == want and len(rows) > 50


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, name):
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).withColumn("more", F.lit(1))
    out = dict(corpus_pipeline.STAGES)[name](spark, empty, FOLDER)
    assert out.count() == 0 and out.columns[:5] == COLUMNS
