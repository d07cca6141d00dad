"""Ids near 2**62 beside nulls come back unchanged from every operator and stage, and so do other integer columns."""

import corpus_pipeline
import pytest
from gnomon.llm import byte_cnn, fingerprints, langid, mixing, ngram_join, pieces, pii, quality, token_counts

BIG = 1 << 62
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over the lazy dog and runs to the river where it drinks cold water all day long".split()


def rows():
    near = " ".join(WORDS * 3)
    return [(BIG + 1, near, "en", "s", BIG + 7), (BIG + 3, near + " again", "en", "s", None), (None, "a text without id", "en", "s", BIG + 9), (BIG + 5, "something else in full that nobody wrote", "en", None, 3), (None, None, None, None, None)]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).coalesce(1)


OPERATORS = {
    "mix": mixing.pareto_mix,
    "count": token_counts.token_counts,
    "pieces": pieces.encoded_digests,
    "encode": pieces.encode,
    "pii": pii.personal_data,
    "redact": pii.redact,
    "fingerprints": fingerprints.fingerprints,
    "join": ngram_join.similar_classes,
    "language": lambda d: langid.identify(d, langid.train(d)),
    "quality": quality.quality,
    "network": lambda d: byte_cnn.score(d, byte_cnn.Network()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_come_back(spark, name):
    d = OPERATORS[name](docs(spark))
    assert sorted(str(r["doc_id"]) for r in d.collect()) == sorted(str(r[0]) for r in rows())
    if "n_chars" in d.columns and name not in ("quality", "fingerprints"):
        assert sorted(str(r["n_chars"]) for r in d.collect()) == sorted(str(r[4]) for r in rows())


def test_join_keeps_links(spark):
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.similar_classes(docs(spark)).collect() if r["doc_id"]}
    assert found == {BIG + 1: (BIG + 1, 1), BIG + 3: (BIG + 1, 1), BIG + 5: (BIG + 5, 0)}
    kept = [r["doc_id"] for r in ngram_join.deduplicated(docs(spark)).collect()]
    assert sorted(kept, key=str) == sorted([BIG + 1, BIG + 5, None, None], key=str)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_ids(spark, stage):
    given = {r[0] for r in rows()}
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs(spark), "")
    assert {r["doc_id"] for r in out.collect()} <= given
    if stage in ("PII", "SentencePiece encoding and decoding"):
        assert {r["doc_id"] for r in out.collect()} == given
