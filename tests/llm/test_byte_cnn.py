"""The byte network: gradients against differences, pooling against loops, held-out accuracy, odd rows."""

import numpy as np
import pytest
from gnomon.llm import byte_cnn
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"


def plain_logit(net, text):
    """One document, by loops over places and chunks."""
    data = np.frombuffer(text, np.uint8)
    n = max(1, -(-len(data) // byte_cnn.HALF)) * byte_cnn.HALF
    data = np.concatenate([data, np.zeros(n - len(data) + byte_cnn.HALF, np.uint8)])
    seen = byte_cnn.SEEN
    flag = np.zeros(len(data), bool)
    for i in range(byte_cnn.LAG + seen, len(data)):
        own = data[i - seen + 1 : i + 1]
        flag[i] = own.any() and any((data[i - lag - seen + 1 : i - lag + 1] == own).all() for lag in range(1, byte_cnn.LAG))
    x = np.concatenate([net.vector[data], flag[:, None]], axis=1)
    values = []
    for at in range(0, n, byte_cnn.STEP):
        first, last = x[at : at + 4].ravel(), x[at + 4 : at + 8].ravel()
        values.append(np.maximum(first @ net.filters[:, : byte_cnn.FILTERS] + last @ net.filters[:, byte_cnn.FILTERS :] + net.shift, 0))
    per = byte_cnn.HALF // byte_cnn.STEP
    halves = [np.max(values[k : k + per], axis=0) for k in range(0, len(values), per)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves
    return float(np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)]) @ net.top + net.bias[0]) + net.prior


def texts():
    r = np.random.default_rng(2)
    return [b"", b"a", b"word " * 90, bytes(r.integers(0, 256, 700, np.uint8)), b"x" * 128, b"y" * 129, "éü ".encode() * 200, bytes(400)]


def test_logits_against_loops():
    net = byte_cnn.Network()
    got = net.logits(texts())
    assert np.allclose(got, [plain_logit(net, t) for t in texts()], atol=1e-4)
    assert np.allclose(got, [net.logits([t])[0] for t in texts()], atol=1e-4)


def test_long_texts_in_parts(monkeypatch):
    net = byte_cnn.Network()
    t = b"".join(texts()) * 5
    whole = net.logits([b"some", t, b"more"])
    monkeypatch.setattr(byte_cnn, "BUFFER", 512)
    assert np.allclose(net.logits([b"some", t, b"more"]), whole, atol=1e-4)
    assert np.allclose(net.scores([b"some", t, b"more"]), 1 / (1 + np.exp(-whole)), atol=1e-5)


def test_gradients_against_differences():
    net = byte_cnn.Network(3)
    for name in ("vector", "filters", "shift", "top", "bias"):
        setattr(net, name, getattr(net, name).astype(float))
    net.shift += np.random.default_rng(8).normal(0, 0.1, len(net.shift))  # at 0, fillings lie on the corner
    some = texts()[1:7]
    y = np.array([0, 1, 1, 0, 1, 0], np.float32)

    def loss():
        p = 1 / (1 + np.exp(-net.logits(some)))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    r, apart = np.random.default_rng(4), []
    for p, g in zip(net.parameters(), net.gradients(some, y)):
        flat, slope = p.reshape(-1), g.reshape(-1)
        large = np.argsort(-np.abs(slope))[:6]
        for i in [*large.tolist(), *r.integers(0, len(flat), 4).tolist()]:
            if p is net.vector and i < byte_cnn.VECTOR:
                continue  # byte 0 stays 0
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            apart.append(abs((up - down) / 2e-6 - slope[i]) / (1e-6 + 1e-3 * abs(slope[i])))
    # A difference may step over a corner of a maximum.
    assert np.quantile(apart, 0.9) < 1


def test_held_out_accuracy(spark):
    from gnomon.llm.queries import QUERIES

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    d = QUERIES["op13_byte_cnn"](spark, FOLDER)
    assert d.columns == ["doc_id", "held_out", "score", "predicted"] and d.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    rows = d.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 60 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    other = labels.withColumn("quality", F.when(byte_cnn.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (byte_cnn.train(docs, x.filter(~byte_cnn.held_out(F.col("doc_id"))), sample=20) for x in (labels, other))
    assert all((p == q).all() for p, q in zip(a.parameters(), b.parameters())) and a.prior == b.prior


ODD = "doc_id long, text string, label int, score string, quality int"


def test_odd_rows(spark):
    rows = [(1, None, 1, "s", 1), (2, "", 1, "s", 1), (None, "no id", 1, "s", None), (3, "x" * 3_000_000, 1, "s", 0), (3, "x" * 3_000_000, 1, "s", 0), (4, "\x00", 1, "s", 5), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, ODD)
    net = byte_cnn.train(d, d, sample=3)
    out = byte_cnn.score(d.drop("score"), net).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert len({round(r["score"], 5) for r in out if not r["text"]}) == 1
    assert byte_cnn.score(d.drop("score"), net).limit(0).columns == ["doc_id", "text", "label", "quality", "score"]
    assert byte_cnn.score(d.limit(0), byte_cnn.train(d.limit(0), d.limit(0))).count() == 0


@pytest.mark.parametrize("label", [0, 1])
def test_one_label_only(spark, label):
    d = spark.createDataFrame([(i, f"text {i}", label) for i in range(8)], "doc_id long, text string, quality int")
    out = byte_cnn.score(d, byte_cnn.train(d, d)).collect()
    assert all(abs(r["score"] - (0.9 if label else 0.1)) < 1e-6 for r in out)
