"""Document quality by a convolutional network over bytes, in numpy.

A byte enters as a learned vector and a flag: whether the eight bytes that end with it stood less than LAG bytes before
(no filter of eight bytes can see that a word is repeated).  Learned filters of eight bytes step over the text four
bytes at a time.  Their rectified values are max-pooled over chunks of two halves, each half being shared with the
neighbour, so chunks overlap and cover the whole document.  The largest and the mean value of every filter over the
chunks are combined into one probability.  Documents of a batch lie in one buffer, each in halves of its own.

Training takes at most SAMPLE documents of each label, chosen by a hash of their id, and of each at most TRAIN_PARTS
even pieces of TRAIN_BYTES bytes together (scoring reads everything); the share of labels in all labelled rows corrects
for the sample.  It runs once, on the driver, whose memory is bounded by these numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, read_table

SAMPLE = 500
TRAIN_BYTES, TRAIN_PARTS = 8_192, 4
VECTOR, FILTERS = 7, 24
STEP = 4
HALF = 128
LAG, SEEN = 32, 8
EPOCHS, BATCH, RATE = 10, 16, 0.01
#: Bytes of texts that are scored at once.
BUFFER = 1 << 20
THRESHOLD = 0.7
WIDE = STEP * (VECTOR + 1)


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, each filled up with zeros to whole halves (one at least), and the halves of each."""
    halves = np.array([max(1, -(-len(t) // HALF)) for t in texts], np.int64)
    out = np.zeros((int(halves.sum()) + 1) * HALF, np.uint8)
    for t, at in zip(texts, np.cumsum(halves) - halves):
        out[at * HALF : at * HALF + len(t)] = np.frombuffer(t, np.uint8)
    return out, halves


def repeated(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether the SEEN bytes that end at a place are the same as those that end 1 to LAG - 1 bytes before, in the same document; starts: halves in which documents begin."""
    n = len(data)
    word = np.zeros(n, np.uint64)
    for k in range(SEEN):
        word[k:] |= data[: n - k].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(n, bool)
    for lag in range(1, LAG):
        out[lag:] |= word[lag:] == word[:-lag]
    out &= word != 0  # fillings
    out[(starts[:, None] * HALF + np.arange(LAG + SEEN)[None, :]).ravel()] &= False
    return out


class Network:
    """vector: byte -> numbers; filters: (WIDE, 2 * FILTERS), those of the first four bytes before those of the last; shift; top: weights of the largest and mean values; bias."""

    def __init__(self, seed: int = 13):
        r = np.random.default_rng(seed)
        self.vector = r.normal(0, 0.5, (256, VECTOR)).astype(np.float32)
        self.vector[0] = 0
        self.filters = r.normal(0, 1 / np.sqrt(2 * WIDE), (WIDE, 2 * FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.top = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        #: Added to the logit: the labels' odds in all rows against those in the sample.
        self.prior = 0.0

    def parameters(self) -> list[np.ndarray]:
        return [self.vector, self.filters, self.shift, self.top, self.bias]

    def rectified(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(blocks of four bytes as inputs, rectified values (halves, places, filters))."""
        x = np.empty((len(data), VECTOR + 1), self.vector.dtype)
        x[:, :VECTOR] = self.vector[data]
        x[:, VECTOR] = repeated(data, starts)
        x = x.reshape(-1, WIDE)
        z = x @ self.filters
        per = HALF // STEP
        z[starts * per, FILTERS:] = 0  # the document before ends in zeros, not in this one's first bytes
        y = z[: -per, :FILTERS] + z[1 : len(z) - per + 1, FILTERS:] + self.shift
        return x, np.maximum(y, 0).reshape(-1, per, FILTERS)

    def half_maxima(self, data: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """The largest value of each filter in each half, BUFFER bytes at a time; a half before goes along for the flags."""
        n, starts, per = int(halves.sum()), np.cumsum(halves) - halves, BUFFER // HALF
        out = np.empty((n, FILTERS), self.vector.dtype)
        for lo in range(0, n, per):
            hi, a = min(n, lo + per), max(0, lo - 1)
            some = starts[np.searchsorted(starts, a) : np.searchsorted(starts, hi, "right")] - a
            out[lo:hi] = self.rectified(data[a * HALF : (hi + 1) * HALF], some)[1].max(axis=1)[lo - a :]
        return out

    @staticmethod
    def chunks(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first half, second half, document) of every chunk; a document of one half is one chunk."""
        n = np.maximum(halves - 1, 1)
        doc = np.repeat(np.arange(len(halves)), n)
        first = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(halves) - halves, n)
        return first, np.where(halves[doc] > 1, first + 1, first), doc

    def logits(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        data, halves = laid_out(texts)
        half = self.half_maxima(data, halves)
        first, second, doc = self.chunks(halves)
        chunk = np.maximum(half[first], half[second])
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        largest, mean = np.maximum.reduceat(chunk, starts), np.add.reduceat(chunk, starts) / np.diff(np.append(starts, len(doc)))[:, None]
        return (np.concatenate([largest, mean], axis=1) @ self.top + self.bias[0]).astype(np.float64) + self.prior

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of label 1 for each text; buffers hold BUFFER bytes or one longer text."""
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) + HALF <= BUFFER):
                size += len(texts[end]) + HALF
                end += 1
            out.append(self.logits(texts[at:end]))
            at = end
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -30, 30))) if out else np.zeros(0)

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss, by the parameters."""
        data, halves = laid_out(texts)
        x, y = self.rectified(data, np.cumsum(halves) - halves)
        per, n_half, f = HALF // STEP, len(y), np.arange(FILTERS)
        where = y.argmax(axis=1)
        half = np.take_along_axis(y, where[:, None, :], axis=1)[:, 0]
        first, second, doc = self.chunks(halves)
        later = half[second] > half[first]
        chunk = np.where(later, half[second], half[first])
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        size = np.diff(np.append(starts, len(doc)))
        largest = np.maximum.reduceat(chunk, starts)
        feature = np.concatenate([largest, np.add.reduceat(chunk, starts) / size[:, None]], axis=1)
        p = 1 / (1 + np.exp(-np.clip(feature @ self.top + self.bias[0], -30, 30)))
        d = ((p - labels) / len(texts)).astype(self.vector.dtype)
        d_top, d_bias = d @ feature, np.array([d.sum()])
        d_feature = d[:, None] * self.top
        d_chunk = (d_feature[:, FILTERS:] / size[:, None])[doc]
        is_top = chunk == largest[doc]
        d_chunk += d_feature[doc, :FILTERS] * is_top / np.add.reduceat(is_top, starts, dtype=np.float32)[doc]
        d_half = np.zeros((n_half, FILTERS), self.vector.dtype)
        np.add.at(d_half, first, np.where(later, 0, d_chunk))
        np.add.at(d_half, second, np.where(later, d_chunk, 0))
        d_half *= half > 0
        place = where + (np.arange(n_half) * per)[:, None]
        ends = np.isin(place + 1, (np.cumsum(halves) - halves) * per)
        left, right = x[place], np.where(ends[..., None], 0, x[place + 1])  # (halves, filters, WIDE)
        d_filters = np.concatenate([np.einsum("hf,hfw->wf", d_half, left), np.einsum("hf,hfw->wf", d_half, right)], axis=1)
        d_vector = np.zeros_like(self.vector)
        for k, weights in enumerate((self.filters[:, :FILTERS], self.filters[:, FILTERS:])):
            for j in range(STEP):
                byte = np.where(ends & (k == 1), 0, data[(place + k) * STEP + j])
                w = weights[j * (VECTOR + 1) : j * (VECTOR + 1) + VECTOR].T  # (filters, VECTOR)
                for v in range(VECTOR):
                    d_vector[:, v] += np.bincount(byte.ravel(), (d_half * w[f, v]).ravel(), 256)
        d_vector[0] = 0
        return [d_vector, d_filters, d_half.sum(axis=0), d_top, d_bias]

    def fit(self, texts: list[bytes], labels: np.ndarray, *, epochs: int = EPOCHS, seed: int = 7) -> None:
        """Adam over mini-batches."""
        r, params = np.random.default_rng(seed), self.parameters()
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            rate = RATE * (1 - epoch / epochs)
            for at in range(0, len(order), BATCH):
                some, t = order[at : at + BATCH], t + 1
                for p, g, a, b in zip(params, self.gradients([texts[i] for i in some], labels[some]), m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-7)).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Network:
    """A network for the labels 0 and 1; rows with a null id, null or other label are left out, a null text is empty.

    With one label only, or none, the filters stay as they are and scores are the labels' share, smoothed by one of each.
    """
    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    net = Network()
    share = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    chosen = [marked.filter(F.col("label") == k).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample) for k in (0, 1)]
    part = TRAIN_BYTES // TRAIN_PARTS
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    step = F.floor((F.octet_length("text") - part) / (TRAIN_PARTS - 1)).cast("int")
    cut = F.when(F.octet_length("text") <= TRAIN_BYTES, F.col("text")).otherwise(F.concat(*[F.substring(F.col("text"), step * k + 1, F.lit(part)) for k in range(TRAIN_PARTS)]))
    known = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    # At most 2 * sample ids, so the broadcast is bounded.
    rows = known.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").select("id", "label", cut.alias("text")).dropDuplicates(["id", "label"]).collect()
    rows.sort(key=lambda x: (str(x["id"]), x["label"]))
    y = np.array([x["label"] for x in rows], np.float32)
    if len(set(y)) < 2:
        net.top[:] = 0
        net.prior = float(np.log(share / (1 - share)))
        return net
    net.fit([bytes(x["text"]) for x in rows], y)
    net.prior = float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    return net


def score(docs: DataFrame, net: Network, *, text_col: str = "text", out_col: str = "score", keep: bool = True) -> DataFrame:
    """docs with the network's probability of label 1 in out_col, which replaces a column of that name.

    Empty and null texts have the score of the empty text.  Without keep the text is left out.  All other columns and repeated rows are kept; an empty table
    stays empty.
    """

    def work(texts: list) -> list[np.ndarray]:
        return [net.scores([t.encode("utf-8", "surrogatepass") if t else b"" for t in texts])]

    return mapped(docs, [text_col], f"`{out_col}` double", work, claim_as="byte_cnn", keep=keep)


def op13_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    net = train(docs, labels)
    d = score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), net, keep=False)
    return d.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
