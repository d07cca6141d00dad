"""Token ids as binary files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Ids of all documents, each with the end id, form one stream in ascending order of document id, cut into shards (one
file each) and blocks of BLOCK ids.  Every block starts from the shard's initial model, so blocks are coded in lockstep
as lanes of numpy arrays, and one can be read without the others.

Initial model: the shard's ids in descending order of frequency, with their counts.  An id's class is the bit length of
its rank, at most CLASSES - 1.
Model of a lane: order 2 (the last two ids) and order 1 (the last id) each predict an id with a confidence.  The first
decision is whether the id is the leading prediction; its probability is a mixture of the hit rates that the two orders
have at their confidences, with a weight that follows the better one.  Otherwise order 0 codes the id: its class by a
distribution that adapts in the lane, then the id in its class by the shard's counts.  Each decision narrows a 64-bit
range, of which 32 bits at a time are written (carry-less: a range that straddles is cut).

Shard: magic, 8 numbers, the compressed tables (document ids, lengths, ids and counts of the initial model, block words,
block checksums), their checksum, the blocks' 32-bit words.  All numbers are little-endian.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import fresh_path, stored
from .common import claim, read_table

MAGIC = b"GNOMIDS2"
BLOCK = 2_048
SHARD_IDS = 4_000_000
SLOTS = 2_048
ONE = 1 << 15
RATE, CLASS_RATE = 5, 7
CLASSES = 16
MEMO = 1 << 19
#: Characters that are tokenised at once.
SLICE_CHARS = 4_000_000
U = np.uint64
_32, _15 = U(32), U(15)
_SMALL = U(1 << 32)
_TARGET = (np.arange(CLASSES + 1)[None, :] + np.where(np.arange(CLASSES + 1)[None, :] > np.arange(CLASSES)[:, None], ONE - CLASSES, 0)).astype(np.int32)


def parts_of(counts: np.ndarray, total: int) -> np.ndarray:
    """Positive whole parts of total in proportion to counts, as cumulative sums from 0; total is at least twice their number."""
    n = len(counts)
    ends = np.cumsum(counts, dtype=np.float64)
    return np.concatenate([[0], np.floor(ends / ends[-1] * (total - n)).astype(np.int64) + np.arange(1, n + 1)])


class Alphabet:
    """The initial model: distinct ids by rank, and for each its class and its part of the class."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts, n = ids, counts, len(ids)
        self.kind = np.minimum(np.frexp(np.arange(n))[1], CLASSES - 1).astype(np.int32)
        self.bits = max(16, n.bit_length() + 1)
        bounds = np.searchsorted(self.kind, np.arange(CLASSES + 1))
        self.start, self.freq, mass = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(CLASSES)
        for k in range(CLASSES):
            a, b = bounds[k], bounds[k + 1]
            if a < b:
                cut = parts_of(counts[a:b], 1 << self.bits)
                self.start[a:b], self.freq[a:b], mass[k] = cut[:-1], np.diff(cut), counts[a:b].sum()
        self.classes = parts_of(np.maximum(mass, 1e-9), ONE).astype(np.int32)
        # Ascending over all classes, so that one search finds a rank from its class and a point in it.
        self.place = (self.kind.astype(np.int64) << self.bits) + self.start

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Alphabet, np.ndarray]:
        """The alphabet of a stream, and the ranks of its ids."""
        if len(ids) and int(ids.max()) < 1 << 22:  # counted by their own values
            counts, at = np.bincount(ids), ids
            names = np.flatnonzero(counts)
        else:
            names, at, counts = np.unique(ids, return_inverse=True, return_counts=True)
        many = counts[counts > 0]
        order = np.argsort(-many, kind="stable")
        rank = np.zeros(len(counts), np.int32)
        rank[np.flatnonzero(counts)[order]] = np.arange(len(names), dtype=np.int32)
        return cls(names[order].astype("<u4"), many[order].astype("<u4")), rank[at]


class Lanes:
    """Models and range coders of many blocks; step() codes the rank of one id in each of the first n lanes."""

    def __init__(self, n: int, alphabet: Alphabet, words: np.ndarray | None = None, starts: np.ndarray | None = None):
        self.alphabet = alphabet
        self.low, self.range = np.zeros(n, U), np.full(n, 2**64 - 1, U)
        self.reading = words is not None
        if self.reading:
            self.words, self.at = words, starts.copy()
            self.code = (words[self.at].astype(U) << _32) | words[self.at + 1].astype(U)
            self.at += 2
        else:
            self.out, self.at = np.zeros((n, 2 * BLOCK + 4), np.uint32), np.zeros(n, np.int64)
        self.lane = np.arange(n) * SLOTS
        self.guess = np.zeros((2, n * SLOTS), np.int32)  # rank * 4 + confidence
        self.hit = np.full((2, n * 8), ONE // 8, np.int32)
        self.weight = np.full(n, 2048, np.int32)
        self.top = np.tile(alphabet.classes, (n, 1))
        self.one, self.two = np.zeros(n, np.int32), np.zeros(n, np.int32)

    def narrow(self, i, start: np.ndarray, freq: np.ndarray, bits: U) -> None:
        """Takes part [start, start + freq) of 2**bits of the lanes' ranges."""
        r = self.range[i] >> bits
        low = self.low[i] + start.astype(U) * r
        wide = r * freq.astype(U)
        # A renewal is due when the range is small, or low and its end agree in the upper half; the latter can wait.
        move = np.flatnonzero(wide < _SMALL)
        if len(move):
            l, w = low[move], wide[move]
            w = np.where(((l ^ (l + w)) >> _32) == 0, w, _SMALL - (l & U(2**32 - 1)))
            lanes = move if isinstance(i, slice) else i[move]
            at = self.at[lanes]
            if self.reading:
                at = np.minimum(at, len(self.words) - 1)  # a damaged block may ask for more
                self.code[lanes] = (self.code[lanes] << _32) | self.words[at]
            else:
                self.out[lanes, at] = (l >> _32).astype(np.uint32)
            self.at[lanes] = at + 1
            low[move], wide[move] = l << _32, w << _32
        self.low[i], self.range[i] = low, wide

    def target(self, i, bits: U) -> np.ndarray:
        return np.minimum((self.code[i] - self.low[i]) // (self.range[i] >> bits), (U(1) << bits) - U(1)).astype(np.int64)

    def order0(self, i: np.ndarray, rank: np.ndarray | None) -> np.ndarray:
        """Codes or reads ranks by class and place in it."""
        a, cdf, bits = self.alphabet, self.top[i], U(self.alphabet.bits)
        if rank is None:
            kind = (cdf[:, 1:CLASSES] <= self.target(i, _15)[:, None]).sum(axis=1)
        else:
            kind = a.kind[rank]
        k = np.arange(len(i))
        start = cdf[k, kind]
        self.narrow(i, start, cdf[k, kind + 1] - start, _15)
        self.top[i] = cdf + ((_TARGET[kind] - cdf) >> CLASS_RATE)
        if rank is None:
            rank = np.searchsorted(a.place, (kind.astype(np.int64) << a.bits) + self.target(i, bits), "right") - 1
        self.narrow(i, a.start[rank], a.freq[rank], bits)
        return rank

    def step(self, n: int, ranks: np.ndarray | None) -> np.ndarray:
        i = slice(0, n)
        one, two, lane = self.one[i], self.two[i], self.lane[i]
        s1 = lane + (((one * 40503) >> 3) & (SLOTS - 1))
        s2 = lane + ((((one * 40503) ^ (two * 60493)) >> 3) & (SLOTS - 1))
        g1, g2 = self.guess[0][s1], self.guess[1][s2]
        c1, c2, p1, p2 = g1 & 3, g2 & 3, g1 >> 2, g2 >> 2
        lead = np.where(c2 > 0, p2, p1)
        eight = lane // (SLOTS // 8)
        h2, h1 = eight + c2, eight + c1 * 2 + (p1 == lead)
        q2, q1 = self.hit[1][h2], self.hit[0][h1]
        w = self.weight[i]
        p = np.clip((w * q2 + (4096 - w) * q1) >> 12, 32, ONE - 32)
        yes = self.target(i, _15) < p if ranks is None else ranks == lead
        self.narrow(i, np.where(yes, 0, p), np.where(yes, p, ONE - p), _15)
        self.weight[i] = np.clip(w + (np.where(yes, q2 - q1, q1 - q2) >> 6), 256, 3840)
        goal = np.where(yes, ONE, 0)
        self.hit[1][h2] = q2 + ((goal - q2) >> RATE)
        self.hit[0][h1] = q1 + ((goal - q1) >> RATE)
        out, miss = lead, np.flatnonzero(~yes)
        if len(miss):
            out[miss] = self.order0(miss, None if ranks is None else ranks[miss])
        for table, slot, g, c, p in ((self.guess[0], s1, g1, c1, p1), (self.guess[1], s2, g2, c2, p2)):
            table[slot] = np.where((p == out) & (c > 0), g + (c < 3), np.where(c > 1, g - 1, out * 4 + 1))
        self.two[i] = one
        self.one[i] = out
        return out


def lane_sizes(n_ids: int) -> np.ndarray:
    """Ids in each block of a stream: all BLOCK but the last."""
    n = -(-n_ids // BLOCK)
    sizes = np.full(n, BLOCK)
    if n:
        sizes[-1] = n_ids - BLOCK * (n - 1)
    return sizes


def compress(ids: np.ndarray) -> tuple[Alphabet, np.ndarray, np.ndarray, np.ndarray]:
    """(alphabet, words of all blocks, number of words of each, crc32 of each block's ids) of unsigned 32-bit ids."""
    sizes = lane_sizes(len(ids))
    n = len(sizes)
    alphabet, ranks = Alphabet.of(ids)
    table = np.zeros((BLOCK, n), np.int32)  # by step, so that one is a row
    full = len(ids) // BLOCK
    table[:, :full] = ranks[: full * BLOCK].reshape(full, BLOCK).T
    table[: len(ids) - full * BLOCK, full:] = ranks[full * BLOCK :][:, None]
    lanes = Lanes(n, alphabet)
    for t in range(int(sizes[0]) if n else 0):
        live = n if t < sizes[-1] else n - 1
        if live:
            lanes.step(live, table[t, :live])
    words = []
    for k in range(n):
        low = int(lanes.low[k])
        words.append(np.append(lanes.out[k, : lanes.at[k]], np.array([low >> 32, low & 0xFFFFFFFF], np.uint32)))
    sums = [zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) for k in range(n)]
    return alphabet, np.concatenate(words) if n else np.zeros(0, np.uint32), np.array([len(w) for w in words], np.uint32), np.array(sums, np.uint32)


def decompress(alphabet: Alphabet, words: np.ndarray, lengths: np.ndarray, sums: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids; a block whose checksum differs raises ValueError."""
    sizes = lane_sizes(n_ids)
    n = len(sizes)
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[:-1]
    lanes = Lanes(n, alphabet, np.append(words, np.zeros(4, np.uint32)), starts)
    table = np.zeros((BLOCK, n), np.int32)
    for t in range(int(sizes[0]) if n else 0):
        live = n if t < sizes[-1] else n - 1
        if live:
            table[t, :live] = lanes.step(live, None)
    ids = alphabet.ids[np.minimum(table.T.reshape(-1)[:n_ids], len(alphabet.ids) - 1)] if n else np.zeros(0, "<u4")
    for k in range(n):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].tobytes()) != sums[k]:
            raise ValueError(f"block {k} is damaged")
    return ids


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, n_null: int = 0) -> bytes:
    """A shard; the first n_null documents have no id."""
    alphabet, words, counts, sums = compress(ids)
    tables = ((doc_ids, "<i8"), (lengths, "<u4"), (alphabet.ids, "<u4"), (alphabet.counts, "<u4"), (counts, "<u4"), (sums, "<u4"))
    table = zlib.compress(b"".join(x.astype(kind).tobytes() for x, kind in tables), 6)
    return MAGIC + struct.pack("<8Q", len(doc_ids), n_null, len(ids), len(alphabet.ids), BLOCK, len(counts), len(table), zlib.crc32(table)) + table + words.astype("<u4").tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(document ids, lengths, ids, number of first documents without id) of a shard; ValueError if it is damaged."""
    if data[:8] != MAGIC:
        raise ValueError("not a shard of ids")
    n_docs, n_null, n_ids, distinct, block, n_blocks, size, crc = struct.unpack_from("<8Q", data, 8)
    raw = data[72 : 72 + size]
    if zlib.crc32(raw) != crc or block != BLOCK:
        raise ValueError("the shard's tables are damaged")
    table = zlib.decompress(raw)
    cut = np.cumsum([0, 8 * n_docs, 4 * n_docs, 4 * distinct, 4 * distinct, 4 * n_blocks, 4 * n_blocks])
    part = lambda k, kind: np.frombuffer(table[cut[k] : cut[k + 1]], kind)
    ids = decompress(Alphabet(part(2, "<u4"), part(3, "<u4")), np.frombuffer(data[72 + size :], "<u4"), part(4, "<u4"), part(5, "<u4"), n_ids)
    return part(0, "<i8"), part(1, "<u4"), ids, n_null


class Tokens:
    """Ids of texts.  The tokenizer drops white space and no token crosses it, so the parts between blanks are encoded once each and kept in a bounded memo."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.first, self.size, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def learn(self, words: list[str]) -> None:
        """Puts words into the memo: a number each, by which first and size give its ids."""
        found = [np.array(e.ids, "<u4") for at in range(0, len(words), 4096) for e in self.tokenizer.encode_batch_fast(words[at : at + 4096], add_special_tokens=False)]
        self.memo.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.size = np.concatenate([self.size, np.array([len(x) for x in found], np.int64)])
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.ids = np.concatenate([self.ids, *found])

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; number of ids of each text)."""
        if not texts:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        parts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.clear()
            new = words
        if new:
            self.learn(new)
        number = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        word = number[coded.indices.to_numpy()]
        bounds = np.asarray(parts.offsets)
        n = self.size[word]
        before = np.concatenate([[0], np.cumsum(n)])
        lengths = np.diff(before[bounds])
        at = np.arange(before[-1]) + np.repeat(self.first[word] - before[:-1], n)
        out = np.full(before[-1] + len(texts), end_id, "<u4")
        out[np.arange(before[-1]) + np.repeat(np.arange(len(texts)), lengths)] = self.ids[at]
        return out, lengths + 1


_tokens: dict[str, Tokens] = {}


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(uri))


def write_ids(docs: DataFrame, folder: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Writes all documents' ids as shards below folder; returns the manifest (pid, seq, file, n_docs, n_ids), kept as Parquet.

    Partitions are ranges of document id (whole numbers, or text that holds them); rows without id come first, and rows
    that share an id are ordered by a hash of their text.  A shard has a name of its own for every attempt, and the
    manifest, committed by Spark, names those that count, so a task that runs twice does no harm.  A null text gives the
    end id alone; repeated rows stay; an empty table gives an empty manifest; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = _tokens.setdefault(path, None) or Tokens(path)
        _tokens[path] = tokens
        claim("id_codec", tokens.clear)
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        pid, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[pd.Series, np.ndarray, np.ndarray]] = []

        def shard() -> pd.DataFrame:
            name = f"ids-{pid:06d}-{seq:05d}-{uuid.uuid4().hex}.gnomids"
            names = pd.concat([x for x, _, _ in held])
            ids, lengths = np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held])
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(pack(names.fillna(0).astype("int64").to_numpy(), lengths, ids, int(names.isna().sum())))
            return pd.DataFrame({"pid": [pid], "seq": [seq], "file": [name], "n_docs": [len(names)], "n_ids": [len(ids)]})

        for b in batches:
            texts = [t or "" for t in b["text"]]
            names = pd.Series([int(k) if k else None for k in b["doc_id"]], dtype="Int64")
            sizes = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_CHARS, "right")))
                ids, lengths = tokens.encode(texts[at:to], end_id)
                held.append((names[at:to], ids, lengths))
                at = to
                if sum(len(x) for _, x, _ in held) >= SHARD_IDS:
                    yield shard()
                    held, seq = [], seq + 1
        if held:
            yield shard()

    # The id goes as text to the workers: a null among numbers would make them floating point.
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).withColumn("_h", F.xxhash64("text"))
    d = d.repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h").select(F.col("_id").cast("string").alias("doc_id"), "text")
    return stored(d.mapInPandas(run, "pid int, seq int, file string, n_docs bigint, n_ids bigint"), "ids-manifest")


def read_ids(manifest: DataFrame, folder: str, digests: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 or ids) of every document in the shards; start counts the ids before it.

    Documents without id have a null doc_id; an empty manifest gives an empty result.
    """
    # One row a shard.  Starts: inside a partition by a window, between partitions over one row each.
    inside = Window.partitionBy("pid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    between = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = manifest.groupBy("pid").agg(F.sum("n_ids").alias("t")).select("pid", F.coalesce(F.sum("t").over(between), F.lit(0)).alias("before"))
    placed = manifest.withColumn("own", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(totals, "pid").select("file", (F.col("own") + F.col("before")).alias("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(folder)
        for b in batches:
            for file, start in zip(b["file"], b["start"]):
                with store.open_input_file(f"{root}/{file}") as f:
                    doc_ids, lengths, ids, n_null = unpack(f.read())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                pieces = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                out = pd.DataFrame({"doc_id": pd.array(doc_ids, dtype="Int64"), "start": start + ends - lengths, "n_tokens": lengths.astype(np.int64)})
                out.loc[: n_null - 1, "doc_id"] = pd.NA
                if digests:
                    yield out.assign(ids_crc32=np.array([zlib.crc32(p) for p in pieces], np.int64))
                else:
                    yield out.assign(ids=[np.frombuffer(p, "<u4").astype("i4") for p in pieces])

    n = max(1, min(manifest.count(), 100_000))
    return placed.repartition(n).mapInPandas(run, "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digests else "ids array<int>"))


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "id-files")
    manifest = write_ids(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(manifest, folder)
