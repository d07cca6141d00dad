"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. One pass over the texts writes a narrow row for each document: a digest of its words in order (documents with the
   same words are one class), BANDS hashes of WIDTH MinHash values of its word shingles each, and GATE one-byte values
   of other MinHash functions.  Only these rows are shuffled; a class keeps one of them, under a number of its own.
2. The bands make candidates: with a similarity of 0.8, a pair shares no band with probability
   (1 - 0.8**WIDTH)**BANDS < 4e-6.
3. Inside a bucket, values are compared incrementally, GATE_STEP at a time; a pair is dropped as soon as the posterior
   probability (uniform prior) that its similarity reaches the threshold is below TOLERANCE.  Only a spanning forest
   of the surviving pairs leaves the bucket, so a bucket of n classes gives fewer than n rows.
4. Classes connected by survivors meet in one group, for which alone texts are read again; there VERIFY further values
   prune in the same way, and the remaining pairs are verified exactly on their shingle sets.  Links are counted, not
   emitted; a spanning forest of the verified links gives the final classes.
Buckets and groups above BLOCK members are cut into blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components, forest
from ..storage import discard, stored
from .common import claim, free_names, give_back, mapped, read_table

THRESHOLD = 0.8
SHINGLE = 5
BANDS, WIDTH = 24, 4
GATE, GATE_STEP = 32, 8
VERIFY, VERIFY_STEP = 64, 16
TOLERANCE = 1e-7
BLOCK = 2_000
_MIX = np.random.default_rng(20).integers(1, 2**63, size=(BANDS * WIDTH + GATE + VERIFY, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) | 1 for k in range(1, 65)], np.uint64)
_words: dict[bytes, int] = {}


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | list[bytes], n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text or its words; fewer words are one shingle, none give none."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else text
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > 250_000:
        _words.clear()
    known = []
    for w in words:
        h = _words.get(w)
        if h is None:
            h = _words[w] = xxhash.xxh3_64_intdigest(w)
        known.append(h)
    h = np.array(known, np.uint64)
    k = min(n, len(h))
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * _POWERS[i]
    return np.unique(finish(total + np.uint64(k)))


def minhash(s: np.ndarray, first: int, count: int) -> np.ndarray:
    """MinHash values (32 bits) first to first + count of a non-empty shingle set, in slices that bound memory."""
    out = np.full(count, 0xFFFFFFFF, np.uint64)
    mix = _MIX[first : first + count]
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096, None]
        out = np.minimum(out, (((part ^ mix[None, :, 1]) * mix[None, :, 0]) >> np.uint64(32)).min(axis=0))
    return out


@lru_cache(64)
def least_matches(n: int, bits: int, threshold: float, tolerance: float) -> int:
    """The fewest matches of n values with which P(similarity >= threshold | matches) is at least tolerance.

    Uniform prior on the similarity s; two values of so many bits match with probability s + (1 - s) / 2**bits.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 2.0**bits
    for m in range(n + 1):
        log = lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(p) + (n - m) * np.log1p(-p + 1e-15)
        w = np.exp(log - log.max())
        if w[s >= threshold].sum() / w.sum() >= tolerance:
            return m
    return n + 1


def survivors(values: np.ndarray, a: np.ndarray, b: np.ndarray, step: int, bits: int, threshold: float) -> np.ndarray:
    """Which pairs of rows of values stay, comparing `step` more columns at a time."""
    live, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for at in range(0, values.shape[1], step):
        matches[live] += (values[a[live], at : at + step] == values[b[live], at : at + step]).sum(axis=1)
        live = live[matches[live] >= least_matches(at + step, bits, threshold, TOLERANCE)]
        if not len(live):
            break
    return live


def all_pairs(n: int, m: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of 0..n-1, or with m pairs of 0..m-1 and m..n-1, in slices of bounded size."""
    for lo in range(0, n if m is None else m, max(1, 400_000 // max(n, 1))):
        hi = min(n if m is None else m, lo + max(1, 400_000 // max(n, 1)))
        if m is None:
            i, j = np.nonzero(np.arange(lo, hi)[:, None] < np.arange(n)[None, :])
            yield i + lo, j
        else:
            i, j = np.divmod(np.arange((hi - lo) * (n - m)), n - m)
            yield i + lo, j + m


def by_group(keys: list[str], columns: list[str], work: Callable[[pd.DataFrame], list[tuple]], out: list[str]) -> Callable:
    """For mapInPandas over rows sorted by keys: calls work for each run of equal keys with at least two rows, also where batches cut it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, ready = None, []

        def flush(frame: pd.DataFrame) -> None:
            code = np.zeros(len(frame), bool)
            for k in keys:
                v = frame[k].values
                code[1:] |= v[1:] != v[:-1]
            code[:1] = True
            start = np.flatnonzero(code)
            size = np.diff(np.append(start, len(frame)))
            for s, n in zip(start[size > 1], size[size > 1]):
                ready.extend(work(frame.iloc[s : s + n]))

        for batch in batches:
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(frame):
                continue
            last = np.ones(len(frame), bool)
            for k in keys:
                last &= frame[k].values == frame[k].values[-1]
            cut = int(np.argmin(last[::-1])) if not last.all() else len(frame)
            cut = len(frame) - cut
            if cut:
                flush(frame.iloc[:cut])
            rest = frame.iloc[cut:]
            if len(ready) > 5000:
                yield pd.DataFrame(ready, columns=out)
                ready = []
        if rest is not None and len(rest):
            flush(rest)
        yield pd.DataFrame(ready, columns=out)
        del rest, ready
        give_back()

    return run


def in_blocks(df: DataFrame, key: str, member: str) -> DataFrame:
    """df with block_a, block_b, half: a group above BLOCK rows is cut into blocks by a hash of its member, and a row appears in every pair of blocks that has its own."""
    large = df.groupBy(key).count().filter(F.col("count") > BLOCK).select(F.col(key).alias("_k"), F.ceil(F.col("count") / (BLOCK // 2)).cast("int").alias("_n"))
    d = df.join(large, F.col(key) == F.col("_k"), "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    d = d.withColumn("_own", F.pmod(F.xxhash64(member, F.lit(5)), F.col("_n")).cast("int"))
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return d.withColumns({"block_a": F.least("_own", "_other"), "block_b": F.greatest("_own", "_other"), "half": (F.col("_own") > F.col("_other")).cast("int")}).drop("_k", "_n", "_own", "_other")


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, "half")


def pair_slices(g: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs that a group's rows stand for: all inside a block, or those between two blocks."""
    if g["block_a"].iloc[0] == g["block_b"].iloc[0]:
        return all_pairs(len(g))
    return all_pairs(len(g), int((g["half"].values == 0).sum()))


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, raw, key, bands, gate) of rows (doc_id, raw, text); key and what follows is null for texts without words."""

    def work(texts: list) -> list[list]:
        import xxhash

        keys, bands, gates = [], [], []
        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").split()
            if not words:
                keys.append(None), bands.append(None), gates.append(None)
                continue
            v = minhash(shingles(words), 0, BANDS * WIDTH + GATE)
            band = finish((v[: BANDS * WIDTH].reshape(BANDS, WIDTH) * _POWERS[:WIDTH]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
            bands.append(band.view(np.int64))
            gates.append(v[BANDS * WIDTH :].astype(np.uint8).tobytes())
        return [keys, bands, gates]

    return mapped(docs, ["text"], "key binary, bands array<bigint>, gate binary", work, claim_as="ngram_join", clear=_words.clear, keep=False, forget=True)


def bucket_edges(g: pd.DataFrame) -> list[tuple[int, int]]:
    ids = g["id"].values
    values = np.frombuffer(b"".join(g["gate"]), np.uint8).reshape(len(ids), GATE)
    if len(ids) == 2:
        pairs: Iterator = iter([(np.array([0]), np.array([1]))])
    else:
        pairs = pair_slices(g)
    left, right = [], []
    for a, b in pairs:
        k = survivors(values, a, b, GATE_STEP, 8, THRESHOLD)
        a, b = forest(len(ids), a[k], b[k])
        left.append(a), right.append(b)
    a, b = forest(len(ids), np.concatenate(left), np.concatenate(right))
    return list(zip(ids[a].tolist(), ids[b].tolist()))


def exact(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of shingle sets reach the threshold."""
    size = np.array([len(s) for s in sets])
    ok = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
    keep = np.flatnonzero(ok)
    if not len(keep):
        return keep
    if len(keep) < 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a[keep], b[keep])])
    else:  # many pairs: products of 0/1 rows over slices of the shingles that at least two sets share
        values, codes, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        place = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[codes]
        owner, place = owner[place >= 0], place[place >= 0]
        rows, cols = np.unique(a[keep]), np.unique(b[keep])
        total, wide = np.zeros((len(rows), len(cols)), np.float32), 2048
        at = np.argsort(place, kind="stable")
        owner, place = owner[at], place[at]
        for lo in range(0, int(place[-1]) + 1 if len(place) else 0, wide):
            s = slice(*np.searchsorted(place, [lo, lo + wide]))
            bits = np.zeros((len(sets), wide), np.float32)
            bits[owner[s], place[s] - lo] = 1
            total += bits[rows] @ bits[cols].T
        common = total[np.searchsorted(rows, a[keep]), np.searchsorted(cols, b[keep])].astype(np.int64)
    return keep[common >= threshold * (size[a[keep]] + size[b[keep]] - common) - 1e-9]


def group_links(g: pd.DataFrame) -> list[tuple[int, int, int]]:
    """(id, least linked id or itself, documents linked) for the members of a group that have a link."""
    claim("ngram_join", _words.clear)
    ids, copies = g["id"].values, g["copies"].values
    sets = [shingles(t) for t in g["text"]]
    values = np.stack([minhash(s, BANDS * WIDTH + GATE, VERIFY) for s in sets])
    links, left, right = np.zeros(len(ids), np.int64), [], []
    for a, b in pair_slices(g):
        k = survivors(values, a, b, VERIFY_STEP, 32, THRESHOLD)
        k = k[exact(sets, a[k], b[k], THRESHOLD)]
        a, b = a[k], b[k]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        a, b = forest(len(ids), a, b)
        left.append(a), right.append(b)
    a, b = forest(len(ids), np.concatenate(left), np.concatenate(right))
    root = np.arange(len(ids))
    root[a] = b
    live = np.flatnonzero(links)
    return list(zip(ids[live].tolist(), ids[root[live]].tolist(), links[live].tolist()))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, raw, text): raw is a hash of the text as it stands, which tells apart rows that share an id."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("raw"), F.col(text_col).alias("text"))


def _repeated(live: DataFrame) -> DataFrame:
    """(doc_id, raw, key) of rows that share id and words with another row; stored."""
    more = live.groupBy("doc_id", "key").count().filter("count > 1").select("doc_id", "key")
    return stored(live.select("doc_id", "raw", "key").join(more, ["doc_id", "key"], "left_semi").distinct(), "ngram-again")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, raw, key) of every row, key null without words; (key, class_id, n_links, first_key) of every key that has an id; the repeated rows.

    The rows with id class_id and key first_key stand for the class.
    """
    rows = _rows(docs, id_col, text_col)
    members = stored(signed(rows), "ngram-members")
    live = members.filter("key is not null and doc_id is not null")
    again = _repeated(live)
    reps = live.groupBy("key").agg(F.min(F.struct("doc_id", "raw")).alias("least"), F.count("*").alias("copies"), F.min(F.struct("gate", "bands")).alias("sign"))
    # The numbers are fixed by being written.
    reps = stored(reps.select("key", "least.*", "copies", "sign.*", F.monotonically_increasing_id().alias("n")), "ngram-classes")
    bands = reps.select(F.col("n").alias("id"), F.explode("bands").alias("band"), "gate")
    near = dealt(in_blocks(bands, "band", "id"), ["band", "block_a", "block_b"]).mapInPandas(by_group(["band", "block_a", "block_b"], [], bucket_edges, ["a", "b"]), "a bigint, b bigint")
    groups = stored(connected_components(near, "a", "b"), "ngram-groups")
    wanted = reps.select("doc_id", "raw", "n", "copies").join(groups.select(F.col("node").alias("n"), F.col("component").alias("group")), "n")
    loaded = rows.join(wanted.withColumnRenamed("n", "id"), ["doc_id", "raw"]).select("id", "group", "copies", "text")
    if not again.isEmpty():
        loaded = loaded.dropDuplicates(["id"])
    blocks = dealt(in_blocks(loaded, "group", "id"), ["group", "block_a", "block_b"])
    links = stored(blocks.mapInPandas(by_group(["group", "block_a", "block_b"], [], group_links, ["id", "root", "links"]), "id bigint, root bigint, links bigint"), "ngram-links")
    found = connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b")), "a", "b").withColumnRenamed("node", "n")
    linked = links.groupBy(F.col("id").alias("n")).agg(F.sum("links").alias("links"))
    named = reps.select("n", "key", "copies", F.struct("doc_id", "key").alias("least")).join(found, "n", "left").join(linked, "n", "left")
    lowest = named.filter("component is not null").groupBy("component").agg(F.min("least").alias("lowest"))
    named = named.join(lowest, "component", "left").withColumn("lowest", F.coalesce("lowest", "least"))
    named = stored(named.select("key", F.col("lowest.doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("lowest.key").alias("first_key")), "ngram-named")
    discard(reps), discard(groups), discard(links)
    return members, named, again


def similar_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, n_links.

    class_id is the least id of the documents connected to it by similarities of THRESHOLD or more; n_links counts the
    other documents that are that similar, copies included.  Texts with the same words in the same order are copies.
    A text without words (null, empty, blank) is linked to nothing and is its own class.  Rows that repeat an id stay,
    as copies or separate documents by their text; a null id is kept out of all classes, with a null class_id.  Ids are
    whole numbers, or text that holds them.  An empty table gives an empty result.  Other columns are ignored.
    """
    members, named, _ = _classes(docs, id_col, text_col)
    live = F.col("key").isNotNull() & F.col("doc_id").isNotNull()
    out = members.filter(live).join(named, "key").select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"))
    alone = members.filter(~live).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, the one of least id; rows without words or without id all stay.

    Where rows of one class share the least id, the one whose words have the least digest stays; of those with the same
    words, the first by text, then by the other columns.  An empty table stays empty; further columns are kept, whatever their names.
    """
    members, named, again = _classes(docs, id_col, text_col)
    first = (F.col("doc_id") == F.col("class_id")) & (F.col("key") == F.col("first_key"))
    placed = members.select("doc_id", "raw", "key").filter("key is not null and doc_id is not null").join(named.select("key", "class_id", "first_key"), "key")
    i, w, k, at = free_names(docs, "_id", "_raw", "_key", "_row")
    gone = placed.filter(~first).select(F.col("doc_id").alias(i), F.col("raw").alias(w)).distinct()
    d = docs.withColumns({i: F.col(f"`{id_col}`").cast("long"), w: F.xxhash64(text_col)}).join(gone, [i, w], "left_anti")
    if not again.isEmpty():
        twice = again.select(F.col("doc_id").alias(i), F.col("raw").alias(w), F.col("key").alias(k))
        order = Window.partitionBy(i, k).orderBy(text_col, F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
        one = d.join(twice, [i, w]).withColumn(at, F.row_number().over(order)).filter(F.col(at) == 1).drop(at, k)
        d = d.join(twice, [i, w], "left_anti").unionByName(one)
    return d.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(read_table(spark, sf_dir, "documents"))
