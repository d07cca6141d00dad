"""Phrase collocation mining with compressed position bitmaps, in the manner of SPAM.

1. Every task lays the words of its texts out in positions, a free one between pieces so that no shift crosses a piece,
   and cuts them into shards of one language and about SHARD positions.  A word's bitmap in a shard is compressed: of
   its blocks of 8 positions only those with a set bit are kept, as (block, byte).
2. Words are counted by popcount over all shards.  Words below the support are dropped, the others get numbers, and a
   shard's bitmaps meet in one row again.
3. Inside a shard a phrase is extended by shifting its bitmap one position on and taking AND with the bitmaps of the
   words; the popcount of what is left is its count there.  Popcounts are summed over the shards: first for phrases of
   two words; then, depth-first from one slice of first words to the next, for three and four, where each two words in
   a row must be a frequent phrase.  Which ones are frequent is told to the workers by a filter of FILTER_BITS bits; its
   size does not grow, and what it lets through in error is dropped by the sums.
4. Scores and containment are joins on the numbers of the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import row_numbers
from ..storage import discard, stored
from .common import read_table, trim

SUPPORT = 30
TOP = 2000
SHARD = 1 << 21
#: Block rows of first words that are extended at once, and rows of an AND that exist at once.
SLICE = 1 << 17
FILTER_BITS = 27
#: A longer phrase with this percentage of a candidate's count makes it superfluous.
CONTAINED = 80
UNKNOWN = "und"
#: Second key of phrases of one and of two words; those of three and four have none below 0 there.
ONE, TWO = -1, -2

_FOLD = bytearray(range(256))
for _c in range(65, 91):
    _FOLD[_c] = _c + 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = 10
_FOLD[9] = 32
_FOLD = bytes(_FOLD)


class _Shard:
    """Collects words of one language: positions are places in ids, where -1 is a free one."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        number = self.number
        words = text.translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
        for w in words:
            if w not in number:
                number[w] = len(number)
        ids = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
        ids = ids[ids != number.get(b"", -1)]
        ids[ids == number.get(b"\n", -1)] = -1
        self.ids += [ids, np.full(1, -1, np.int32)]
        self.size += len(ids) + 1

    def rows(self, lang: str, shard: int) -> pa.RecordBatch:
        """A row per word: count, blocks (the first, then steps) and bytes of its bitmap."""
        ids = np.concatenate(self.ids)
        at = np.flatnonzero(ids >= 0)
        order = np.argsort(ids[at], kind="stable")
        at, ids = at[order], ids[at][order]
        block, bit = (at >> 3).astype(np.int32), (np.uint8(1) << (at & 7).astype(np.uint8))
        first = np.ones(len(at), bool)
        first[1:] = (ids[1:] != ids[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(first)
        bits = np.bitwise_or.reduceat(bit, start) if len(start) else bit
        ids, block = ids[start], block[start]
        head = np.ones(len(ids), bool)
        head[1:] = ids[1:] != ids[:-1]
        heads = np.flatnonzero(head)
        step = block.copy()
        step[1:] = np.where(head[1:], block[1:], block[1:] - block[:-1])
        ends = np.append(heads, len(ids)).astype(np.int32)
        count = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
        words = list(self.number)
        binary = lambda data, width: pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(heads), pa.string()), pa.array(np.full(len(heads), shard, np.int64)), pa.array([words[i] for i in ids[heads].tolist()], pa.binary()), pa.array(count), binary(step, 4), binary(bits, 1)],
            ["lang", "shard", "word", "n", "steps", "bits"],
        )


def vertical(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", shard: int = SHARD) -> DataFrame:
    """(lang, shard, word, n, steps, bits): the bitmap of every word in every shard, word as UTF-8 bytes.  Null languages are UNKNOWN, null texts empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, open_ = TaskContext.get().partitionId() << 32, {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = open_.setdefault(lang, _Shard())
                s.add(text)
                if s.size >= shard:
                    yield open_.pop(lang).rows(lang, number)
                    number += 1
        for lang in list(open_):
            yield open_.pop(lang).rows(lang, number)
            number += 1
        trim()

    d = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("text")).filter("text is not null")
    return d.mapInArrow(run, "lang string, shard bigint, word binary, n bigint, steps binary, bits binary")


class Bitmaps:
    """The bitmaps of a shard's words, sorted by word, and again by block."""

    def __init__(self, ids: bytes, lens: bytes, steps: bytes, bits: bytes):
        words, lens = np.frombuffer(ids, np.int32), np.frombuffer(lens, np.int32)
        block = np.cumsum(np.frombuffer(steps, np.int32), dtype=np.int64)
        heads = np.concatenate([[0], np.cumsum(lens)[:-1]]) if len(lens) else np.zeros(0, np.int64)
        before = np.concatenate([[0], block[heads[1:] - 1]]) if len(lens) else block[:0]
        self.block = (block - np.repeat(before, lens)).astype(np.int32)
        self.word, self.bits = np.repeat(words, lens), np.frombuffer(bits, np.uint8)
        order = np.argsort(self.block, kind="stable")
        n = int(self.block.max()) + 2 if len(self.block) else 1
        self.start = np.concatenate([[0], np.cumsum(np.bincount(self.block, minlength=n))])
        self.by_word, self.by_bits = self.word[order], self.bits[order]

    def extended(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(phrase, next word, block, bits) of the bitmaps of all phrases shifted by one position AND those of all words, in slices."""
        shifted = np.concatenate([(bits << 1) & np.uint8(255), bits >> 7])
        phrase, block = np.concatenate([phrase, phrase]), np.concatenate([block, block + 1])
        live = np.flatnonzero((shifted != 0) & (block < len(self.start) - 1))
        shifted, phrase, block = shifted[live], phrase[live], block[live]
        begin, count = self.start[block], self.start[block + 1] - self.start[block]
        total = np.cumsum(count)
        lo = 0
        while lo < len(count):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 8 * SLICE, "right")))
            n = count[lo:hi]
            left = np.repeat(np.arange(lo, hi), n)
            right = np.arange(len(left)) + np.repeat(begin[lo:hi] - (np.cumsum(n) - n), n)
            both = shifted[left] & self.by_bits[right]
            hit = np.flatnonzero(both)
            left, right = left[hit], right[hit]
            yield phrase[left], self.by_word[right], block[left], both[hit]
            lo = hi

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, block, bits) of a run of words at a time; a word is never cut."""
        cut = np.flatnonzero(self.word[1:] != self.word[:-1]) + 1
        lo = 0
        while lo < len(self.word):
            k = np.searchsorted(cut, lo + SLICE)
            hi = int(cut[k]) if k < len(cut) else len(self.word)
            yield self.word[lo:hi], self.block[lo:hi], self.bits[lo:hi]
            lo = hi


def _joined(parts: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts)] if parts else []


def _mark(key: np.ndarray) -> np.ndarray:
    """Bit of the filter for a key of two word numbers."""
    h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - FILTER_BITS)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b


def _popcounts(k1: np.ndarray, k2: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set bits of each (k1, k2)."""
    if not len(k1):
        return k1.astype(np.int64), k1.astype(np.int64), k1.astype(np.int64)
    order = np.lexsort((k2, k1)) if len(k2) else np.argsort(k1, kind="stable")
    k1, k2, n = k1[order], k2[order], np.bitwise_count(bits[order]).astype(np.int64)
    new = np.ones(len(k1), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    at = np.flatnonzero(new)
    return k1[at], k2[at], np.add.reduceat(n, at)


def pairs_of(b: Bitmaps) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key of two words, TWO, popcount) of a shard."""
    for word, block, bits in b.slices():
        found = _joined([(_pair(p, w), x) for p, w, _, x in b.extended(word, block, bits)])
        if found:
            yield _popcounts(found[0], np.full(len(found[0]), TWO, np.int64), found[1])


def longer_of(b: Bitmaps, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(k1, k2, popcount) of the phrases of three and four words all of whose neighbours are marked, depth-first by slices of first words."""

    def marked(key: np.ndarray) -> np.ndarray:
        m = _mark(key)
        return np.flatnonzero(marks[m >> np.uint64(3)] >> (m & np.uint64(7)).astype(np.uint8) & np.uint8(1))

    def onward(row: np.ndarray, last: np.ndarray, block: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
        """Rows extended by one word; row numbers say which were."""
        parts = []
        for p, w, at, x in b.extended(np.arange(len(row)), block, bits):
            k = marked(_pair(last[p], w))
            parts.append((row[p[k]], last[p[k]], w[k], at[k], x[k]))
        return _joined(parts)

    for word, block, bits in b.slices():
        two = onward(word, word, block, bits)  # first word, the same, second word
        if not two or not len(two[0]):
            continue
        head, _, second, block2, bits2 = two
        three = onward(_pair(head, second), second, block2, bits2)
        if not three or not len(three[0]):
            continue
        k1, _, third, block3, bits3 = three
        yield _popcounts(k1, third.astype(np.int64), bits3)
        four = onward(np.arange(len(k1)), third, block3, bits3)
        if four and len(four[0]):
            row, c, d, _, bits4 = four
            yield _popcounts(k1[row], (c.astype(np.int64) + 1) << 32 | d, bits4)


_SUMS = "k1 bigint, k2 bigint, n bigint"


def _counted(shards: DataFrame, marks=None) -> DataFrame:
    """(k1, k2, n), a row per phrase and shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                maps = Bitmaps(r.ids, r.lens, r.steps, r.bits)
                for k1, k2, n in pairs_of(maps) if marks is None else longer_of(maps, marks.value):
                    yield pd.DataFrame({"k1": k1, "k2": k2, "n": n})
        trim()

    return shards.select("ids", "lens", "steps", "bits").mapInPandas(run, _SUMS)


def _filter(pairs: DataFrame) -> np.ndarray:
    """The filter's bytes with a bit for each pair's key; its parts are put together by bit_or, at most 2**(FILTER_BITS - 6) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = _mark(b["k1"].to_numpy())
            yield pd.DataFrame({"at": (m >> np.uint64(6)).astype(np.int64), "bits": (np.uint64(1) << (m & np.uint64(63))).view(np.int64)})

    rows = pairs.select("k1").mapInPandas(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def _packed(words: DataFrame) -> DataFrame:
    """A row per shard: the numbers of its words, their lengths in blocks, and their bitmaps one after the other."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        lens = np.array([len(x) for x in rows["bits"]], np.int32)
        return pd.DataFrame({"ids": [rows["id"].to_numpy().astype(np.int32).tobytes()], "lens": [lens.tobytes()], "steps": [b"".join(rows["steps"])], "bits": [b"".join(rows["bits"])]})

    return words.select("shard", "id", "steps", "bits").groupBy("shard").applyInPandas(run, "ids binary, lens binary, steps binary, bits binary")


def frequent_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, lang, word, f) of the frequent words; (k1, k2, f) of the frequent phrases of one to four words; (lang, n) of all words."""
    spark = docs.sparkSession
    maps = stored(vertical(docs, text_col=text_col, lang_col=lang_col, shard=shard), "phrase-bitmaps")
    counted = stored(maps.groupBy("lang", "word").agg(F.sum("n").alias("f")), "phrase-words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = stored(row_numbers(counted.filter(F.col("f") >= support), ["lang", "word"], "id").select((F.col("id") - 1).alias("id"), "lang", "word", "f"), "phrase-frequent")
    shards = stored(_packed(maps.join(words.select("lang", "word", "id"), ["lang", "word"])), "phrase-shards")
    discard(maps)
    sums = lambda d: d.groupBy("k1", "k2").agg(F.sum("n").alias("f")).filter(F.col("f") >= support)
    two = stored(sums(_counted(shards)), "phrase-two")
    marks = spark.sparkContext.broadcast(_filter(two))
    more = stored(sums(_counted(shards, marks)), "phrase-more")
    discard(shards)
    one = words.select(F.col("id").alias("k1"), F.lit(ONE).cast("long").alias("k2"), "f")
    return words, one.unionByName(two).unionByName(more), stored(totals, "phrase-totals")


def _numbers(phrases: DataFrame) -> DataFrame:
    """phrases with ids, the numbers of their words in order."""
    low = F.lit((1 << 32) - 1)
    a, b = F.shiftright("k1", 32), F.col("k1").bitwiseAND(low)
    c, d = F.shiftright("k2", 32) - 1, F.col("k2").bitwiseAND(low)
    ids = F.when(F.col("k2") == ONE, F.array("k1")).when(F.col("k2") == TWO, F.array(a, b)).when(F.col("k2") < (1 << 32), F.array(a, b, F.col("k2"))).otherwise(F.array(a, b, c, d))
    return phrases.withColumn("ids", ids)


def _key(ids: F.Column, start: int, size: int) -> F.Column:
    """The key of ids[start:start + size]."""
    at = lambda k: F.get(ids, F.lit(start + k))
    if size == 1:
        return F.struct(at(0).alias("k1"), F.lit(ONE).cast("long").alias("k2"))
    k1 = F.shiftleft(at(0), 32).bitwiseOR(at(1))
    k2 = F.lit(TWO).cast("long") if size == 2 else at(2) if size == 3 else F.shiftleft(at(2) + 1, 32).bitwiseOR(at(3))
    return F.struct(k1.alias("k1"), k2.alias("k2"))


def _by_size(of: dict[int, list]) -> F.Column:
    """An array of structs that depends on how many words a phrase has."""
    out = None
    for size, items in of.items():
        out = F.when(F.size("ids") == size, F.array(*items)) if out is None else out.when(F.size("ids") == size, F.array(*items))
    return out


def scored(phrases: DataFrame) -> DataFrame:
    """(k1, k2, ids, a, l, r, score) of the candidates among (k1, k2, f) that no longer candidate contains."""
    ids = F.col("ids")
    cands = stored(_numbers(phrases.filter(F.col("k2") != ONE)).withColumnRenamed("f", "a"), "phrase-candidates")
    cut = lambda size, k: F.struct(F.lit(k).alias("k"), _key(ids, 0, k).alias("left"), _key(ids, k, size - k).alias("right"))
    cuts = cands.select("k1", "k2", "a", F.inline(_by_size({s: [cut(s, k) for k in range(1, s)] for s in (2, 3, 4)})))
    part = lambda side, name: phrases.select(F.struct("k1", "k2").alias(side), F.col("f").alias(name))
    cuts = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right")
    # As decimals: 2,000,000 times a count may pass 64 bits, and so may the sum below.
    score = F.expr("cast(2000000 as decimal(8,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("k1", "k2").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("k1", "k2", "best.score", "best.l", "best.r")
    inner = {s: [_key(ids, i, n) for n in range(2, s) for i in range(s - n + 1)] for s in (3, 4)}
    within = cands.filter(F.size("ids") > 2).select("a", F.explode(_by_size(inner)).alias("sub")).groupBy("sub").agg(F.max("a").alias("longest"))
    d = cands.join(within.select("sub.k1", "sub.k2", "longest"), ["k1", "k2"], "left")
    d = d.filter("longest is null or cast(100 as decimal(3,0)) * cast(longest as decimal(19,0)) < cast(%d as decimal(3,0)) * cast(a as decimal(19,0))" % CONTAINED)
    return d.drop("longest").join(best, ["k1", "k2"])


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """The first `top` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Null texts are empty, null languages UNKNOWN; repeated rows count as often as they occur; other columns are ignored,
    and an empty table gives an empty result.  Ties in score and count go by the phrase's UTF-8 bytes.
    """
    words, phrases, totals = frequent_phrases(docs, text_col=text_col, lang_col=lang_col, support=support, shard=shard)
    found = scored(phrases).withColumn("id", F.get("ids", F.lit(0))).join(words.select("id", "lang"), "id").drop("id")
    # First by numbers, ties kept: words are looked up for what may be returned only.  Tasks keep their own first rows before the shuffle.
    place = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    best = found.withColumn("place", place).filter(F.col("place") <= top).drop("place")
    spelled = best.select("k1", "k2", F.posexplode("ids").alias("at", "id")).join(words.select("id", F.decode("word", "utf-8").alias("word")), "id")
    spelled = spelled.groupBy("k1", "k2").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    d = best.join(spelled, ["k1", "k2"]).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return d.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of documents."""
    return collocations(read_table(spark, sf_dir, "documents"))
