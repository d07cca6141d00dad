"""Collocations against brute force, over many shards, and the bitmaps against plain positions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from gnomon.llm import collocations
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, support=30, top=2000):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            for n in range(1, 5):
                counts[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = set()
    for lang, f in counts.items():
        total = sum(v for k, v in f.items() if len(k) == 1)
        cands = {k: v for k, v in f.items() if len(k) > 1 and v >= support}
        longest = Counter()
        for k, v in cands.items():
            for n in range(2, len(k)):
                for i in range(len(k) - n + 1):
                    longest[k[i : i + n]] = max(longest[k[i : i + n]], v)
        best = []
        for k, a in cands.items():
            if k not in longest or 100 * longest[k] < 80 * a:
                score, cut = min((2_000_000 * a // (f[k[:c]] + f[k[c:]]), c) for c in range(1, len(k)))
                best.append((-score, -a, " ".join(k).encode(), f[k[:cut]], f[k[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return out


def result(df):
    rows = [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("shard", [3_000, collocations.SHARD])
def test_documents_against_brute_force(spark, shard):
    d = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("lang", F.expr("if(doc_id % 50 = 0, null, lang)")).repartition(3)
    expected = brute(d.select("lang", "text").collect())
    assert len(expected) > 200
    assert result(collocations.collocations(d, shard=shard)) == expected


def test_query(spark):
    from gnomon.llm.queries import QUERIES

    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert result(QUERIES["op12_collocations"](spark, FOLDER)) == brute(d.select("lang", "text").collect())


def test_few_words_with_ties_and_overlaps(spark):
    """All phrases of few words: runs of one word, ties in every score, containment, the cut at top."""
    r = random.Random(3)
    rows = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(["a", "B", "c", "é", "d"]) + r.choice([" "] * 6 + ["\t ", ". ", "\n", "; ", "\x0b", "\x0c", "\r\n"]) for _ in range(r.randint(0, 90)))) for _ in range(150)]
    d = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    for top in (2000, 7):
        assert result(collocations.collocations(d, top=top, shard=200)) == brute(rows, top=top)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 7} x" for i in range(60_000))
    rows = [(None, None, 1), ("en", None, 2), ("en", "", 3), ("de", " \t\n.;", 4), (None, "One two. " * 40, 5), ("en", "A b c d e " * 40, 6), ("en", "A b c d e " * 40, 6), ("en", long, 7), ("fr", "\x00 \x00   ퟿ " * 40, 8), ("fr", "z" * 100_000 + " y " + "z" * 100_000, 9)]
    d = spark.createDataFrame([(*x, 1, 2, 3, "w") for x in rows], "lang string, text string, shard int, id int, k1 int, n int, word string")
    assert result(collocations.collocations(d)) == brute([x[:2] for x in rows])
    assert collocations.collocations(d.limit(0)).count() == 0


def shard_of(ids):
    s = collocations._Shard()
    s.ids, s.size, s.number = [np.array(ids, np.int32)], len(ids), {str(i).encode(): i for i in range(max(ids) + 1)}
    b = s.rows("en", 0)
    at = np.array([int(x) for x in b.column("word").to_pylist()], np.int32)
    bits = b.column("bits").to_pylist()
    return collocations.Bitmaps(at.tobytes(), np.array([len(x) for x in bits], np.int32).tobytes(), b"".join(b.column("steps").to_pylist()), b"".join(bits))


def test_shift_and_popcount_equal_positions(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 16)
    r = random.Random(1)
    ids = [r.choice([-1, 0, 0, 1, 2, 3, 4]) for _ in range(3_000)]
    maps = shard_of(ids)
    two, more = Counter(), Counter()
    for i in range(len(ids)):
        w = ids[i : i + 4]
        if len(w) > 1 and min(w[:2]) >= 0:
            two[tuple(w[:2])] += 1
        for n in (3, 4):
            if len(w) >= n and min(w[:n]) >= 0 and all((w[k], w[k + 1]) != (0, 1) for k in range(n - 1)):
                more[tuple(w[:n])] += 1
    got = Counter()
    for k1, _, n in collocations.pairs_of(maps):
        for k, c in zip(k1.tolist(), n.tolist()):
            got[k >> 32, k & 0xFFFFFFFF] += c
    assert got == two
    marks = np.zeros(1 << (collocations.FILTER_BITS - 3), np.uint8)
    for a, b in two:
        if (a, b) != (0, 1):
            m = int(collocations._mark(np.array([a << 32 | b]))[0])
            marks[m >> 3] |= 1 << (m & 7)
    got = Counter()
    for k1, k2, n in collocations.longer_of(maps, marks):
        for a, b, c in zip(k1.tolist(), k2.tolist(), n.tolist()):
            tail = (b,) if b < 1 << 32 else ((b >> 32) - 1, b & 0xFFFFFFFF)
            got[(a >> 32, a & 0xFFFFFFFF, *tail)] += c
    assert got == more


def test_scores_beyond_64_bits(spark):
    """Counts of 9 * 10**18: 2,000,000 * a and l + r pass 64 bits."""
    n = 9 * 10**18
    rows = [(0, collocations.ONE, n), (1, collocations.ONE, n), (0 << 32 | 1, collocations.TWO, n - 1)]
    got = collocations.scored(spark.createDataFrame(rows, "k1 long, k2 long, f long")).collect()
    assert [(r["a"], r["l"], r["r"], r["score"]) for r in got] == [(n - 1, n, n, 2_000_000 * (n - 1) // (2 * n))]
