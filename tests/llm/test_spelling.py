"""Spelling variants against brute force over all pairs, on odd rows and on words made by random edits."""

import random
import re
import zlib
from collections import Counter

import pytest
from gnomon.llm import spelling

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key string, slot int, mask long, other string, shorter int"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute(words):
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, []) if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda v: (-words[v], v))
            if words[best] >= 10 * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def result(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_documents_against_brute_force(spark):
    from gnomon.llm.queries import QUERIES

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    expected = brute(brute_words(docs))
    assert any(x[1] for x in expected) and any(x[4] > 1 for x in expected)
    assert result(QUERIES["op11_spelling_variants"](spark, FOLDER)) == expected


def test_edits_of_every_kind(spark):
    """Words of all lengths from 7 on, edited at any place by letters of all kinds; ties; words whose edits share halves."""
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzéèüß×É"
    words = {}
    for _ in range(150):
        w = "".join(r.choice(letters[:12]) for _ in range(r.randint(7, 16)))
        words[w] = r.choice([2, 20, 400, 400, 5000])
        for _ in range(6):
            k = r.randrange(len(w) + 1)
            v = r.choice([w[:k] + r.choice(letters) + w[k:], w[: max(0, k - 1)] + w[k:], w[: max(0, k - 1)] + r.choice(letters) + w[k:]])
            if len(v) >= 7:
                words[v] = r.choice([2, 3, 40, 400])
                w = v if r.random() < 0.5 else w
    assert result(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


def test_one_hot_group(spark):
    """Words with one half and one band in common."""
    words = {f"prefixes{a}{b}": 2 + (i == 0) * 98 for i, (a, b) in enumerate((a, b) for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghij")}
    assert result(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


def test_bands():
    masks = spelling.band_masks()
    assert sum(masks) == (1 << spelling.LETTER_BITS) - 1 and all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])
    bits = spelling.letter_bits()
    assert len(bits) == 26 + 64 and max(bits.values()) == spelling.LETTER_BITS - 1


def test_parity_flips(spark):
    words = ["letters", "lettersa", "lettars", "etters", "", "étéé", "aab", "b"]
    got = {r["w"]: r["m"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", spelling.parity_mask(spelling.F.col("w")).alias("m")).collect()}
    flips = lambda a, b: bin(got[a] ^ got[b]).count("1")
    assert (flips("letters", "lettersa"), flips("letters", "lettars"), flips("letters", "etters"), flips("aab", "b")) == (1, 2, 1, 0) and got[""] == 0


def test_odd_rows(spark):
    text = "Letters letters LETTERS lettres lÉttres, short"
    rows = [(None, None), (1, None), (2, ""), (3, " \n"), (None, text), (None, text), (4, text), (4, text), (5, "verylongword " * 30_000), (6, "a" * 50_000 + " " + "a" * 49_999), (7, "a" * 50_000)]
    d = spark.createDataFrame([(*x, "k", 1, 2, "o", 3) for x in rows], SCHEMA)
    assert result(spelling.variants(spelling.word_table(spelling.edited_runs(d)))) == brute(brute_words(rows))
    assert spelling.variants(spelling.word_table(spelling.edited_runs(d.limit(0)))).count() == 0


@pytest.mark.parametrize("n", [9, 10])
def test_ratio(spark, n):
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(spark.createDataFrame([("letters", 10 * n), ("lettersa", n), ("lettersab", 1)], "word string, n long"), ratio=10).collect()}
    assert got["lettersa"] == ("letters", "letters")
    assert got["lettersab"] == (("lettersa", "letters") if n == 10 else (None, "lettersab"))
