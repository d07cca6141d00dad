"""Language identification as inference of a multilingual mixture.

Training counts character n-grams (three characters, hashed to BUCKETS) per language, on a bounded sample: about
SAMPLE documents of each language, chosen by a hash of their id.  A word's likelihood under a language is the product
over its n-grams.  A document is a mixture: every word comes from one language, and expectation-maximisation estimates
the proportions.  The k languages of largest proportion are fitted again for k = 1, 2, ..., as long as the languages
from the k-th on have half a word together (less cannot outweigh the penalty); the set with the best log-likelihood
less PENALTY * k * ln(words) is chosen, and its largest member is the prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, read_table

BUCKETS = 1 << 15
SAMPLE = 2_000
#: Expectation-maximisation ends for a document when no proportion moves by more.
TOLERANCE = 1e-4
PENALTY = 3.0
SMOOTHING = 0.2
MEMO = 1 << 17
SLICE = 300
MAX_LANGUAGES = 1_000
UNKNOWN = "und"
_LETTER = np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x10000)])


def is_letter(points: np.ndarray) -> np.ndarray:
    return np.where(points < 0x10000, _LETTER[np.minimum(points, 0xFFFF)], True)


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all words, index of each one's word); characters that are no letters are taken out, and a word has a blank on both sides."""
    text = " " + "  ".join(words) + " "
    lower = text.lower()
    if len(lower) != len(text):  # a few characters have longer lower-case forms
        lower = "".join(c.lower()[0] for c in text)
    points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    keep = is_letter(points) | (points == 32)
    points, owner = points[keep], owner[keep]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = points[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ points[2:] * np.uint64(0x165667B19E3779F9)
    h = (h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(49)
    inside = (owner[:-2] == owner[2:]) & (points[1:-1] != 32)
    return h[inside].astype(np.int64), owner[1:-1][inside]


def letter_words(text: str) -> list[str]:
    return [w for w in text.split() if any(map(str.isalpha, w))]


class Mixture:
    """The trained model; languages are in code point order, logp is a language x bucket table."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.logp = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)).T.astype(np.float64).copy() if languages else np.zeros((BUCKETS, 0))
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((0, len(languages)))

    def __getstate__(self):
        return {"languages": self.languages, "logp": self.logp, "memo": {}, "rows": self.rows[:0]}

    def learn_words(self, words: set[str]) -> None:
        """Rows of log-likelihoods for words not yet in the memo; a word without a letter gets -1."""
        new = sorted(words - self.memo.keys())
        if len(self.memo) + len(new) > MEMO:
            self.memo, self.rows, new = {}, self.rows[:0], sorted(words)
        self.memo.update((w, -1) for w in new)
        new = [w for w in new if any(map(str.isalpha, w))]
        if new:
            grams, owner = word_grams(new)
            logs = np.zeros((len(new), len(self.languages)))
            for k in range(len(self.languages)):
                logs[:, k] = np.bincount(owner, self.logp[grams, k], len(new))
            self.memo.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, logs])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[str]]]:
        """(language, its share, the language set) of each text; UNKNOWN and 0 for null, no letter or an untrained model."""
        out: list = [(UNKNOWN, 0.0, [])] * len(texts)
        cut = [t.split() if t else [] for t in texts]
        live = [i for i, w in enumerate(cut) if w] if self.languages else []
        at = 0
        while at < len(live):
            part, size = [], 0
            while at < len(live) and (not part or size + len(cut[live[at]]) <= 60_000):
                size += len(cut[live[at]])
                part.append(live[at])
                at += 1
            self.learn_words({w for i in part for w in cut[i]})
            rows = np.fromiter((r for i in part for r in map(self.memo.__getitem__, cut[i])), np.int64, size)
            doc = np.repeat(np.arange(len(part)), [len(cut[i]) for i in part])[rows >= 0]
            sizes = np.bincount(doc, minlength=len(part))
            some = [i for i, n in zip(part, sizes) if n]
            if some:
                for i, found in zip(some, self.infer(self.rows[rows[rows >= 0]], sizes[sizes > 0])):
                    out[i] = found
        return out

    def infer(self, logs: np.ndarray, sizes: np.ndarray) -> list[tuple[str, float, list[str]]]:
        n_docs, n_lang = len(sizes), logs.shape[1]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        top = logs.max(axis=1, keepdims=True)
        like, base = np.exp(logs - top), np.add.reduceat(top[:, 0], starts)
        doc = np.repeat(np.arange(n_docs), sizes)

        share, ll = self.fit(like, base, doc, starts, sizes, np.ones((n_docs, n_lang)))
        order = np.argsort(-share, axis=1, kind="stable")
        count = np.ones(n_docs, int)
        result = np.zeros((n_docs, n_lang))
        np.put_along_axis(result, order[:, :1], 1.0, axis=1)
        # Languages that have less than half a word together cannot outweigh a penalty, so the best set is among those before them.
        words = np.take_along_axis(share, order, axis=1) * sizes[:, None]
        rest = np.cumsum(words[:, ::-1], axis=1)[:, ::-1]
        best = np.full(n_docs, -np.inf)
        for k in range(1, n_lang + 1):
            mixed = np.flatnonzero(rest[:, max(k, 2) - 1] >= 0.5) if n_lang > 1 else np.zeros(0, int)
            if not len(mixed):
                break
            inside, few = np.isin(doc, mixed), sizes[mixed]
            begin = np.concatenate([[0], np.cumsum(few)[:-1]])
            place = np.repeat(np.arange(len(mixed)), few)
            allowed = np.zeros((len(mixed), n_lang))
            np.put_along_axis(allowed, order[mixed, :k], 1.0, axis=1)
            now, ll = self.fit(like[inside], base[mixed], place, begin, few, allowed)
            score = ll - PENALTY * k * np.log(few + 1)
            better = score > best[mixed]
            at = mixed[better]
            best[at], result[at], count[at] = score[better], now[better], k
        names = self.languages
        return [(names[a], float(min(1.0, result[i, a])), [names[j] for j in order[i, : count[i]]]) for i, a in enumerate(result.argmax(axis=1))]

    @staticmethod
    def fit(like, base, doc, starts, sizes, allowed) -> tuple[np.ndarray, np.ndarray]:
        """Proportions by expectation-maximisation over the allowed languages, until they stand still, and the log-likelihoods."""
        share = allowed / allowed.sum(axis=1, keepdims=True)
        live, part, place, begin, few = np.arange(len(sizes)), like, doc, starts, sizes
        while len(live):
            now = share[live]
            each = part * now[place]
            new = np.add.reduceat(each / np.maximum(each.sum(axis=1, keepdims=True), 1e-300), begin, axis=0) / few[:, None]
            share[live] = new
            moving = np.abs(new - now).max(axis=1) > TOLERANCE
            if not moving.all():
                part, few, live = part[np.repeat(moving, few)], few[moving], live[moving]
                place, begin = np.repeat(np.arange(len(live)), few), np.concatenate([[0], np.cumsum(few)[:-1]]).astype(int)
        return share, np.add.reduceat(np.log(np.maximum((like * share[doc]).sum(axis=1), 1e-300)), starts) + base


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Mixture:
    """A model of the languages in lang_col (rows with null text or language are left out), from about `sample` documents of each.

    More than MAX_LANGUAGES languages raise ValueError, as the table of a model has a column for each.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    per_lang = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).toPandas()
    if len(per_lang) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(per_lang["lang"], key=lambda x: x.encode())
    if not languages:
        return Mixture([], np.zeros((0, BUCKETS)))
    number = {x: i for i, x in enumerate(languages)}
    limit = F.create_map(*[F.lit(x) for lang, n in zip(per_lang["lang"], per_lang["count"]) for x in (lang, min(1.0, sample / n))])
    # Rows without id are drawn by their text.
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))), F.lit(1_000_000)) / 1_000_000
    chosen = rows.filter(drawn < F.element_at(limit, F.col("lang"))).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            for text, lang in zip(b["text"], b["lang"]):
                if words := letter_words(text):
                    table[number[lang]] += np.bincount(word_grams(words)[0], minlength=BUCKETS)
        lang, gram = np.nonzero(table)
        yield pd.DataFrame({"lang": lang.astype("i4"), "gram": gram.astype("i4"), "n": table[lang, gram]})

    sums = chosen.mapInPandas(count, "lang int, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), BUCKETS))
    counts[sums["lang"], sums["gram"]] = sums["n"]
    return Mixture(languages, counts)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Mixture, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and lang_set, which replace columns of those names.

    und with score 0 and an empty set where the text is null or has no letter, or no language was learned.  All other
    columns, of any type, and repeated rows are kept as they are; an empty table stays empty.
    """

    def work(texts: list) -> list[list]:
        found = model.predict(texts)
        return [[x[0] for x in found], [x[1] for x in found], [x[2] for x in found]]

    return mapped(docs, [text_col], "lang_pred string, score double, lang_set array<string>", work, claim_as="langid", clear=model.memo.clear, rows=SLICE)


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "lang_set")
