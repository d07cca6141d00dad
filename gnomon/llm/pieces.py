"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces' UTF-8 bytes lie in a double-array trie (base, check).  From every position of a pre-token the trie is
walked once, which yields all pieces that start there; the best path takes the highest sum of log scores, an earlier
start winning ties.  Characters without a piece fall back to byte ids.  Encoded pre-tokens are kept in a memo of bounded size.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, mapped, read_table
from .unigram import MARK, Vocabulary, load, pretokens

#: Pre-tokens whose ids a worker remembers: about 200 bytes each.  The pipeline's stage has less room, as its workers carry more.
MEMO, STAGE_MEMO = 1 << 20, 1 << 18
SLICE = 500


class DoubleArray:
    """base[s] + byte + 1 is the next state if check of that is s; a state's value is at base[s] if check of that is s."""

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for k, v in keys.items():
            node = tree
            for b in k:
                node = node.setdefault(b + 1, {})
            node[0] = v
        size = 1 << 10
        base, check = [0] * size, [-1] * size
        check[0] = 0
        first, todo = 1, [(0, tree)]
        while todo:
            state, node = todo.pop()
            codes = sorted(node)
            while first < len(check) and check[first] >= 0:
                first += 1
            at = max(1, first - codes[0])
            while True:
                if at + 257 >= len(check):
                    base.extend([0] * len(base))
                    check.extend([-1] * len(check))
                if all(check[at + c] < 0 for c in codes):
                    break
                at += 1
            base[state] = at
            for c in codes:
                check[at + c] = state
            for c in codes:
                if c:
                    todo.append((at + c, node[c]))
                else:
                    base[at] = ~node[0]
        while len(check) > 1 and check[-1] < 0:
            check.pop()
        pad = 258
        self.base, self.check = base[: len(check)] + [0] * pad, check + [-1] * pad

    def prefixes(self, s: bytes, start: int) -> list[tuple[int, int]]:
        """(end, value) of every key that is a prefix of s[start:]."""
        base, check, state, out = self.base, self.check, 0, []
        for i in range(start, len(s)):
            nxt = base[state] + s[i] + 1
            if check[nxt] != state:
                break
            state = nxt
            leaf = base[state]
            if check[leaf] == state:
                out.append((i + 1, ~base[leaf]))
        return out


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.trie = DoubleArray({p.encode(): i for p, (_, i) in vocabulary.scores.items()})
        self.score = [0.0] * vocabulary.n_ids
        for x, i in vocabulary.scores.values():
            self.score[i] = x
        self.memo: dict[str, bytes] = {}
        self.limit = MEMO

    def pretoken(self, word: str) -> list[int]:
        if word == MARK:
            return [self.v.byte_id[b] for b in word.encode()]
        s = word.replace(" ", MARK).encode()
        n, score, byte_id = len(s), self.score, self.v.byte_id
        base, check = self.trie.base, self.trie.check
        best, back = [-1e300] * (n + 1), [None] * (n + 1)
        best[0], i = 0.0, 0
        while i < n:
            here, b = best[i], s[i]
            wide = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            single, state, j = False, 0, i
            while j < n:  # the common-prefix walk of DoubleArray.prefixes, in place: it is the inner loop
                nxt = base[state] + s[j] + 1
                if check[nxt] != state:
                    break
                state = nxt
                j += 1
                leaf = base[state]
                if check[leaf] == state:
                    piece = ~base[leaf]
                    if j - i == wide:
                        single = True
                    if (x := here + score[piece]) > best[j]:
                        best[j], back[j] = x, (i, piece)
            if not single and (x := here + self.v.unknown) > best[i + wide]:
                best[i + wide], back[i + wide] = x, (i, -1)
            i += wide
        out, i = [], n
        while i:
            j, piece = back[i]
            out.append([piece] if piece >= 0 else [byte_id[b] for b in s[j:i]])
            i = j
        return [x for p in reversed(out) for x in p]

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit integers; none for the empty text."""
        memo, parts = self.memo, []
        for w in pretokens(text) if text else ():
            x = memo.get(w)
            if x is None:
                if len(memo) >= self.limit:
                    memo.clear()
                x = memo[w] = np.array(self.pretoken(w), "<u4").tobytes()
            parts.append(x)
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD, and the space put before the text is taken away."""
        out = self.v.out
        text = b"".join([out[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(2)
def codec(path: str | None = None) -> Codec:
    return Codec(load(path))


def _codec(path: str | None, limit: int = MEMO) -> Codec:
    c = codec(path)
    c.limit = limit
    claim("pieces", c.memo.clear)
    return c


def encode(docs: DataFrame, *, text_col: str = "text", out_col: str = "piece_ids", path: str | None = None) -> DataFrame:
    """docs with the piece ids of text_col (null: null) in out_col, an array of int, which replaces a column of that name.

    All other columns, of any type, and repeated rows are kept as they are; an empty table stays empty.
    """
    if out_col.lower() == text_col.lower():
        raise ValueError("out_col must not be the text's column")

    def work(texts: list) -> list[list]:
        c = _codec(path, STAGE_MEMO)
        return [[None if t is None else c.encode(t).astype("i4") for t in texts]]

    return mapped(docs, [text_col], f"`{out_col}` array<int>", work, rows=SLICE)


def decode(docs: DataFrame, *, ids_col: str = "piece_ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """docs with the text of ids_col (null: null) in out_col, which replaces a column of that name.

    All other columns and repeated rows are kept; an empty table stays empty; an empty list is the empty text.
    """
    if out_col.lower() == ids_col.lower():
        raise ValueError("out_col must not be the ids' column")

    def work(ids: list) -> list[list]:
        c = _codec(path)
        return [[None if x is None else c.decode(x) for x in ids]]

    return mapped(docs, [ids_col], f"`{out_col}` string", work, rows=SLICE)


def encoded_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: id, n_pieces, n_bytes (ids from byte fallback), ids_crc32, round_trip (decoding gave the text).

    A null text is taken as empty: no pieces, crc32 0, round_trip true.  Ids of any type, nulls among them, come back as
    they are; repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """

    def work(texts: list) -> list[list]:
        c = _codec(path)
        low, high = min(c.v.byte_id), max(c.v.byte_id)
        rows = []
        for t in texts:
            t = t or ""
            ids = c.encode(t)
            rows.append((len(ids), int(((ids >= low) & (ids <= high)).sum()), zlib.crc32(ids.tobytes()), c.decode(ids) == t))
        return [list(x) for x in zip(*rows)]

    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return mapped(d, ["text"], "n_pieces bigint, n_bytes bigint, ids_crc32 bigint, round_trip boolean", work, rows=SLICE, keep=False)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(read_table(spark, sf_dir, "documents"))
