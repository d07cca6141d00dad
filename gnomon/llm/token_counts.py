"""Token counts by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens are inserted in a trie.  The unigram forward score of a prefix (the score and the number of
pieces of its best segmentation) is computed once, when its node is made, whatever number of pre-tokens share it; the
node where a pre-token ends holds its count.  A document's count is the sum over its pre-tokens.  The trie and the
terminal counts by pre-token live on from batch to batch, up to a bounded size.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, read_table
from .unigram import MARK, Vocabulary, load, pretokens

MEMO = 1 << 19
NODES = 1 << 21


class ForwardTrie:
    """A trie of pre-tokens whose nodes hold the forward score of their prefix.

    child: (node, character) to node, as one dictionary; a node's best is the score of the best segmentation of its
    prefix and many the pieces of it; terminal has the count of a pre-token that ends in a node.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        lengths: dict[str, set[int]] = {}
        for p in vocabulary.scores:
            lengths.setdefault(p[-1], set()).add(len(p))
        #: A piece that ends at a node ends in the node's character: only these lengths are looked up, longest first.
        self.lengths = {c: sorted(x, reverse=True) for c, x in lengths.items()}
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.many, self.up, self.terminal = [0.0], [0], [0], {}

    @property
    def nodes(self) -> int:
        """Nodes besides the root."""
        return len(self.best) - 1

    def insert(self, word: str) -> int:
        """Inserts a pre-token, which makes and scores the nodes that no other shares, and returns the count at its terminal node."""
        if word == MARK:  # stands in the text itself
            return len(word.encode())
        w = word.replace(" ", MARK)
        child, best, many, up = self.child, self.best, self.many, self.up
        node, i, n = 0, 0, len(w)
        while i < n and (nxt := child.get((node, w[i]))) is not None:
            node, i = nxt, i + 1
        if i < n:
            path = [node]  # the nodes of the prefix, from the shared one up to the root
            while node:
                node = up[node]
                path.append(node)
            path.reverse()
            for k in range(i, n):
                path.append(self.grown(w, k, path))
            node = path[-1]
        count = self.terminal[node] = many[node]
        return count

    def grown(self, w: str, k: int, path: list[int]) -> int:
        """A new node for w[: k + 1], scored from the nodes of its shorter prefixes."""
        scores, best, many, c = self.v.scores, self.best, self.many, w[k]
        top, n, end = -1e300, 0, k + 1
        for size in self.lengths.get(c, ()):
            if size <= end and (p := scores.get(w[end - size : end])) and (s := best[path[end - size]] + p[0]) > top:
                top, n = s, many[path[end - size]] + 1
        if c not in scores and (s := best[path[k]] + self.v.unknown) > top:
            top, n = s, many[path[k]] + len(c.encode())
        node = len(best)
        best.append(top)
        many.append(n)
        self.up.append(path[k])
        self.child[path[k], c] = node
        return node

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        return {w: self.insert(w) for w in words}


_tries: dict[str | None, tuple[ForwardTrie, dict[str, int]]] = {}


def count_texts(texts: Iterable[str], path: str | None = None) -> list[tuple[int, int]]:
    """(pieces, pre-tokens) of each text; the empty text has none.  Trie and memo start anew when they pass NODES or MEMO."""
    if path not in _tries:
        _tries[path] = ForwardTrie(load(path)), {}
    trie, memo = _tries[path]
    out = []
    for t in texts:
        words = pretokens(t) if t else []
        n = 0
        for w in words:
            count = memo.get(w)
            if count is None:
                if len(memo) >= MEMO or trie.nodes >= NODES:
                    memo.clear()
                    trie.clear()
                count = memo[w] = trie.insert(w)
            n += count
        out.append((n, len(words)))
    return out


def _forget() -> None:
    for trie, memo in _tries.values():
        memo.clear()
        trie.clear()


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: id, n_tokens, n_pretokens.

    A null or empty text has 0 of both.  Ids of any type, nulls among them, come back as they are; repeated rows stay;
    an empty table gives an empty result; other columns are ignored; ties between segmentations of one score go to the
    longer last piece.
    """

    def work(texts: list) -> list[list]:
        found = count_texts((t or "" for t in texts), path)
        return [[x[0] for x in found], [x[1] for x in found]]

    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return mapped(d, ["text"], "n_tokens bigint, n_pretokens bigint", work, claim_as="token_counts", clear=_forget, keep=False)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
