"""A unigram piece model: pieces with log scores, unknown characters as bytes, and the pre-token split both users share.

The vocabulary comes from a public SentencePiece file whose path is a parameter.  A file of merge ranks holds no
probabilities, so a piece of rank r (its place among the ordinary pieces) gets log p = -ln(r + 10) - ln(sum of
1 / (r + 10)), Zipf's law.  A character without a piece costs the least score minus 10 and is written as its UTF-8
bytes.  White-space marker: a space becomes U+2581, and one is put before the text.  A U+2581 in the text itself is
written as bytes, so decoding gives the text back exactly.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

MARK = "▁"
#: No piece crosses the start of a run of markers or a line end (checked when the model is loaded), so the best path of a text is the best paths of these in turn.
PRETOKEN = re.compile(" +[^ \n▁]*|[^ \n▁]+|[\n▁]")
UNKNOWN_COST = 10.0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """pieces: id -> bytes to decode to; scores: piece -> (score, id) for ordinary pieces; byte_id: byte -> id."""

    def __init__(self, entries: list[tuple[str, float]], byte_ids: list[int], n_ids: int):
        self.scores = {p: (s, i) for i, (p, s) in enumerate(entries) if p}
        self.byte_id = byte_ids
        self.out = [p.replace(MARK, " ").encode() for p, _ in entries]
        for b, i in enumerate(byte_ids):
            self.out[i] = bytes([b])
        self.unknown = min(s for s, _ in self.scores.values()) - UNKNOWN_COST
        self.n_ids = n_ids
        for p in self.scores:
            if "\n" in p or MARK in p.lstrip(MARK):
                raise ValueError(f"piece {p!r} crosses a pre-token boundary")


@lru_cache(2)
def load(path: str | None = None) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
    n = sp.get_piece_size()
    byte_ids, ordinary = [0] * 256, []
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[1:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            ordinary.append(i)
    norm = math.log(sum(1 / (r + 10) for r in range(len(ordinary))))
    entries = [("", 0.0)] * n
    for r, i in enumerate(ordinary):
        entries[i] = (sp.id_to_piece(i), -math.log(r + 10) - norm)
    return Vocabulary(entries, byte_ids, n)


def pretokens(text: str) -> list[str]:
    """The text, after one space, cut where no piece can cross; joined they are that text."""
    return PRETOKEN.findall(" " + text)
