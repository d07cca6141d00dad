"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns (base spans) are exact.  The CRF adds what they miss: secrets (keys and tokens that a text gives away),
phone numbers without a country code, obfuscated e-mail addresses, grouped numbers.  It is trained by gradient ascent
on the small labelled table TRAINING below, once, on the driver; its weights go to the workers, which decode by Viterbi
in numpy batches.  Its input are the words within REACH words of a trigger: a word with a digit or @, or with `at` or
`dot` as a word of its own, in any case and with or without marks around it.  Every span that passes its kind's check
below holds one, so a word farther off is outside by the model's definition.  What a span is, is the model's decision;
a decoded span must only hold what its kind cannot be without (sound) and overlap no other span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, mapped, read_table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the CRF: those of the patterns, then secrets.
ALL_KINDS = (*KINDS, "secret")
REACH = 4
Span = tuple[str, int, int]

# The patterns.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORDS = re.compile(WORD)
# One class of first characters, so that the search skips quickly.
TRIGGER = re.compile(r"[0-9@AaDd](?:(?<=[0-9@])|(?<!\w.)(?:(?<=[Aa])[Tt]|(?<=[Dd])[Oo][Tt])(?!\w))")


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind: str, s: str) -> bool:
    """The check of a pattern's match."""
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)
    n = digits_of(s)
    if kind == "card":
        return 16 <= len(n) <= 19 and luhn(n)
    return kind == "email" or 8 <= len(n) <= 15


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local@domain; the local part is sought backwards from each @, so long runs of letters cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by kind as listed, then start; code points, end exclusive."""
    out = list(emails(text))
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if passes(kind, m[0])]
    return out


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# The labelled table.  <e..> e-mail, <p..> phone, <c..> card, <i..> address, <s..> secret; # stands for
# any digit, ~ for any hexadecimal one, ^ for any letter or digit.
TRAINING = """
call me at <p(###) ###-####> after lunch
tel. <p###-###-####> or write
phone: <p### ### ####> today
my number is <p###.###.####>, thanks
my number is <p### ### ####>
Tel.: <p0## #######>
Tel.: <p0#### ######> anrufen
ring <p0### ### ###> later
phone no. <p(0#) #### ####> or so
whatsapp <p### ### ###> please
mobile: <p#### ### ###>
call <p###-###-####> now
Tel <p0## ### ## ##> bitte
appelez le <p0# ## ## ## ##> demain
llame al <p### ## ## ##> por favor
fax <p(0##) ####-####> office
mobile <p0#### ######> only
reach us on <p###-####> now
the office (<p###-###-####>) is open
phone <p(###)###-####> is mine
write to <ejohn (at) example (dot) com> soon
mail <ejane.doe [at] mail.example.org> please
contact <eanna at example dot com> today
write to <emary at example dot com>
send it to <etom at mail dot example dot org> if so
reach me under <elee (at) firm (dot) de>
WRITE TO <eKIM (AT) SHOP (DOT) NET>
send it to <eNora (At) Firm (Dot) com> soon
mail <eOTTO (AT) Firm (DOT) de> again
mail: <esales (at) shop.example.net>
reach <ep.smith {at} example.com> for this
write <eoffice [at] example [dot] org> now
my email is <ebob (at) site (dot) org> ok
contact <ebob.jones at mail dot example dot net> or call
my card <c####-####-####-####> expires soon
card number <c#### #### #### ####> visa
card <c#### ###### #####> amex
pay with <c################> now
server at <i##.##.##.##> is down
ping <i###.##.#.##> and wait
host <i##.###.##.#> answered
token = <s"~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~">; done
(token: <s~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~>) was lost
set token <s^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^> there
auth_token: <s"^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^">, then
key = <s"~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~"***> and so on
token: <s~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~>
api key <s^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^> was sent
api_key = <s"^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^"> here
secret = <s'^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^'> there
the key is <sAKIA^^^^^^^^^^^^^^^^> now
bearer <s^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^> sent
password = <s"^^^^^^^^^^^^^^^^">
"""
CLEAN = """
in the year #### there were ## of them
version #.## was out on ####-##-##
it cost ##.## and then ###,### more
see page ### of chapter ##
id ######## was not found
id ^^^^^^^^ was not found
on ##/##/#### at ##:## we met
order ###-## has ### items
order ########## has come
the score was ##-## at half time
meet at noon by the river
meet me at the shop dot by noon
look at this house and that dot there
they were at home with the dog
the token in the text and the key to the house
release # of the manual ####
row ###### column ###
about #### people came in ####
# ## ### #### numbers in a row
section ###.## part #.#
he was at the shop and at work
hash### name## and word### are junk
http://www.example.com/en/##### is a page
commit ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~ made it
commit ~~~~~~~ was the last
sha1 ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~ of the file
md5 ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~ checksum
file ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~.png is here
words like aaaaaaaaaaaaaaaaaaaaaaaaaa# are long
the men at the house and at last
at at at at, said the parrot
build #### passed in ### ms
call number ## of the list
the number is ####
phone home in ## days
he stood at. then the dog at, was here
odd@@ marks** after&& words%% at## all==
we&& sat%% at&& one## table**
LOOK!! AT!! THAT!! NOW!!
At the end. At home or at. The rest
write at once and mail at ten
"""
#: Rows whose texts are searched at once.
ROWS = 2_000
CUES = frozenset("tel phone call fax mobile number card mail email write contact reach at dot (at) [at] {at} (dot) [dot] {dot} version page token key id on in = api_key secret password bearer commit sha1 md5 file".split())
LABELS = ("O", *(f"{p}-{k}" for k in ALL_KINDS for p in "BI"))


def shape(word: str) -> tuple[str, str]:
    """(with run lengths up to 9, without): digits d, capitals X, other letters x, marks as they are."""
    runs: list[list] = []
    for c in word:
        s = "d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    runs = runs[:12]
    return "".join(f"{s}{min(n, 9)}" if s == "d" else s for s, n in runs), "".join(s for s, _ in runs)


def word_features(word: str) -> tuple[str, ...]:
    long, short = shape(word)
    bare = word.lower().strip(".,;:!?")
    if bare in ("at", "dot") and bare != word.lower():
        bare = f"{bare} and marks"
    core = long.strip(".,;:!?\"'")
    n = sum(c.isalnum() for c in word)
    mixed = any("0" <= c <= "9" for c in word) and any(c.isalpha() for c in word)
    return (f"w{mixed}{min(n // 8, 5)}", f"l{core}" if len(core) < 12 else "l", f"s{short}" if len(short) < 12 else "s", f"c{bare if bare in CUES or ' ' in bare else ''}", f"n{min(sum('0' <= c <= '9' for c in word), 20)}", f"@{'@' in word}")


class Field:
    """Weights of the model: three tables (the word before, the word, the word after) from features to labels, and transitions."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, 3, len(LABELS)))
        self.moves = np.zeros((len(LABELS), len(LABELS)))
        self.memo: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def allowed(self) -> np.ndarray:
        """0 where a move is possible, else a large negative number: I-k follows B-k or I-k only."""
        bad = np.zeros_like(self.moves)
        for j, b in enumerate(LABELS):
            if b[0] == "I":
                for i, a in enumerate(LABELS):
                    if a[1:] != b[1:]:
                        bad[i, j] = -1e4
        return bad

    def ids(self, word: str, grow: bool = False) -> list[int]:
        found = word_features(word)
        if grow:
            return [self.index.setdefault(f, len(self.index)) for f in found]
        return [self.index[f] for f in found if f in self.index]

    def word_scores(self, word: str) -> np.ndarray:
        """Scores (3, labels) that the word gives as the one before, here and after."""
        x = self.memo.get(word)
        if x is None:
            if len(self.memo) > 50_000:
                self.memo.clear()
            x = self.memo[word] = self.weights[self.ids(word)].sum(axis=0)
        return x

    def emissions(self, sequences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Padded (sequence, word, label) scores, and lengths."""
        n = np.array([len(s) for s in sequences])
        e = np.zeros((len(sequences), n.max(), len(LABELS)))
        for i, s in enumerate(sequences):
            w = np.stack([self.word_scores(x) for x in s])
            e[i, : len(s)] = w[:, 1]
            e[i, 1 : len(s)] += w[:-1, 0]
            e[i, : len(s) - 1] += w[1:, 2]
        e[:, 0, [j for j, b in enumerate(LABELS) if b[0] == "I"]] -= 1e4
        return e, n

    def decode(self, sequences: list[list[str]], batch: int = 2048) -> list[list[int]]:
        """The best label sequences, by Viterbi over batches of windows of similar length."""
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        out: list = [None] * len(sequences)
        moves = self.moves + self.allowed()
        at = 0
        while at < len(order):
            part = order[at : at + batch]
            while len(part) > 1 and len(part) * len(sequences[part[-1]]) > 200_000:
                part = part[: len(part) // 2]
            at += len(part)
            e, n = self.emissions([sequences[i] for i in part])
            score, back = e[:, 0].copy(), np.zeros(e.shape, np.int8)
            for t in range(1, e.shape[1]):
                step = score[:, :, None] + moves[None]
                back[:, t] = step.argmax(axis=1)
                now = step.max(axis=1) + e[:, t]
                score = np.where((t < n)[:, None], now, score)
            rows, label = np.arange(len(part)), score.argmax(axis=1)
            path = np.zeros(e.shape[:2], np.int8)
            for t in range(e.shape[1] - 1, -1, -1):
                live = t < n
                path[live, t] = label[live]
                if t:
                    label = np.where(live, back[rows, t, label], label)
            for i, k in enumerate(part):
                out[k] = path[i, : n[i]].tolist()
        return out

    def fit(self, sequences: list[list[str]], labels: list[list[int]], rounds: int = 120, rate: float = 0.15, decay: float = 2e-3) -> None:
        """Gradient ascent (Adam) on the penalised log-likelihood, by forward-backward over the padded batch."""
        ids = [[self.ids(w, True) for w in s] for s in sequences]
        self.weights = np.zeros((len(self.index), 3, len(LABELS)))
        rows, cols, slots, feats = [], [], [], []
        for i, s in enumerate(ids):
            for t, fs in enumerate(s):
                for slot, u in ((0, t + 1), (1, t), (2, t - 1)):
                    if 0 <= u < len(s):
                        for f in fs:
                            rows.append(i), cols.append(u), slots.append(slot), feats.append(f)
        rows, cols, slots, feats = map(np.array, (rows, cols, slots, feats))
        n = np.array([len(s) for s in sequences])
        most, k, bad = n.max(), len(LABELS), self.allowed()
        gold = np.zeros((len(n), most, k))
        pairs = np.zeros((k, k))
        for i, y in enumerate(labels):
            gold[i, np.arange(len(y)), y] = 1
            np.add.at(pairs, (y[:-1], y[1:]), 1)
        start = np.array([-1e4 if b[0] == "I" else 0.0 for b in LABELS])
        mean = [np.zeros_like(self.weights), np.zeros_like(self.moves)]
        square = [np.zeros_like(self.weights), np.zeros_like(self.moves)]

        def lse(x, axis):
            m = x.max(axis=axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))

        for r in range(1, rounds + 1):
            e = np.zeros((len(n), most, k))
            np.add.at(e, (rows, cols), self.weights[feats, slots])
            e[:, 0] += start
            moves = self.moves + bad
            a, b = e.copy(), np.zeros_like(e)
            for t in range(1, most):
                a[:, t] = np.where((t < n)[:, None], lse(a[:, t - 1, :, None] + moves, 1) + e[:, t], a[:, t - 1])
            for t in range(most - 2, -1, -1):
                b[:, t] = np.where((t + 1 < n)[:, None], lse(moves[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0.0)
            z = lse(a[:, -1], 1)
            inside = (np.arange(most) < n[:, None])[..., None]
            p = np.where(inside, np.exp(a + b - z[:, None, None]), 0.0)
            pp = np.zeros((k, k))
            for t in range(1, most):
                q = np.exp(a[:, t - 1, :, None] + moves + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None])
                pp += q[t < n].sum(axis=0)
            g = np.zeros_like(self.weights)
            np.add.at(g, (feats, slots), (gold - p)[rows, cols])
            for j, (w, grad) in enumerate(((self.weights, g), (self.moves, pairs - pp))):
                grad = grad / len(n) - decay * w
                mean[j] = 0.9 * mean[j] + 0.1 * grad
                square[j] = 0.99 * square[j] + 0.01 * grad**2
                w += rate * (mean[j] / (1 - 0.9**r)) / (np.sqrt(square[j] / (1 - 0.99**r)) + 1e-8)
        self.memo.clear()


def labelled(copies: int = 6) -> tuple[list[list[str]], list[list[int]]]:
    """The labelled table with digits filled in, several times, from a fixed seed."""
    rng = np.random.default_rng(7)
    kind = dict(zip("eicps", ALL_KINDS))
    hexes, names = "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    sequences, labels = [], []
    for line in [x for x in (TRAINING + CLEAN).splitlines() if x] * copies:
        line = re.sub("[#~^]", lambda m: {"#": hexes[:10], "~": hexes, "^": names}[m[0]][rng.integers({"#": 10, "~": 16, "^": 62}[m[0]])], line)
        words, tags = [], []
        for part in re.split(r"(<[^>]*>[^\s<]*)", line):
            if m := re.match(r"<(.)([^>]*)>(.*)", part):
                inside = m[2].split(" ")
                inside[-1] += m[3]
                if words and not prefix_done:
                    inside[0] = words.pop() + inside[0]
                    tags.pop()
                words += inside
                tags += [f"B-{kind[m[1]]}"] + [f"I-{kind[m[1]]}"] * (len(inside) - 1)
            else:
                words += part.split()
                tags += ["O"] * len(part.split())
            prefix_done = not part or part[-1] == " "
        sequences.append(words)
        labels.append([LABELS.index(t) for t in tags])
    return sequences, labels


@lru_cache(1)
def model() -> Field:
    field = Field()
    field.fit(*labelled())
    return field


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Stretches of words (start, end) within REACH words of a trigger; overlapping ones are one."""
    hits = [m.start() for m in TRIGGER.finditer(text)]
    if not hits:
        return []
    spans = [m.span() for m in WORDS.finditer(text)]
    starts = np.array([s for s, _ in spans])
    hot = np.unique(np.searchsorted(starts, hits, "right") - 1)
    out, first, last = [], None, None
    for h in hot.tolist():
        a, b = max(0, h - REACH), min(len(spans), h + REACH + 1)
        if first is not None and a <= last:
            last = b
            continue
        if first is not None:
            out.append(spans[first:last])
        first, last = a, b
    out.append(spans[first:last])
    return out


def trimmed(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """The span without the marks around it; of a secret, its longest run of key characters."""
    if kind == "secret":
        runs = [m.span() for m in re.finditer(r"[A-Za-z0-9_+/-]+", text[a:b])]
        x, y = max(runs, key=lambda r: (r[1] - r[0], -r[0]), default=(0, 0))
        return a + x, a + y
    while b > a and text[b - 1] in ".,;:!?\"'>]}" or (b > a and text[b - 1] == ")" and "(" not in text[a:b]):
        b -= 1
    while a < b and text[a] in "\"'<[{" or (a < b and text[a] == "(" and ")" not in text[a:b]):
        a += 1
    return a, b


def sound(kind: str, s: str) -> bool:
    """What a decoded span cannot be without: an `at` and a `dot`, or their signs, for an e-mail address, as many digits as a phone number has,
    the patterns' own checks for addresses and cards, and 16 or more characters with letters and digits for a secret."""
    if kind == "email":
        return re.search(r"(@|(?<!\w)at(?!\w)).+(\w\.\w|(?<!\w)dot(?!\w))", s, re.IGNORECASE) is not None
    if kind == "phone":
        return 7 <= len(digits_of(s)) <= 15
    if kind == "secret":
        return len(s) >= 16 and any(c.isalpha() for c in s) and digits_of(s) != ""
    return passes(kind, s)


def crf_spans(texts: list[str], base: list[list[Span]], field: Field) -> list[list[Span]]:
    """For each text, the spans that the CRF adds to its base spans."""
    out: list[list[Span]] = [[] for _ in texts]
    owners, where, words = [], [], []
    for i, t in enumerate(texts):
        for w in windows(t):
            owners.append(i), where.append(w), words.append([t[a:b] for a, b in w])
    if not words:
        return out
    for i, w, labels in zip(owners, where, field.decode(words)):
        t, k = texts[i], 0
        while k < len(labels):
            name = LABELS[labels[k]]
            j = k + 1
            if name[0] == "B":
                while j < len(labels) and LABELS[labels[j]] == "I" + name[1:]:
                    j += 1
                kind = name[2:]
                a, b = trimmed(kind, t, w[k][0], w[j - 1][1])
                if a < b and sound(kind, t[a:b]) and all(b <= x or y <= a for _, x, y in base[i] + out[i]):
                    out[i].append((kind, a, b))
            k = j
    return out


def find_spans(texts: list[str], field: Field | None = None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind as listed, then start."""
    field = field or model()
    base = [base_spans(t) if TRIGGER.search(t) else [] for t in texts]
    rank = {k: i for i, k in enumerate(ALL_KINDS)}
    return [(b, sorted(b + x, key=lambda s: (rank[s[0]], s[1], s[2]))) for b, x in zip(base, crf_spans(texts, base, field))]


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added.

    A null text is taken as empty: no spans, the digest of the empty string.  Ids of any type, nulls among them, come
    back as they are; repeated rows stay; other columns are ignored.  Offsets are code points of the whole text.  An
    empty table gives an empty result.
    """
    field = model()

    def work(texts: list) -> list[list]:
        rows = []
        for base, spans in find_spans([t or "" for t in texts], field):
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
        return [list(x) for x in zip(*rows)]

    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    adds = ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint"
    return mapped(d, ["text"], adds, work, claim_as="pii", clear=field.memo.clear, rows=ROWS, keep=False)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced as one, by the first's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col replaced; a null text stays null, all other columns, of any type, and repeated rows are kept; an empty table stays empty."""
    field = model()

    def work(texts: list) -> list[list]:
        found = find_spans([t or "" for t in texts], field)
        return [[None if t is None else redacted(t, s) for t, (_, s) in zip(texts, found)]]

    return mapped(docs, [text_col], f"`{text_col}` string", work, claim_as="pii", clear=field.memo.clear, rows=ROWS).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read_table(spark, sf_dir, "documents"))
