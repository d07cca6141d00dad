"""Precision and recall of each kind on labelled lines of other words and forms than the field was trained on; [x] marks a span."""

import re
from collections import Counter

from gnomon.llm import pii

LINES = """
phone: ring my desk, phone [555 867 5309], before noon
phone: my number is [555 867 5309]
phone: Tel.: [030 1234567]
phone: the fax [(212) 736-5000] never answers
phone: Reach the desk at [415-555-2671] or come by.
phone: mobile [0151 23456789] works best
phone: call [1-800-555-0199] whenever you want
phone: tel [020 7946 0958] is the hotel
email: write to [mary at gmail dot com]
email: please write to [mary at gmail dot com] again
email: mail [j.doe (at) uni-bonn (dot) de] for a copy
email: contact [press [at] museum.example] about it
email: you can reach [susan (at) bakery.example.co] all day
email: contact [frank at post dot example dot net] soon
card: charge the card [4539 1488 0343 6467] once more
card: card number [5105-1051-0510-5100] was refused
ip: ping [10.12.200.4] from the console
ip: server [192.168.01.99] is down
secret: api_key = "[Zk3vT9qLm2Xr8WcY5uNa7Bd1Ee4Hf6Gj]" in the config
secret: token: [9f86d081884c7d659a2feaa0c55ad015a3bf4f1b]
secret: he set token = "[2c26b46b68ffc68ff99b453c1d30413413422d70]" and left
secret: bearer [aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRva2Vu42x] was logged
clean: the match of 1998 ended 21-17 in hall 4
clean: order 99812 shipped with 12 boxes of 24
clean: meet us at the dot on the map
clean: they met at noon and at night
clean: version 3.14.2 of the tool needs 2048 MB
clean: sha256 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b of the archive
clean: the commit 2c26b46b68ffc68ff99b453c1d30413413422d70 broke it
clean: chapter 12 begins on page 345
clean: 1,250,000 people live there since 2011
clean: rows 100 200 300 400 of the table
clean: on 12/31/1999 at 23:59 all was well
clean: it costs 19.99 or 24.50 with tax
clean: a dot at the end is a full stop
clean: id 48151623 was not on the list
"""


def labelled():
    for line in LINES.strip().splitlines():
        kind, marked = line.split(": ", 1)
        at = [(m.start(), m.end()) for m in re.finditer(r"\[(?!at\])[^\[\]]*(?:\[at\][^\[\]]*)?\]", marked)]
        spans, text, last = [], "", 0
        for a, b in at:
            text += marked[last:a]
            spans.append((kind, len(text), len(text) + b - a - 2))
            text += marked[a + 1 : b - 1]
            last = b
        yield text + marked[last:], spans if kind != "clean" else []


def test_precision_and_recall():
    texts, truth = zip(*labelled())
    assert sum(map(len, truth)) == 22
    assert not {" ".join(t.split()) for t in texts} & {" ".join(re.sub(r"<[a-z]|>", "", line).split()) for line in (pii.TRAINING + pii.CLEAN).splitlines()}
    hit, given, wanted = Counter(), Counter(), Counter()
    for (_, found), spans in zip(pii.find_spans(list(texts)), truth):
        given.update(k for k, _, _ in found)
        wanted.update(k for k, _, _ in spans)
        hit.update(k for k, a, b in found if (k, a, b) in spans)
    recall = {k: hit[k] / wanted[k] for k in wanted}
    precision = {k: hit[k] / given[k] for k in given}
    assert all(recall[k] >= 0.8 for k in wanted), recall
    assert all(precision[k] >= 0.8 for k in given), precision
