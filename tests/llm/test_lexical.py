import heapq
import math
import random
from collections import Counter

import numpy as np
import pytest

from engramlake.llm import lexical
from cases import empty, odd_rows, SCHEMA


def brute(docs, items, top):
    """docs (id, text), items (id, text): every document scored for every item."""
    own = [(i, Counter(lexical.terms_of(t.encode())), len(lexical.terms_of(t.encode()))) for i, t in docs if t is not None]
    own = [x for x in own if x[2]]
    n, total, df = len(own), sum(x[2] for x in own), Counter(t for _, c, _ in own for t in c)
    asked = {}
    for i, t in sorted({(i, t) for i, t in items if t is not None}, key=repr):
        asked[i] = asked.get(i, Counter()) + Counter(lexical.terms_of(t.encode()))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c, size in own:
            m = 75 + 25 * size * n // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in terms.items() if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(heapq.nsmallest(top, found), 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_numbers_packed():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**35, 2**62, 5], dtype=np.int64)
    data, ends = lexical.packed(v)
    assert lexical.unpacked(data.tobytes()).tolist() == v.tolist() and len(ends) == len(v)
    assert lexical.unpacked(data[ends[2] : ends[5]].tobytes()).tolist() == [128, 16383, 16384]
    assert len(lexical.unpacked(b"")) == 0


@pytest.mark.parametrize("size", [300, 16 << 20])
def test_against_the_definition(spark, monkeypatch, size):
    """Few and many shards, windows of few documents, ties, repeats, several blocks of items."""
    monkeypatch.setattr(lexical, "SHARD_BYTES", size)
    monkeypatch.setattr(lexical, "WINDOW", 3)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 400)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["Tea", "rain_drop", "Süd", "x1", "the", "the", "the"] + [f"w{k}" for k in range(40)]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 3, 20, 60]))) for i in range(300)]
    docs += [(i + 1000, docs[i][1]) for i in range(60)] + [docs[5], (None, docs[6][1])]
    items = [(i, text(rng.choice([1, 4, 12]))) for i in range(25)] + [(3, "another text"), (70, "nothing matches"), (None, "tea"), (71, None), (72, "")]
    got_ = got(lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")))
    assert got_ == brute(docs, items, lexical.TOP)


def test_odd_rows(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    items = [(1, "word text today"), (2, "w1x 中文字 123")]
    asked = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, term string")
    assert got(lexical.search(df, asked)) == brute([r[:2] for r in odd_rows()], items, lexical.TOP)
    assert lexical.search(empty(spark), asked).count() == 0 and lexical.search(df, asked.limit(0)).count() == 0
