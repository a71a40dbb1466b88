import random
from collections import Counter

import pytest

from engramlake.llm import audit
from cases import empty, odd_rows, SCHEMA


def brute(rows, least, top):
    """rows (lang, source, text): the definition, term by term."""
    docs = [(a or "", b or "", bytes(t or "", "utf-8").translate(audit.TERM).decode().split()) for a, b, t in rows]
    out = []
    for lang in {a for a, _, _ in docs}:
        own = [(b, w) for a, b, w in docs if a == lang]
        held, total = Counter(t for _, w in own for t in set(w)), Counter(t for _, w in own for t in w)
        kept = [t for t in held if held[t] >= least]
        v, share = len(kept), lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
        nl = sum(total[t] for t in kept)
        q = {t: share(total[t], nl, v) for t in kept}
        counts = {s: Counter(t for b, w in own if b == s for t in w if t in q) for s in {b for b, _ in own}}
        p = {s: {t: share(c[t], sum(c.values()), v) for t in kept} for s, c in counts.items()}
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_against_the_definition(spark, monkeypatch, small):
    """Uneven sources and ties; with tiny slices and blocks every tile and several slices a group are met."""
    if small:
        monkeypatch.setattr(audit, "SLICE", 7)
        monkeypatch.setattr(audit, "BLOCK", 2)
        monkeypatch.setattr(audit, "GATHERED", 5)
    rng, rows = random.Random(2), []
    for _ in range(400):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", "é", None])
        rows.append((lang, source, " ".join(rng.choice(["Tea", "rain", "Süd", "x1y", "so"] + [f"w{chr(97 + k)}{chr(97 + rng.randrange(3))}" for k in range(20)]) for _ in range(rng.randrange(40)))))
    rows += [("fr", "lonely", "un mot"), ("fr", "other", None), ("zz", None, "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string").repartition(5)
    assert got(audit.divergence(df)) == brute(rows, audit.MIN_DOCS, audit.TOP)


def test_stops_at_the_bound():
    """More than TOP terms, ties at the k-th value included."""
    import pandas as pd

    n = 300
    of = pd.DataFrame({"lang": "en", "source": "s", "term": [f"t{i:03d}" for i in range(n)], "count": [i % 7 + 1 for i in range(n)], "p": [(i % 7 + 1) * 100 for i in range(n)], "q": [50 + 10 * (i % 13) for i in range(n)]})
    want = sorted(((int(p - q), t) for t, p, q in zip(of.term, of.p, of.q) if p > q), key=lambda x: (-x[0], x[1]))[: audit.TOP]
    assert [(v, t) for t, v in zip(audit._best(of)["item"], audit._best(of)["value"])] == want


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(audit, "MIN_DOCS", 2)
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    assert got(audit.divergence(df)) == brute([(r[2], r[3], r[1]) for r in odd_rows()], 2, audit.TOP)
    assert audit.divergence(empty(spark)).count() == 0
