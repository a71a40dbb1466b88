import random

import numpy as np

from engramlake.llm import similar, simhash
from cases import empty, odd, odd_rows, words


def sets(texts):
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return {i: grams(similar.words_of(t)) for i, t in texts.items()}


def components(texts):
    """Least id of each id's component, by holding all sets that share a shingle against each other."""
    own, root, holders = sets(texts), {i: i for i in texts}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def join(i, j):
        a, b = sorted((find(i), find(j)))
        root[b] = a

    blank = [i for i, s in own.items() if not s]
    for i in blank[1:]:
        join(blank[0], i)
    for i in sorted(own):
        for j in {j for g in own[i] for j in holders.get(g, ())}:
            if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
                join(i, j)
        for g in own[i]:
            holders.setdefault(g, []).append(i)
    return {i: find(i) for i in texts}


def kept(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    return sorted(r.doc_id for r in simhash.one_of_each(df).collect())


def edited(rng, text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


def test_signature():
    h = similar.shingles(similar.words_of(words(9000)))
    own = similar.registers(h)
    assert own.all() and (own == similar.registers(h[::-1])).all() and len(similar.bands(own)) == similar.BANDS
    assert similar.signature(None)[1] == similar.signature(" \n")[1] == 0 and similar.signature(None)[3] == []
    assert similar.signature("A b") == similar.signature("a  B") and len(similar.shingles([b"a"] * 50)) == 1
    one = similar.registers(similar.shingles([b"one"]))
    assert np.count_nonzero(one) == 1 and len(set(similar.filled(one).tolist())) == 1


def test_registers_by_definition():
    """1 + leading zeros and the next ten bits of each bucket's least hash."""
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 2**64, 500, dtype=np.uint64))
    least = {}
    for x in h.tolist():
        y = x * 0x9E3779B97F4A7C15 % 2**64
        y = (y ^ (y >> 32)) * 0xD6E8FEB86659FD93 % 2**64
        b = (x >> 32) * similar.BUCKETS >> 32
        least[b] = min(least.get(b, 2**64), y)
    own = similar.registers(h)
    for b in range(similar.BUCKETS):
        if b not in least:
            assert own[b] == 0
        else:
            v = least[b]
            top = v.bit_length()
            bits = (v >> (top - 11)) & 1023 if top > 11 else (v << (11 - top)) & 1023
            assert abs(int(own[b]) - ((min(65 - top, 62) + 1) << 10 | bits)) <= 1  # the mantissa may be rounded


def test_near_copies_against_brute_force(spark):
    """Copies with up to 3 % of their words changed, groups of one to twelve, and texts that share a long passage."""
    rng, texts = random.Random(4), {}
    shared = words(60, 999)
    for g in range(40):
        base = words(rng.choice([8, 40, 200]), 50_000 + g * 313)
        for _ in range(rng.choice([1, 2, 5, 12])):
            texts[len(texts) + 1] = edited(rng, base, rng.randrange(0, 1 + len(base.split()) // 30))
    for g in range(30):
        texts[len(texts) + 1] = shared + " " + words(60, 20_000 + g * 131)
    root = components(texts)
    assert 40 < len(set(root.values())) < len(texts)
    assert kept(spark, texts) == sorted(set(root.values()))


def test_large_mixed_groups(spark):
    """Six bases of 300 words, 60 copies each with 2 to 9 words changed, all of one crowd through a common passage; single texts beside them."""
    rng, texts = random.Random(11), {}
    for g in range(6):
        base = words(300, 40_000 + g * 977)
        for _ in range(60):
            texts[len(texts) + 1] = edited(rng, base, rng.randrange(2, 10))
    assert kept(spark, texts) == sorted(set(components(texts).values()))


def test_a_group_of_hundreds(spark, monkeypatch):
    """600 copies around one text, from like to unlike it, in several tiles."""
    monkeypatch.setattr(similar, "TILE", 64)
    rng, texts = random.Random(13), {}
    base = words(150, 7)
    for _ in range(600):
        texts[len(texts) + 1] = edited(rng, base, rng.randrange(1, 9))
    want = components(texts)
    assert 5 < len(set(want.values())) < 500
    assert kept(spark, texts) == sorted(set(want.values()))


def test_two_groups_and_a_rest(spark, monkeypatch):
    """Keys of two groups and single texts with a common passage."""
    monkeypatch.setattr(similar, "TILE", 4)
    rng, texts = random.Random(7), {}
    for base, n in ((words(200, 1), 25), (words(160, 1) + " " + words(40, 70_000), 25)):
        for _ in range(n):
            texts[len(texts) + 1] = edited(rng, base, 2)
    for g in range(15):
        texts[len(texts) + 1] = words(120, 1) + " " + words(80, 30_000 + 211 * g)
    assert kept(spark, texts) == sorted(set(components(texts).values()))


def test_recall_at_the_threshold():
    """Pairs at 0.8 to 0.85 share a band and are plausible, in sets of 20 to 4,000; pairs at 0.5 are mostly discarded."""
    rng, n, hit, low = np.random.default_rng(1), 0, 0, 0
    for _ in range(600):
        size = int(rng.choice([20, 60, 400, 4000]))
        k = -(-8 * size // 9)  # common to two sets of size: k / (2 size - k) >= 0.8
        h = rng.integers(0, 2**64, size, dtype=np.uint64)
        a, b = np.unique(h), np.unique(np.concatenate([h[:k], rng.integers(0, 2**64, size - k, dtype=np.uint64)]))
        ra, rb = similar.registers(a), similar.registers(b)
        share = bool(set(similar.bands(ra)) & set(similar.bands(rb)))
        hit, n = hit + (share and bool(similar.plausible(ra, rb, np.float64(size), np.float64(size)))), n + 1
        far = similar.registers(np.unique(np.concatenate([h[: 2 * size // 3], rng.integers(0, 2**64, size - 2 * size // 3, dtype=np.uint64)])))
        low += size >= 400 and bool(similar.plausible(ra, far, np.float64(size), np.float64(size)))
    assert hit == n and low <= 2


def test_common_counts_in_parts(monkeypatch):
    monkeypatch.setattr(similar, "COUNTED", 7)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 30, rng.integers(0, 20))) for _ in range(12)]
    got = similar.common(sets[:5], sets[5:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]


def test_components_query(spark):
    """op12's columns by brute force, four words, with odd rows."""
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = sorted(map(tuple, similar.components(odd(spark), 4).collect()), key=repr)
    want = []
    for i, t in rows:
        w = similar.words_of(t)
        n = len({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))}) if w else 0
        root = 9 if i in (9, 10) else i
        want.append((i, n, root, i is None or root == i))
    assert got == sorted(want, key=repr)
    assert similar.components(empty(spark), 4).count() == 0
