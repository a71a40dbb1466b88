import hashlib
import random

from pyspark.sql import functions as F

from engramlake.llm import winnow
from cases import empty, odd, odd_rows


def slow_positions(spark, text):
    """Chosen positions by the definition, with the same hashes."""
    if not text:
        return []
    data = text.encode()
    grams = [data[i : i + winnow.K] for i in range(max(1, len(data) - winnow.K + 1))]
    rows = spark.createDataFrame([(i, bytearray(g)) for i, g in enumerate(grams)], "i int, g binary").select("i", F.shiftright(F.xxhash64("g"), 12).alias("h")).orderBy("i").collect()
    h = [r.h for r in rows]
    out = set()
    for s in range(max(1, len(h) - winnow.W + 1)):
        w = h[s : s + winnow.W]
        out.add(max(s + k for k, x in enumerate(w) if x == min(w)))
    return sorted((h[i], i) for i in out)


def test_chosen_positions(spark):
    rng = random.Random(3)
    texts = ["", "short", "x" * 16, "ab" * 300, "".join(rng.choice("abcdé 中") for _ in range(900)), "".join(rng.choice("ab") for _ in range(winnow.BLOCK * 2 + 31))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: sorted((c.hash, c.position) for c in r.chosen) for r in winnow.fingerprints(df).collect()}
    assert got == {i: slow_positions(spark, t) for i, t in enumerate(texts)}


def test_shared_passages_share_a_hash(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnop"
    rnd = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = rnd(winnow.K + winnow.W - 1)
    rows = [(i, rnd(rng.randint(50, 500)) + shared + rnd(rng.randint(50, 500))) for i in range(20)]
    got = [{c.hash for c in r.chosen} for r in winnow.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert set.intersection(*got)


def test_edited_pairs(spark):
    rng = random.Random(6)
    rows = [(i * 3, "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([0, 1, 5, 40, 700, 3000])))) for i in range(60)]
    rows += [(1000, rows[5][1]), (1001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in winnow.edited_pairs(df).collect()}
    order = sorted(rows)
    edited = []
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        cut = len(t) // 4
        edited.append((i, t[: len(t) - cut] + nxt[:cut]))
        assert got[i].edited_sha256 == hashlib.sha256(edited[-1][1].encode()).hexdigest() and got[i].n_chars == len(t)
    # reusing the blocks before the edit changes nothing
    whole = {r.doc_id: r for r in winnow.edited_pairs(spark.createDataFrame(edited, "doc_id long, text string")).collect()}
    assert all(whole[i].fingerprint == got[i].edited_fingerprint for i, _ in edited)
    assert got[rows[5][0]].fingerprint == got[1000].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


def test_odd_rows(spark):
    got = winnow.edited_pairs(odd(spark)).collect()
    assert len(got) == len(odd_rows()) and winnow.edited_pairs(empty(spark)).count() == 0
    one = winnow.edited_pairs(odd(spark).where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
