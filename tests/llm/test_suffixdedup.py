import hashlib
import random

import numpy as np
import pytest

from engramlake.llm import suffixdedup as sd
from cases import empty, odd


def brute(rows):
    first = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for o in range(len(b) - 49):
            first.setdefault(b[o : o + 50], i)
    out = []
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for o in range(len(b) - 49):
            if first[b[o : o + 50]] < i:
                gone[o : o + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [10**9, 5])
def test_suffix_order(tmp_path, limit):
    rng = random.Random(limit)
    for letters in (b"ab", b"a", b"abcd", bytes(range(256))):
        s = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(20)]
        s += s[:7]
        string, depth, prefix = sd.suffix_order(np.frombuffer(b"".join(s), np.uint8), np.array([len(x) for x in s]), str(tmp_path), limit)
        own = [s[i][len(s[i]) - d :] for i, d in zip(string, depth)]
        assert own == sorted(x[k:] for x in s for k in range(len(x) + 1))
        for a, b, p in zip(own, own[1:], prefix[1:]):
            n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert n == p


def passages(rng, n):
    words = ["alpha", "beta", "gamma", "delta", "omega", "é", "zz"]
    shared = [" ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(5, 30))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) + str(rng.randint(0, 9999)) for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a:], "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30)))]
        rows.append((i, "".join(parts)))
    return rows


def test_equals_brute_force(spark):
    rng = random.Random(8)
    rows = passages(rng, 80) + [(100 + i, "abcde" * rng.randint(1, 60)) for i in range(10)] + [(200, None), (201, ""), (202, "x" * 49), (203, "x" * 50), (204, "x" * 3000), (205, "é" * 60), (206, "é" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in sd.remove_repeats(df).collect()) == brute(rows)


def test_crowded_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sd, "CROWDED_BYTES", 500)
    rows = passages(random.Random(9), 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in sd.remove_repeats(df).collect()) == brute(rows)


def test_small_blocks_and_batches_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_BYTES", 400)
    monkeypatch.setattr(sd, "TAKEN_BYTES", 300)
    monkeypatch.setattr(sd, "ORDER_BYTES", 200)
    rows = passages(random.Random(10), 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in sd.remove_repeats(df).collect()) == brute(rows)


def test_rows_that_share_an_id(spark):
    a, b, c = "a" * 10 + "".join(f"one{i} " for i in range(30)), "".join(f"two{i} " for i in range(40)), "".join(f"two{i} " for i in range(20)) + "zz"
    got = sd.remove_repeats(spark.createDataFrame([(5, a), (5, b), (5, c), (9, c), (9, b)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got) == sorted([(5, len(a), 0), (5, len(b), 0), (5, len(c), 0), (9, len(c), len(c)), (9, len(b), len(b))])


def test_no_table_but_the_result_stays(spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {p.name for p in folder.iterdir()}
    out = sd.remove_repeats(spark.createDataFrame(passages(random.Random(11), 20), "doc_id long, text string"))
    assert out.count() == 20 and [n for n in {p.name for p in folder.iterdir()} - before if n.startswith("run-")] == []


def test_what_a_step_shuffled_goes_before_the_next(spark, monkeypatch):
    import gc
    import time
    from pathlib import Path

    from engramlake.llm import common

    folders = [Path(str(d)) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    shuffled = lambda: {p.name for d in folders for p in d.glob("*/shuffle_*.data")}
    before, left, tables, write = shuffled(), [], {}, common._written

    def written(df, path, partition_by=None):
        name = path.rsplit("/", 1)[-1].split("-")[0]
        run = Path(path.removeprefix("file:")).parent if name != "kept" else tables["folder"]
        tables.setdefault("folder", run)
        tables[name] = {p.name.split("-")[0] for p in run.iterdir()} if run.exists() else set()
        out = write(df, path, partition_by)
        end = time.time() + 5  # files go in the background
        while shuffled() - before and time.time() < end:
            time.sleep(0.1)
        left.append((name, len(shuffled() - before)))
        return out

    monkeypatch.setattr(common, "_written", written)
    gc.disable()
    try:
        rows = passages(random.Random(12), 60)
        got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    finally:
        gc.enable()
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert left == [(name, 0) for name in ("firsts", "keys", "strings", "crowded", "ranges", "kept")]
    assert "keys" not in tables["ranges"] and not {"keys", "strings"} & tables["kept"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_BYTES", 300)
    data = bytes(random.Random(1).choice(b"ab") for _ in range(2000))
    seen = [base + o for base, part in sd.pieces(data) for o in range(len(part) - 49)]
    assert seen == list(range(2000 - 49))


def test_odd_rows(spark):
    got = {(r.doc_id, r.n_bytes): r for r in sd.remove_repeats(odd(spark)).collect()}
    assert got[None, 12].n_removed == 0 and got[1, 0].n_bytes == 0 and got[10, 26].n_removed == 0 and got[8, 20_000].n_removed == 0
    assert sd.remove_repeats(odd(spark)).count() == 14 and sd.remove_repeats(empty(spark)).count() == 0
