"""SimHash near-duplicates through deletion-variant signatures.

A text's fingerprint has 64 bits: each the majority of that bit in the XXH64
(seed 42) of its three-word shingles, ASCII letters lowered, repeats included.
Fingerprints link at 3 or fewer differing bits.  Cut in 2 segments of 32 bits,
two such fingerprints differ by at most one bit in one of them.  Each segment is
indexed under 32 variants, one bit left out each; an equality join on the
variants finds all links, and the bits are verified.

Only different fingerprints are indexed, so exact copies cost nothing.  A variant
shared by more than ``CROWD`` fingerprints is not paired up.  Its fingerprints go
another exact way: everything within one bit of a point p links to the least
such fingerprint m(p), everything at two bits from p as well.  Any two
fingerprints at distance 3 or less have such a point between them, and whatever
links to m(p) is within 3 bits of it, so this gives the same components with a
number of rows in proportion to the fingerprints.

Null and blank texts have fingerprint 0 and link to each other like any others.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm import similar
from engramlake.llm.common import Tables, connected_components, text_batches

WORDS = 3
BITS = 3
SEED = 42
CROWD = 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles hashed at once; bounds memory on very long texts.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """As a signed 64-bit integer."""
    words = (text or "").encode("utf-8").translate(LOWER).split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        starts, ends = [0], [len(joined)]
    else:
        stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], stop[:-1] + 1])[: len(words) - WORDS + 1].tolist()
        ends = stop[WORDS - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), CHUNK):
        own = np.array([h(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], dtype="<u8")
        ones += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return text_batches(docs, id_col, text_col, lambda t: (fingerprint(t),), "fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): each segment with one of its bits left out, the segment and the bit in the key's upper half."""
    at = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at")
    return fps.select("fp", at).selectExpr(
        "(shiftleft(cast(at as bigint), 32) | (shiftrightunsigned(fp, 32 * (at div 32)) & 4294967295L & ~shiftleft(1L, at % 32))) as key", "fp"
    )


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= BITS


def links(fps: DataFrame, tables: Tables) -> DataFrame:
    """Edges (a, b) between different fingerprints that give the components of all links at 3 bits or fewer."""
    # dealt by number, so that a few tasks with the small table of fingerprints do not explode it alone
    keys = variants(fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp"))
    shared = tables.stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "variants")
    twos = shared.where("n = 2").where(_near("a", "b")).select("a", "b").distinct()
    # both sides are dealt by key at every size: the shared variants grow with the fingerprints
    members = tables.stored(keys.join(shared.where("n > 2").select("key", "n").hint("merge"), "key"), "members")
    few = members.where(F.col("n") <= CROWD).select("key", "fp")
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")).hint("merge"), "key").where("a < b").where(_near("a", "b")).select("a", "b").distinct()
    return twos.unionByName(pairs).unionByName(crowd_links(members.where(F.col("n") > CROWD).select("fp").distinct(), tables))


def crowd_links(fps: DataFrame, tables: Tables) -> DataFrame:
    """Edges among fingerprints of crowded variants, by the points between them.  The points grow with the crowd, so they are dealt and never sent whole."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(63)))
    one = fps.select("fp", bit.alias("i")).selectExpr("fp", "fp ^ shiftleft(1L, i) as p").unionByName(fps.selectExpr("fp", "fp as p"))
    least = tables.stored(one.groupBy("p").agg(F.min("fp").alias("m")), "points")
    near = one.join(least.hint("merge"), "p").where("fp <> m").selectExpr("m as a", "fp as b").distinct()
    two = fps.select("fp", bit.alias("i")).select("fp", "i", bit.alias("j")).where("i < j").selectExpr("fp", "fp ^ shiftleft(1L, i) ^ shiftleft(1L, j) as p")
    far = two.join(least.hint("merge"), "p").where("fp <> m").selectExpr("least(m, fp) as a", "greatest(m, fp) as b").distinct()
    return near.unionByName(far)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id): one row for each document; component_id is the least id of its component."""
    tables = Tables(docs.sparkSession)
    rows = tables.stored(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    heads = tables.stored(rows.groupBy("fp").agg(F.min(id_col).alias("head")), "heads")
    roots = connected_components(links(heads.select("fp"), tables), tables)
    joined = heads.join(roots.hint("merge"), heads.fp == roots.node, "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("head").alias("component_id"))
    named = joined.join(least.hint("merge"), "root").select("fp", "component_id")
    return tables.result(rows.join(named.hint("merge"), "fp").select(id_col, "fp", "component_id"), "components")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs with the least doc_id of their group; columns unchanged.

    Groups are the components of texts with a five-word similarity of 0.8 or more.
    Fingerprints within 3 bits are candidates like the bands of registers of
    :mod:`similar`, which find the pairs that deletion variants cannot; all are verified.
    Rows without an id stay; rows that share an id stay or go together.
    """
    tables = Tables(docs.sparkSession)
    known = docs.where("doc_id is not null")
    one = lambda t: (fingerprint(t), *similar.signature(t))
    rows = tables.stored(text_batches(known, "doc_id", "text", one, f"fp long, {similar.SIGNATURE}"), "signatures")
    texts = similar.different(rows, tables)
    fps = tables.stored(texts.groupBy("fp").agg(F.min("node").alias("first")), "heads")
    near = links(fps.select("fp"), tables)
    ends = near.join(fps.selectExpr("fp as a", "first as x").hint("merge"), "a").join(fps.selectExpr("fp as b", "first as y").hint("merge"), "b").selectExpr("x as a", "y as b")
    same = texts.join(fps.hint("merge"), "fp").where("node <> first").selectExpr("first as a", "node as b")
    roots = similar.links(texts, known.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")), tables, more=ends.unionByName(same))
    joined = texts.select("node", "head").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = tables.stored(joined.groupBy("root").agg(F.min("head").alias("doc_id")).select("doc_id").distinct(), "kept")
    out = docs.join(kept.hint("merge"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)
    return tables.result(out, "one-of-each")
