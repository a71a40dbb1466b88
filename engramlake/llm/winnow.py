"""Document fingerprints by winnowing, with DataFrame functions only.

Every run of ``K`` bytes of the UTF-8 text is hashed; of every ``W`` consecutive
hashes the least is chosen, the rightmost among equals, with its position.  Any
passage of W + K - 1 bytes that two texts share gives both a common hash; nothing
shorter than K does.

A text is cut into blocks of ``BLOCK`` window starts, each with the bytes its
windows reach; the blocks of a text stay in its row and nothing is shuffled.  An
edited text reuses the blocks before its first changed byte.  Window minima come
from doubling (the least of 2, 4, 8, 16), one pass over a block each.

Null and empty texts have no hashes; texts shorter than K have one, of the whole
text; texts with fewer than W hashes have one window.  Likeness is the share of
common hashes (Jaccard), 1 for two texts without hashes.  Rows that share an id follow
each other in the order of their texts; rows with a null id come first.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 16
W = 16
BLOCK = 160
#: Low bits of a hash that hold its place in the block, counted from the end so that the least is the rightmost.
PLACE = 4095


def _least_with(ahead: int):
    """Each hash or the one so far ahead, whichever is less; at the end, where there is none, the hash."""
    return lambda h: F.zip_with(h, F.slice(h, ahead + 1, F.size(h)), lambda x, y: F.least(x, y))


def selected(data: Column, length: Column, first_block: Column | None = None) -> Column:
    """array<array<bigint>>: for each block of the bytes, the chosen hashes with their place in the low bits."""
    hashes = F.when(length > 0, F.greatest(length - (K - 1), F.lit(1))).otherwise(0)
    windows = F.when(hashes > 0, F.greatest(hashes - (W - 1), F.lit(1))).otherwise(0)
    last = F.ceil(windows / BLOCK).cast("int") - 1
    first = F.lit(0) if first_block is None else first_block
    numbers = F.when(last >= first, F.sequence(first, F.greatest(last, first))).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(numbers, lambda b: F.substring(data, b * BLOCK + 1, BLOCK + K + W - 2))
    least = F.transform(
        pieces,
        lambda p: F.transform(
            F.sequence(F.lit(1), F.greatest(F.octet_length(p) - (K - 1), F.lit(1))),
            lambda i: F.xxhash64(F.substring(p, i, K)).bitwiseAND(F.lit(~PLACE)).bitwiseOR(F.lit(PLACE + 1) - i.cast("long")),
        ),
    )
    width = 1
    while width < W:  # the least of the next 2, 4, 8, ... hashes
        least = F.transform(least, _least_with(width))
        width *= 2
    return F.transform(least, lambda h: F.array_distinct(F.slice(h, 1, F.greatest(F.size(h) - (W - 1), F.lit(1)))))


def hash_set(blocks: Column) -> Column:
    """The different hashes, without places."""
    return F.array_distinct(F.transform(F.flatten(blocks), lambda h: F.shiftright(h, 12)))


def positions(blocks: Column, first_block: int = 0) -> Column:
    """array<struct<hash, position>>: what was chosen, with its byte position in the text."""
    return F.array_distinct(F.flatten(F.transform(blocks, lambda own, b: F.transform(own, lambda h: F.struct(F.shiftright(h, 12).alias("hash"), ((b + first_block) * BLOCK + PLACE - h.bitwiseAND(F.lit(PLACE))).cast("int").alias("position"))))))


def likeness(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when(total == 0, F.lit(1.0)).otherwise(common / total)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, chosen array<struct<hash, position>>: the general form."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(id_col, positions(selected(data, F.octet_length(data))).alias("chosen"))


def _in_ranges(rows: DataFrame, key: str, n: int) -> DataFrame:
    """rows with _range, the number of the row's range among about n equal ranges of key; null keys are in the first.

    The boundaries, fewer than n, are one constant in the plan: every step-th finds the part, then the part is searched.
    """
    marks = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000).alias("m")).first()["m"] or []
    marks = sorted(set(marks))
    step = max(1, int(len(marks) ** 0.5))
    kind = f"array<{rows.schema[key].dataType.simpleString()}>"
    constant = lambda values: F.from_json(F.lit(json.dumps(values, default=str)), kind)
    part = F.greatest(F.size(F.filter(constant(marks[::step]), lambda m: m < F.col(key))) - 1, F.lit(0)) * step
    inside = F.size(F.filter(F.slice(constant(marks), part + 1, step), lambda m: m < F.col(key)))
    return rows.withColumn("_range", F.coalesce(part + inside, F.lit(0)).cast("int"))


def with_next(docs: DataFrame, *, ranges: int | None = None, add=lambda df: df, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """Rows dealt by ranges of id and sorted, each range followed by a copy of the first row of the next one (the last by the very first).

    add: columns to compute once the rows lie in order.  Returns the rows, the
    copies marked in _ghost, and the window in which lead() sees the next row.
    """
    n = ranges or max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _in_ranges(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), id_col, n)
    heads = rows.groupBy("_range").agg(F.min(id_col).alias("head")).orderBy("_range").collect()  # n rows at most
    heads = [r for r in heads if r["head"] is not None]
    follows = [(heads[i]["head"], heads[i - 1]["_range"]) for i in range(len(heads))]  # the first row follows the last range
    after = docs.sparkSession.createDataFrame(follows, f"_head {docs.schema[id_col].dataType.simpleString()}, _after int")
    own, also = F.struct("_range", F.lit(0).alias("_ghost")), F.struct(F.col("_after").alias("_range"), F.lit(1).alias("_ghost"))
    both = F.when(F.col("_after").isNotNull(), F.array(own, also)).otherwise(F.array(own))
    rows = rows.join(F.broadcast(after), F.col(id_col) == F.col("_head"), "left")
    dealt = rows.select(id_col, "_text", F.explode(both).alias("_at")).select(id_col, "_text", "_at.*")
    order = ["_range", "_ghost", id_col, "_text"]
    dealt = add(dealt.repartitionById(n, "_range").sortWithinPartitions(*order))
    return dealt, Window.partitionBy("_range").orderBy("_ghost", id_col, "_text")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""

    def add(df):
        data = F.col("_text").cast("binary")
        return df.withColumn("_n", F.char_length("_text")).withColumn("_blocks", selected(data, F.octet_length(data)))

    rows, order = with_next(docs, add=add)
    rows = rows.select(
        "doc_id", "_ghost", "_text", "_n", "_blocks",
        F.lead("_text").over(order).alias("_next"), F.lead("_blocks").over(order).alias("_next_blocks"),
    ).where("_ghost = 0")
    # a lone range without a neighbour can only be one row's whole table
    rows = rows.withColumn("_next", F.coalesce("_next", "_text")).withColumn("_next_blocks", F.coalesce("_next_blocks", "_blocks"))
    cut = F.floor(F.col("_n") / 4).cast("int")
    keep = F.col("_n") - cut
    kept = F.substring(F.col("_text"), F.lit(1), keep)
    rows = rows.withColumn("_keep", F.octet_length(kept)).withColumn("_edited", F.concat(kept, F.substring(F.col("_next"), F.lit(1), cut)).cast("binary"))
    same = F.greatest(F.floor((F.col("_keep") - (K + W - 2)) / BLOCK).cast("int"), F.lit(0))
    rows = rows.withColumn("_same", F.least(same, F.size("_blocks")))
    changed = selected(F.col("_edited"), F.octet_length("_edited"), F.col("_same"))
    rows = rows.withColumn("_edited_blocks", F.concat(F.slice("_blocks", F.lit(1), F.col("_same")), changed))
    rows = rows.select("doc_id", "_n", F.sha2("_edited", 256).alias("edited_sha256"), "_blocks", "_edited_blocks", hash_set(F.col("_blocks")).alias("_a"), hash_set(F.col("_edited_blocks")).alias("_b"), hash_set(F.col("_next_blocks")).alias("_c"))
    digest = lambda c: F.sha2(F.array_join(F.transform(F.flatten(c), lambda h: F.hex(h)), ","), 256)
    return rows.select(
        "doc_id", F.col("_n").cast("long").alias("n_chars"), "edited_sha256", digest(F.col("_blocks")).alias("fingerprint"), digest(F.col("_edited_blocks")).alias("edited_fingerprint"),
        likeness(F.col("_a"), F.col("_b")).alias("near_edited"), likeness(F.col("_a"), F.col("_c")).alias("near_next"),
    )
