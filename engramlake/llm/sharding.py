"""Sharding by fixed virtual slots, with DataFrame functions only.

A record's slot is the hash of its id modulo ``SLOTS``; it never changes.  Bytes
and rows are summed by slot, and a small versioned map sends slots to shards.  The
map is a table of its own, one folder a version: version 1 deals slots out largest
first to the emptiest shard and evens them out; each later version is the newest
one edited: slots of shards that are gone go to the emptiest ones, then slots move from the
fullest shards to the emptiest until the sizes are near equal.  While the records stay as they
are, the newest version is used as it is.  A version is written under a name of its own and
published by a rename, so a lost writer leaves the last version readable and the next run
working; of two runs at once the later one goes on from the other's version.  The map has SLOTS
rows whatever the input, so it is worked out on the driver and broadcast.

Equal texts are not kept together: their ids spread them over the slots, so that a
text with very many copies fills no slot.  Null ids share one slot; null texts have
no bytes.  Rows with equal ids stay together.  An empty table gives an empty result
and a map of empty slots.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramlake.sources.versions import Conflict, Version, Versions

SLOTS = 4096
SHARDS = 24
#: Bytes that each record takes besides its text.
RECORD_BYTES = 8


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(id_col), F.lit(SLOTS)).cast("int").alias("vslot"),
    )


def slot_sizes(records: DataFrame) -> DataFrame:
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def rebalance(sizes: dict[int, int], before: dict[int, int], shards: int) -> dict[int, int]:
    """An edited map: slots move from the fullest shard to the emptiest while that narrows the gap."""
    after = dict(before)
    load, held = [0] * shards, [[] for _ in range(shards)]
    for slot, shard in before.items():
        if shard < shards:
            load[shard] += sizes.get(slot, 0)
    # shards that are gone: their slots, largest first, to the emptiest shards
    for slot in sorted((s for s, shard in before.items() if shard >= shards), key=lambda s: (-sizes.get(s, 0), s)):
        after[slot] = min(range(shards), key=lambda s: (load[s], s))
        load[after[slot]] += sizes.get(slot, 0)
    load = [0] * shards
    for slot, shard in after.items():
        load[shard] += sizes.get(slot, 0)
        if sizes.get(slot, 0):
            held[shard].append(slot)
    for own in held:
        own.sort(key=lambda s: (sizes[s], s))
    while True:  # each move lowers the sum of the squared loads
        full, least = max(range(shards), key=lambda s: (load[s], s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[least]
        # the largest slot that still narrows the gap, best near half of it
        fit = [s for s in held[full] if 0 < sizes[s] < gap]
        if not fit:
            break
        slot = min(fit, key=lambda s: (abs(2 * sizes[s] - gap), s))
        held[full].remove(slot)
        held[least].append(slot)
        after[slot] = least
        load[full] -= sizes[slot]
        load[least] += sizes[slot]
    return after


def first_map(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Version 1: each slot, largest first, to the emptiest shard; empty slots in turn."""
    heap, out = [(0, s) for s in range(shards)], {}
    for slot in sorted(range(SLOTS), key=lambda s: (-sizes.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, 0), shard))
    return out


def slot_map(sizes: DataFrame, shards: int = SHARDS, previous: DataFrame | None = None) -> DataFrame:
    """(version, vslot, shard, bytes, rows, first_row): the next version after previous.

    first_row is the place in its shard of the slot's first record.
    """
    spark = sizes.sparkSession
    rows = {r["vslot"]: (int(r["bytes"]), int(r["rows"])) for r in sizes.collect()}  # SLOTS rows at most
    by_bytes = {s: b for s, (b, _) in rows.items()}
    if previous is None:
        version, plan = 1, rebalance(by_bytes, first_map(by_bytes, shards), shards)
    else:
        old = previous.collect()
        version = 1 + max(r["version"] for r in old)
        plan = rebalance(by_bytes, {r["vslot"]: r["shard"] for r in old}, shards)
    at, out = [0] * shards, []
    for slot in range(SLOTS):
        shard, (size, n) = plan[slot], rows.get(slot, (0, 0))
        out.append((version, slot, shard, size, n, at[shard]))
        at[shard] += n
    return spark.createDataFrame(out, "version int, vslot int, shard int, bytes long, rows long, first_row long")


def kept_map(sizes: DataFrame, folder: str, shards: int = SHARDS, tries: int = 20) -> Version:
    """The newest version of the folder's map if it fits these sizes, else the version after it, published and read back."""
    versions = Versions(sizes.sparkSession, folder)
    facts = lambda df: sorted(tuple(r) for r in df.drop("version").collect())  # noqa: E731  SLOTS rows
    for _ in range(tries):
        base = versions.newest()
        before = base.table("map") if base else None
        after = slot_map(sizes, shards, before)
        if base and facts(before) == facts(after):
            return base
        try:
            return versions.publish({"map": after.coalesce(1)}, base=base, expected={"map": SLOTS})
        except Conflict:
            continue  # another run published first; its version is the next base
    raise Conflict(f"the map in {folder} changed {tries} times while it was edited")


def assign(docs: DataFrame, folder: str, shards: int = SHARDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot (place in the shard, from 0), grown_shard, vslot, map_version; folder: where the map's versions are kept."""
    records = sized(docs, id_col=id_col, text_col=text_col)
    plan = kept_map(slot_sizes(records), folder, shards).table("map")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy(F.col(id_col), "size", "text_crc32"))
    return (
        records.withColumn("_n", place)
        .join(F.broadcast(plan.select("version", "vslot", "shard", "first_row")), "vslot")
        .select(
            id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first_row") + F.col("_n") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"),
        )
    )
