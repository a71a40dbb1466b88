"""Benchmark decontamination by size-partitioned MinHash containment search.

Items and documents are sets of five-word shingles (lower case, ASCII punctuation
as blanks; fewer than five words: the whole sequence).  Items are partitioned by
size: 1, 2-3, 4-7, ... shingles.  Each partition is an index of its own with one
signature length: the bottom-k MinHash of an item, with k such that even the
partition's largest item keeps the guarantee.  A document that holds a share t of
an item's n shingles misses at most floor((1-t)n) of them, so it holds at least one
of the floor((1-t)n)+1 least.  Documents are not sampled: a short item is lost in
a long document's MinHash, so all of a document's shingle hashes are looked up in
every partition.  Candidates are then verified on the shingles themselves.

The items of one block (``BLOCK_SHINGLES`` shingles) are broadcast; more items
make more blocks, each a pass over the rows with what they were found to contain.
Null and blank items are skipped; null and blank documents contain nothing.  Rows of
items that share an id are items of their own, and the id is listed once; an item
without an id is listed as null, after the others.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.common import text_batches

WORDS = 5
CONTAINED = 0.8
BLOCK_SHINGLES = 500_000
#: Bytes that read as blanks: ASCII control characters and punctuation.
PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8").translate(PLAIN).split()


def spans(words: list[bytes], k: int = WORDS) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The joined words and where each shingle starts and ends in them."""
    joined = b" ".join(words)
    if not words:
        return joined, np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(words) <= k:
        return joined, np.array([0]), np.array([len(joined)])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return joined, starts[: len(words) - k + 1], ends[k - 1 :]


def hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(joined[s:e]) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def needed(n: int, share: float = CONTAINED) -> int:
    """Shingles of n that make up the share."""
    return -int(-(Fraction(str(share)) * n) // 1)


class Partition:
    """The signatures of items of size low to 2 * low - 1."""

    def __init__(self, low: int, share: float):
        self.length = (2 * low - 1) - needed(2 * low - 1, share) + 1
        self.signatures: dict[int, set[int]] = defaultdict(set)

    def add(self, number: int, shingles: set[bytes]) -> None:
        for h in sorted(map(xxhash.xxh3_64_intdigest, shingles))[: self.length]:
            self.signatures[h].add(number)

    def close(self) -> None:
        self.keys = np.array(sorted(self.signatures), dtype=np.uint64)
        self.items = [sorted(self.signatures[int(k)]) for k in self.keys]
        del self.signatures

    def lookup(self, h: np.ndarray) -> set[int]:
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return {i for k in np.unique(at[self.keys[at] == h]).tolist() for i in self.items[k]}


class Index:
    """The partitions of one block of items."""

    def __init__(self, items: list[tuple[int | None, str]], share: float = CONTAINED):
        self.share, self.ids, self.sets, self.partitions = share, [], [], {}
        for item, text in items:
            joined, starts, ends = spans(words_of(text))
            shingles = {joined[s:e] for s, e in zip(starts.tolist(), ends.tolist())}
            if not shingles:
                continue
            low = 1 << (len(shingles).bit_length() - 1)
            self.partitions.setdefault(low, Partition(low, share)).add(len(self.ids), shingles)
            self.ids.append(item)
            self.sets.append(shingles)
        #: One bit for each 20-bit prefix that some key has: most shingles end here.
        self.seen = np.zeros(1 << 20, dtype=bool)
        for part in self.partitions.values():
            part.close()
            self.seen[(part.keys >> np.uint64(44)).astype(np.int64)] = True

    def search(self, text: str | None) -> list[tuple[int | None, float]]:
        """(item's id, containment) of the items that the text contains; the greatest where an id stands for several."""
        words = words_of(text)
        if not words or not self.sets:
            return []
        joined, starts, ends = spans(words)
        h = hashes(joined, starts, ends)
        h = h[self.seen[(h >> np.uint64(44)).astype(np.int64)]]
        found = set().union(*(part.lookup(h) for part in self.partitions.values())) if len(h) else ()
        out: dict[int | None, float] = {}
        own = {joined[s:e] for s, e in zip(starts.tolist(), ends.tolist())} if found else set()
        for number in found:
            n, size = len(self.sets[number] & own), len(self.sets[number])
            if n >= needed(size, self.share):
                out[self.ids[number]] = max(out.get(self.ids[number], 0.0), n / size)
        return sorted(out.items(), key=lambda x: (x[0] is None, x[0]))


def blocks(items: DataFrame, id_col: str, text_col: str, size: int = BLOCK_SHINGLES) -> list[DataFrame]:
    """The items in blocks of about size shingles, by hash of their id."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"] // 4  # a shingle has 4 bytes of text at least
    n = max(1, -(-int(total) // size))
    return [rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == b) for b in range(n)]


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = CONTAINED) -> DataFrame:
    """(id_col, items array<long>, max_containment): one row for each row of docs; no item: an empty array and 0."""
    found = "items array<long>, max_containment double"
    out, carried, every = docs.select(F.col(id_col), F.col(text_col).alias("_text")), (), blocks(items, item_id, item_text)
    for left, block in zip(range(len(every) - 1, -1, -1), every):
        index = docs.sparkSession.sparkContext.broadcast(Index([(r["item"], r["text"]) for r in block.collect()], share))

        def one(text, before=(), most=0.0, index=index, left=left):
            own = index.value.search(text)
            return *([text] if left else []), sorted({*before, *(i for i, _ in own)}, key=lambda i: (i is None, i)), max([most, *(c for _, c in own)])

        out = text_batches(out, id_col, "_text", one, f"_text string, {found}" if left else found, *carried)
        carried = ("items", "max_containment")
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """The rows of docs that contain no item; columns unchanged."""
    import pyarrow as pa

    from engramlake.llm.common import by_bytes

    by_bytes(docs.sparkSession)
    at = docs.columns.index("text")
    for block in blocks(items, "item_id", "text"):
        index = docs.sparkSession.sparkContext.broadcast(Index([(r["item"], r["text"]) for r in block.collect()]))

        def keep(batches, index=index):
            for batch in batches:
                yield batch.filter(pa.array([not index.value.search(t) for t in batch.column(at).to_pylist()], type=pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
