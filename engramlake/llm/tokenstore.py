"""Token-id output: a content-addressed store.

Id streams are cut into chunks where a rolling hash of the last ``WINDOW`` ids
ends in zero bits, so equal passages give equal chunks wherever they stand.  A
chunk is stored once under the first 16 bytes of its SHA-256.  A document's
recipe lists its chunks; its Merkle root is the hash tree over them.  Recipes lie
in segments of ascending ids.  The manifest is the tree above the documents: a
page's root is the hash of up to ``PAGE`` documents' roots in order, a segment's
that of its pages, the store's that of its segments.

Files (Parquet, by Spark's writers, in one folder):
  format/    version, width (bytes of an id: 2 where the vocabulary allows)
  chunks/    chunk binary(16), payload binary (ids, little-endian)
  recipes/   segment, page, doc_id, before (ids of the segment's documents before it), n_tokens, root, recipe (chunk keys in order)
  manifest/  segment, page, documents, tokens, first_id, last_id, root; page -1: the segment's row, with start, the ids before the segment;
             segment -1: the store's row

Reading back first holds the recipes against the manifest, page by page and up to
the store's root, so that a lost or changed recipe file is found; then it hashes
every stored payload against its key, recomputes each document's root from its
recipe and combines the CRCs of its chunks, so no document is ever assembled in
one place to be verified; ``ids_of`` assembles ids.

Null and empty texts hold the end id alone.  Equal recipes are resolved once.
Among rows that share an id the order is that of their roots; rows with a null id
come first.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.llm.bpe import Parted, Vocabulary, byte_alphabet, plain, word_blocks
from engramlake.llm.common import by_bytes, remove

END_ID = 1
#: Documents of one page of the manifest.
PAGE = 4096
WINDOW = 8
#: Chunks have 256 ids on average.
MASK = np.uint64(0xFF)
LEAST, MOST = 32, 2048
KEY = 16


def marks(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW ids would cut."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while width < WINDOW:  # h[i] covers ids i-width+1 .. i
        h[width:] = h[width:] + h[:-width] * np.uint64(pow(0x100000001B3, width, 1 << 64))
        width *= 2
    return np.flatnonzero((h >> np.uint64(40)) & MASK == 0) + 1


def cuts(n: int, marked: list[int]) -> list[int]:
    """Ends of the chunks of a stream of n ids, from its own marks."""
    out, at = [], 0
    for m in [*(m for m in marked if WINDOW <= m < n), n]:
        while m - at > MOST:
            at += MOST
            out.append(at)
        if m - at >= LEAST or m == n and m > at:
            at = m
            out.append(at)
    return out


def merkle(keys: list[bytes]) -> bytes:
    """Root of the binary hash tree over chunk keys; an odd node moves up as it is."""
    level = [hashlib.sha256(b"\0" + k).digest() for k in keys] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class LibraryEncoder(Parted):
    """The tokenizers library's ids, packed; each different word of some megabytes goes to its model once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = id_width(self.tokenizer)
        vocabulary = Vocabulary(path)
        self.split, self.added = vocabulary.words.findall, list(vocabulary.added)
        self.bytes, self.model, self.code = dict(enumerate(byte_alphabet())), self.tokenizer.model, "H" if self.width == 2 else "I"
        super().__init__()

    def word(self, word: str) -> bytes:
        symbols = word if word.isascii() and word.isalpha() else word.encode("utf-8").decode("latin-1").translate(self.bytes)
        return array(self.code, [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def pieces(self, text: str):
        if all(plain(block) for block, _ in word_blocks(text)) and not any(a in text for a in self.added):
            for block, goes_on in word_blocks(text):
                if goes_on:  # a word longer than a block: the library takes the text as a whole
                    break
            else:
                return (block.lower() for block, _ in word_blocks(text))
        return (array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes(),)


def id_width(tokenizer) -> int:
    return 2 if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return LibraryEncoder(path)


CHUNKS = "chunk binary, payload binary"
RECIPES = "doc_id long, n_tokens long, recipe binary, root binary"


def encoded(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of two kinds: 'recipe', one a document, and 'chunk', what a task has not sent before."""

    def encode(batches):
        enc = library_encoder(tokenizer)
        end, width, sent = np.array([END_ID], dtype=f"<u{enc.width}").tobytes(), enc.width, set()
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            streams = [[] for _ in range(len(batch))]
            for k, ids in enc.stream(batch.column(1).to_pylist()):
                streams[k].append(ids)
            lengths, data = [], []
            for own in streams:
                own.append(end)
                lengths.append(sum(map(len, own)) // width)
                data += own
            data, ends = b"".join(data), np.cumsum(lengths)
            marked = marks(np.frombuffer(data, dtype=f"<u{width}"))
            upto = np.searchsorted(marked, ends, side="right").tolist()
            chunks, recipes, start, seen = [], [], 0, 0
            for doc, n, m in zip(batch.column(0).to_pylist(), lengths, upto):
                at, keys = 0, []
                for to in cuts(n, (marked[seen:m] - start).tolist()):
                    payload = data[(start + at) * width : (start + to) * width]
                    key, at = hashlib.sha256(payload).digest()[:KEY], to
                    keys.append(key)
                    if key not in sent:  # a task's own repeats; the rest meet by key later
                        if len(sent) > 100_000:
                            sent.clear()
                        sent.add(key)
                        chunks.append(("chunk", None, None, None, None, key, payload))
                recipes.append(("recipe", doc, n, b"".join(keys), merkle(keys), None, None))
                start, seen = start + n, m
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*recipes, *chunks), types)] if recipes else [pa.array([], t) for t in types], names=["kind", "doc_id", "n_tokens", "recipe", "root", "chunk", "payload"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(encode, f"kind string, {RECIPES}, {CHUNKS}")


def store(docs: DataFrame, tokenizer: str, folder: str, **names) -> None:
    """Write docs' ids into a new folder.

    What the encoder gives is written once, by kind; recipes are then dealt by
    ranges of ids.  Only sums of segments, never texts or ids, meet in one place.
    """
    from tokenizers import Tokenizer

    spark, staged = docs.sparkSession, f"{folder}/staged"
    by_bytes(spark)
    spark.createDataFrame([(2, id_width(Tokenizer.from_file(tokenizer)))], "version int, width int").coalesce(1).write.parquet(f"{folder}/format")
    encoded(docs, tokenizer, **names).write.option("compression", "zstd").partitionBy("kind").parquet(staged)
    rows = spark.read.schema(f"{RECIPES}, {CHUNKS}, kind string").parquet(staged)
    rows.where("kind = 'chunk'").groupBy("chunk").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{folder}/chunks")
    n, order = max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), [F.col("doc_id").asc_nulls_first(), F.col("root")]
    placed = rows.where("kind = 'recipe'").select("doc_id", "n_tokens", "root", "recipe").repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(in_segments, SEGMENTS)
    placed.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    manifest(spark.read.parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")
    remove(spark, staged)


SEGMENTS = "segment int, page int, doc_id long, before long, n_tokens long, root binary, recipe binary"


def in_segments(batches):
    """A task's recipes, which come in order, with their place: the task is the segment."""
    segment, count, before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = before + np.cumsum(n)
        page = (count + np.arange(len(n))) // PAGE
        columns = [pa.array(np.full(len(n), segment, dtype=np.int32)), pa.array(page.astype(np.int32)), batch.column(0), pa.array(ends - n), batch.column(1), batch.column(2), batch.column(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["segment", "page", "doc_id", "before", "n_tokens", "root", "recipe"])
        if len(n):
            count, before = count + len(n), int(ends[-1])


def _above(rows: DataFrame, order: str, *by: str):
    """One level of the tree: the hash of the roots below, in order."""
    roots = F.array_sort(F.collect_list(F.struct(order, "root")))
    root = F.sha2(F.array_join(F.transform(roots, lambda x: x["root"]), ""), 256).alias("root")
    sums = [F.sum(c).alias(c) for c in ("documents", "tokens")] + [F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), root]
    return rows.groupBy(*by).agg(*sums) if by else rows.agg(*sums)


def manifest(recipes: DataFrame) -> DataFrame:
    """The pages', segments' and store's rows of the recipes given."""
    leaves = recipes.select("segment", "page", "before", F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("tokens"), F.col("doc_id").alias("first_id"), F.col("doc_id").alias("last_id"), F.hex("root").alias("root"))
    pages = _above(leaves, "before", "segment", "page")
    segments = _above(pages, "page", "segment").withColumn("page", F.lit(-1))
    whole = _above(segments, "segment").select(F.lit(-1).alias("segment"), F.lit(-1).alias("page"), "documents", "tokens", "first_id", "last_id", "root", F.lit(0).cast("long").alias("start")).where("documents is not null")
    # one row a segment
    started = segments.withColumn("start", F.sum("tokens").over(Window.orderBy("segment")) - F.col("tokens"))
    return pages.withColumn("start", F.lit(None).cast("long")).unionByName(started).unionByName(whole)


# CRC-32 of joined byte strings from the parts' CRCs: multiplication by x^(8n) modulo the polynomial.
POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        b = (b >> 1) ^ POLYNOMIAL if b & 1 else b >> 1
        bit >>= 1
    return out


@lru_cache(maxsize=1 << 14)
def _power(n: int) -> int:
    """x^(8n)."""
    out, base = 1 << 31, 1 << 23
    while n:
        if n & 1:
            out = _times(out, base)
        base, n = _times(base, base), n >> 1
    return out


def joined_crc(parts) -> int:
    """parts: (crc, bytes) in order."""
    out = 0
    for crc, n in parts:
        out = _times(_power(n), out) ^ crc
    return out


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """The recipes, once they agree with the manifest in every page, segment and root."""
    recipes, kept = spark.read.parquet(f"{folder}/recipes"), spark.read.parquet(f"{folder}/manifest")
    keys, facts = ["segment", "page"], ["documents", "tokens", "first_id", "last_id", "root", "start"]
    both = kept.select(*keys, F.struct(*facts).alias("kept")).join(manifest(recipes).select(*keys, F.struct(*facts).alias("found")), keys, "full")
    wrong = both.where(~F.col("kept").eqNullSafe(F.col("found"))).orderBy(*keys).head()
    if wrong:
        raise ValueError(f"segment {wrong['segment']}, page {wrong['page']}: the recipes are not those of the manifest")
    return recipes


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, verified; fails on a damaged store."""
    by_bytes(spark)
    width = spark.read.parquet(f"{folder}/format").first()["width"]
    recipes = verified(spark, folder)

    def look(batches):
        for batch in batches:
            payloads, n, crc, at = batch.column(1).to_pylist(), [], [], 0
            wide = memoryview(np.frombuffer(b"".join(payloads), dtype=f"<u{width}").astype("<u4")).cast("B")
            for key, payload in zip(batch.column(0).to_pylist(), payloads):
                if hashlib.sha256(payload).digest()[:KEY] != key:
                    raise ValueError(f"chunk {key.hex()} does not have its content")
                own = len(payload) // width
                n.append(own)
                crc.append(zlib.crc32(wide[4 * at : 4 * (at + own)]))
                at += own
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["chunk", "n", "crc"])

    chunks = spark.read.parquet(f"{folder}/chunks").select("chunk", "payload").mapInArrow(look, "chunk binary, n long, crc long")
    unique = recipes.groupBy("root").agg(F.first("recipe").alias("recipe"))
    parts = unique.select("root", F.posexplode(F.expr(f"transform(sequence(0, octet_length(recipe) div {KEY} - 1), i -> substring(recipe, i * {KEY} + 1, {KEY}))")).alias("at", "chunk"))
    found = parts.join(chunks, "chunk", "left").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("at", "n", "crc", "chunk"))).alias("parts"))

    def fold(batches):
        for batch in batches:
            roots, totals, crcs = batch.column(0).to_pylist(), [], []
            for root, own in zip(roots, batch.column(1).to_pylist()):
                if any(x["n"] is None for x in own) or merkle([x["chunk"] for x in own]) != root:
                    raise ValueError(f"recipe {root.hex()} cannot be rebuilt")
                totals.append(sum(x["n"] for x in own))
                crcs.append(joined_crc((x["crc"], 4 * x["n"]) for x in own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(crcs, pa.int64())], names=["root", "total", "ids_crc32"])

    resolved = found.mapInArrow(fold, "root binary, total long, ids_crc32 long")
    starts = spark.read.parquet(f"{folder}/manifest").where("page = -1 and segment >= 0").select("segment", F.col("start").alias("_start"))
    whole = F.when(F.col("total") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document has lost ids"))).cast("long").alias("n_tokens")
    return recipes.select("segment", "doc_id", "before", "n_tokens", "root").join(resolved, "root").join(starts, "segment").select("doc_id", (F.col("_start") + F.col("before")).alias("start"), whole, "ids_crc32")


def ids_of(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids array<int>) of some documents, put together from their chunks."""
    width = spark.read.parquet(f"{folder}/format").first()["width"]
    recipes = spark.read.parquet(f"{folder}/recipes").where(F.col("doc_id").isin(doc_ids))
    parts = recipes.select("doc_id", F.posexplode(F.expr(f"transform(sequence(0, octet_length(recipe) div {KEY} - 1), i -> substring(recipe, i * {KEY} + 1, {KEY}))")).alias("at", "chunk"))
    rows = parts.join(spark.read.parquet(f"{folder}/chunks"), "chunk").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "payload"))).alias("parts"))

    def put(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["payload"] for x in own), dtype=f"<u{width}").astype(np.int32) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return rows.mapInArrow(put, "doc_id long, ids array<int>")
