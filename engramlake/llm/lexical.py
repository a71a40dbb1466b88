"""Ranked lexical search over an index of compressed postings, documents at a time.

A term is a run of ASCII letters, digits and everything beyond ASCII; only A-Z are
lowered.  N counts the documents with a term, L all their terms, n a document's, df
the documents that hold a term, tf its occurrences in one.  A term weighs
w = floor(1000 ln((2N + 2) / (2 df + 1))); with m = 75 + (25 n N) div L a document's
score is the sum of w * (10^9 tf div (1000 tf + 12 m)) over an item's terms, repeats included.

**Index.**  A task turns about ``SHARD_BYTES`` of its texts into a shard: documents in order
of their ids, and for each term a posting list of document gaps and counts, seven bits a
byte, one table row a list.  Texts are not shuffled.  The index holds every term.

**Search.**  The lists of the items' terms are dealt by shard.  For each item a heap holds
one cursor a list, keyed by the next document in it; the least document opens a window
of ``WINDOW`` documents, and every list with a document in it adds to their scores and moves on.  A
document's score is whole when its window closes.  An item's best k lie in a heap keyed by
score, then id, which goes on from shard to shard of a task; a shard whose lists cannot
reach the k-th score is passed over.  Spark merges the tasks' best k.

Items are taken in blocks of about ``BLOCK_BYTES`` of text, which is what a task holds of them.
Null texts have no terms; documents without terms count nowhere and are never found.  Repeated
rows are documents of their own; a document without an id comes after equal scores with one.
Texts of items that share an id (or have none) are searched as one item, repeated rows once.  An empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramlake.llm.common import Tables, by_bytes

TOP = 20
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 2 << 20
WINDOW = 4096
TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM).split()


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all numbers, seven bits each, and where each number ends."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), dtype=np.int64)
    for bits in range(7, 64, 7):
        size += v >= np.uint64(1 << bits)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, dtype=np.uint8)
    for i in range(int(size.max(initial=0))):
        own = size > i
        part = (v[own] >> np.uint64(7 * i)) & np.uint64(127)
        out[ends[own] - size[own] + i] = part | np.where(size[own] > i + 1, np.uint64(128), np.uint64(0))
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out, size = np.zeros(len(ends), dtype=np.int64), ends - starts + 1
    for i in range(int(size.max(initial=0))):
        own = size > i
        out[own] |= (b[starts[own] + i] & 127).astype(np.int64) << (7 * i)
    return out


INDEX = "shard long, term string, docs long, occurrences long, postings binary"
_INDEX = [("shard", pa.int64()), ("term", pa.string()), ("docs", pa.int64()), ("occurrences", pa.int64()), ("postings", pa.binary())]


def shard_rows(shard: int, docs: list[tuple[int | None, bytes | None]]) -> pa.RecordBatch:
    """One row a term; the row without a term holds how many documents have an id, the ids and the lengths, and sums only over documents with terms."""
    docs = sorted(((i, t) for i, t in docs), key=lambda x: (x[0] is None, x[0]))
    numbers = defaultdict(itertools.count().__next__)
    terms, lengths = [], []
    for _, text in docs:
        own = list(map(numbers.__getitem__, terms_of(text)))
        terms.append(np.array(own, dtype=np.int64))
        lengths.append(len(own))
    flat = np.concatenate([t * len(docs) + d for d, t in enumerate(terms)]) if terms else np.zeros(0, np.int64)
    both, tf = np.unique(flat, return_counts=True)  # by term, then document
    term, doc = both // len(docs), both % len(docs)
    starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    gaps = np.diff(doc, prepend=0)
    gaps[starts] = doc[starts]
    data, ends = packed(np.stack([gaps, tf], axis=1).ravel())
    cuts = np.concatenate([ends[2 * starts - 1] if len(starts) else [], ends[-1:]]).astype(np.int64)
    if len(starts):
        cuts[0] = 0
    whole = data.tobytes()
    names = list(numbers)
    held = np.diff(np.append(starts, len(term)))
    total = np.add.reduceat(tf, starts) if len(starts) else np.zeros(0, np.int64)
    ids = np.array([i for i, _ in docs if i is not None], dtype=np.int64)
    about = np.array([len(ids)], dtype=np.int64).tobytes() + ids.tobytes() + np.array(lengths, dtype=np.int64).tobytes()
    columns = [
        [shard] * (len(names) + 1), pa.array([*names, None], pa.binary()).cast(pa.string()), [*held.tolist(), sum(x > 0 for x in lengths)],
        [*total.tolist(), sum(lengths)], [*(whole[s:e] for s, e in itertools.pairwise(cuts.tolist())), about],
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, (_, t) in zip(columns, _INDEX)], names=[n for n, _ in _INDEX])


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, term, docs, occurrences, postings); to be stored, since a shard's number holds for one run of its task."""
    by_bytes(docs.sparkSession)
    full = SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), itertools.count(), [], 0
        for x in batches:
            for i, value in zip(x.column(0).to_pylist(), x.column(1)):
                text = value.as_buffer().to_pybytes() if value.is_valid else None
                held.append((i, text))
                size += len(text or b"")
                if size >= full:
                    yield shard_rows(task << 32 | next(number), held)
                    held, size = [], 0
        if held:
            yield shard_rows(task << 32 | next(number), held)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, INDEX)


class Item:
    """An item's terms with their repeats, and the best k found so far."""

    def __init__(self, number: int, terms: Counter, k: int):
        self.number, self.terms, self.k, self.heap = number, terms, k, []

    def floor(self) -> int:
        """What a document must reach to matter."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def offer(self, score: int, doc: int | None) -> None:
        entry = (score, doc is not None, -(doc or 0))
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    def found(self) -> list[tuple[int, int | None, int]]:
        return [(self.number, -doc if known else None, score) for score, known, doc in self.heap]


class Shard:
    """The lists of one shard, opened when an item first asks for them."""

    def __init__(self, about: bytes, lists: dict[bytes, bytes], weights: dict[bytes, int], n: int, total: int):
        known = int(np.frombuffer(about[:8], np.int64)[0])
        rest = np.frombuffer(about[8:], np.int64)
        self.lengths = rest[known:]
        self.ids = [*rest[:known].tolist(), *[None] * (len(self.lengths) - known)]
        # Python integers where a product could pass 64 bits
        big = n * int(self.lengths.max(initial=0)) * 25 >= 1 << 62
        m = np.array([75 + 25 * int(x) * n // total for x in self.lengths], dtype=np.int64) if big else 75 + 25 * self.lengths * n // max(total, 1)
        self.m, self.lists, self.weights, self.open = m, lists, weights, {}

    def cursor(self, term: bytes) -> tuple[np.ndarray, np.ndarray, int] | None:
        """The list's documents, what each gets for the term, and the most that one gets."""
        if term not in self.open:
            data = self.lists.get(term)
            if data is None:
                self.open[term] = None
            else:
                both = unpacked(data)
                docs, tf = np.cumsum(both[::2]), both[1::2]
                part = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * self.m[docs]))
                self.open[term] = docs, part, int(part.max())
        return self.open[term]

    def search(self, item: Item, window: int) -> None:
        lists = [(c, times) for t, times in item.terms.items() if (c := self.cursor(t)) and c[2]]
        if sum(c[2] * times for c, times in lists) < item.floor():
            return
        heap = [(int(c[0][0]), i, 0) for i, (c, _) in enumerate(lists)]
        heapq.heapify(heap)
        while heap:
            start = heap[0][0]
            scores = np.zeros(min(window, len(self.ids) - start), dtype=np.int64)
            while heap and heap[0][0] < start + window:
                _, i, at = heap[0]
                (docs, part, _), times = lists[i]
                to = int(np.searchsorted(docs, start + window))
                scores[docs[at:to] - start] += times * part[at:to]
                if to < len(docs):
                    heapq.heapreplace(heap, (int(docs[to]), i, to))
                else:
                    heapq.heappop(heap)
            good = np.flatnonzero(scores >= item.floor())
            if len(good) > item.k:
                good = good[np.argsort(-scores[good], kind="stable")[: item.k]]  # documents lie in order of their ids
            for d in good.tolist():
                item.offer(int(scores[d]), self.ids[start + d])


def _blocks(items: DataFrame, item_id: str, item_text: str) -> list[DataFrame]:
    """(item, texts): items in blocks of about BLOCK_BYTES, by hash of their id."""
    rows = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).where("text is not null").groupBy("item").agg(F.array_sort(F.collect_set("text")).alias("texts"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length(F.array_join("texts", " "))), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-int(size) // BLOCK_BYTES))
    return [rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == b) for b in range(n)]


def search(docs: DataFrame, items: DataFrame, top: int = TOP, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents with a score above 0."""
    tables = Tables(docs.sparkSession)
    whole = tables.stored(index(docs, id_col=id_col, text_col=text_col), "index")
    out = None
    for block in _blocks(items, item_id, item_text):
        found = _searched(whole, block.collect(), top, tables)  # BLOCK_BYTES, about
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return tables.result(out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"), "search")


def _searched(whole: DataFrame, block: list, top: int, tables: Tables) -> DataFrame:
    """(item_id, doc_id, score): the best of each task."""
    spark, window, kind = whole.sparkSession, WINDOW, "item_id long, doc_id long, score long"
    wanted = {r["item"]: sum((Counter(terms_of(t.encode("utf-8"))) for t in r["texts"]), Counter()) for r in block}
    numbers = list(wanted)
    terms = sorted({t for c in wanted.values() for t in c})
    names = spark.createDataFrame([(t.decode("utf-8"),) for t in terms], "term string")
    about = whole.where("term is null")
    totals = about.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("l")).first()
    hits = tables.stored(whole.join(F.broadcast(names), "term", "left_semi").unionByName(about), "lists")  # names: a block's terms
    df = {r["term"].encode("utf-8"): r["df"] for r in hits.where("term is not null").groupBy("term").agg(F.sum("docs").alias("df")).collect()}
    n, total = int(totals["n"]), int(totals["l"])
    weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    given = spark.sparkContext.broadcast(([(i, wanted[x]) for i, x in enumerate(numbers)], weights, numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights, numbers = given.value
        items = [Item(i, c, top) for i, c in wanted]
        shard, lists, about = None, {}, None

        def done() -> None:
            own = Shard(about, lists, weights, n, total)
            for item in items:
                own.search(item, window)

        for x in batches:
            for number, term, data in zip(*(x.column(c).to_pylist() for c in ("shard", "term", "postings"))):
                if number != shard:
                    if shard is not None:
                        done()
                    shard, lists, about = number, {}, None
                if term is None:
                    about = data
                else:
                    lists[term.encode("utf-8")] = data
        if shard is not None:
            done()
        rows = [r for item in items for r in item.found()]
        yield pa.RecordBatch.from_arrays([pa.array([numbers[i] for i, _, _ in rows], pa.int64()), pa.array([d for _, d, _ in rows], pa.int64()), pa.array([s for *_, s in rows], pa.int64())], names=["item_id", "doc_id", "score"])

    return tables.stored(hits.repartition("shard").sortWithinPartitions("shard").select("shard", "term", "postings").mapInArrow(run, kind), "found")


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
totals AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, totals),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM b) GROUP BY ALL),
score AS (
  SELECT a.item_id, tf.doc_id, CAST(sum(a.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * tf.n * t.n) // t.l)))) AS BIGINT) AS score
  FROM asked a JOIN tf ON tf.term = a.term JOIN weight w ON w.term = a.term, totals t GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
