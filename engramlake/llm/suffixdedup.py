"""Removal of repeated 50-byte strings with a column-wise collection suffix order.

A byte goes if some 50-byte string over it also starts in a document with a
smaller id.  What has to be found is, for every 50-byte window, the least
document that holds it.

1. Windows are dealt by content: a window's key is the least hash of its 24-byte
   grams, so equal windows have equal keys wherever they stand, and neighbouring
   windows mostly share one.  A first pass sends (key, text's hash), not texts, to
   find the keys of two or more different texts; the rest of a text is done with.
2. Runs of windows with one shared key become strings of 50 to 113 bytes, one row
   each.  They are dealt by key, so that all occurrences of a window meet.
3. Where a key has different strings, their collection Burrows-Wheeler transform
   and longest common prefixes are built column by column: each round puts one
   more symbol in front of every string's suffix, reorders the transform and
   updates the common prefixes (:func:`suffix_order`).  The columns go through
   sequential files once they are large.  Intervals with a common prefix of 50
   or more are equal windows; the least document of an interval owns it.
4. Each string's row carries where its text holds it, so the owners turn into byte
   ranges at once, which meet the texts once more.

Memory: a block of ``BLOCK_BYTES`` of texts, or strings of about ``ORDER_BYTES``,
is all a task holds at a time; keys and strings are plain rows that Spark sorts
and spills, so nothing depends on the number of partitions.

Disk: each step is written as a table, so that what it shuffled goes before the next
one shuffles; keys and strings are removed once they are used.  Texts and strings
are never shuffled at the same time.

Hot content: exact copies of a text are found by SHA-256 before: all of a copy
goes (if it has 50 bytes), so only the first of each takes part.  A block sends a
string once, with the block's least document; its other documents lose the string
at once.  A key that several texts of a block hold is sent as one marker, and goes
to those texts under keys of their own.  A key with over ``CROWDED_BYTES`` of
strings is resolved by grouping its single windows in Spark.  The rounds of step 3
are bounded by the strings' length, which is why the method stays linear here;
over whole documents it would take as many rounds as the longest document has
bytes.

Null texts are empty.  Rows with a null id are kept whole.  Rows that share an id
never remove each other.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramlake.llm.common import Tables, by_bytes

LENGTH = 50
GRAM = 24
#: Windows of one string at most.
RUN = 64
BLOCK_BYTES = 1 << 20
BLOCK_PIECES = 60_000
#: Bytes of strings whose suffixes are ordered at once, and of rows taken up at once.
ORDER_BYTES = 1 << 20
TAKEN_BYTES = 2 << 20
#: Bytes of one key's strings from which its windows are grouped by Spark instead.
CROWDED_BYTES = 4 << 20
#: Entries of a column from which it is kept in a file between rounds.
FILE_ENTRIES = 4 << 20
KEY_BITS = (1 << 48) - 1


# ---- windows and their keys ----


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """48-bit hashes of all grams of GRAM bytes, put together from those of powers of two."""
    power = lambda n: np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64))
    h, width, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if GRAM & width:
            if out is None:
                out = h
            else:  # these bytes first, then what is done
                size = len(data) - done - width + 1
                out = h[:size] * power(done) + out[width : width + size]
            done += width
        if 2 * width > GRAM:
            break
        h = h[:-width] * power(width) + h[width:]
        width *= 2
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out >> np.uint64(16)


def window_keys(data: np.ndarray) -> np.ndarray:
    """The least gram hash of each window."""
    m, width, wanted = gram_hashes(data), 1, LENGTH - GRAM + 1
    while 2 * width <= wanted:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = wanted - width
    return np.minimum(m[:-rest], m[rest:]) if rest else m


class Block:
    """Pieces of texts in one buffer, and the runs of windows with one key."""

    def __init__(self):
        self.owners, self.bases, self.parts, self.size = [], [], [], 0

    def add(self, owner, base: int, data: bytes) -> None:
        self.owners.append(owner)
        self.bases.append(base)
        self.parts.append(data)
        self.size += len(data)

    def runs(self) -> None:
        """starts (in the buffer), counts (windows), keys and piece numbers of the runs."""
        self.data = np.frombuffer(b"".join(self.parts), dtype=np.uint8)
        lens = np.array([len(p) for p in self.parts], dtype=np.int64)
        self.offsets = np.cumsum(lens) - lens
        empty = np.zeros(0, dtype=np.int64)
        self.starts = self.counts = self.piece = empty
        self.keys = empty.astype(np.uint64)
        if len(self.data) < LENGTH:
            return
        keys = window_keys(self.data)
        piece = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        at = np.flatnonzero(piece[: len(keys)] == piece[LENGTH - 1 :][: len(keys)])  # windows inside one piece
        if not len(at):
            return
        keys, piece = keys[at], piece[at]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (piece[1:] != piece[:-1])]))
        count = np.diff(np.append(first, len(keys)))
        parts = -(-count // RUN)
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(first, parts) + RUN * inside
        self.counts = np.minimum(np.repeat(count, parts) - RUN * inside, RUN)
        self.starts, self.keys, self.piece = at[begin], keys[begin], piece[begin].astype(np.int64)


def pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """A text in parts of at most a block, each window in exactly one of them."""
    for at in range(0, max(1, len(data) - LENGTH + 1), BLOCK_BYTES):
        yield at, data[at : at + BLOCK_BYTES + LENGTH - 1]


def in_blocks(batches, rows) -> Iterator[tuple[Block, list]]:
    """Blocks of about BLOCK_BYTES; rows(batch) gives (owner, data, more)."""
    block, more = Block(), []
    for batch in batches:
        for owner, data, extra in rows(batch):
            if len(data) < LENGTH:
                continue
            for base, part in pieces(data):
                block.add(owner, base, part)
                more.append(extra)
                if block.size >= BLOCK_BYTES or len(more) >= BLOCK_PIECES:
                    yield block, more
                    block, more = Block(), []
    if block.size:
        yield block, more


def edges_of(*columns: np.ndarray) -> np.ndarray:
    """Where each run of equal rows of sorted columns starts."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(len(columns[0]), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


# ---- 1: keys that two different texts hold ----


def block_keys(batches):
    """(key, owner) once a block: keys of one text as they are; keys of more as (key, null), and for each of those texts under a negative key of its own."""
    rows = lambda b: zip(b.column(0).to_pylist(), b.column(1).to_pylist(), [None] * len(b))
    for block, _ in in_blocks(batches, rows):
        block.runs()
        owner = np.array(block.owners, dtype=np.int64)[block.piece]
        order = np.lexsort((owner, block.keys))
        keys, owner = block.keys[order], owner[order]
        new = edges_of(keys, owner)
        keys, owner = keys[new], owner[new]
        first = edges_of(keys)
        count = np.diff(np.append(first, len(keys)))
        several = np.repeat(count > 1, count)
        marked = keys[first[count > 1]]
        own = keys[several] | (owner[several].astype(np.uint64) & np.uint64(0x7FFF)) << np.uint64(48) | np.uint64(1 << 63)
        owners = np.concatenate([owner[~several], np.zeros(len(marked), dtype=np.int64), owner[several]])
        unnamed = np.zeros(len(owners), dtype=bool)
        unnamed[(~several).sum() : (~several).sum() + len(marked)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys[~several], marked, own]).view(np.int64)), pa.array(owners, mask=unnamed)], names=["key", "owner"])


def shared_keys(texts: DataFrame) -> DataFrame:
    """(owner, shared array<long>): the keys of each text that another text holds too."""
    group = Window.partitionBy("key")
    keys = texts.select("owner", "data").mapInArrow(block_keys, "key long, owner long")
    seen = keys.select("key", "owner", F.min("owner").over(group).alias("least"), F.max("owner").over(group).alias("most"), F.max(F.col("owner").isNull()).over(group).alias("marked"))
    found = seen.where("owner is not null and (key < 0 or marked or least <> most)")
    return found.groupBy("owner").agg(F.collect_set(F.col("key").bitwiseAND(F.lit(KEY_BITS))).alias("shared"))


# ---- 2: strings of windows with a shared key ----

PARTS = "kind string, key long, doc_id long, owner long, positions array<long>, data binary, start long, end long"
NAMES = ["kind", "key", "doc_id", "owner", "positions", "data", "start", "end"]
TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()]


def _parts(kind: str, n: int, **columns):
    """A batch of PARTS with what is given."""
    filled = [columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(NAMES[1:], TYPES[1:])]
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.string()).take(pa.array(np.zeros(n, dtype=np.int32))), *filled], names=NAMES)


def block_strings(batches):
    """'string' rows: each different string of a block with the block's least document and its positions there; 'range' rows: what the block's other documents lose to that one."""

    def rows(batch):
        shared = batch.column(3)
        values, at = shared.flatten().to_numpy(), shared.offsets.to_numpy() - shared.offsets[0].as_py()
        for i, (doc, owner, data) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
            yield (doc, owner), data, values[at[i] : at[i + 1]]

    for block, marks in in_blocks(batches, rows):
        block.runs()
        shared = np.sort(np.concatenate([m.astype(np.uint64) | np.uint64(i << 48) for i, m in enumerate(marks)]))
        mine = block.keys | block.piece.astype(np.uint64) << np.uint64(48)
        at = np.minimum(np.searchsorted(shared, mine), len(shared) - 1)
        run_no = np.flatnonzero(shared[at] == mine) if len(shared) else np.zeros(0, dtype=np.int64)
        if not len(run_no):
            continue
        starts, counts, keys, piece = (c[run_no] for c in (block.starts, block.counts, block.keys, block.piece))
        named = np.array(block.owners, dtype=np.int64)
        doc, owner = named[piece, 0], named[piece, 1]
        position = starts - block.offsets[piece] + np.array(block.bases, dtype=np.int64)[piece]
        raw, known, ids = block.data.tobytes(), {}, np.empty(len(run_no), dtype=np.int64)
        for i, (s, c) in enumerate(zip(starts.tolist(), counts.tolist())):
            ids[i] = known.setdefault(raw[s : s + c + LENGTH - 1], len(known))
        texts = np.array(list(known), dtype=object)
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, ids, doc)
        lost = doc > least[ids]
        if lost.any():
            yield _ranges(doc[lost], owner[lost], position[lost], position[lost] + counts[lost] + LENGTH - 1)
        own = np.flatnonzero(~lost)
        own = own[np.lexsort((position[own], owner[own], ids[own]))]
        first = edges_of(ids[own], owner[own])
        head = own[first]
        yield _parts(
            "string", len(first), key=pa.array(keys[head].view(np.int64)), doc_id=pa.array(doc[head]), owner=pa.array(owner[head]), data=pa.array(texts[ids[head]].tolist(), pa.binary()),
            positions=pa.ListArray.from_arrays(pa.array(np.append(first, len(own)).astype(np.int32)), pa.array(position[own])),
        )


def _ranges(doc: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray):
    """'range' rows, those that touch as one; ranges that start later must not end earlier."""
    order = np.lexsort((start, owner, doc))
    doc, owner, start, end = doc[order], owner[order], start[order], end[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return _parts("range", len(first), doc_id=pa.array(doc[first]), owner=pa.array(owner[first]), start=pa.array(start[first]), end=pa.array(end[last]))


# ---- 3: the suffix order of a collection of strings ----


class Columns:
    """Columns of one round: in memory while small, else in sequential files until the next round reads them."""

    def __init__(self, folder: str | None, limit: int):
        self.folder, self.limit, self.held = folder, limit, {}

    def put(self, **columns: np.ndarray) -> None:
        for name, c in columns.items():
            if self.folder and len(c) > self.limit:
                c.tofile(f"{self.folder}/{name}")
                self.held[name] = c.dtype
            else:
                self.held[name] = c

    def take(self, name: str) -> np.ndarray:
        c = self.held.pop(name)
        return c if isinstance(c, np.ndarray) else np.fromfile(f"{self.folder}/{name}", dtype=c)


def suffix_order(data: np.ndarray, lens: np.ndarray, folder: str | None = None, limit: int = FILE_ENTRIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, suffix length, common prefix with the one before) of all suffixes in order, empty ones included.

    Strings end their rounds together: one that is shorter than the longest by d
    joins at round d+1, so that few rounds carry its suffixes.  A round puts one more
    symbol before the newest suffix of each string that has joined.  The transform
    then holds, for each suffix so far, the symbol before it, and a stable sort of
    it is the order of the suffixes one longer.
    A common prefix that is new is one more than the least of the old ones
    between the two suffixes that were lengthened.
    """
    n = len(lens)
    ends = np.cumsum(lens)
    files = Columns(folder, limit)
    place = np.arange(n)  # of each string's newest suffix
    rounds = int(lens.max(initial=0))
    delay = (rounds - lens).astype(np.uint8)
    # symbols in as few bits as their number allows: 0 stands for none
    used = np.flatnonzero(np.bincount(data, minlength=256)) if len(data) else np.zeros(0, dtype=np.int64)
    code = np.zeros(256, dtype=np.uint8 if len(used) < 256 else np.int16)
    code[used] = np.arange(1, len(used) + 1)
    data = code[data]
    files.put(string=np.arange(n, dtype=np.int32), round=delay, prefix=np.zeros(n, dtype=np.uint8), symbol=np.zeros(n, dtype=data.dtype))
    for j in range(1, rounds + 1):
        string, since, prefix, symbol = (files.take(c) for c in ("string", "round", "prefix", "symbol"))
        active = np.flatnonzero(delay < j)
        symbol[place[active]] = data[ends[active] - (j - delay[active].astype(np.int64))]
        order = np.argsort(symbol, kind="stable")
        order = order[np.searchsorted(symbol[order], 1) :]  # what has no symbol before it yet makes no suffix
        first = symbol[order]
        new_string = np.concatenate([np.arange(n, dtype=np.int32), string[order]])
        new_since = np.concatenate([delay, since[order] + np.uint8(1)])
        fresh = new_since == j
        fresh[:n] = False
        new_prefix = np.zeros(len(new_since), dtype=np.uint8)
        new_prefix[~fresh] = prefix
        near = fresh.copy()
        near[1:] |= fresh[:-1]
        near[:n] = False
        ask = np.flatnonzero(near)
        t = ask - n
        low, high = order[np.maximum(t - 1, 0)], order[t]
        same = (t > 0) & (first[t] == first[np.maximum(t - 1, 0)])
        new_prefix[ask] = 0
        q, lo, hi = ask[same], low[same] + 1, high[same]
        back = np.argsort(-lo, kind="stable")  # from the right, so that what lies between two ranges is never walked
        if len(q):
            bounds = np.empty(2 * len(q), dtype=np.int64)
            bounds[0::2], bounds[1::2] = lo[back], hi[back] + 1
            padded = np.append(prefix, np.uint8(0))
            new_prefix[q[back]] = np.minimum(np.minimum.reduceat(padded, bounds)[0::2], 254) + 1
        new_symbol = np.zeros(len(new_since), dtype=data.dtype)
        new_symbol[~fresh] = symbol
        at = np.flatnonzero(fresh)
        place[new_string[at]] = at
        files.put(string=new_string, round=new_since, prefix=new_prefix, symbol=new_symbol)
    string = files.take("string")
    return string, files.take("round") - delay[string], files.take("prefix")


def window_owners(data: np.ndarray, lens: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The least document of each window of each string, string by string."""
    with tempfile.TemporaryDirectory() as folder:
        string, depth, prefix = suffix_order(data, lens, folder)
    group = np.cumsum(prefix < LENGTH) - 1
    whole = depth >= LENGTH
    string, depth, group = string[whole], depth[whole].astype(np.int64), group[whole]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    out = np.empty(int((lens - LENGTH + 1).sum()), dtype=np.int64)
    if len(group):
        least = np.minimum.reduceat(docs[string], first)
        base = np.cumsum(lens - LENGTH + 1) - (lens - LENGTH + 1)
        out[base[string] + lens[string] - depth] = np.repeat(least, np.diff(np.append(first, len(group))))
    return out


FOUND = "doc_id long, owner long, start long, end long"


def find_owners(batches):
    """'range' rows of the documents that lose windows of their strings; rows come sorted by key."""

    def resolve(rows: pa.Table):
        keys, docs, owners = (rows.column(c).to_numpy() for c in ("key", "doc_id", "owner"))
        positions = rows.column("positions").combine_chunks()
        known: dict[bytes, int] = {}
        which = np.fromiter((known.setdefault(t, len(known)) for t in rows.column("data").to_pylist()), dtype=np.int64, count=len(rows))
        texts = list(known)
        ulens = np.array([len(t) for t in texts], dtype=np.int64)
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, which, docs)
        ukeys = np.zeros(len(texts), dtype=np.int64)
        ukeys[which] = keys
        windows = ulens - LENGTH + 1
        base = np.cumsum(windows) - windows
        owner = np.repeat(least, windows)
        # a key with one string needs no order: its windows repeat only with the string
        order = np.argsort(ukeys, kind="stable")
        edge = np.zeros(len(order) + 1, dtype=bool)
        edge[edges_of(ukeys[order])] = edge[-1] = True
        rest = order[~(edge[:-1] & edge[1:])]
        for cut in np.split(rest, _cuts(ukeys[rest], np.cumsum(ulens[rest]))):
            if len(cut):
                w = windows[cut]
                target = np.repeat(base[cut] - (np.cumsum(w) - w), w) + np.arange(w.sum())
                owner[target] = window_owners(np.frombuffer(b"".join([texts[i] for i in cut]), dtype=np.uint8), ulens[cut], least[cut])
        # the runs of windows that a row's document loses
        w = windows[which]
        row = np.repeat(np.arange(len(which), dtype=np.int32), w)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(w) - w, w)
        hit = np.flatnonzero(owner[np.repeat(base[which], w) + inside] < docs[row])
        row, inside = row[hit], inside[hit]
        if not len(row):
            return
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (inside[1:] != inside[:-1] + 1)
        first = np.flatnonzero(new)
        row, start, count = row[first], inside[first], np.diff(np.append(first, len(row)))
        offsets = positions.offsets.to_numpy() - positions.offsets[0].as_py()
        times = (offsets[1:] - offsets[:-1])[row]
        spread = np.repeat(np.arange(len(row)), times)
        place = positions.flatten().to_numpy()[np.repeat(offsets[row] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        begin = place + start[spread]
        yield _ranges(docs[row][spread], owners[row][spread], begin, begin + count[spread] + LENGTH - 1).select(["doc_id", "owner", "start", "end"])

    held, size = [], 0
    for batch in batches:
        keys = batch.column(0).to_numpy()
        if size >= TAKEN_BYTES:
            last = int(np.searchsorted(keys, held[-1].column(0)[-1].as_py(), side="right")) if len(keys) else 0
            if last < len(keys):  # what is held, up to the end of its last key
                yield from resolve(pa.Table.from_batches([*held, batch.slice(0, last)]))
                batch, held, size = batch.slice(last), [], 0
        if len(batch):
            held.append(batch)
            size += batch.nbytes
    if held:
        yield from resolve(pa.Table.from_batches(held))


def crowded_ranges(strings: DataFrame) -> DataFrame:
    """The same ranges from single windows, grouped by Spark; one range a lost window."""
    at = F.explode(F.sequence(F.lit(0), F.octet_length("data") - LENGTH)).alias("at")
    single = strings.select("doc_id", "owner", "positions", "data", at).select("doc_id", "owner", "positions", "at", F.expr(f"substring(data, at + 1, {LENGTH})").alias("piece"))
    least = single.groupBy("piece").agg(F.min("doc_id").alias("least"))
    lost = single.join(least, "piece").where("least < doc_id").select("doc_id", "owner", "at", F.explode("positions").alias("place"))
    return lost.select("doc_id", "owner", (F.col("place") + F.col("at")).alias("start"), (F.col("place") + F.col("at") + LENGTH).alias("end"))


def _cuts(keys: np.ndarray, size: np.ndarray) -> list[int]:
    """Where to cut, between keys, so that about ORDER_BYTES come together."""
    if not len(keys):
        return []
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    part = (size[edges - 1] // ORDER_BYTES) if len(edges) else edges
    return edges[np.flatnonzero(np.diff(part, prepend=0))].tolist()


# ---- 4: back to the texts ----

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_texts(batches):
    names, types = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        rows = []
        for doc, data, first, ranges in zip(*(c.to_pylist() for c in batch.columns)):
            spans = kept_spans(data, doc, first, ranges)
            kept, at = hashlib.sha256(), 0
            for s, e in spans:
                kept.update(data[at:s])
                at = e
            kept.update(data[at:])
            rows.append((doc, len(data), sum(e - s for s, e in spans), len(spans), kept.hexdigest()))
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def kept_spans(data: bytes, doc, first: bool, ranges) -> list[tuple[int, int]]:
    """Maximal removed runs, in order."""
    if doc is not None and not first:
        return [(0, len(data))] if len(data) >= LENGTH else []
    found = sorted((r["start"], r["end"]) for r in ranges or [])
    out: list[tuple[int, int]] = []
    for s, e in found:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def removed_ranges(docs: DataFrame, tables: Tables, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(texts, info): the rows with data and content hash, and for the first row of each content its id, hash and ranges."""
    by_bytes(docs.sparkSession)
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("data")).withColumn("owner", F.xxhash64("data"))
    known = texts.where("doc_id is not null")
    first = tables.stored(known.groupBy(F.unhex(F.sha2("data", 256)).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.first("owner").alias("owner")).select("doc_id", "owner").distinct(), "firsts")
    shared = tables.stored(shared_keys(known), "keys")
    taking = first.join(shared, "owner").select("doc_id", "owner", "shared")
    parts = tables.stored(texts.join(taking, ["doc_id", "owner"]).select("doc_id", "owner", "data", "shared").mapInArrow(block_strings, PARTS), "strings", partition_by="kind")
    tables.drop("keys")
    strings = parts.where("kind = 'string'").select("key", "doc_id", "owner", "positions", "data")
    crowded = tables.stored(strings.groupBy("key").agg(F.sum(F.octet_length("data")).alias("bytes")).where(F.col("bytes") > CROWDED_BYTES).select("key"), "crowded")
    ranges = parts.where("kind = 'range'").select("doc_id", "owner", "start", "end")
    if not crowded.isEmpty():
        ranges = ranges.unionByName(crowded_ranges(strings.join(crowded, "key", "left_semi")))
        strings = strings.join(crowded, "key", "left_anti")
    found = strings.repartition("key").sortWithinPartitions("key").mapInArrow(find_owners, FOUND)
    ranges = tables.stored(ranges.unionByName(found).groupBy("doc_id", "owner").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges")
    tables.drop("strings")
    return texts, first.join(ranges, ["doc_id", "owner"], "left").withColumn("first", F.lit(True))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    tables = Tables(docs.sparkSession)
    texts, info = removed_ranges(docs, tables, id_col, text_col)
    joined = texts.join(info, ["doc_id", "owner"], "left").select("doc_id", "data", F.coalesce("first", F.lit(False)).alias("first"), "ranges")
    return tables.result(joined.mapInArrow(cut_texts, RESULT), "kept")
