"""Near copies by word shingles: HyperMinHash registers, banded, estimated, verified.

Words and lower case are those of the SimHash operator.  A text is the set of its
different shingles of ``words`` words; fewer words give one shingle, the whole
sequence, and no words an empty set.  Two sets are linked if 100 * common >= 80 * union.

**Registers.**  A shingle's hash falls in one of ``BUCKETS`` buckets.  A bucket keeps
its least remaining hash as 16 bits: the number of leading zeros and the next ten
bits.  For the bands only, an empty bucket borrows another one's register.

**Bands.**  ``BANDS`` keys of ``ROWS`` registers; two sets at similarity 0.8 share no
key with probability (1 - 0.8 ** 7) ** 52 = 5e-6, less above it.

**Candidates.**  A key's texts are not paired up.  All of them are held against one hub,
the text that the most others share keys with; what the registers allow is verified on the whole sets,
and of a pair only the second set travels to the first.  That gives components.

**The rest.**  Only texts of a hub's keys that are outside its component have open pairs: rest against
rest, and rest against the others.  They meet by hub, in tiles of ``TILE`` by ``TILE`` texts.  Each
text brings only its difference from the hub, x ^ h; since |x ^ y| = |x ^ h| + |y ^ h| - 2 |(x ^ h) & (y ^ h)|,
a tile decides its pairs exactly and sends a spanning forest of the links, fewer than it has
texts.  No pair is given up, whatever a key's size; the work grows with rest x texts of a hub.

**Estimate.**  Equal registers over filled ones, less the expected chance collisions.  Only what is
five standard errors below 0.8 is discarded before it is verified.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.common import Tables, connected_components, text_batches
from engramlake.llm.decontam import hashes, spans

WORDS = 5
SIMILAR = 80
BANDS, ROWS = 52, 7
BUCKETS = BANDS * ROWS
MANTISSA = 10
TILE = 256
#: Common elements of a tile's differences that are counted at once.
COUNTED = 1 << 20
ERRORS = 5.0
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_EMPTY = np.iinfo(np.uint64).max
_HOPS = np.random.default_rng(5).integers(0, BUCKETS, (64, BUCKETS))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(LOWER).split()


def shingles(words: list[bytes], k: int = WORDS) -> np.ndarray:
    """The different shingles' hashes, in order."""
    return np.unique(hashes(*spans(words, k)))


def registers(h: np.ndarray) -> np.ndarray:
    """uint16 a bucket: 1 + leading zeros above, ten bits below; 0 where no hash fell."""
    mixed = h * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    least = np.full(BUCKETS, _EMPTY, dtype=np.uint64)
    np.minimum.at(least, ((h >> np.uint64(32)) * np.uint64(BUCKETS) >> np.uint64(32)).astype(np.int64), mixed)
    part, exponent = np.frexp(least.astype(np.float64))
    out = ((np.minimum(65 - exponent, 62) + 1) << MANTISSA) | ((2 * part - 1) * (1 << MANTISSA)).astype(np.int64)
    return np.where(least == _EMPTY, 0, out).astype(np.uint16)


def filled(own: np.ndarray) -> np.ndarray:
    """The registers with each empty one borrowed from a bucket that depends on its place only."""
    out, left = own.copy(), np.flatnonzero(own == 0)
    for hop in _HOPS:
        if not len(left):
            return out
        out[left] = own[hop[left]]
        left = left[out[left] == 0]
    some = np.flatnonzero(own)
    out[left] = own[some[np.searchsorted(some, left) % len(some)]]
    return out


def bands(own: np.ndarray) -> list[int]:
    """One key a band, as signed 64-bit integers; none for an empty set."""
    if not own.any():
        return []
    rows = filled(own).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], dtype=np.uint64).view(np.int64).tolist()


def signature(text: str | None, k: int = WORDS) -> tuple[bytes, int, bytes, list[int]]:
    """The set's digest, its size, its registers and the bands' keys."""
    h = shingles(words_of(text), k)
    own = registers(h)
    return xxhash.xxh3_128_digest(h.tobytes()), len(h), own.tobytes(), bands(own)


SIGNATURE = "digest binary, n long, regs binary, keys array<long>"


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Of register arrays (..., BUCKETS) and set sizes: which pairs' estimated similarity is not clearly below the threshold."""
    some = np.count_nonzero(a | b, axis=-1)
    same = np.count_nonzero((a == b) & (a != 0), axis=-1)
    chance = some * 0.17 / (1 << MANTISSA) * 4.0 * na * nb / np.maximum((na + nb) ** 2, 1)
    return same - chance + ERRORS * np.sqrt(0.16 * some) >= SIMILAR / 100 * some


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)


def estimated(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose estimate allows a link."""
    own = texts.select("node", "n", "regs")
    both = pairs.join(own.withColumnsRenamed({"node": "b", "n": "nb", "regs": "rb"}).hint("merge"), "b").join(own.withColumnsRenamed({"node": "a", "n": "na", "regs": "ra"}).hint("merge"), "a")
    both = both.where(100 * F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb"))

    def keep(batches: Iterator[pa.RecordBatch]):
        for x in batches:
            if len(x):
                ok = plausible(_matrix(x.column("ra")), _matrix(x.column("rb")), *(x.column(c).to_numpy().astype(float) for c in ("na", "nb")))
                yield x.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(keep, "a long, b long")


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of left has in common with each of right."""
    out = np.zeros(len(left) * len(right), dtype=np.int64)
    flat = lambda sets: (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
    (a, of_a), (b, of_b) = flat(left), flat(right)
    order = np.argsort(b, kind="stable")
    b, of_b = b[order], of_b[order]
    first, last = np.searchsorted(b, a), np.searchsorted(b, a, side="right")
    hit = last > first
    of_a, first, size = of_a[hit], first[hit], (last - first)[hit]
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTED, side="right")))
        n = size[at:to]
        place = np.repeat(first[at:to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out += np.bincount(np.repeat(of_a[at:to], n) * len(right) + of_b[place], minlength=len(out))
        at = to
    return out.reshape(len(left), len(right))


def forest(node: np.ndarray, comp: np.ndarray, n: np.ndarray, apart: list[np.ndarray], first: np.ndarray) -> list[tuple[int, int]]:
    """Links of a tile that join its components: between texts marked first and the others, or among the first where there are no others."""
    rows = np.flatnonzero(first)
    columns = rows if first.all() else np.flatnonzero(~first)
    if not len(rows) or not len(columns):
        return []
    size = np.array([len(x) for x in apart])
    unlike = size[rows][:, None] + size[columns][None, :] - 2 * common([apart[i] for i in rows], [apart[j] for j in columns])
    total = n[rows][:, None] + n[columns][None, :]
    # |x & y| = (|x| + |y| - |x ^ y|) / 2, |x | y| = (|x| + |y| + |x ^ y|) / 2
    near = (100 * (total - unlike) >= SIMILAR * (total + unlike)) & (comp[rows][:, None] != comp[columns][None, :])
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = root[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(near)):
        x, y = find(int(comp[rows[i]])), find(int(comp[columns[j]]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(node[rows[i]]), int(node[columns[j]])))
    return out


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile in, (a, b) out.  A tile may go over several batches."""
    keys = ["hub", "part", "i", "j"]

    def done(table: pa.Table) -> list:
        node, comp, n, first = (table.column(c).to_numpy() for c in ("node", "comp", "n", "first"))
        apart = [np.asarray(x.values) for c in table.column("apart").chunks for x in c]
        return forest(node, comp, n, apart, first)

    held: list[pa.Table] = []
    same = lambda a, b: all(a.column(c)[-1].as_py() == b.column(c)[0].as_py() for c in keys)
    for x in batches:
        if not len(x):
            continue
        table, rows = pa.Table.from_batches([x]), []
        ids = np.stack([table.column(c).to_numpy().astype(np.int64) for c in keys], axis=1)
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
        for s, e in itertools.pairwise(cuts):
            part = table.slice(s, e - s)
            if held and not same(held[-1], part):
                rows += done(pa.concat_tables(held))
                held = []
            held.append(part)
        yield _links(rows)
    if held:
        yield _links(done(pa.concat_tables(held)))


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["a", "b"])


class Sets:
    """Whole shingle sets of the texts that are to be verified, each worked out once."""

    def __init__(self, texts: DataFrame, docs: DataFrame, tables: Tables, k: int):
        self.texts, self.docs, self.tables, self.k, self.known = texts, docs, tables, k, None

    def of(self, pairs: DataFrame) -> DataFrame:
        """(node, set) of at least the pairs' nodes."""
        ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if self.known is not None:
            ids = ids.join(self.known.select("node").hint("merge"), "node", "left_anti")
        wanted = self.texts.select("node", "head", "digest").join(ids.hint("merge"), "node")
        rows = self.docs.join(wanted, self.docs["_id"] == wanted["head"]).select("node", "_text", "digest")
        k = self.k

        def one(text, digest):
            h = shingles(words_of(text), k)
            return (h.view(np.int64) if xxhash.xxh3_128_digest(h.tobytes()) == bytes(digest) else None,)  # else another text of the same id

        got = self.tables.stored(text_batches(rows, "node", "_text", one, "set array<long>", "digest").where("set is not null").dropDuplicates(["node"]), "sets")
        self.known = got if self.known is None else self.known.unionByName(got)
        return self.known


def _both_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs with sa and sb; the second set goes to the first, so a hub's own set is shuffled once, not once a pair."""
    held = pairs.join(sets.selectExpr("node as b", "set as sb").hint("merge"), "b")
    return held.join(sets.selectExpr("node as a", "set as sa").hint("merge"), "a")


def verified(pairs: DataFrame, sets: DataFrame, tables: Tables) -> DataFrame:
    """Those of the pairs of nodes whose texts are similar."""
    both = F.size(F.array_intersect("sa", "sb"))
    total = F.size("sa") + F.size("sb") - both
    return tables.stored(_both_sets(pairs, sets).where(100 * both >= SIMILAR * total).select("a", "b"), "similar")


def links(texts: DataFrame, docs: DataFrame, tables: Tables, k: int = WORDS, more: DataFrame | None = None) -> DataFrame:
    """(node, root): the components of similar texts; a node without a link does not appear.

    texts (node, head, digest, n, regs, keys): one row for each different set; docs (_id, _text): where
    the text of a head is read; more (a, b): other candidates among nodes.
    """
    keys = texts.select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # both sides are dealt by key, so that Spark can split a hot band
    members = tables.stored(keys.join(shared.hint("merge"), "key"), "members")
    known = members.groupBy("node").agg(F.sum("c").alias("pop"))
    hubs = tables.stored(members.join(known.hint("merge"), "node").groupBy("key").agg(F.max(F.struct("pop", -F.col("node"))).alias("top")).select("key", (-F.col("top.col2")).alias("hub")), "hubs")
    star = members.join(hubs.hint("merge"), "key").where("hub <> node").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.max("c").alias("c"))
    star = tables.stored(star, "stars")
    pairs = star.select("a", "b") if more is None else star.select("a", "b").unionByName(more.select("a", "b")).distinct()
    sets = Sets(texts, docs, tables, k)
    pairs = tables.stored(estimated(pairs, texts), "pairs")
    found = verified(pairs, sets.of(pairs), tables)
    roots = connected_components(found, tables)
    label = lambda of, out: roots.select(F.col("node").alias(of), F.col("root").alias(out)).hint("merge")
    # a key of two texts has no pair but the hub's
    crowd = star.where("c > 2").join(label("b", "comp"), "b", "left").join(label("a", "own"), "a", "left")
    crowd = crowd.select("a", "b", F.coalesce("comp", "b").alias("comp"), F.coalesce("own", "a").alias("own"))
    rest = crowd.groupBy("a").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.expr("comp <> own")).alias("r")).where("r > 0 and c > 1")
    crowd = tables.stored(crowd.join(rest.hint("merge"), "a"), "crowd")
    if crowd.isEmpty():
        return roots
    sizes = texts.select(F.col("node").alias("b"), "n").hint("merge")
    apart = _both_sets(crowd, sets.of(crowd)).select("a", "b", "comp", "own", "c", "r", F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")).alias("apart")).join(sizes, "b")
    more_links = tables.stored(_dealt(tables.stored(apart, "apart")).mapInArrow(_tiled, "a long, b long"), "links")
    return connected_components(found.unionByName(more_links), tables)


def _dealt(crowd: DataFrame) -> DataFrame:
    """Each text once for every tile it is in, sorted by tile: part 0, the rest's blocks i <= j; part 1, the rest's block i and the others' block j."""
    count = lambda n: F.ceil(F.expr(n) / TILE).cast("int")
    crowd = crowd.withColumn("nr", count("r")).withColumn("no", count("c - r")).withColumn("first", F.expr("comp <> own"))
    crowd = crowd.withColumn("block", F.pmod(F.xxhash64("b"), F.when(F.col("first"), F.col("nr")).otherwise(F.greatest("no", F.lit(1)))).cast("int"))
    upto = lambda n: F.expr(f"case when {n} > 0 then sequence(0, {n} - 1) else cast(array() as array<int>) end")
    tile = lambda part, i, j, first: F.struct(F.lit(part).alias("part"), i.alias("i"), j.alias("j"), first.alias("first"))
    own = F.col("block")
    among = F.transform(upto("nr"), lambda x: tile(0, F.least(own, x), F.greatest(own, x), own <= x))
    among = F.when(F.col("r") > 1, among).otherwise(F.slice(among, 1, 0))
    across = F.transform(upto("no"), lambda x: tile(1, own, x, F.lit(True)))
    others = F.transform(upto("nr"), lambda x: tile(1, x, own, F.lit(False)))
    tiles = crowd.select(F.col("a").alias("hub"), F.col("b").alias("node"), "comp", "n", "apart", F.explode(F.when(F.col("first"), F.concat(among, across)).otherwise(others)).alias("t"))
    order = ["hub", "part", "i", "j"]
    return tiles.select("hub", "t.*", "node", "comp", "n", "apart").repartition(*order).sortWithinPartitions(*order)


def different(rows: DataFrame, tables: Tables) -> DataFrame:
    """(node, head, digest, n, regs, keys ...): one row for each different set of the signatures (doc_id, digest, n, regs, keys ...); head is its least id."""
    rest = [c for c in rows.columns if c not in ("doc_id", "digest")]
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("head"), *(F.first(c).alias(c) for c in rest))
    return tables.stored(texts.withColumn("node", F.monotonically_increasing_id()), "texts")  # numbers hold because they are written


def components(docs: DataFrame, k: int = WORDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept), one row for each row of docs.

    component_id is the least id of the row's component, kept whether that is the row's own.
    Rows with an empty set are linked with nothing.  Rows without an id take no part: their component_id is
    null and they are kept.  Rows that share an id are documents of their own.  Other columns are ignored.
    """
    tables = Tables(docs.sparkSession)
    rows = tables.stored(text_batches(docs, id_col, text_col, lambda t: signature(t, k), SIGNATURE).withColumnRenamed(id_col, "doc_id"), "signatures")
    texts = different(rows.where("doc_id is not null and n > 0"), tables)
    roots = links(texts, docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), tables, k)
    joined = texts.select("node", "digest", "head").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("head").alias("least"))
    named = joined.join(least.hint("merge"), "root").select("digest", "least")
    whole = rows.select("doc_id", "n", "digest").join(named.hint("merge"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")))
    out = whole.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return tables.result(out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))), "near")


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN size USING (doc_id) JOIN least USING (doc_id)
"""
