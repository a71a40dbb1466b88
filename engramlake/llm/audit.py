"""How the sources of a language differ in their words.

A term is a run of letters (ASCII letters, lowered, and everything beyond ASCII).  A
language keeps its V terms that at least ``MIN_DOCS`` of its documents hold.  A group
is a (lang, source) that occurs; with count occurrences of a kept term, and N of all
of them, the term's probability there is 1 + floor(10^9 * (count + 5) / (N + 5 V)).

**Pairs of sources.**  The sum of |p - q| over all kept terms comes from postings: a term's
list of the groups that hold it.  With z a group's probability of a term it has not,

    sum |p - q| = V |z - z'| + (over the group's terms) (|p - z'| - |z - z'|) + the same for the other
                  + (over common terms) (|p - q| - |p - z'| - |q - z| + |z - z'|),

so that terms which neither holds cost nothing.  Postings are dealt by slices of terms
and blocks of groups; a task holds at most a slice and two blocks.

**Terms of a group.**  A slice's terms are put in buckets of equal count, and so of equal p; with the
least probability that the language gives any term of a bucket, p - q is bounded.
Buckets are opened best bound first, until what is left is strictly below the k-th value
found.  A group with many terms is several slices, whose best k meet in one window.

Null text, lang and source are read as ''.  Sums are decimals or 64-bit integers.
Repeated rows count; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.llm.common import Tables, by_bytes

MIN_DOCS = 30
TOP = 50
SCALE = 1_000_000_000
PRIOR = 5
#: Postings, or terms of a group, that a task holds at once, about.
SLICE = 8192
#: Groups of a language that are held against as many others at once.
BLOCK = 512
#: Different (group, term) counts that a task gathers before it sends them on.
GATHERED = 400_000
TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, count, docs): partial counts, summed in each task first."""
    by_bytes(docs.sparkSession)
    gathered = GATHERED
    kinds = [("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("count", pa.int64()), ("docs", pa.int64())]

    def sent(counts: dict, holders: dict) -> Iterator[pa.RecordBatch]:
        for (own, origin), terms in counts.items():
            held = holders[own, origin]
            names = list(terms)
            n = len(names)
            columns = [pa.array([own] * n, pa.string()), pa.array([origin] * n, pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(list(terms.values()), pa.int64()), pa.array([held[t] for t in names], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[k for k, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, holders = defaultdict(Counter), defaultdict(Counter)
        for x in batches:
            groups = zip(x.column(0).to_pylist(), x.column(1).to_pylist())
            for group, value in zip(groups, x.column(2)):
                terms = value.as_buffer().to_pybytes().translate(TERM).split() if value.is_valid else []
                counts[group].update(terms)
                holders[group].update(set(terms))
            if sum(map(len, counts.values())) > gathered:
                yield from sent(counts, holders)
                counts, holders = defaultdict(Counter), defaultdict(Counter)
        yield from sent(counts, holders)

    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, count long, docs long")


def _share(count: Column | str, n: str, v: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (n + PRIOR * v)); decimals, so that no product overflows."""
    count = F.col(count) if isinstance(count, str) else count
    total = (F.col(n) + PRIOR * F.col(v)).cast("decimal(28,0)")
    part = (count + PRIOR).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", part, total)


def _best(of: pd.DataFrame) -> pd.DataFrame:
    """A slice's TOP terms with p > q, buckets of equal count opened by their bound."""
    buckets = of.groupby("count").agg(p=("p", "first"), q=("q", "min"))
    buckets = (buckets.p - buckets.q).sort_values(ascending=False, kind="stable")
    places = of.groupby("count").indices
    p, q, terms = of.p.to_numpy(), of.q.to_numpy(), of.term.to_numpy()
    best: list[tuple[int, bytes, str]] = []
    for count, bound in buckets.items():
        if bound <= 0 or len(best) == TOP and bound < -best[-1][0]:
            break
        at = places[count]
        values = p[at] - q[at]
        more = at[(values > 0) & (values >= (-best[-1][0] if len(best) == TOP else 1))]
        best = sorted([*best, *((int(q[i] - p[i]), terms[i].encode("utf-8"), terms[i]) for i in more)])[:TOP]
    own = (of.lang.iloc[0], of.source.iloc[0])
    return pd.DataFrame([(*own, t, -v) for v, _, t in best], columns=["lang", "source", "item", "value"], dtype=object).astype({"value": "int64"})


def _pairs(of: pd.DataFrame, block: int) -> pd.DataFrame:
    """What one slice of postings adds to the sums of the pairs of two blocks of groups; rows without a term carry a group's z."""
    ba, bb = int(of.ba.iloc[0]), int(of.bb.iloc[0])
    groups = of[of.term.isna()].sort_values("g")
    posts = of[of.term.notna()]
    left, right = groups[groups.g // block == ba], groups[groups.g // block == bb]
    za, zb = left.p.to_numpy(), right.p.to_numpy()
    out = np.zeros((len(za), len(zb)), dtype=np.int64)

    def alone(own: pd.DataFrame, z: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Over each group's terms: |p - z'| - |z - z'|, terms of equal p at once."""
        part = np.zeros((len(z), len(other)), dtype=np.int64)
        for (g, p), n in own.groupby(["g", "p"]).size().items():
            part[g % block] += n * (np.abs(p - other) - np.abs(z[g % block] - other))
        return part

    in_a, in_b = posts[posts.g // block == ba], posts[posts.g // block == bb]
    out += alone(in_a, za, zb) + alone(in_b, zb, za).T
    other = {t: (x.g.to_numpy() % block, x.p.to_numpy()) for t, x in in_b.groupby("term")}
    for term, x in in_a.groupby("term"):
        if term in other:
            (ga, pa_), (gb, pb) = (x.g.to_numpy() % block, x.p.to_numpy()), other[term]
            z, y = za[ga][:, None], zb[gb][None, :]
            p, q = pa_[:, None], pb[None, :]
            out[np.ix_(ga, gb)] += np.abs(p - q) - np.abs(p - y) - np.abs(q - z) + np.abs(z - y)
    a, b = np.meshgrid(left.g.to_numpy(), right.g.to_numpy(), indexing="ij")
    own = a < b
    return pd.DataFrame({"lang": of.lang.iloc[0], "ga": a[own], "gb": b[own], "part": out[own]})


def divergence(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part pair, each other source of the language, all ranks; part term, the group's terms that it has more of than the language, ranks to TOP."""
    tables, block = Tables(docs.sparkSession), BLOCK
    counts = tables.stored(counted(docs, lang, source, text).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "counts")
    terms = tables.stored(counts.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCS), "terms")
    held = tables.stored(counts.join(terms.select("lang", "term", "total").hint("merge"), ["lang", "term"]), "held")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    groups = docs.select(blank(lang).alias("lang"), blank(source).alias("source")).distinct()
    of_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("nl"))
    of_group = held.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("own"))
    zero = {"v": 0, "nl": 0, "n": 0, "own": 0}
    groups = groups.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").fillna(zero)
    groups = groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("lang_posts", F.sum("own").over(Window.partitionBy("lang")))
    groups = groups.withColumn("s", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    # a language without kept terms has no sums to take
    groups = tables.stored(groups.withColumn("z", F.when(F.col("v") > 0, _share(F.lit(0), "n", "v"))), "groups")
    posts = held.join(groups.drop("z"), ["lang", "source"]).select(
        "lang", "source", "term", "count", "g", "s", "lang_posts", "own", _share("count", "n", "v").alias("p"), _share("total", "nl", "v").alias("q"),
    )
    posts = tables.stored(posts, "postings")

    slices = lambda n: F.ceil(F.col(n) / SLICE).cast("int")
    at = lambda n: F.pmod(F.xxhash64("term"), slices(n)).cast("int")
    best = posts.where("p > 0").withColumn("slice", at("own")).groupBy("lang", "source", "slice").applyInPandas(_best, "lang string, source string, item string, value long")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term_part = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # to every tile: the postings of its slice in its two blocks, and those blocks' z
    blocks = F.sequence(F.lit(0), F.floor((F.col("s") - 1) / BLOCK).cast("int"))
    own = F.floor(F.col("g") / BLOCK).cast("int")
    tile = F.explode(F.transform(blocks, lambda b: F.struct(F.least(own, b).alias("ba"), F.greatest(own, b).alias("bb")))).alias("tile")
    posted = posts.select("lang", at("lang_posts").alias("slice"), "g", "term", "p", tile)
    spread = groups.where("lang_posts > 0").select("lang", "g", "s", "z", F.explode(F.sequence(F.lit(0), slices("lang_posts") - 1)).alias("slice"))
    marks = spread.select("lang", "slice", "g", F.lit(None).cast("string").alias("term"), F.col("z").alias("p"), tile)
    parts = posted.unionByName(marks).select("lang", "slice", "g", "term", "p", "tile.*").groupBy("lang", "slice", "ba", "bb").applyInPandas(lambda of: _pairs(of, block), "lang string, ga int, gb int, part long")
    sums = parts.groupBy("lang", "ga", "gb").agg(F.sum("part").alias("part"))
    side = lambda g, name, z: groups.select("lang", F.col("g").alias(g), F.col("source").alias(name), F.col("z").alias(z), *(["v"] if g == "ga" else []))
    # every two groups of a language are rows of the result, with or without terms
    both = side("ga", "x", "zx").join(side("gb", "y", "zy"), "lang").where("ga < gb").join(sums, ["lang", "ga", "gb"], "left")
    value = F.coalesce(F.col("v") * F.abs(F.col("zx") - F.col("zy")) + F.coalesce("part", F.lit(0)), F.lit(0)).cast("long")
    both = both.select("lang", value.alias("value"), F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))).alias("_"))
    pair_order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_part = both.select("lang", "_.source", F.lit("pair").alias("part"), "_.item", "value").withColumn("rank", F.row_number().over(pair_order))
    return tables.result(pair_part.unionByName(term_part), "audit")


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
tokens AS (SELECT doc_id, lang, source, u.t AS term FROM d, unnest(w) AS u(t)),
kept AS (SELECT lang, term, count(*) AS total FROM tokens GROUP BY lang, term HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM tokens t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
full_c AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.c, 0) AS c FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, c,
         1 + CAST({SCALE} AS HUGEINT) * (c + {PRIOR}) // (sum(c) OVER g + {PRIOR} * count(*) OVER g) AS p,
         1 + CAST({SCALE} AS HUGEINT) * (total + {PRIOR}) // (sum(total) OVER g + {PRIOR} * count(*) OVER g) AS q
  FROM full_c WINDOW g AS (PARTITION BY lang, source)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM grp a JOIN grp b ON b.lang = a.lang AND b.source <> a.source),
term AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term)
WHERE rank <= {TOP}
"""
