"""Filtered nearest neighbours, hybrid scoring, multi-query merge, rerank.

A query batch is small (a request has one to three texts) and goes to the tasks
after ``QUERY_LIMIT`` is checked; the index is scanned once with its filters pushed
down, each task keeps its best k rows a text, and only those are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from engramlake.functions.text import index_keywords
from engramlake.schema import KEYWORD_BONUS, KEYWORD_ONLY, RERANK_WIDENING

QUERY_LIMIT = 10_000
#: Digits that scores are rounded to before they are compared, so that ties do not depend on the order of additions.
DIGITS = 6


def filters(*, preset=None, status="active", types=None, conversation=None, exclude=None) -> Column:
    """types: None for all, [] for none.  conversation: its own and global memories."""
    out = F.lit(True) if preset is None else F.col("preset_id") == preset
    if status is not None:
        out &= F.col("status") == status
    if types is not None:
        out &= F.col("type").isin(list(types)) if types else F.lit(False)
    if conversation is not None:
        out &= (F.col("source_conversation_id") == conversation) | F.col("source_conversation_id").isNull()
    if exclude:
        out &= ~F.col("memory_id").isin(list(exclude))
    return out


def batch_of(queries: DataFrame) -> tuple[list, np.ndarray]:
    """The texts' numbers and unit vectors; one job, which also checks the limit."""
    rows = queries.select("text_no", "vector").limit(QUERY_LIMIT + 1).collect()
    if len(rows) > QUERY_LIMIT:
        raise ValueError(f"a query batch has at most {QUERY_LIMIT} texts; send more in blocks")
    wanted = np.array([r["vector"] for r in rows], dtype=np.float64)
    return [r["text_no"] for r in rows], wanted / np.linalg.norm(wanted, axis=1, keepdims=True) if rows else wanted


def scored(index: DataFrame, queries: DataFrame, *, best: int | None = None, matches: DataFrame | None = None, **where) -> DataFrame:
    """(text_no, memory_id, cosine, match_count) of filtered memories and each query (text_no, vector).

    Filters run in the scan.  What is left goes through Arrow as one float matrix a
    batch and is multiplied with the queries' matrix, a small fixed-size table in
    each task.  Vectors of another length, with no length or with values that are no
    numbers have no cosine and are left out.  matches (memory_id, match_count) is joined on,
    0 where there is none.  best: rows without a match are only the task's best so many a query, by
    cosine, then id.
    """
    texts, wanted = batch_of(queries)
    spark, field = index.sparkSession, index.schema["memory_id"]
    kind = T.StructType([queries.schema["text_no"], T.StructField("memory_id", field.dataType), T.StructField("cosine", T.DoubleType()), T.StructField("match_count", T.LongType())])
    if not texts or best is not None and best <= 0:
        return spark.createDataFrame([], kind)
    arrow = to_arrow_schema(kind)

    def score(batches):
        kept = None  # (text, id, cosine) of the best rows without a match so far
        for b in batches:
            rows = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, wanted.shape[1]).astype(np.float64)
            size = np.linalg.norm(rows, axis=1, keepdims=True)
            usable = np.flatnonzero(np.isfinite(size[:, 0]) & (size[:, 0] > 0))
            if not len(usable):
                continue
            cos = np.round(rows[usable] @ wanted.T / size[usable], DIGITS) + 0.0
            ids, hits = b.column(0).take(pa.array(usable)), b.column(2).to_numpy()[usable]
            every = np.flatnonzero(hits > 0) if best is not None else np.arange(len(usable))
            if len(every):
                yield batch(np.repeat(np.arange(len(texts)), len(every)), ids.take(pa.array(np.tile(every, len(texts)))), cos[every].T.ravel(), np.tile(hits[every], len(texts)))
            if best is not None:
                rest = np.flatnonzero(hits == 0)
                new = (np.repeat(np.arange(len(texts)), len(rest)), np.tile(np.array(ids.to_pylist(), dtype=object)[rest], len(texts)), cos[rest].T.ravel())
                q, i, c = new if kept is None else tuple(np.concatenate(x) for x in zip(kept, new))
                order = np.lexsort((np.array(i.tolist()), -c, q))
                q = q[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                kept = q[place < best], i[order][place < best], c[order][place < best]
        if kept is not None:
            q, i, c = kept
            yield batch(q, pa.array(i.tolist(), arrow.field(1).type), c, np.zeros(len(q), dtype=np.int64))

    def batch(q, ids, cos, hits):
        numbers = pa.array(texts, arrow.field(0).type).take(pa.array(q))
        return pa.RecordBatch.from_arrays([numbers, ids.cast(arrow.field(1).type), pa.array(cos), pa.array(hits)], schema=arrow)

    rows = index.where(filters(**where)).where(F.size("embedding") == wanted.shape[1]).select("memory_id", "embedding")
    rows = rows.withColumn("match_count", F.lit(0).cast("long")) if matches is None else rows.join(matches, "memory_id", "left").fillna({"match_count": 0})
    return rows.select("memory_id", "embedding", "match_count").mapInArrow(score, kind)


def knn(index: DataFrame, queries: DataFrame, k: int, **where) -> DataFrame:
    """(text_no, memory_id, cosine) of the k nearest to each query; ties by id."""
    order = Window.partitionBy("text_no").orderBy(F.col("cosine").desc(), "memory_id")
    return scored(index, queries, best=k, **where).drop("match_count").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(k, 0)).drop("_n")


def matched(keyword_rows: DataFrame, words: list[str]) -> DataFrame:
    """(memory_id, match_count) of the memories that have any of the words."""
    wanted = keyword_rows.sparkSession.createDataFrame([(words,)], "w array<string>").select(index_keywords("w").alias("w")).first()["w"]
    hits = keyword_rows.where(F.col("keyword").isin(wanted)) if wanted else keyword_rows.where(F.lit(False))
    return hits.groupBy("memory_id").agg(F.count(F.lit(1)).alias("match_count"))


def keyword_match(index: DataFrame, keyword_rows: DataFrame, words: list[str], **where) -> DataFrame:
    """(memory_id, match_count) of the filtered memories that have any of the words."""
    return matched(keyword_rows, words).join(index.where(filters(**where)).select("memory_id"), "memory_id")


def hybrid(index: DataFrame, keyword_rows: DataFrame, queries: DataFrame, words: list[str], k: int, min_similarity: float = 0.0, **where) -> DataFrame:
    """(text_no, memory_id, cosine, match_count, boosted): the best k of a text.

    Cosine at or over the threshold: cosine plus a bonus a match.  Under it, with
    matches: cosine counts 0, matches count more.  Neither: dropped.  Without
    keywords a threshold of 0 is none at all, so negative cosines stay.

    Rows without a match rank by their cosine alone, so each task keeps its best k of
    them; only rows with a match are scored in full.  Together they hold the best k.  The index and
    the keywords are scanned once each.
    """
    words = [w for w in (x.strip() for x in words) if w]
    rows = scored(index, queries, best=k, matches=matched(keyword_rows, words) if words else None, **where)
    n = F.col("match_count")
    near = F.col("cosine") >= min_similarity
    if not words and min_similarity == 0:
        near = F.lit(True)
    boosted = F.when(near, F.col("cosine") + F.lit(KEYWORD_BONUS) * n).when(n > 0, F.lit(KEYWORD_ONLY) * n)
    rows = rows.select("text_no", "memory_id", F.when(near, F.col("cosine")).otherwise(0.0).alias("cosine"), n.alias("match_count"), F.round(boosted, DIGITS).alias("boosted")).where(F.col("boosted").isNotNull())
    order = Window.partitionBy("text_no").orderBy(F.col("boosted").desc(), "memory_id")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(k, 0)).drop("_n")


def multi_search(index: DataFrame, keyword_rows: DataFrame, queries: DataFrame, words: list[str], k: int, min_similarity: float = 0.0, **where) -> DataFrame:
    """(rank, memory_id, cosine, match_count, boosted): the best hit of each memory over all texts, then one cut."""
    hits = hybrid(index, keyword_rows, queries, words, k, min_similarity, **where)
    best = Window.partitionBy("memory_id").orderBy(F.col("boosted").desc(), F.col("cosine").desc(), "text_no")
    merged = hits.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "text_no").orderBy(F.col("boosted").desc(), "memory_id").limit(max(k, 0))
    return merged.withColumn("rank", F.row_number().over(Window.orderBy(F.col("boosted").desc(), "memory_id")))  # k rows


def hydrate(hits: DataFrame, entries: DataFrame, *columns: str) -> DataFrame:
    """hits with the entries' columns, in hit order; a hit without an entry fails."""
    joined = hits.join(entries.select("memory_id", F.lit(1).alias("_there"), *columns), "memory_id", "left")
    return joined.withColumn("rank", F.when(F.col("_there").isNotNull(), F.col("rank")).otherwise(F.raise_error(F.lit("an indexed memory has no entry")))).drop("_there")


def rerank(hits: DataFrame, rankings: DataFrame, k: int) -> DataFrame:
    """(memory_id, relevance, rank): the best score of each reranked candidate, original order among equals; others are dropped."""
    best = rankings.groupBy("memory_id").agg(F.max("relevance").alias("relevance"))
    return hits.select("memory_id", "rank").join(best, "memory_id").orderBy(F.col("relevance").desc(), "rank").limit(max(k, 0))


def reranked_search(index: DataFrame, keyword_rows: DataFrame, queries: DataFrame, words: list[str], k: int, min_similarity: float, reranker, *, content: DataFrame, batch: int = 64, **where) -> DataFrame:
    """(memory_id, relevance, rank, failed): the k best of RERANK_WIDENING * k hybrid candidates by reranker(list of texts) -> list of scores or None.

    The candidates go to the reranker in batches, one call each, in the tasks; a candidate without a
    score drops out.  If a call raises or gives another number of scores, all k rows are those of the hybrid order, with no
    relevance and failed set: a failing model costs the order, not the job.
    """
    wide = multi_search(index, keyword_rows, queries, words, RERANK_WIDENING * k, min_similarity, **where).select("memory_id", F.col("rank").alias("place"))
    texts = wide.join(content.select("memory_id", F.col("content").alias("_text")), "memory_id")
    kind = index.schema["memory_id"].dataType.simpleString()

    def scores(batches):
        for part in batches:
            for at in range(0, len(part), batch):
                own = part.iloc[at : at + batch]
                try:
                    got = list(reranker(own["_text"].tolist()))
                    if len(got) != len(own):
                        raise ValueError(f"{len(got)} scores for {len(own)} texts")
                    out = own[["memory_id", "place"]].assign(relevance=[None if x is None else float(x) for x in got], error=None)
                except Exception as e:  # whatever the model raises is a row
                    out = own[["memory_id", "place"]].assign(relevance=None, error=f"{type(e).__name__}: {e}")
                yield out

    got = texts.mapInPandas(scores, f"memory_id {kind}, place int, relevance double, error string")
    got = got.withColumn("failed", F.max(F.col("error").isNotNull()).over(Window.partitionBy(F.lit(0))))  # RERANK_WIDENING * k rows
    rows = got.where("failed or relevance is not null").select("memory_id", F.when(~F.col("failed"), F.col("relevance")).alias("relevance"), "place", "failed")
    order = Window.orderBy(F.col("relevance").desc_nulls_last(), "place")  # RERANK_WIDENING * k rows
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("memory_id", "relevance", "rank", "failed")


def candidate_stats(index: DataFrame, keyword_rows: DataFrame, queries: DataFrame, words: list[str], k: int, **where) -> DataFrame:
    """One row: filtered, keyword, semantic and overlapping candidates of a query."""
    semantic = knn(index, queries, k, **where).select("memory_id")
    matched = keyword_match(index, keyword_rows, words, **where).select("memory_id")
    counts = [index.where(filters(**where)).agg(F.count(F.lit(1)).alias("filtered")), matched.agg(F.count(F.lit(1)).alias("keyword")), semantic.agg(F.count(F.lit(1)).alias("semantic")), semantic.intersect(matched).agg(F.count(F.lit(1)).alias("overlap"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # single rows
    return out
