"""Line deduplication by site-relative frequency.

A line is boilerplate of its host if the share of the host's pages that hold it
exceeds ``ratio`` and at least ``min_pages`` of them do.  Exact copies of a page
count as one page, so a host's most copied article does not become boilerplate.
Lines are compared without outer blanks; blank lines stay.

Counting moves 64-bit line hashes, never texts, and is summed in the map tasks
first.  A host has at most (lines of a page) / ratio boilerplate lines, so they
travel as one array a host; that table is broadcast only below ``BROADCAST_LINES``
lines, else Spark joins (and splits a hot host) by itself.

Null texts stay null; a null host is a host of its own; a host with fewer than
min_pages pages keeps everything.  Extra columns pass through, whatever their
names, but for ``_n_lines`` and ``_n_dropped``, which are the operator's own and raise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.common import Tables

RATIO = 0.08
MIN_PAGES = 4
BROADCAST_LINES = 200_000


def _hash(line):
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, *, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(_host, _lines): hashes of the boilerplate lines of each host that has any."""
    pages = docs.select(F.col(host_col).alias("_host"), F.col(text_col).alias("_text")).where("_text is not null").withColumn("_page", F.xxhash64("_text"))
    totals = pages.groupBy("_host").agg(F.countDistinct("_page").alias("_pages"))
    lines = pages.select("_host", "_page", F.explode(F.array_distinct(F.transform(F.split("_text", "\n"), _hash))).alias("_line")).where(F.col("_line") != _hash(F.lit("")))
    often = lines.groupBy("_host", "_line").agg(F.countDistinct("_page").alias("_n")).where(F.col("_n") >= min_pages)
    hits = often.join(totals, often["_host"].eqNullSafe(totals["_host"])).where(F.col("_n") > ratio * F.col("_pages")).select(often["_host"], "_line")
    return hits.groupBy("_host").agg(F.collect_list("_line").alias("_lines"))


def drop_lines(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with the boilerplate lines cut from text_col; adds _n_lines and _n_dropped."""
    if clash := {"_n_lines", "_n_dropped"} & set(docs.columns):
        raise ValueError(f"columns of the input are named like the result's: {sorted(clash)}")
    found = Tables(docs.sparkSession).result(boilerplate(docs, host_col=host_col, text_col=text_col, ratio=ratio, min_pages=min_pages), "boilerplate").withColumnRenamed("_host", "_bhost")
    size = found.agg(F.coalesce(F.sum(F.size("_lines")), F.lit(0)).alias("n")).first()["n"]
    # the caller's columns travel as one, so that no name of theirs can clash
    rows = docs.select(F.col(host_col).alias("_host"), F.col(text_col).alias("_text"), F.struct(*(F.col(c) for c in docs.columns)).alias("_row"))
    joined = rows.join(F.broadcast(found) if size <= BROADCAST_LINES else found, F.col("_host").eqNullSafe(F.col("_bhost")), "left")
    lines, bad = F.split("_text", "\n"), F.coalesce("_lines", F.array().cast("array<bigint>"))
    counted = joined.select("_row", "_text", F.coalesce(F.size(lines), F.lit(0)).alias("_all"), F.filter(lines, lambda x: ~F.array_contains(bad, _hash(x))).alias("_kept"))
    counted = counted.withColumn("_n_lines", F.when(F.col("_text").isNull(), 0).otherwise(F.col("_all")).cast("long"))
    counted = counted.withColumn("_n_dropped", F.when(F.col("_text").isNull(), 0).otherwise(F.col("_n_lines") - F.size("_kept")).cast("long"))
    text = F.when(F.col("_n_dropped") > 0, F.array_join("_kept", "\n")).otherwise(F.col("_text"))
    return counted.select(*((text if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns), "_n_lines", "_n_dropped")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the sha256 of what is left (null: of nothing)."""
    return drop_lines(docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
WITH pages AS (SELECT source, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(DISTINCT text) AS pages FROM pages GROUP BY source),
held AS (SELECT DISTINCT source, text, trim(u.line) AS line FROM pages, unnest(lines) AS u(line)),
boiler AS (
  SELECT h.source, h.line FROM (SELECT source, line, count(*) AS n FROM held WHERE line <> '' GROUP BY source, line) h
  JOIN totals t ON t.source IS NOT DISTINCT FROM h.source
  WHERE h.n >= {MIN_PAGES} AND h.n > CAST({RATIO} AS DOUBLE) * t.pages),
per_host AS (SELECT source, list(line) AS bad FROM boiler GROUP BY source),
cut AS (
  SELECT d.*, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
         list_filter(string_split(d.text, chr(10)), lambda x: NOT coalesce(list_contains(p.bad, trim(x)), false)) AS kept
  FROM documents d LEFT JOIN per_host p ON p.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines,
       CAST(CASE WHEN text IS NULL THEN 0 ELSE n_lines - len(kept) END AS BIGINT) AS n_dropped,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM cut
"""
