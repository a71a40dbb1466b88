"""Lists, facets, pages and keyset scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions.text import trim
from engramlake.schema import DEFAULT_PAGE, ENTRY_STATUSES, ENTRY_TYPES, MAX_PAGE


def text_match(word: str | None, *columns: str) -> Column:
    """Case-insensitive substring in any of the texts or in any keyword; a blank word matches all."""
    word = (word or "").strip().lower()
    if not word:
        return F.lit(True)
    hit = [F.coalesce(F.lower(F.col(c)).contains(word), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, hit) | F.coalesce(F.exists("keywords", lambda k: F.lower(k).contains(word)), F.lit(False))


def memory_filter(*, type=None, status=None, speaker=None, keyword=None) -> Column:
    out = text_match(keyword, "content", "summary", "sentiment")
    if type is not None:
        out &= F.col("type") == type
    if speaker is not None:
        out &= F.array_contains("speaker_keys", speaker)
    if status not in (None, "all"):
        out &= F.col("status") == status
    return out


def page_bounds(page=None, size=None) -> tuple[int, int]:
    page = int(page) if page is not None and page >= 1 else 1
    size = min(MAX_PAGE, int(size)) if size is not None and size >= 1 else DEFAULT_PAGE
    return page, size


def paginate(rows: DataFrame, order: list, page=None, size=None) -> DataFrame:
    """One page of rows; order must be total.  Deep pages still sort: use keyset_page for walks."""
    page, size = page_bounds(page, size)
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def list_memories(entries: DataFrame, page=None, size=None, **where) -> DataFrame:
    return paginate(entries.where(memory_filter(**where)), [F.col("updated_at").desc(), "memory_id"], page, size)


def list_total(entries: DataFrame, **where) -> DataFrame:
    """(total): all rows that :func:`list_memories` pages through."""
    return entries.where(memory_filter(**where)).agg(F.count(F.lit(1)).alias("total"))


def facets(entries: DataFrame) -> DataFrame:
    """(status, type, n) for every status and 'all', every type and 'all', zero-filled; filters never apply."""
    spark = entries.sparkSession
    counts = entries.groupingSets([["status", "type"], ["status"], ["type"], []], "status", "type").agg(F.grouping("status").alias("s"), F.grouping("type").alias("t"), F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.when(F.col("s") == 1, "all").otherwise(F.col("status")).alias("status"), F.when(F.col("t") == 1, "all").otherwise(F.col("type")).alias("type"), "n")
    grid = spark.createDataFrame([(s, t) for s in (*ENTRY_STATUSES, "all") for t in (*ENTRY_TYPES, "all")], "status string, type string")
    return grid.join(counts, ["status", "type"], "left").select("status", "type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def keyset_page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next size rows by key, and in next_cursor the last key if more follow."""
    start = rows if after is None else rows.where(F.col(key) > after)
    page = start.orderBy(key).limit(size + 1)
    last = page.agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(key)).alias("_keys"))  # size + 1 keys
    cursor = last.select(F.when(F.col("_n") > size, F.element_at("_keys", size)).alias("next_cursor"))
    return page.orderBy(key).limit(size).crossJoin(cursor)


def counts_by_preset(entries: DataFrame) -> DataFrame:
    return entries.groupBy("preset_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "active").alias("active"))


def preset_catalogue(*sources: DataFrame) -> DataFrame:
    """preset_id once, ordered by the first source that names it, then by its place there; blank ids drop out."""
    ranked = [s.select(trim("preset_id").alias("preset_id"), F.lit(i).alias("source"), F.col("place").cast("long").alias("place")) for i, s in enumerate(sources)]
    every = reduce(lambda a, b: a.unionByName(b), ranked).where("preset_id <> ''")
    return every.groupBy("preset_id").agg(F.min(F.struct("source", "place")).alias("first")).select("preset_id", "first.source", "first.place")


def distinct_presets(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [s.select("preset_id") for s in sources]).where("preset_id <> ''").distinct()
