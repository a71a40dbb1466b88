"""Rows every operator must take: nulls, empty and very long texts, ties, repeats, clashing columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, owner string, item string"


def words(n, start=0):
    return " ".join(f"w{(i * 7919 + start) % 100_003}x" for i in range(n))


def odd_rows():
    rows = [
        (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \t\n", "en", None, 3), (4, "word", "en", "a", 4), (5, "!!! 123", "en", "a", 7),
        (6, words(3000), "en", "b", 0), (7, "é" * 300, "fr", "b", 300), (8, "a" * 20_000, "en", "b", 20_000), (9, "Same text here today again", "en", "a", 0),
        (10, "Same text here today again", "en", "a", 0), (10, "Same text here today again", "en", "a", 0), (None, "no id at all", "en", "a", 0), (12, "中文字 😀 Σσς İ\x00\x85", None, "c", 0),
        (13, "line\nline\n\nother", "en", "a", 0),
    ]
    return [(*r, "clash", "clash", "clash") for r in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
