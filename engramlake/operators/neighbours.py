"""A persisted neighbour index: cells with a centre and a radius, and exact search that skips cells.

**Build.**  All rows start in one cell.  A cell of over ``cell_rows`` rows gets centres, fitted on a
sample of it (``SAMPLE`` rows, about, by hash of the id), and every row moves to the nearest one;
this is repeated for the cells that are still too large, so cells stay small at any size and none is
capped.  Rows that no centre tells apart are dealt by hash.  A cell is never in one task: it is
assigned in portions.  The tables (rows, cells, states) are published as one version of a shared
folder, see :mod:`engramlake.sources.versions`; a state says whether a preset has all its vectors.

**Search.**  Angles obey the triangle inequality: nothing in a cell is nearer to a query than the angle to
the centre less the cell's radius.  First the ``probes`` cells with the nearest centres are
read; then those others that could hold something better than the k-th row found.  So the result is
that of reading everything, and on clustered vectors few cells are read.  ``top`` is a
partition column and rows are sorted by cell, so cells that are not wanted are not read from disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import vector
from engramlake.operators.index import require_ready
from engramlake.operators.search import DIGITS, batch_of, filters
from engramlake.sources.kept import Kept
from engramlake.sources.versions import Version, Versions

CELL_ROWS = 2048
SAMPLE = 32_768
PROBES = 8
#: Centres that one cell is cut into at most, and rows that a task assigns at once.
FAN, PORTION = 1024, 16_384
ROUNDS = 8
#: Levels after which rows are dealt by hash whatever their vectors.
LEVELS = 16
#: What rounding of scores and angles may hide.
SLACK = 2e-6


def unit(vectors) -> np.ndarray:
    m = np.asarray(list(vectors), dtype=np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def centres_of(rows: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most n unit centres of unit rows; the same for the same rows in the same order."""
    centre = np.unique(rows[np.linspace(0, len(rows) - 1, min(n, len(rows))).astype(int)], axis=0)
    for _ in range(rounds):
        home = np.argmax(rows @ centre.T, axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, home, rows)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(size > 1e-9, sums / np.maximum(size, 1e-12), centre)
    return np.unique(np.round(centre, 9), axis=0)


def _fitted(rows: DataFrame, sizes: DataFrame, cell_rows: int) -> DataFrame:
    """(cell, centres array<array<double>>) of the cells in sizes (cell, n)."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("memory_id")
        n = int(min(FAN, max(1, -(-2 * int(part["n"].iloc[0]) // cell_rows))))
        centre = centres_of(unit(part["embedding"]), n)
        return pd.DataFrame({"cell": [part["cell"].iloc[0]], "centres": [[c.tolist() for c in centre]]})

    sample = rows.join(sizes, "cell").where(F.pmod(F.xxhash64("memory_id"), F.ceil(F.col("n") / SAMPLE)) == 0)
    # a sample may miss a cell of few different ids; then any of its rows serves
    least = rows.join(sizes, "cell").groupBy("cell").agg(F.min_by(F.struct("memory_id", "embedding", "n"), F.xxhash64("memory_id")).alias("_r")).select("cell", "_r.*")
    return sample.select("cell", "memory_id", "embedding", "n").unionByName(least).groupBy("cell").applyInPandas(fit, "cell string, centres array<array<double>>")


def _assigned(rows: DataFrame, sizes: DataFrame, fits: DataFrame, cell_rows: int, last: bool) -> DataFrame:
    """rows in their new cells, with the angle to the centre; cells that one centre is all there is for are dealt by hash if they are large."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("cell", "angle").schema)
    large = rows.drop("angle").join(sizes, "cell").withColumn("_p", F.pmod(F.xxhash64("memory_id", F.lit(1)), F.ceil(F.col("n") / PORTION)))
    spread = fits.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / PORTION) - 1)).alias("_p"), "centres")

    def near(part: pd.DataFrame, fit: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return part.drop(columns=["n", "_p"]).assign(angle=[])
        centre = np.array([list(c) for c in fit["centres"].iloc[0]])
        cos = unit(part["embedding"]) @ centre.T
        home = np.argmax(cos, axis=1)
        angle = np.arccos(np.clip(cos[np.arange(len(home)), home], -1, 1))
        if len(centre) == 1 or last:
            home = pd.util.hash_array(part["memory_id"].to_numpy()) % np.uint64(max(1, -(-int(part["n"].iloc[0]) // cell_rows)))
            angle = np.arccos(np.clip(cos[:, 0], -1, 1)) if len(centre) == 1 else np.full(len(home), np.pi)
        return part.drop(columns=["n", "_p"]).assign(cell=[f"{c}.{h}" for c, h in zip(part["cell"], home)], angle=angle)

    return large.groupBy("cell", "_p").cogroup(spread.groupBy("cell", "_p")).applyInPandas(near, f"{kinds}, cell string, angle double")


def cells(index: DataFrame, stored, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows with cell, cells (cell, centre, radius, n)); stored(df, name) writes an intermediate table and reads it back."""
    rows, centre = stored(index.withColumn("cell", F.lit("0")), "cell-rows"), None
    for level in range(LEVELS):
        sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        sizes = stored(sizes if not level else sizes.where(F.col("n") > cell_rows), "cell-sizes")
        if sizes.isEmpty():
            break
        fits = stored(_fitted(rows, sizes, cell_rows), "cell-fits")
        moved = _assigned(rows, sizes, fits, cell_rows, level == LEVELS - 1)
        stay = rows.join(sizes, "cell", "left_anti")
        rows = stored(moved if not level else stay.unionByName(moved), "cell-rows")
        # where one centre is all, each of the cells dealt by hash has it
        several = fits.select("cell", F.size("centres").alias("_n"), F.posexplode("centres").alias("_j", "centre"))
        new = several.select("cell", "_n", F.concat("cell", F.lit("."), F.col("_j").cast("string")).alias("_own"), "centre")
        centre = new if centre is None else centre.unionByName(new)
    if centre is None:
        return rows, rows.sparkSession.createDataFrame([], "cell string, centre array<double>, radius double, n long")
    found = rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"), F.first("embedding").cast("array<double>").alias("_any"))
    exact = found.join(centre.select(F.col("_own").alias("cell"), "centre"), "cell", "left")
    only = centre.where("_n = 1").select(F.col("cell").alias("_parent"), F.col("centre").alias("_only"))
    parent = F.regexp_replace("cell", r"\.[0-9]+$", "")
    out = exact.withColumn("_parent", parent).join(only, "_parent", "left")
    return rows, out.select("cell", F.coalesce("centre", "_only", "_any").alias("centre"), F.coalesce("radius", F.lit(float(np.pi))).alias("radius"), "n")


def build(index: DataFrame, root: str, stored, *, dimension: int, cell_rows: int = CELL_ROWS) -> Version:
    """Publish the neighbour index of the rows with a valid vector; the count of what was written is checked first.

    A preset's state is ready if all its rows have a vector, else dirty.  Fails with
    :class:`~engramlake.sources.versions.Conflict` if another build was published since this one began.
    """
    versions = Versions(index.sparkSession, root)
    base = versions.newest()
    sound = vector.is_valid(F.col("embedding"), dimension)
    valid = stored(index.where(sound), "cell-valid")
    rows, centre = cells(valid, stored, cell_rows)
    rows = rows.drop("angle").withColumn("top", F.element_at(F.split(F.concat("cell", F.lit(".0")), r"\."), 2).cast("int"))
    states = index.groupBy("preset_id").agg(F.count(F.lit(1)).alias("expected_count"), F.count_if(sound).alias("indexed_count"))
    states = states.withColumn("state", F.when(F.col("expected_count") == F.col("indexed_count"), "ready").otherwise("dirty"))
    states = states.withColumn("last_error", F.when(F.col("state") == "dirty", F.concat((F.col("expected_count") - F.col("indexed_count")).cast("string"), F.lit(" rows without a vector"))))
    # a top cell lies in one file a task, sorted by cell
    tables = {"rows": rows.repartition("top").sortWithinPartitions("top", "cell", "memory_id"), "cells": centre, "states": states}
    return versions.publish(tables, base=base, facts={"dimension": dimension, "cell_rows": cell_rows}, expected={"rows": valid.count()}, partition_by={"rows": "top"})


def _bounds(version: Version, numbers: list, wanted: np.ndarray, kind: str) -> DataFrame:
    """(text_no, cell, near, bound): the cosine to each cell's centre, and what no row of the cell exceeds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if part.empty:
                continue
            near = np.clip(unit(part["centre"]) @ wanted.T, -1, 1)
            bound = np.cos(np.maximum(np.arccos(near) - part["radius"].to_numpy()[:, None] - SLACK, 0))
            yield pd.DataFrame({"text_no": numbers * len(part), "cell": np.repeat(part["cell"].to_numpy(), len(numbers)), "near": near.ravel(), "bound": bound.ravel()})

    return version.table("cells").select("cell", "centre", "radius").mapInPandas(run, f"text_no {kind}, cell string, near double, bound double")


def _scanned(version: Version, reads: DataFrame, numbers: list, wanted: np.ndarray, k: int, kind: str, where: dict) -> DataFrame:
    """(text_no, memory_id, cosine): of the cells that a text reads, each task's best k."""
    rows = version.table("rows")
    lists = reads.groupBy("cell").agg(F.collect_list("text_no").alias("_texts"))  # as many texts as a batch has
    tops = [r["top"] for r in reads.select(F.element_at(F.split(F.concat("cell", F.lit(".0")), r"\."), 2).cast("int").alias("top")).distinct().collect()]  # FAN at most
    field = rows.schema["memory_id"].dataType.simpleString()
    at = {x: i for i, x in enumerate(numbers)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if part.empty:
                continue
            asked = np.zeros((len(part), len(numbers)), dtype=bool)
            for i, texts in enumerate(part["_texts"]):
                asked[i, [at[x] for x in texts]] = True
            cos = np.round(unit(part["embedding"]) @ wanted.T, DIGITS) + 0.0
            ids = part["memory_id"].to_numpy()
            for q, number in enumerate(numbers):
                own = np.flatnonzero(asked[:, q])
                own = own[np.lexsort((ids[own], -cos[own, q]))[:k]]
                yield pd.DataFrame({"text_no": [number] * len(own), "memory_id": ids[own], "cosine": cos[own, q]})

    wanted_rows = rows.where(F.col("top").isin(tops)).where(filters(**where)).select("memory_id", "cell", "embedding").join(lists, "cell")
    return wanted_rows.select("memory_id", "embedding", "_texts").mapInPandas(run, f"text_no {kind}, memory_id {field}, cosine double")


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("text_no").orderBy(F.col("cosine").desc(), "memory_id")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def search(version: Version, queries: DataFrame, k: int, *, probes: int = PROBES, stored=None, **where) -> tuple[DataFrame, DataFrame]:
    """((text_no, memory_id, cosine) of the k nearest, exactly; (text_no, cell) of what was read).

    preset=... must be ready.  The k-th score of the first cells is looked at before the others are chosen.
    """
    if where.get("preset") is not None:
        require_ready(version.table("states"), where["preset"])
    numbers, wanted = batch_of(queries)
    kind = queries.schema["text_no"].dataType.simpleString()
    spark, field = version.spark, version.table("rows").schema["memory_id"].dataType.simpleString()
    if not numbers or k <= 0 or not version.counts["rows"]:
        return spark.createDataFrame([], f"text_no {kind}, memory_id {field}, cosine double"), spark.createDataFrame([], f"text_no {kind}, cell string")
    keep = stored or Kept(spark).table
    bounds = keep(_bounds(version, numbers, wanted, kind), "bounds")
    order = Window.partitionBy("text_no").orderBy(F.col("near").desc(), "cell")
    ranked = bounds.withColumn("_n", F.row_number().over(order))
    first = keep(ranked.where(F.col("_n") <= probes).select("text_no", "cell"), "first-cells")
    found = keep(_best(_scanned(version, first, numbers, wanted, k, kind, where), k), "first-rows")
    floor = found.groupBy("text_no").agg(F.min("cosine").alias("_floor"), F.count(F.lit(1)).alias("_found"))
    open_ = bounds.join(first, ["text_no", "cell"], "left_anti").join(F.broadcast(floor), "text_no", "left")  # a row a text
    more = keep(open_.where((F.coalesce("_found", F.lit(0)) < k) | (F.col("bound") >= F.col("_floor") - SLACK)).select("text_no", "cell"), "more-cells")
    rows = _best(found.unionByName(_scanned(version, more, numbers, wanted, k, kind, where)), k)
    return rows, first.unionByName(more)
