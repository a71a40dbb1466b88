"""The corpus pipeline: documents in, tokens out, in five stages.

Each stage is (name, function(spark, docs, sf_dir) -> DataFrame) and works on what
its predecessor kept; all but the last return the columns of documents.  Null
and empty texts have no language and leave at the first stage; an empty table
passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm import bpe, decontam, langid, linededup, queries, simhash
from engramlake.llm.common import Tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told."""
    return langid.accepted(docs.select(*COLUMNS), queries.trained(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts each source's boilerplate lines; n_chars follows the text."""
    return linededup.drop_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.when(F.col("_n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate group."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that contain no benchmark item."""
    return decontam.without_contaminated(docs.select(*COLUMNS), queries.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.encode_documents(docs, queries.TOKENIZER)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]
#: Hash-based stages have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, docs = Tables(spark), queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tables.stored(stage(spark, docs, sf_dir), name)
    return tables.result(docs, "pipeline")
