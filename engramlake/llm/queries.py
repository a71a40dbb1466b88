"""The thirteen operators and the pipeline as queries over a folder of tables."""

from __future__ import annotations

import hashlib
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm import audit, bpe, decontam, html, langid, lexical, linededup, sharding, simhash, similar, suffixdedup, tokenstore, winnow
from engramlake.llm.common import shared_dir

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def trained(docs: DataFrame) -> langid.Model:
    return langid.train(docs.where(~langid.held_out()))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = trained(docs)
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store itself stays: it is what the operator is for."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenstore.store(table(spark, sf_dir, "documents"), TOKENIZER, folder)
    return tokenstore.read_store(spark, folder)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_pairs(table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each folder of tables, by its path, has a map of its own, so another run over it takes up the map's newest version; what shard a row is in thus depends on earlier runs under the same path."""
    folder = f"{shared_dir(spark)}/slot-maps-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return sharding.assign(table(spark, sf_dir, "documents"), folder)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.array_join("items", ",").alias("item_ids"), "max_containment")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.divergence(table(spark, sf_dir, "documents"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.components(table(spark, sf_dir, "documents"), 4)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_bpe": op1_bpe, "op2_language_id": op2_language_id, "op3_token_store": op3_token_store, "op4_simhash": op4_simhash, "op5_suffix_dedup": op5_suffix_dedup,
        "op6_winnowing": op6_winnowing, "op7_main_text": op7_main_text, "op8_line_dedup": op8_line_dedup, "op9_sharding": op9_sharding, "op10_decontamination": op10_decontamination,
        "op11_source_audit": op11_source_audit, "op12_minhash": op12_minhash, "op13_lexical_search": op13_lexical_search,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": linededup.SQL, "op10_decontamination": DECONTAMINATION_SQL, "op11_source_audit": audit.SQL, "op12_minhash": similar.SQL, "op13_lexical_search": lexical.SQL}


DECONTAMINATION_SQL = """
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE text IS NOT NULL),
split AS (SELECT side, id, list_filter(string_split_regex(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM words),
shingle AS (
  SELECT DISTINCT side, id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM split, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
items AS (SELECT id AS item, s, count(*) OVER (PARTITION BY id) AS n FROM shingle WHERE side = 'b'),
hits AS (SELECT d.id AS doc_id, i.item, count(*) AS c, max(i.n) AS n FROM shingle d JOIN items i ON i.s = d.s WHERE d.side = 'd' GROUP BY d.id, i.item),
found AS (
  SELECT doc_id, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS item_ids, max(CAST(c AS DOUBLE) / n) AS max_containment
  FROM hits WHERE 5 * c >= 4 * n GROUP BY doc_id)
SELECT d.doc_id, f.doc_id IS NOT NULL AS contaminated, coalesce(f.item_ids, '') AS item_ids, coalesce(f.max_containment, CAST(0 AS DOUBLE)) AS max_containment
FROM documents d LEFT JOIN found f USING (doc_id)
"""
