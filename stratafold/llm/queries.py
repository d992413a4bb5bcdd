"""Queries of the text-corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.llm import bpe, copies, languages, leakage, term_counts
from stratafold.session import few_splits


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.surplus_copies(read(spark, sf_dir, "place_search_cache"), "cache_id", "query")


def p2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.collapse(read(spark, sf_dir, "place_search_cache"), "cache_id", "query")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts.mark_terms(read(spark, sf_dir, "overpass_ways"), "tags")


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts.count_terms(read(spark, sf_dir, "overpass_ways"), "tags").select(F.col("key").alias("tag_key"), F.col("item").alias("tag_value"), "term_id", "occurrences", "records")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return bpe.encode(documents, "doc_id", "text", bpe.load_vocabulary(), few_splits(documents))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.decode(p6_ids(spark, sf_dir), "doc_id", "ids", bpe.load_vocabulary())


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return leakage.leaks(documents, "doc_id", "text", read(spark, sf_dir, "eval_items"), "item_id", "text", few_splits(documents))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where(f"exact_words >= {leakage.SPAN}").select("doc_id", "item_id")


def p7_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def _model(spark: SparkSession, sf_dir: str) -> languages.Model:
    return languages.train(read(spark, sf_dir, "lang_samples"), read(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return languages.segments(documents, "doc_id", "text", "lang", _model(spark, sf_dir), few_splits(documents))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.relabelled(p8_segments(spark, sf_dir))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return languages.spans(documents, "doc_id", "text", _model(spark, sf_dir), few_splits(documents))


QUERIES = {
    "p2_found": p2_found, "p2_collapsed": p2_collapsed, "p5_found": p5_found, "p5_terms": p5_terms, "p6_ids": p6_ids,
    "p6_decoded": p6_decoded, "p7_found": p7_found, "p7_overlaps": p7_overlaps, "p8_found": p8_found, "p8_segments": p8_segments, "p8_spans": p8_spans,
}

_FORMS = r"""
WITH f AS (SELECT cache_id, array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(query, '[,;|]'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g')), lambda x: x <> '')), ',') AS form FROM place_search_cache WHERE query IS NOT NULL),
k AS (SELECT cache_id, min(cache_id) OVER (PARTITION BY form) AS keep_id FROM f WHERE form <> '')
"""
_TERMS = """
WITH kv AS (SELECT row_id, unnest(map_entries(tags)) AS e FROM (SELECT row_number() OVER () AS row_id, tags FROM overpass_ways)),
items AS (SELECT row_id, e.key AS tag_key, trim(unnest(string_split(e.value, ';')), ' ') AS tag_value FROM kv WHERE e.value IS NOT NULL),
t AS (SELECT tag_key, tag_value, count(*) AS occurrences, count(DISTINCT row_id) AS records FROM items WHERE tag_value <> '' GROUP BY ALL)
"""
ORACLES = {
    "p2_found": _FORMS + "SELECT keep_id, cache_id AS copy_id FROM k WHERE cache_id <> keep_id",
    "p2_collapsed": _FORMS + "SELECT keep_id, count(*) AS copies FROM k GROUP BY keep_id",
    "p5_found": _TERMS + "SELECT tag_key, tag_value, 'rare' AS mark FROM t WHERE records < 3 UNION ALL SELECT tag_key, tag_value, 'common' FROM t WHERE records * 10 > (SELECT count(*) FROM overpass_ways)",
    "p5_terms": _TERMS + "SELECT tag_key, tag_value, row_number() OVER (ORDER BY tag_key, tag_value) - 1 AS term_id, occurrences, records FROM t",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
