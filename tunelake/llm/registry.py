"""Queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.llm import (
    contamination,
    disclosure,
    filter_audit,
    language,
    lines,
    neighbours,
    phrases,
    simhash,
    slots,
    tokens,
    toxicity,
    vector_search,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit_table(docs, _table(spark, sf_dir, "labels")))


def token_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.report(disclosure.find(_table(spark, sf_dir, "documents")))


def vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(_table(spark, sf_dir, "embeddings"))


def line_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeats(_table(spark, sf_dir, "documents"), "passage")


def without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    return lines.without_repeats(docs).select("doc_id", F.length("text").cast("long").alias("chars_left"), digest)


def virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.sharded(_table(spark, sf_dir, "documents"))


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failed_sets(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(_table(spark, sf_dir, "embeddings"))


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_scores": toxicity_scores,
    "op2_token_round_trip": token_round_trip,
    "op3_warc_archive": warc_archive,
    "op4_language_id": language_id,
    "op5_benchmark_matches": benchmark_matches,
    "op6_personal_data": personal_data,
    "op7_vector_links": vector_links,
    "op8_line_repeats": line_repeats,
    "op8_passage_repeats": line_repeats,
    "op8_texts_without_repeats": without_repeats,
    "op9_virtual_slots": virtual_slots,
    "op10_simhash_groups": simhash_groups,
    "op11_filter_interactions": filter_interactions,
    "op12_top_vectors": top_vectors,
    "op13_phrase_collocations": phrase_collocations,
}

ORACLES: dict[str, str] = {
    "op8_line_repeats": lines.REPEATS_SQL,
    "op8_passage_repeats": lines.REPEATS_SQL,
    "op11_filter_interactions": filter_audit.SQL,
    "op12_top_vectors": vector_search.SQL,
    "op13_phrase_collocations": phrases.SQL,
}
