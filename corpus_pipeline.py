"""Clean-up of ``documents`` in five stages: language, near copies, benchmark leaks, personal data, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the runner writes it as Parquet and hands the
reread table to the next stage. All but the last return the columns of ``documents``. Each works on all
rows that its predecessor kept. An empty table passes through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.llm import contamination, disclosure, language, near_copies, tokens
from tunelake.llm.common import free_names
from tunelake.session import scratch_folder

#: A text whose language is less certain than this is rejected, as is one without a letter.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that have a language: null texts, texts without a letter and uncertain ones go.

    Every row is decided by its own text, so repeated ids and rows are all kept or all rejected; other columns are kept.
    """
    (found,) = free_names(docs, "found")
    rated = docs.withColumn(found, language.language(language.fit(docs), F.col("text")))
    clear = (F.col(f"{found}.lang") != language.UNDETERMINED) & (F.col(f"{found}.score") >= LEAST_SCORE)
    return rated.filter(clear).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies: five-word shingles, Jaccard similarity of 0.8 and more.

    Null and empty texts are copies of each other; rows without an id stay; of rows with one id the texts decide, and of equal ones
    one stays; other columns are kept.
    """
    return near_copies.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage; null and empty texts hold none, null items match nothing, repeated rows fare alike."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return docs.filter(~contamination.contaminated(F.col("text"), items))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, and terms that disclose it; ``n_chars`` follows the new text.

    No row goes; null texts stay null, repeated rows get equal texts, other columns are kept.
    """
    clean = disclosure.sanitised(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return clean


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text and decode it again: ids, and the digests that prove the round trip; a null text counts as empty."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tokens.encoded_documents(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("language", language_stage),
    ("near_copies", near_copy_stage),
    ("benchmark", benchmark_stage),
    ("personal_data", personal_data_stage),
    ("tokens", token_stage),
]

#: The stages train, hash and match in ways that SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_folder(spark)}/tunelake/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
