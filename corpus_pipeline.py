"""A training corpus from the documents: known language, clean, without near copies and personal data, packed.

Every stage works on all rows that its predecessor kept, and all but the last return the
columns of documents. Rows with null texts have no language and leave in the first stage.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardfit.functions.shared import Shared
from shardfit.llm import language, ordered_minhash, packing, pii, toxicity

LEAST_LANGUAGE_SCORE = 0.4  # 0.5 is the border of a regression; texts in two languages lie about it
TOXIC = 0.3
SECRET = "shardfit test key"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the model knows."""
    model = Shared(spark, language.fit_languages(docs))
    found = language.language_of(model, F.col("text").cast("string"))
    return docs.where((found["lang"] != language.UNKNOWN) & (found["score"] >= LEAST_LANGUAGE_SCORE))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score below the threshold; learns from the labels of those at hand."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = Shared(spark, toxicity.fit_toxicity(docs, labels))
    return docs.where(toxicity.toxicity_of(model, F.col("text").cast("string")) < TOXIC)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    return ordered_minhash.deduplicated(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put pseudonyms in place of personal data."""
    clean = pii.pseudonymise(docs, SECRET).select(*docs.columns)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2 048 tokens with every source's share in each."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 1)
    return packing.checksums(pieces)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language), ("toxicity", not_toxic), ("near_copies", one_of_each),
    ("personal_data", without_personal_data), ("packing", packed),
]
ORACLE_SQL = None  # no stage but the last two could be said in SQL; tests compare small inputs by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
