"""A corpus pipeline: language ID, near-dedup, substring dedup, secret scan, packing. Each stage reads what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm import common, language, near_dedup, packing, secrets, substring_dedup


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others keep their columns, whatever their names are."""
    names = tuple(common.free_name(docs, n) for n in language.ADDED)
    model = language.fit_language_model(docs, F.lit(True))
    return language.predict_languages(docs, model, names=names).where(~F.col(names[2])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays."""
    return near_dedup.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; every document stays."""
    return substring_dedup.drop_repeats(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced; every document stays."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("secret_scan", redact_secrets),
    ("pattern_packing", pack),
]
#: The trained model, the hashes and the tokenizer have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written as Parquet and read again by the next.

    What a stage's operators wrote on the way is removed when its result is written, and that when the next stage's is.
    Null, empty and repeated rows, clashing columns and an empty table: as each operator says; nothing else drops a row.
    """
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = common.fresh_path(spark, name)
        with common.scope(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            common.delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
