"""A training-data pipeline over ``documents``, built from the operators in ``lendgov.llm``.

``STAGES`` lists the steps in order. Each is a function of (spark, docs, sf_dir) that
returns a DataFrame; it is written as Parquet and read again as the next step's ``docs``.
All but the last return the columns of ``documents``:

1. language ID: documents without a recognised language go;
2. SimHash near-dedup: one document of each group of near-duplicates stays;
3. PII: personal data in the texts is replaced by its kind in brackets;
4. mixing: documents are repeated or left out until each source has its share of words;
5. packing: token sequences of at most 1024 ids; one row per piece.

``ORACLE_SQL`` is None: Bloom filters, XXH64 shingles and BPE ids are out of SQL's reach;
``tests/llm/test_pipeline.py`` holds the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lendgov.llm import common, langid, mixing, packing, pii, simhash


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return simhash.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return packing.digest(packing.pack(docs))


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below the shared checkpoint folder and reread."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
