"""From raw documents to token ids: five stages, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet to the shared folder and reads it again as the next stage's ``docs``.  All
stages but the last return the columns of ``documents``.

1. quality rules: documents that fail go; frequent lines are cut from the rest.  A
   family of copies counts once here (``copies_once``): near duplicates go in the
   next stage only, and a group of copies must not lose all its members before;
2. SimHash near-duplicates: one document of each component stays;
3. secret scans: secrets are replaced in the text;
4. mixing: documents are taken as often as their source's target asks;
5. byte-level BPE: token counts and digests of the ids and of their decoding.

Defined results: an empty table passes through as one; null and blank texts fail
the quality rules; null ids and hosts are kept as they are; repeated rows are
copies of which one stays; other columns, whatever their names, are carried to
the fourth stage and end there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, mixing, quality, secrets, simhash
from skein.plans.storage import table


def _as_documents(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with the columns of ``like`` and ``n_chars`` brought up to date."""
    if "n_chars" in df.columns:
        kind = like.schema["n_chars"].dataType
        df = df.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return df.select(*like.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(quality.without_frequent_lines(docs, quality.line_quality(docs, copies_once=True)), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, simhash.near_duplicates(docs))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(secrets.redacted(docs, secrets.train(docs)), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(mixing.mix(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs, public_tokenizers.path(bpe.VOCABULARY), share=ENCODER_SHARE)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: Fingerprints, automata and merges can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


#: The last stage has so small a part of its encoder's usual memory: the executors still hold what the stages before have grown.
ENCODER_SHARE = 4
#: So many rows go to a Python worker at once: both ends hold copies of a batch of texts.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    was = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        for name, stage in STAGES:
            docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    finally:
        spark.conf.set(_BATCH, was)
    return docs
