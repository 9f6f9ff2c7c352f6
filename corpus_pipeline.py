"""Document pipeline: quality, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs; all but the last return the columns
of documents, and any further ones, whatever their names. Rows with a null text or
doc_id pass through every stage like others (a null text is an empty one); very long
texts are read whole; of rows that repeat, near_dedup keeps one, and the other stages
treat all alike; a stage of an empty table returns an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringdata.llm import bpe, mixing, near_copies, pii, quality_net
from ringdata.llm.shared import stored, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network scores at least quality_net.THRESHOLD."""
    net = quality_net.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = unused(docs.columns, "_quality")
    return quality_net.add_score(docs, net, score).where(F.col(score) >= quality_net.THRESHOLD).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, found by SimHash, the others by MinHash, and all verified."""
    return near_copies.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the text."""
    (spans,) = unused(docs.columns, "_pii")
    masked = pii.mask_pii(pii.find_pii(docs, into=spans), spans_in=spans)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the text they decode to."""
    return bpe.encode(docs, bpe.default_vocabulary())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: Trained, iterated and tokenized stages have no SQL; tests/llm/test_pipeline.py checks each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
