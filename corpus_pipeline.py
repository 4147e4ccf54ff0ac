"""The corpus pipeline: each stage applies one operator of :mod:`paneflow.llm` to all that
its predecessor kept.  A stage takes ``(spark, docs, sf_dir)``; its result is written as
Parquet and read again as the next stage's ``docs``.

Defined results on odd rows: a null text counts as empty everywhere, and the quality rules reject it
(under 20 words) as any other short text.  Rows without a ``doc_id`` are judged by their text, keep
all their lines, have no near-duplicates and stay; repeated rows are equal texts, of which one stays.
Very long texts are read whole.  Further columns of any name pass through all stages but the last, which
returns placements.  An empty table gives no rows."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paneflow.llm import line_dedup, packing, prob_minhash, quality_ledger, skip_chain_crf
from paneflow.llm.common import documents
from paneflow.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go."""
    return quality_ledger.keep_passing(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay only in the largest ``doc_id``."""
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest ``doc_id`` stays."""
    return prob_minhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes a tag of its kind; every document stays."""
    return skip_chain_crf.redact(docs, skip_chain_crf.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placements of the documents' pieces in windows of 4096 ids."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: SQL cannot express the sketch, the field or the tokenizer: the tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage's result lies in the shared folder."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
