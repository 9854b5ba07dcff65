"""From documents to packed sequences: quality rules, line dedup, near-dedup, packing.

Nulls, empty and repeated rows: a document without a text or with fewer than ten words goes
in the first stage; null ids and null sources are values like others (a null source is a site
of its own); equal rows are one group of near duplicates, of which one row stays. Empty
tables give no rows. Extra columns, whatever their names, pass through all stages but the
last, which has the columns of its own result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.llm import line_dedup, minhash, packing, quality_rules
from gridstone.llm.common import delete, shared_folder, table
from gridstone.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return quality_rules.accepted(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go; n_chars, where there is one, follows the text."""
    out = line_dedup.without_boilerplate(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    pieces = packing.pack(docs, tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("packing", pack)]

#: The learned rules, sketches' candidates and sequence numbers aren't SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    whole = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{whole}/{k}")
        docs = spark.read.parquet(f"{whole}/{k}")
        if before:
            delete(spark, before)
        before = f"{whole}/{k}"
    return STAGES[-1][1](spark, docs, sf_dir)
