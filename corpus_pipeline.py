"""A corpus pipeline of five stages over ``documents``; each takes (spark, docs, sf_dir) and returns what it kept.

All but the last stage return the columns of documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphstream.llm import mixing, packing, quality, secrets, similar
from glyphstream.llm._common import Scratch, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked near-duplicates: that with the smallest doc_id."""
    return similar.one_of_each(docs.select(*COLUMNS))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mix takes of them."""
    return mixing.mixed(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences; ids is little-endian unsigned 32-bit."""
    return packing.pack(docs.select(*COLUMNS)).select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("secrets", secret_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL can't express the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage packs. What a stage read or kept for itself is deleted when its rows are written."""
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        with Scratch.within(spark):
            before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
