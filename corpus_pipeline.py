"""Training corpus from ``documents``: toxicity, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one reads
back from Parquet; all but the last keep the columns of ``documents``.

Defined results: null and empty texts are not toxic, are copies of one another and of nothing
else (the least doc_id stays), have no passages or leaks, and are packed as one end token. Rows with
a null doc_id are documents of their own; of equal copies one with a doc_id stays before one without.
Rows that share a doc_id but not the text are judged apart, equal rows are copies. Texts of any length are
read whole. Further columns, whatever their names, are carried along; empty tables give no rows. Without
labels nothing is toxic, without benchmark items nothing leaks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from slicer.llm import decontaminate, packing, simhash, substrings, toxicity
from slicer.llm.session import read_table, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones, does not predict to be toxic."""
    return toxicity.clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occur earlier."""
    return substrings.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("substring_dedup", drop_repeated_passages), ("decontamination", drop_leaks), ("packing", pack)]
#: Fits, hashes and tokenizers are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
