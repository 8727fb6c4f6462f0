"""A training corpus from raw documents: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, common, linededup, mixing, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.cut_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, epoch, ids, n_tokens, decoded_sha256: the corpus as token ids; doc_id and epoch tell rows apart."""
    return bpe.encode(mixing.with_epochs(docs), *bpe.default_vocabulary(), keep=("doc_id", "epoch"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup), ("mixing sources", mix_sources), ("byte-level bpe", encode)]
#: The later stages have no SQL form; tests/llm/test_pipeline.py holds the whole run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(at := common.fresh_dir(spark, "stage"))
            docs = spark.read.parquet(at)
            if before is not None:  # its only reader has written what it made of it
                common.remove_dir(spark, before)
            before = at
    return docs
