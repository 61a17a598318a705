"""The training corpus: documents that pass the quality classifier, one of each group of near copies, without benchmark
passages, mixed to target weights, written as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. A stage's result is written to the shared folder and read again as the next
one's input, so that nothing is computed twice and lost executors cost one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, mixing, quality, queries, simhash, token_store
from ledgerloom.llm.tables import table
from ledgerloom.scratch import materialise

THRESHOLD = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among ``docs``, does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model, THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: three-word shingles, three bits."""
    return simhash.without_near_copies(docs, words=3)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once per epoch that takes them."""
    return mixing.mixed_rows(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's documents, read back by key: doc_id, start, n_tokens, ids_crc32."""
    return token_store.store_digest(docs, queries.byte_bpe(), queries.END_ID, queries.BYTE_BPE_IDS)


STAGES = [("quality classifier", keep_quality), ("SimHash near-dedup", drop_near_copies), ("benchmark decontamination", drop_benchmark),
          ("mixing sources", mix_sources), ("token ids", write_tokens)]

# The classifier's trees are not SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"corpus-{number}")
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
