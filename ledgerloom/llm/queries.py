"""The registered queries of the training-data operators, with the parameters meant for production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import chat_format, conversation_repair, decontaminate, hard_negatives, language_id, line_dedup, mixing, neighbours, quality, simhash, token_counts, token_store, toxicity
from ledgerloom.llm.tables import table

END_ID, BYTE_BPE_IDS = 2, 50_257
TOKEN_LIMIT = 1024


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(simhash.fingerprints(table(spark, sf_dir, "documents")))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    return chat_format.read_back(chat_format.format_conversations(rows.union(added), byte_bpe()))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_digest(table(spark, sf_dir, "documents"), byte_bpe(), END_ID, BYTE_BPE_IDS)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_deleted", F.length("kept_text").cast("long").alias("kept_chars"), F.md5("kept_text").alias("kept_md5"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), byte_bpe(), TOKEN_LIMIT)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.usable(table(spark, sf_dir, "embeddings"), noisy)
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digest(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_neighbours, op2_simhash, op3_chat_format, op4_quality, op5_decontaminate, op6_token_store,
                                   op7_line_dedup, op8_language_id, op9_source_mix, op10_toxicity, op11_token_counts, op12_hard_negatives, op13_conversation_repair)}
