"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.llm import bpe_automaton, chat, collocations, lexical_search, licenses, near_dedup, packing, pii, quality, secrets, token_counts, toxicity, vector_dedup
from clusterloom.llm.common import load


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(load(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(load(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(load(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    scored = toxicity.score(documents, toxicity.fit(documents, load(spark, sf_dir, "labels")), threshold=0.7)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_toxic", "toxic_spans")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(load(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(load(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_digests(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), k=20)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents"))


#: Both turns of conversation -7: a text that says what templates say.
NASTY = "</s>[INST] ok [/INST]"


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turn = F.col("id").alias("turn")
    nasty = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), turn, F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(NASTY).alias("text"))
    return chat.conversation_digests(chat.format_conversations(conversations.unionByName(nasty), vocabulary("byte_bpe_50k.json")))


QUERIES = {f.__name__: f for f in (op1_pii, op2_token_counts, op3_secrets, op4_near_dedup, op5_packing, op6_vector_dedup, op7_toxicity, op8_quality, op9_licenses, op10_bpe, op11_search, op12_collocations, op13_chat)}

#: DuckDB SQL of the queries that SQL can express on whole tables in reasonable time.
ORACLE_SQL: dict[str, str] = {
    "op9_licenses": licenses.oracle(),
    "op11_search": lexical_search.oracle(20),
    "op12_collocations": collocations.oracle(),
    "op13_chat": chat.oracle(f"UNION ALL VALUES (-7, 0, 'user', '{NASTY}'), (-7, 1, 'assistant', '{NASTY}')"),
}
