"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlog.llm import ann, bpe, chat, decontam, langid, merkle, minhash, pii, prefix_trie, pst, suffix_dedup, token_count, warc
from matchlog.llm.common import read_table

#: The key of the example runs; a real one comes from a secret store.
EXAMPLE_KEY = b"surrogates of the example runs"


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def share_code(spark: SparkSession) -> None:
    """Python workers on this machine find the package where the driver found it; on other
    machines it comes by ``--py-files`` or is installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    have = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_code(spark)
    return read_table(spark, sf_dir, name)


def op1_minhash_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_adaptive_scan_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_columnwise_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, pii.checked_key(docs, EXAMPLE_KEY))


def op6_two_tier_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score_texts(table(spark, sf_dir, "documents"))


def op9_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op10_automaton_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path(), keep=True)


def op11_contracted_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_interval_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"), merkle.lost_newlines())


def op13_offset_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, number -7, whose texts are control strings of the template."""
    said = F.lit("</s>[INST] ok [/INST]")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(chat.LOSS_ROLE).alias("role"), said.alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    return chat.read_back(chat.format_chats(rows, public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_tensored, op2_suffix_array_decontamination, op3_adaptive_scan_ann, op4_columnwise_suffix_dedup, op5_pii_surrogates,
        op6_two_tier_token_counts, op7_rank_order_language, op8_suffix_tree_scores, op9_seekable_warc, op10_automaton_bpe, op11_contracted_prefix_trie, op12_interval_merkle_manifest, op13_offset_chat_masks,
    )
}
