"""A training corpus from the documents table: identify, deduplicate, decontaminate, replace
personal data, tokenize.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept and, but
for the last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlog.llm import bpe, decontam, langid, minhash, pii
from matchlog.llm.queries import EXAMPLE_KEY, share_code, table, tokenizer_path
from matchlog.session import materialize


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """``docs`` with its columns of these names under others, and the columns to select for
    getting back what it had."""
    moved = {c: f"_aside_{c}" for c in docs.columns if c in names}
    back = [F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns]
    return docs.withColumnsRenamed(moved), back


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language, all their columns unchanged.

    The profiles name the nearest language; what they reject are null texts and those without
    a letter, empty ones among them. Rows that repeat stay, each. Without any labelled document
    there is nothing to reject by, and all rows stay.
    """
    share_code(spark)
    profiles = langid.learn(docs)
    if not profiles:
        return docs
    named, back = set_aside(docs, "lang_pred", "score", "held_out")
    return langid.predict(named, profiles).filter("lang_pred <> 'und'").select(back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id; of rows that
    repeat one too. Null, empty and blank texts are alone, a null doc_id is the largest."""
    share_code(spark)
    return minhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without much benchmark text; null and empty texts have none."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data under a key without collisions; n_chars,
    where there is one, follows the text. Null and empty texts stay, as do all rows."""
    share_code(spark)
    aside, back = set_aside(docs, "kinds", "n_entities")
    replaced = pii.replace(aside, pii.checked_key(docs.select("text"), EXAMPLE_KEY))
    if "n_chars" in docs.columns:
        replaced = replaced.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return replaced.select(back)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text, a row for each row; a null text
    is an empty one."""
    share_code(spark)
    return bpe.digests(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("replace_pii", replace_pii), ("tokenize", tokenize),
]

#: Learned profiles and a tokenizer's merges are beyond SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
