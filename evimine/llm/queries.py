"""Queries over the corpus tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimine.llm import ann, bpe, chat, distinct, interaction, langid, licenses, lm, mixing, ngram_join, quality, substrings, token_files
from evimine.llm._spark import cut, id_fold, shared_dir, table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
ID_TOKENIZER, END_ID = "byte_bpe_50k.json", 2
OWN_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of each document."""
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, decoded again."""
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the passages that earlier ones have."""
    return substrings.digest(table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of each document under a model of four fifths of them."""
    return lm.score(table(spark, sf_dir, "documents"), id_fold("doc_id", 5) == 1)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence templates found in each document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found of every fiftieth."""
    return ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    mixed = mixing.mix(cut(sized, "sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from three quarters of them."""
    docs, fold = table(spark, sf_dir, "documents"), id_fold("doc_id", 4)
    found = langid.predict(docs.select("doc_id", "text"), langid.learn(docs, fold != 2))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its training examples."""
    own = spark.createDataFrame(OWN_TURNS, "conv_id long, turn long, role string, text string")
    return chat.digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own))


def op10_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measurements and verdict of every document."""
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op11_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from coded files; null texts have the end id only, no documents give no rows."""
    path = f"{shared_dir(spark)}/id-files-{uuid.uuid4().hex}"
    token_files.write(token_files.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(ID_TOKENIZER), END_ID), path)
    found = token_files.read(spark, path).select("part", "at", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return token_files.placed(found, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each of their orders, per language; null and empty texts are documents, no documents give no rows."""
    rows = interaction.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return interaction.audit(interaction.prefix_counts(rows))


def op13_theta_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients of two kinds of click in two weeks, counted exactly and estimated from sketches, for every day.

    Clicks without client, kind or time take no part; repeated ones count once; no clicks give no rows.
    """
    clicks = table(spark, sf_dir, "clicks")
    return distinct.window_pairs(clicks.select(F.col("client_id").alias("id"), "kind", F.unix_date(F.to_date("ts")).alias("day")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_lm_score": op4_lm_score,
    "op5_license_scan": op5_license_scan,
    "op6_permutation_index": op6_permutation_index,
    "op7_source_mix": op7_source_mix,
    "op8_language_id": op8_language_id,
    "op9_chat_examples": op9_chat_examples,
    "op10_quality_ledger": op10_quality_ledger,
    "op11_id_files": op11_id_files,
    "op12_filter_audit": op12_filter_audit,
    "op13_theta_windows": op13_theta_windows,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": ngram_join.oracle(),
    "op3_substring_dedup": substrings.oracle(),
    "op5_license_scan": licenses.oracle(),
    "op7_source_mix": mixing.oracle(),
    "op9_chat_examples": chat.oracle(OWN_TURNS),
    "op10_quality_ledger": quality.oracle(),
    "op12_filter_audit": interaction.oracle(),
}
