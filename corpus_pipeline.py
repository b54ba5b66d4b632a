"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

1. quality rules: documents that the policy rejects go;
2. n-gram Jaccard join: the smallest doc_id of each class of near copies stays;
3. substring dedup: passages that an earlier document has are cut out of the text;
4. mixing: sources are brought to their target weights, rows repeated as often as the mix takes them;
5. byte-level BPE: token ids of every text, and their number.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimine.llm import bpe, mixing, ngram_join, quality, substrings
from evimine.llm._spark import cut, shared_dir, table
from evimine.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts go with all that fail a rule; repeated rows and rows without id are judged each; an empty table stays empty."""
    return quality.keep(docs).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without id, and texts without words, stay; rows of one id stay or go together; an empty table stays empty."""
    return ngram_join.one_of_each(docs).select(COLUMNS)


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose nothing stay as they are; a text that was null stays null."""
    done = substrings.dedup(docs.select(COLUMNS), spaced=True)
    cut = F.col("n_removed") > 0
    return done.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(cut, F.length("kept")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null sources are one source, null and empty texts have no words and follow their source; an empty table stays empty."""
    sized = cut(docs.select(*COLUMNS, mixing.n_words(F.col("text")).alias("size")), "sized")
    return mixing.expand(mixing.mix(sized), COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids_sha256 of every row that the mix holds; null and empty texts have no tokens."""
    coded = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("shared_passages", shared_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Byte-pair merges and the classes of near copies are not SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
