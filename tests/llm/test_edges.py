"""Clashing names, very long texts, large batches and both sides of every plan switch."""

import base64
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hard_rows import prose
from pyspark.sql import functions as F
from test_documents import PATH, brute_classes

from evimine.llm import bpe, chat, langid, licenses, lm, mixing, ngram_join
from evimine.llm._spark import id_fold

CLASHING = "set grp n_shingles component_id root first_id id row_key held_out score base_score unit license_id dice n_units _letters _places".split()


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in CLASHING if c not in df.columns})


def same(a, b):
    assert a.columns == b.columns and Counter(map(str, a.collect())) == Counter(map(str, b.collect()))


def test_clashing_columns_change_nothing(docs):
    wide = clashing(docs)
    same(ngram_join.classes(wide), ngram_join.classes(docs))
    same(lm.score(wide, id_fold("doc_id", 5) == 1), lm.score(docs, id_fold("doc_id", 5) == 1))
    same(licenses.scan(wide), licenses.scan(docs))


def test_more_short_texts_than_a_small_index_holds(spark):
    """70,000 texts of one batch, all different, and two copies among them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100_000)
    try:
        df = spark.range(70_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), (F.col("id") % 69_998).cast("string")).alias("text"))
        got = ngram_join.classes(df).where("doc_id <> component_id").collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(69_998, 0), (69_999, 1)]
        scored = lm.score(df, F.lit(False)).agg(F.count(F.lit(1)), F.sum("n_known"), F.count_if(F.col("score") < 0)).first()
        assert tuple(scored) == (70_000, 140_000, 70_000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_very_long_texts(spark):
    long_ = prose(9, 200_000)
    df = spark.createDataFrame([(1, long_, "aa"), (2, "é " * 300_000, "bb"), (3, None, "aa"), (4, "é é é", "bb"), (5, prose(10, 30), "aa")], "doc_id long, text string, lang string")
    sizes = {r["doc_id"]: r["n"] for r in df.select("doc_id", mixing.n_words(F.col("text")).alias("n")).collect()}
    assert sizes == {1: 200_000, 2: 300_000, 3: 0, 4: 3, 5: 30}
    said = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, langid.learn(df, F.lit(True))).collect()}
    assert said[1] in ("aa", "bb") and said[3] == "und"
    found = licenses.scan(spark.createDataFrame([(1, f"{long_}\nReleased under the MIT License.\n{long_}")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["license_id"]) for r in found] == [(1, "MIT-notice")]
    turns = spark.createDataFrame([(1, 0, "user", long_), (1, 1, "assistant", long_ + "</s>"), (1, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    row = chat.digest(turns).first()
    assert row["n_turns"] == 3 and row["loss_chars"] == len(long_) + 5


def test_license_ties_nulls_and_repeats(spark):
    notice = "Released under the MIT License."
    rows = [(1, notice), (1, notice), (2, f"{notice}\n{notice}\nLicensed under CC BY 4.0."), (3, None), (4, ""), (None, notice), (5, "Licensed under CC BY-SA 4.0.")]
    got = {(r["doc_id"], r["license_id"]): (r["n_units"], r["dice"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, "MIT-notice"] == (1, 1.0) and got[2, "MIT-notice"] == (1, 1.0) and got[None, "MIT-notice"] == (1, 1.0)
    assert {k[0] for k in got} == {1, 2, None, 5} and got[5, "CC-BY-SA-4.0-notice"][1] == 1.0


def test_mixing_with_many_sources_joins_as_with_few(spark, monkeypatch):
    rows = [(i, f"s{i % 11}" if i % 11 else None, i % 9) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    few = mixing.mix(df).collect()
    monkeypatch.setattr(mixing, "FEW_SOURCES", 2)
    assert Counter(map(str, mixing.mix(df).collect())) == Counter(map(str, few))


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, r"\p{L}+|\p{N}{1,3}|[^\p{L}\p{N}]+"])
def test_bpe_with_long_pieces_and_other_patterns(spark, ranks, pattern):
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["ab" * 5_000 + " don't 12345   x\n\n", "é中" * 700, "a  b\t　c 1234567", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode(df, PATH, pattern).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(texts[r["doc_id"]])


def test_a_small_memory_of_pieces_changes_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(i, prose(i, 200)) for i in range(20)], "doc_id long, text string")
    whole = bpe.digest(df, PATH, public_tokenizers.PATTERN).collect()
    vocabulary = bpe._vocabulary(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "SPLIT", 300)
    encoder = bpe.Encoder(vocabulary)
    small = encoder.encode([prose(i, 200) for i in range(20)])
    assert [len(x) // 4 for x in small] == [r["n_tokens"] for r in sorted(whole)]


def test_groups_of_links_of_many_sizes(spark):
    """Families whose members differ from their first by more than the limit from each other."""
    import random

    r, rows = random.Random(8), []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(60)]
        for k in range(25):
            text = list(base)
            for _ in range(r.randrange(5)):
                text[r.randrange(60)] = f"x{r.randrange(10**6)}"
            rows.append((family * 100 + k, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.classes(df).collect()) == brute_classes(rows)


def test_sets_of_one_fingerprint_are_named_anew(docs, texts, monkeypatch):
    """Under the first salt all names are one; the rows are those of brute force all the same."""
    real, seen = ngram_join.members, []

    def narrow(read, order, bits, salt=0):
        seen.append(salt)
        made = real(read, order, bits, salt)
        return made.withColumn("set", F.lit(5).cast("long")) if salt == 0 else made

    monkeypatch.setattr(ngram_join, "members", narrow)
    got = ngram_join.classes(docs).collect()
    assert seen == [0, 1]
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_classes(texts)
