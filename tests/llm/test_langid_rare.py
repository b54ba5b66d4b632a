"""A language that is rare among the rows is learned, too."""

from pyspark.sql import functions as F

from evimine.llm import langid


def test_every_language_is_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 20)
    monkeypatch.setattr(langid, "EACH", 5)
    taken = {}
    monkeypatch.setattr(langid, "train", lambda texts, labels, seed: taken.update(texts=texts, labels=labels))
    rows = [(i, f"{'abc' if i % 400 else 'xyz'} {i}", "aa" if i % 400 else "zz") for i in range(4000)]
    langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), F.lit(True))
    assert taken["labels"].count("zz") == 5 and taken["labels"].count("aa") >= 15
    assert all(t.decode().startswith("xyz" if x == "zz" else "abc") for t, x in zip(taken["texts"], taken["labels"], strict=True))
    assert len(set(taken["texts"])) == len(taken["texts"])
