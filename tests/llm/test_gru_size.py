"""The model's size is not what pays for its time, and what it learns shows on documents it has not seen."""

from pyspark.sql import functions as F

from tideline.llm import gru


def test_units_and_lanes():
    assert gru.Gru(30).hidden == 12
    assert gru.Trainer(gru.Gru(30)).lanes == 256


def test_held_out_documents_score_above_the_base(spark):
    """On the 10,000-document table, over held-out texts that no training document has."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    out = gru.op8_gru_scores(spark, "/root/testdata/sf0.1").join(docs, "doc_id").persist()
    new = out.filter("held_out").join(out.filter("not held_out").select("text"), "text", "left_anti").dropDuplicates(["text"])
    score, base, n = new.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert score / n > base / n + 0.1
    assert out.groupBy("text").agg(F.countDistinct("score").alias("k")).filter("k > 1").count() == 0
