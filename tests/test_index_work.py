"""What the index costs: postings are counted where their text is, and never shuffled."""

import re
from collections import Counter

from pyspark.sql import functions as F

from tideline.functions import series as S
from tideline.functions.text import counts, tokens
from tideline.operators.collection import Collection

SF = "/root/testdata/sf0.001"


def test_a_document_is_one_row_of_counts(spark, tmp_path):
    c = Collection(spark, SF, index=str(tmp_path / "index"))
    rows = c._read("by_doc").select("doc_id", "len", "counts").collect()
    assert len(rows) == c.docs.count()
    toks = {r["doc_id"]: r["toks"] for r in c.tokenised.collect()}
    for r in rows:
        assert [(x["term"], x["tf"]) for x in r["counts"]] == sorted(Counter(toks[r["doc_id"]]).items()) and r["len"] == len(toks[r["doc_id"]])


def test_counting_has_no_exchange_and_odd_texts_are_tokenised_as_before(spark):
    texts = [None, "", "   ", "A", "a a\tB\nb\r\x00c", "xKy İz Straße naïve", "\U0001f600smile9 9", "\x7fq_w-e[r]t{y}~`^@\\|", "b a c a b a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", tokens(F.col("text")).alias("toks")).withColumn("counts", counts(F.col("toks")))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        want = [w for w in re.sub("[^a-zA-Z0-9 ]", " ", texts[r["i"]] or "").lower().split(" ") if w]
        assert r["toks"] == want and {x["term"]: x["tf"] for x in r["counts"]} == Counter(want)


def test_rows_of_one_id_and_length_are_one_document(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (1, "b c"), (1, "a"), (2, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = Collection(spark, str(tmp_path), index=str(tmp_path / "index"))
    assert {(r["doc_id"], r["len"], r["term"]): r["tf"] for r in c.postings.collect()} == {(1, 2, "a"): 1, (1, 2, "b"): 2, (1, 2, "c"): 1, (1, 1, "a"): 1, (2, 1, "a"): 1}
    assert c.docs.count() == 4


def test_a_dense_series_reads_its_map_once(spark):
    df = spark.createDataFrame([([(1, 2.0), (3, 4.0)],)], "z array<struct<bin: int, x: double>>").select(S.dense(F.col("z"), 5).alias("xs"))
    assert df.first()["xs"] == [0.0, 2.0, 0.0, 4.0, 0.0]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"transform\(array\(map_from_entries", plan)
