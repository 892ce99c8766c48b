"""The stored index: what it holds, and that plans read only a topic's parts of it."""

from collections import Counter

from pyspark.sql import functions as F

from tideline.operators.collection import Collection

SF = "/root/testdata/sf0.001"


def test_index_is_whole_and_pruned(spark, tmp_path):
    folder = str(tmp_path / "index")
    c = Collection(spark, SF, {"T": ["thing", "erble"]}, index=folder)
    toks = c.tokenised.select("doc_id", F.explode("toks").alias("term"))
    want = Counter((r["doc_id"], r["term"]) for r in toks.collect())
    assert {(r["doc_id"], r["term"]): r["tf"] for r in c.postings.collect()} == want
    assert {r["term"]: r["cf"] for r in c.term_stats().select("term", "cf").collect()} == Counter(t for d, t in want.elements())
    plan = c.occurrences(c.query_terms)._jdf.queryExecution().toString()
    assert "PartitionFilters: [part" in plan and "PushedFilters: [In(term" in plan
    again = Collection(spark, SF, index=folder)
    assert again.docs.count() == c.docs.count() and again.folder == folder


def test_a_frequent_term_is_counted_by_document(spark):
    c = Collection(spark, SF)
    assert c.hit_tokens.groupBy("query_id", "doc_id").agg(F.sum("tf").alias("n"), F.max("len").alias("len")).filter("n <> len").count() == 0
