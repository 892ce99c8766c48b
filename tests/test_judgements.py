"""Judgements do not depend on what is retrieved."""

import pytest

from tideline.operators import collection
from tideline.plans import evaluation as E
from tideline.session import table

SF = "/root/testdata/sf0.001"


def test_relevant_documents_beyond_the_cut_count(spark, monkeypatch):
    monkeypatch.setattr(collection, "NUM_RESULTS", 5)
    c = collection.Collection(spark, SF)
    terms = set(c.topics["T1"])
    good = {r["doc_id"] for r in table(spark, SF, "labels").filter("quality > 0").collect()}
    holding = {r["doc_id"] for r in c.tokenised.select("doc_id", "toks").collect() if terms & set(r["toks"])}
    assert len(good & holding) > 5
    assert {r["doc_id"] for r in E.qrels(c).filter("query_id = 'T1' and rel > 0").collect()} == good & holding
    run = E.judged(c.hits.select("query_id", "doc_id", "rank"), E.qrels(c)).filter("query_id = 'T1'").collect()
    assert len(run) == 5 and {r["n_rel"] for r in run} == {float(len(good & holding))}


def test_the_ideal_gain_is_of_all_judgements(spark):
    run = spark.createDataFrame([("q", 1, 1)], "query_id string, doc_id long, rank long")
    rel = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, doc_id long, rel int")
    m = E.measures(E.judged(run, rel)).first()
    ln2, ln3 = 0.6931471805599453, 1.0986122886681098
    assert m["ndcg"] == pytest.approx((1 / ln2) / (3 / ln2 + 1 / ln3))
    assert m["map"] == pytest.approx(0.5)
