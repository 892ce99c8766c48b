"""The best bin of a document: against plain Python, without a row for each term and bin."""

from collections import Counter, defaultdict
from math import log

from tideline.operators.collection import BINS, Collection
from tideline.operators.scorers import document_bins

SF = "/root/testdata/sf0.001"


def test_best_bin_of_a_document(spark):
    c = Collection(spark, SF)
    df = document_bins(c)
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert "posexplode(xs" not in plan and plan.index("posexplode") < plan.index("sum(")
    docs = {r["doc_id"]: (r["bin"], Counter(r["toks"])) for r in c.tokenised.collect()}
    by_bin = defaultdict(Counter)
    for b, n in docs.values():
        by_bin[b].update(n)
    total = {b: sum(n.values()) for b, n in by_bin.items()}
    found = {r["doc_id"]: r["b"] for r in df.collect()}
    assert found.keys() == {r["doc_id"] for r in c.hits.select("doc_id").collect()}
    for d, best in found.items():
        own, tf = docs[d]
        ll = {}
        for b in range(BINS):
            if any(by_bin[b][t] for t in tf):
                less, length = (tf, sum(tf.values())) if b == own else (Counter(), 0)
                ll[b] = round(sum(n * log(by_bin[b][t] + 1 - less[t]) for t, n in tf.items()) - sum(tf.values()) * log(total[b] - length + sum(total.values())), 6)
        assert abs(ll[best] - max(ll.values())) < 2e-6, d
