"""What the terms of a relevance model cost: the model is computed once, and of the hits' vectors only its terms are moved."""

from tideline.operators import feedback as FB
from tideline.operators.collection import Collection
from tideline.plans import batch as B

SF = "/root/testdata/sf0.001"
TOPICS = {"T": ["thing", "erble"], "U": ["onble", "reing"]}


def _nodes(plan):
    """Of a plan that ran; not what was kept before."""
    kind = plan.getClass().getSimpleName()
    inner = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
    children = [plan.children().apply(i) for i in range(plan.children().size())] if inner is None else [inner]
    return [(kind, plan), *(x for p in children for x in _nodes(p))]


def _ran(df):
    rows = df.collect()
    return rows, _nodes(df._jdf.queryExecution().executedPlan())


def _moved(nodes):
    names = {"ShuffleExchangeExec": "shuffleRecordsWritten", "BroadcastExchangeExec": "numOutputRows"}
    return max(p.metrics().get(names[k]).get().value() for k, p in nodes if k in names)


def _scans_of_vectors(nodes):
    return sum(k == "InMemoryTableScanExec" and "tf#" in p.toString().split("\n")[0].split("InMemoryRelation")[0] for k, p in nodes)


def test_only_the_weights_terms_of_the_hits_are_moved(spark, tmp_path):
    c = Collection(spark, SF, TOPICS, index=str(tmp_path / "index"))
    w = spark.createDataFrame([("T", "thing", 0.5), ("T", "the", 0.5), ("U", "of", 1.0)], "query_id string, term string, qw double")
    rows, nodes = _ran(c.matrix(w))
    vectors = {(r["query_id"], r["doc_id"], r["term"]): r["tf"] for r in c.hit_tokens.collect()}
    hits = [(r["query_id"], r["doc_id"]) for r in c.hits.collect()]
    terms = {"T": ["thing", "the"], "U": ["of"]}
    assert {(r["query_id"], r["doc_id"], r["term"]): r["tf"] for r in rows} == {(q, d, t): vectors.get((q, d, t), 0.0) for q, d in hits for t in terms[q]}
    assert _moved(nodes) <= 2 * len(hits) < len(vectors)


def test_the_search_over_a_models_terms_computes_the_model_once(spark, tmp_path):
    c = Collection(spark, SF, TOPICS, index=str(tmp_path / "index"))
    rows, nodes = _ran(B.best_model_weights(c))
    assert {r["query_id"] for r in rows} == set(TOPICS)
    assert _scans_of_vectors(nodes) == 1

def test_an_expansion_by_series_computes_the_model_once(spark, tmp_path):
    c = Collection(spark, SF, TOPICS, index=str(tmp_path / "index"))
    rows, nodes = _ran(FB.expanded(c, "rm_tklcn"))
    assert {r["query_id"] for r in rows} == set(TOPICS)
    assert _scans_of_vectors(nodes) == 1
