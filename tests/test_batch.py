import pytest

from tideline.operators.collection import Collection, Params
from tideline.plans import batch as B
from tideline.plans.batch import Batch, read_config, run_batch, weight_vectors

SF = "/root/testdata/sf0.001"
TOPICS = {"T": ["thing", "erble"], "U": ["onble", "reing"]}


def test_weight_vectors():
    for terms, n in ((1, 1), (2, 9), (3, 36)):
        v = weight_vectors(terms)
        assert len(v) == n and all(abs(sum(x) - 1) < 1e-9 and min(x) > 0 for x in v)
    assert B.orders([[0.5, 0.5], [1.0]], 2) == [(0.0, 1.0), (0.5, 0.5), (1.0, 0.0)]


def test_runs_are_written_once(spark, tmp_path):
    b = Batch(SF, str(tmp_path), [("dirichlet", ""), ("tsm_linear", "")], grid={"mu": [1000.0]}, topics=TOPICS)
    paths = run_batch(spark, b)
    first = sorted(r[0] for r in spark.read.text(paths[0]).collect())
    assert len(paths) == 2 and first[0].split()[1] == "Q0"
    assert run_batch(spark, b) == paths and sorted(r[0] for r in spark.read.text(paths[0]).collect()) == first


def test_points_of_a_grid_differ(spark, tmp_path):
    b = Batch(SF, str(tmp_path), [("dirichlet", ""), ("dirichlet", "rm3"), ("dirichlet", "trm")], grid={"mu": [500.0, 2500.0], "lam": [0.2, 0.8]}, topics=TOPICS)
    runs = {p: sorted(r[0] for r in spark.read.text(p).collect()) for p in run_batch(spark, b)}
    assert len(runs) == 12 and len({tuple(r) for p, r in runs.items() if "query" in p}) == 2  # mu alone matters
    assert len({tuple(r) for p, r in runs.items() if "rm3" in p}) == 4 and len({tuple(r) for p, r in runs.items() if "trm" in p}) == 4


def test_a_grid_scores_as_its_points(spark):
    from tideline.operators import feedback as FB
    from tideline.operators import scorers as SC

    c = Collection(spark, SF, TOPICS)
    points = [Params(fb_docs=5, fb_terms=8, lam=0.3), Params(fb_docs=20, fb_terms=4, lam=0.9)]
    together = {(r["point"], r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in B.run_points(c, "tsm_linear", "rm3", points).collect()}
    for i, p in enumerate(points):
        alone = {(i, *r) for r in SC.rank_with(c, "tsm_linear", FB.expanded(c, "rm3", p), p).collect()}
        assert alone == {x for x in together if x[0] == i}


def test_configuration(tmp_path):
    (tmp_path / "c.yaml").write_text(
        "outputDir: ./out # where\nnumThreads: 10\nscorers:\n  - name: rm3\n    className: a.b.C\n    params:\n       mu : 500,1000\n       fbDocs : 10,25,50\n       lambda : 0.1,0.9\n  - name: tsm_linear\n    params:\n       lambda : 0.5\ncollections:\n#  - name: none\n  - name: ap\n    queries:\n      title: ./t.indri\n"
    )
    config = read_config(str(tmp_path / "c.yaml"))
    assert config["collections"] == [{"name": "ap", "queries": {"title": "./t.indri"}}] and config["numThreads"] == "10"
    a, b = Batch.from_config(config, SF)
    assert a.scorers == [("dirichlet", "rm3")] and len(a.points()) == 12 and a.points()[-1] == Params(mu=1000.0, fb_docs=50, lam=0.9)
    assert b.scorers == [("tsm_linear", "")] and b.out == "./out"


def test_the_best_orders_of_model_weights(spark):
    found = B.best_model_weights(Collection(spark, SF, TOPICS), [[1.0], [0.5, 0.5]], terms=2).collect()
    assert {r["query_id"] for r in found} <= set(TOPICS) and all(sum(float(x.split(":")[1]) for x in r["weights"].split()) == pytest.approx(1) for r in found)
