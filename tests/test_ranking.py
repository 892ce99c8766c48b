"""Hand-checked statistics, and invariants of the ranking plans; the SQL oracles cover the rest."""

import math

import pytest
from pyspark.sql import functions as F

from tideline.functions import series as S
from tideline.functions.text import markup_tokens
from tideline.operators import feedback as FB
from tideline.operators import scorers as SC
from tideline.operators.collection import Collection, Params
from tideline.plans import evaluation as E
from tideline.plans import registry
from tideline.streaming.series import streaming_bins

SF = "/root/testdata/sf0.001"


def value(spark, expr, **arrays):
    df = spark.range(1).select(*(F.array(*map(F.lit, map(float, v))).alias(k) for k, v in arrays.items()))
    return df.select(expr.alias("x")).first()[0]


def test_series_by_hand(spark):
    a = F.col("a")
    one = {"a": [1, 2, 3, 4, 5]}
    assert value(spark, S.acf(a, 1), **one) == pytest.approx(0.4)
    assert value(spark, S.acf(a, 2), **one) == pytest.approx(-0.1)
    assert value(spark, S.pacf2(a), **one) == pytest.approx(-0.309524, abs=1e-6)
    assert value(spark, S.sma(a, 3), a=[3, 6, 9, 12]) == [0, 0, 6, 9]
    assert value(spark, S.centred_average(a, 2), a=[1, 2, 3]) == pytest.approx([4 / 3, 3, 11 / 3])
    assert value(spark, S.kl(a, F.col("b")), a=[0.5, 0.5, 0], b=[0.25, 0.25, 0.5]) == pytest.approx(math.log(2))
    assert value(spark, S.entropy(a), a=[0.5, 0.5]) == pytest.approx(math.log(2))
    assert value(spark, S.ccf(a, F.col("b")), a=[1, 2, 3], b=[2, 4, 6]) == pytest.approx(1)
    wave = [math.cos(2 * math.pi * t / 5) for t in range(20)]
    assert value(spark, S.period(a, S.spectrum(a)), a=wave) == pytest.approx(5)
    assert value(spark, S.peak(S.spectrum(a)), a=wave) == pytest.approx(10)
    assert value(spark, S.mutual_information(a, 1, 2), a=[0, 1] * 10) == pytest.approx(0.69, abs=0.01)


def test_distributions_and_scales(spark):
    row = spark.range(1).select(F.expr(FB.pexp("2e0", "0.5e0")), F.expr(FB.pexp("-1e0", "0.5e0")), F.expr(FB.pnorm("1.96e0")), F.expr(FB.pnorm("-1e0"))).first()
    assert row[0] == pytest.approx(1 - math.exp(-1)) and row[1] == 0 and row[2] == pytest.approx(0.975, abs=1e-4) and row[3] == pytest.approx(0.158655, abs=1e-5)
    w = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 3.0), ("q", "c", 2.0), ("r", "a", 4.0)], "query_id string, term string, qw double")
    assert {(r["query_id"], r["term"]): r["qw"] for r in FB.spread(w, "qw").collect()} == {("q", "a"): 0.0, ("q", "b"): 1.0, ("q", "c"): 0.5, ("r", "a"): 0.0}
    assert [r["qw"] for r in FB.spread(w, "qw", 0, 4).filter("query_id = 'r'").collect()] == [1.0]


def test_tokens_of_marked_up_text(spark):
    df = spark.createDataFrame([("A <b x='1'>Bold</b> word-1",)], "t string")
    assert df.select(markup_tokens(F.col("t"))).first()[0] == ["a", "bold", "word", "1"]


def test_measures_by_hand(spark):
    run = spark.createDataFrame([("q", i, i) for i in range(1, 11)], "query_id string, doc_id long, rank long")
    rel = spark.createDataFrame([("q", 1, 1), ("q", 3, 1)], "query_id string, doc_id long, rel int")
    m = E.measures(E.judged(run, rel)).first()
    assert m["map"] == pytest.approx(0.833333, abs=1e-6) and m["p_5"] == pytest.approx(0.4) and m["p_legacy"] == pytest.approx(2 / 11)
    judged = E.judged(run, rel)
    assert [r["value"] for name in ("map", "p_5", "none") for r in E.metric(judged, name).collect()] == [m["map"], m["p_5"], m["map"]]
    two = E.measures(E.judged(run.filter("rank <= 2"), spark.createDataFrame([("q", 2, 1)], rel.schema))).first()
    assert two["ndcg"] == pytest.approx(math.log(2) / math.log(3))
    grid = spark.createDataFrame([("a", "1", 0.2), ("a", "2", 0.4), ("b", "1", 0.3), ("b", "2", 0.1)], "params string, query_id string, value double")
    assert {tuple(r) for r in E.leave_one_out(grid).collect()} == {("1", "a", 0.2), ("2", "b", 0.1)}


def test_weights_and_ranks(spark):
    c = Collection(spark, SF)
    for name in ("rm1", "rm3", "trm"):
        for total, n in FB.expanded(c, name).groupBy("query_id").agg(F.sum("qw"), F.count("*")).select("sum(qw)", "count(1)").collect():
            assert total == pytest.approx(1) and n <= Params.fb_terms + 3
    r = SC.rank_with(c, "dirichlet").groupBy("query_id").agg(F.max("rank").alias("m"), F.countDistinct("rank").alias("d"), F.count("*").alias("n")).collect()
    assert all(x["m"] == x["d"] == x["n"] for x in r)


def test_names_and_oracles():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert len(registry.ORACLE_SQL) > 150


def test_streaming(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 01:00:00", "A b"), ("2024-01-01 05:00:00", "a"), ("2024-01-03 00:00:00", "c")], "t string, text string").selectExpr("cast(t as timestamp) ts", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = streaming_bins(stream).writeStream.outputMode("complete").format("memory").queryName("bins").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["term"], r["n"]) for r in spark.sql("select * from bins").collect()} == {("a", 2), ("b", 1), ("c", 1)}
