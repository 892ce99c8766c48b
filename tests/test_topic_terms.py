"""What a topic's terms cost: postings are sorted by term alone, and only the pages of the topics' terms are read."""

import re

from pyspark.sql import functions as F

from tideline.operators.collection import PARTS, Collection, part_of

TERMS = [f"w{i:04d}" for i in range(2000)]


def _collection(spark, tmp_path):
    rows = [(i, " ".join(TERMS)) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return Collection(spark, str(tmp_path), {"A": TERMS[:6], "B": TERMS[-6:]}, index=str(tmp_path / "index"))


def test_postings_are_sorted_by_term_in_every_file(spark, tmp_path):
    c = _collection(spark, tmp_path)
    c.folder  # noqa: B018
    plans = spark._jsparkSession.sharedState().statusStore().executionsList()
    plan = next(p for p in (plans.apply(i).physicalPlanDescription() for i in reversed(range(plans.size()))) if f"{tmp_path}/index/by_term, false, [part" in p)
    assert re.findall(r"Arguments: \[(\w+)#\d+L? ASC", plan) == ["term"]
    read = c._read("by_term").select("part", "term", "doc_id", F.input_file_name().alias("f"))
    files = {}
    for r in read.collect():
        files.setdefault(r["f"], []).append((r["term"], r["doc_id"]))
    assert sum(map(len, files.values())) == 200 * len(TERMS) and all(rows == sorted(rows) for rows in files.values())
    assert read.filter(F.col("part") != part_of(F.col("term"))).isEmpty() and read.select("part").distinct().count() == PARTS
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_only_pages_of_the_topics_terms_are_read(spark, tmp_path):
    c = _collection(spark, tmp_path)
    df = c.occurrences(c.query_terms)
    assert len(df.collect()) == 200 * 12
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    read = scan.metrics().get("numOutputRows").get().value()
    parts = [r[0] for r in spark.createDataFrame([(t,) for t in TERMS[:6] + TERMS[-6:]], "t string").select(part_of(F.col("t"))).distinct().collect()]
    assert read < c._read("by_term").filter(F.col("part").isin(parts)).count() / 2


def test_only_pages_of_the_topics_statistics_are_read(spark, tmp_path):
    words = [f"w{i:06d}" for i in range(128_000)]
    spark.createDataFrame([(i, " ".join(words)) for i in range(2)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = Collection(spark, str(tmp_path), {"A": words[:2], "B": words[-2:]}, index=str(tmp_path / "index"))
    df = c._of_topics("terms")
    assert {r["term"]: r["cf"] for r in df.collect()} == dict.fromkeys([*words[:2], *words[-2:]], 2)
    read = df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()
    parts = [r[0] for r in spark.createDataFrame([(t,) for t in [*words[:2], *words[-2:]]], "t string").select(part_of(F.col("t"))).distinct().collect()]
    assert read < c._read("terms").filter(F.col("part").isin(parts)).count() * 3 / 4


def test_a_batch_may_have_many_topics(spark, tmp_path):
    c = _collection(spark, tmp_path)
    many = Collection(spark, str(tmp_path), {f"T{i}": TERMS[i : i + 3] for i in range(0, 1500, 3)}, index=c.folder)
    assert many.occurrences(many.query_terms).count() == 200 * 1500
