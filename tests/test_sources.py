"""Readers and writers on small files."""

from pyspark.sql import functions as F

from tideline.functions.text import Stemmer, stemmed_tokens, stemmer
from tideline.sources import readers, writers


def test_topics_and_weights(spark, tmp_path):
    (tmp_path / "t.indri").write_text("<parameters>\n<query>\n<number>51</number>\n<text>\n#weight( 0.5 alpha 1.5e-1 beta )</text>\n</query><query><number>52</number><text>one two &amp; two</text><lastrel>7</lastrel></query></parameters>")
    t = readers.topics_xml(spark, str(tmp_path / "t.indri"))
    assert {(r["query_id"], r["lastrel"]) for r in t.collect()} == {("51", None), ("52", "7")}
    assert {tuple(r) for r in readers.weighted_terms(t).collect()} == {("51", "alpha", 0.5), ("51", "beta", 0.15), ("52", "one", 1.0), ("52", "two", 2.0), ("52", "&", 1.0)}
    (tmp_path / "t.json").write_text('{"queries": [\n{"title": "1", "text": "a b", "constraint": "c", "model": [{"weight": "1", "feature": "a"}]}]}')
    assert readers.topics_json(spark, str(tmp_path / "t.json")).first()["model"][0]["feature"] == "a"


def test_tables(spark, tmp_path):
    (tmp_path / "q").write_text("1 0 d1 2\n1 0 d2 0\n")
    assert readers.qrels(spark, str(tmp_path / "q")).filter("rel > 0").first()["doc_id"] == "d1"
    (tmp_path / "s.csv").write_text("a,1,2\n_total_,1,2,3\n")
    assert {tuple(r) for r in readers.series(spark, str(tmp_path / "s.csv")).filter("term = 'a'").collect()} == {("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 0.0)}
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "mu=5").write_text("map\t1\t0.5\nmap\tall\t0.4\nrunid\t1\tx\nP_5\t1\tbad\n")
    assert [tuple(r) for r in readers.trec_eval(spark, str(tmp_path / "e")).collect()] == [("mu=5", "map", "1", 0.5)]
    (tmp_path / "l").write_text("1   mu=5\t0.5\n")
    assert tuple(readers.loocv(spark, str(tmp_path / "l")).first()) == ("1", "mu=5", 0.5)
    (tmp_path / "w").write_text("0.5,0.1\n0.1,0.5\n")
    assert [r[0] for r in readers.weight_grid(spark, str(tmp_path / "w"), 3).collect()] == [[0.0, 0.1, 0.5]]
    (tmp_path / "tt").write_text("3,word,x,y,0.25\n")
    assert tuple(readers.topic_terms(spark, str(tmp_path / "tt")).first()) == (3, "word", 0.25)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "7-doc-topics.txt").write_text("d1,3,0.5\n")
    assert readers.binned_topics(spark, str(tmp_path / "b"), "doc").first()["bin"] == 7
    (tmp_path / "stop").write_text("the\n\nthe\n")
    assert readers.stop_words(spark, str(tmp_path / "stop")).count() == 1


def test_documents(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "d").write_text("<DOC><DOCNO> A-1 </DOCNO><EPOCH>12</EPOCH>\n<P>one &amp; two</P></DOC>\n<DOC><DOCNO>A-2</DOCNO><TEXT>x</TEXT></DOC>\n")
    assert {tuple(r) for r in readers.trec_text(spark, str(tmp_path)).collect()} == {("A-1", 12, "one & two"), ("A-2", None, "x")}
    (tmp_path / "blog").write_text("<DOC><DOCNO>B</DOCNO><DATE_XML>2006-02-01T00:00:10+0000</DATE_XML><DOCHDR>skip</DOCHDR><html><title>T</title><script>no</script><p>body</p></html></DOC>")
    r = readers.blog_feed(spark, str(tmp_path / "blog")).first()
    assert (r["doc_id"], r["epoch"], r["title"], r["text"]) == ("B", 1138752010, "T", "T body")


def test_writers(spark, tmp_path):
    run = spark.createDataFrame([("1", "d12", 1, 0.5), ("1", "x", 2, 0.4), ("1", "d 3  z", 3, 0.1)], "query_id string, doc_id string, rank int, score double")
    writers.write_run(run, str(tmp_path / "run"), "me")
    assert [r[0] for r in spark.read.text(str(tmp_path / "run")).collect()] == ["1 Q0 d12 1 0.5 me"]
    w = spark.createDataFrame([("1", "a", 0.25), ("1", "b", 0.5), ("1", "c", float("nan"))], "query_id string, term string, qw double")
    assert "#weight( 0.50000 b 0.25000 a )" in writers.indri_queries(w).first()["value"]
    s = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("_total_", 0, 1.0), ("_total_", 1, 2.0)], "term string, bin int, freq double")
    writers.write_series(s, str(tmp_path / "ser"))
    assert readers.series(spark, str(tmp_path / "ser")).filter("term = 'a'").agg(F.sum("freq")).first()[0] == 3.0
    p = spark.createDataFrame([("1", "z", 1.0), ("1", "a", 2.0)], "query_id string, predictor string, value double")
    assert writers.predictor_table(p).columns == ["query_id", "a", "z"]
    even, odd = writers.split_by_position(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), "k")
    assert (even.count(), odd.count()) == (2, 1)


def test_stems(spark):
    plain = Stemmer()
    assert [plain.stem(w) for w in ("ponies", "running", "classes", "is", "jumped", "x1", "glasses", "bus")] == ["pony", "run", "class", "is", "jump", "x1", "glass", "bus"]
    known = Stemmer({"active", "activity", "happy", "create", "nation", "national", "care", "walk", "magnet", "differ", "different", "employ"}, {"geese": "goose"})
    words = {"happiness": "happy", "creation": "create", "nationality": "national", "nations": "nation", "caring": "care", "walker": "walk", "magnetic": "magnet", "difference": "different", "employment": "employ", "activity": "activity", "geese": "goose", "thingness": "thingness"}
    assert {w: known.stem(w) for w in words} == words
    docs = spark.createDataFrame([(1, "The walkers walked"), (2, None)], "doc_id int, text string")
    out = stemmed_tokens(docs, stemmer(spark, {"walk"}), ["the"]).collect()
    assert {r["doc_id"]: r["toks"] for r in out} == {1: ["walk", "walk"], 2: []}


def test_filters_of_language_and_time(spark):
    docs = spark.createDataFrame([(1, "en", 5), (2, "fr", 5), (3, "en", None), (4, "en", 9)], "doc_id int, lang string, epoch long")
    assert {r["doc_id"] for r in readers.within(docs, "en", 5, 8).collect()} == {1}
    assert {r["doc_id"] for r in readers.within(docs).collect()} == {1, 3, 4}
    assert spark.createDataFrame([("950131",), ("x",)], "d string").select(readers.day(F.col("d"))).collect()[0][0] == 791510400
