"""Readers and writers as queries: each writes what the tables hold in a format of the toolkit, reads it back and returns the rows.

Files go to the session's shared folder. The SQL is of the tables, not of the files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import feedback as FB
from tideline.operators import scorers as SC
from tideline.operators.collection import START, Collection
from tideline.plans import duck, evaluation
from tideline.plans import ranking as R
from tideline.session import shared_folder, table
from tideline.sources import readers, writers

QUERIES, ORACLE_SQL = {}, {}


def _through(name: str, write: Callable[[SparkSession, str, str], None], read: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        folder = f"{shared_folder(spark)}/tideline-{name}-{uuid.uuid4().hex}"
        write(spark, sf, folder)
        return read(spark, folder)

    QUERIES[name], ORACLE_SQL[name] = query, sql


def _text(df: DataFrame, folder: str, column: str = "value", gzip: bool = False) -> None:
    df.select(column).write.option("compression", "gzip" if gzip else "none").text(folder)


_RANKED = f"WITH {duck.HITS}, {duck.matrix()}, {R.scored_sql('m', R.DIRICHLET)}, run AS ({duck.ranking('f')})"
_through(
    "format_run",
    lambda spark, sf, folder: writers.write_run(SC.rank_with(Collection(spark, sf), "dirichlet"), folder, "tide", 10),
    lambda spark, folder: spark.read.csv(folder, sep=" ", schema="query_id string, q0 string, doc_id long, rank long, score double, run string").drop("q0"),
    f"{_RANKED} SELECT query_id, doc_id, rank, score, 'tide' AS run FROM run WHERE rank <= 10 AND doc_id >= 10",
)
_through(
    "format_series",
    lambda spark, sf, folder: writers.write_series(_series(Collection(spark, sf)), folder),
    readers.series,
    f"""WITH {duck.BASE}, {duck.dense_terms("qt", "d")} SELECT term, CAST(t AS INTEGER) AS bin, x AS freq FROM d UNION ALL SELECT '_total_', bin, total FROM tot""",
)


def _series(c: Collection) -> DataFrame:
    """term, bin, freq of the topics' terms and of all."""
    terms = c.term_stats(c.query_terms).select("term", F.posexplode("xs").alias("bin", "freq"))
    return terms.unionByName(c.background.select(F.lit("_total_").alias("term"), F.posexplode("bg").alias("bin", "freq")))


_through(
    "format_queries",
    lambda spark, sf, folder: _text(writers.indri_queries(FB.expanded(Collection(spark, sf), "rm3")), folder),
    lambda spark, folder: readers.weighted_terms(readers.topics_xml(spark, folder)).select("query_id", "term", F.round("qw", 4).alias("weight")),
    f"WITH {duck.HITS}, {R.RM}, {R.EXPANSION_SQL['rm3']} SELECT query_id, term, round(round(qw, 5), 4) AS weight FROM wz",
)
_through(
    "format_queries_json",
    lambda spark, sf, folder: writers.write_queries(FB.expanded(Collection(spark, sf), "rm1"), folder),
    lambda spark, folder: spark.read.schema("query_id string, terms array<struct<term: string, weight: double>>").json(folder).select("query_id", F.explode("terms").alias("x")).select("query_id", "x.term", F.round("x.weight", 6).alias("weight")),
    f"WITH {duck.HITS}, {R.RM} SELECT query_id, term, round(rm, 6) AS weight FROM rm1",
)
_through(
    "format_judgements",
    lambda spark, sf, folder: evaluation.qrels(Collection(spark, sf)).select("query_id", F.lit(0), "doc_id", "rel").write.csv(folder, sep=" "),
    lambda spark, folder: readers.qrels(spark, folder).select("query_id", F.col("doc_id").cast("long").alias("doc_id"), "rel"),
    f"WITH {duck.BASE}, {evaluation._REL} SELECT query_id, doc_id, CAST(rel AS INTEGER) AS rel FROM qrels",
)
_through(
    "format_split",
    lambda spark, sf, folder: writers.write_split((c := Collection(spark, sf)).query_terms.select("query_id", "term"), evaluation.qrels(c), folder),
    lambda spark, folder: readers.qrels(spark, f"{folder}/test/qrels").select("query_id", F.col("doc_id").cast("long").alias("doc_id"), "rel"),
    f"WITH {duck.BASE}, {evaluation._REL}, o AS (SELECT query_id, row_number() OVER (ORDER BY query_id) AS k FROM (SELECT DISTINCT query_id FROM qt)) SELECT query_id, doc_id, CAST(rel AS INTEGER) AS rel FROM qrels JOIN o USING (query_id) WHERE k % 2 = 0",
)
_through(
    "format_measures",
    lambda spark, sf, folder: _text(_measures(Collection(spark, sf)), folder),
    lambda spark, folder: readers.trec_eval(spark, folder).select("measure", "query_id", "value"),
    f"WITH {duck.HITS}, {evaluation._REL}, {evaluation.RUNS['dirichlet'][1]}, {evaluation._measures_sql('run', 'query_id')} SELECT k AS measure, query_id, v AS value FROM (UNPIVOT (SELECT query_id, {evaluation._ROUNDED} FROM ev) ON {', '.join(evaluation.MEASURES)} INTO NAME k VALUE v)",
)


def _measures(c: Collection) -> DataFrame:
    """Lines of an evaluation, with those that a reader passes over."""
    m = evaluation.run_measures(c, SC.rank_with(c, "dirichlet"))
    pairs = F.explode(F.array(*(F.struct(F.lit(x).alias("k"), F.round(x, 6).alias("v")) for x in evaluation.MEASURES)))
    lines = m.select("query_id", pairs.alias("p")).select(F.concat_ws("\t", "p.k", "query_id", F.col("p.v").cast("string")).alias("value"))
    return lines.unionByName(c.spark.createDataFrame([("runid\tall\ttide",), ("map\tall\t0.5",), ("relstring\tT1\t0101",)], "value string"))


_through(
    "format_predictors",
    lambda spark, sf, folder: writers.write_csv(writers.predictor_table(_predictors(Collection(spark, sf))), folder),
    lambda spark, folder: spark.read.csv(folder, header=True, schema="query_id string, avg_idf double, max_ictf double, scs double"),
    f"WITH p AS ({evaluation.ORACLE_SQL['qpp_pre']}) SELECT query_id, avg_idf, max_ictf, scs FROM p",
)


def _predictors(c: Collection) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(x).alias("predictor"), F.col(x).alias("value")) for x in ("scs", "avg_idf", "max_ictf"))))
    return evaluation.pre_retrieval(c).select("query_id", pairs.alias("p")).select("query_id", "p.*")


_through(
    "format_trec_text",
    lambda spark, sf, folder: _text(_records(spark, sf), folder),
    lambda spark, folder: readers.trec_text(spark, folder).select(F.col("doc_id").cast("long").alias("doc_id"), "epoch", F.md5("text").alias("text_md5")),
    f"""SELECT doc_id, {START} + doc_id AS epoch, md5(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9.,&<>]', ' ', 'g'), ' +', ' ', 'g'))) AS text_md5 FROM documents""",
)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as records, with escaped signs and paragraph marks; a newline before the end of each."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z0-9.,&<>]", " ")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    body = F.concat(F.lit("<DOC>\n<DOCNO> "), F.col("doc_id").cast("string"), F.lit(" </DOCNO>\n<EPOCH>"), (F.lit(START) + F.col("doc_id")).cast("string"), F.lit("</EPOCH>\n<P>"), text, F.lit("</P>\n</DOC>"))
    return table(spark, sf, "documents").select(body.alias("value"))


_through(
    "format_topic_model",
    lambda spark, sf, folder: _topic_terms(spark, sf).write.option("compression", "gzip").csv(folder),
    readers.topic_terms,
    "SELECT CAST(n_nationkey AS INTEGER) AS topic, n_name AS term, (n_nationkey + 1) / 32e0 AS p FROM nation",
)


def _topic_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", "n_name", F.lit("x"), F.lit("y"), (F.col("n_nationkey") + 1) / 32)


_through(
    "format_clusters",
    lambda spark, sf, folder: table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster"), "embedding").write.parquet(folder),
    readers.clusters,
    "SELECT vec_id AS doc_id, label AS cluster FROM embeddings",
)
_through(
    "format_priors",
    lambda spark, sf, folder: R.priors(Collection(spark, sf)).write.csv(folder),
    lambda spark, folder: readers.priors(spark, folder).select(F.col("doc_id").cast("long").alias("doc_id"), F.round("prior", 9).alias("prior")),
    f"WITH {duck.BASE}, {R._PRIORS} SELECT doc_id, round(prior, 9) AS prior FROM pri",
)
_through(
    "format_profile",
    lambda spark, sf, folder: Collection(spark, sf).background.select(F.posexplode("bg").alias("b", "n")).selectExpr("cast(b as double)", "n").write.csv(folder),
    lambda spark, folder: readers.profile(spark, folder),
    f"WITH {duck.BASE} SELECT CAST(bin AS DOUBLE) AS time, total AS p FROM tot",
)
_through(
    "format_stop_words",
    lambda spark, sf, folder: _text(Collection(spark, sf).query_terms.select(F.concat(F.lit(" "), "term", F.lit(" ")).alias("value")), folder),
    readers.stop_words,
    f"WITH qt(query_id, term, qw) AS (VALUES {duck._TOPICS}) SELECT DISTINCT term FROM qt",
)
_through(
    "format_term_list",
    lambda spark, sf, folder: Collection(spark, sf).query_terms.select("query_id", "term").write.csv(folder),
    readers.term_list,
    f"WITH qt(query_id, term, qw) AS (VALUES {duck._TOPICS}) SELECT query_id, term FROM qt",
)
_through(
    "format_loocv",
    lambda spark, sf, folder: writers.write_csv(evaluation.leave_one_out(evaluation.grid(Collection(spark, sf))).select("query_id", F.col("params").cast("string"), "value"), folder, "\t", False),
    readers.loocv,
    f"SELECT query_id, CAST(params AS VARCHAR) AS params, value FROM ({evaluation.ORACLE_SQL['loocv']})",
)
_through(
    "format_bins",
    lambda spark, sf, folder: writers.write_partitioned(_binned(Collection(spark, sf)), folder, "bin", F.concat_ws(",", "doc_id", "n")),
    lambda spark, folder: spark.read.text(folder).select(F.col("bin").cast("int").alias("bin"), F.split("value", ",")[0].cast("long").alias("doc_id"), F.split("value", ",")[1].cast("long").alias("n")),
    f"WITH {duck.BASE} SELECT bin, doc_id, CAST(len AS BIGINT) AS n FROM docs",
)


def _binned(c: Collection) -> DataFrame:
    return c.docs.select("bin", "doc_id", F.col("len").cast("long").alias("n"))


_through(
    "format_topic_input",
    lambda spark, sf, folder: _text(writers.topic_input((c := Collection(spark, sf)).tokenised, F.col("toks")), folder),
    lambda spark, folder: spark.read.text(folder).select(F.split("value", ",", 2).alias("v")).select(F.col("v")[0].cast("long").alias("doc_id"), F.md5(F.col("v")[1]).alias("tokens_md5")),
    f"WITH {duck.BASE} SELECT doc_id, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM docs",
)
QUERIES["format_pages"] = lambda spark, sf: table(spark, sf, "pages").select("page_id", readers.html_text(F.col("html"))[0].alias("title"))
ORACLE_SQL["format_pages"] = """SELECT page_id, replace(replace(replace(replace(replace(replace(replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS title FROM pages"""
