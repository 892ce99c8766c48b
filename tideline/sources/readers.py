"""Readers of the toolkit's file formats, each with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _unescaped(text: Column) -> Column:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def topics_xml(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text, lastrel of <query><number/><text/>[<lastrel/>]</query>."""
    body = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit("(?s)<query>(.*?)</query>"), F.lit(1))).alias("q"))
    part = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("q", f"(?s)<{tag}>(.*?)</{tag}>", 1), r"\s+", " ")), F.lit(""))
    return body.select(part("number").alias("query_id"), _unescaped(part("text")).alias("text"), part("lastrel").alias("lastrel"))


def topics_json(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text, constraint, model of {"queries": [{title, text, constraint, model: [{weight, feature}]}]}."""
    model = T.ArrayType(T.StructType([T.StructField("weight", T.StringType()), T.StructField("feature", T.StringType())]))
    query = T.StructType([*(T.StructField(c, T.StringType()) for c in ("title", "text", "constraint")), T.StructField("model", model)])
    read = spark.read.schema(T.StructType([T.StructField("queries", T.ArrayType(query))])).json(path, multiLine=True)
    return read.select(F.explode("queries").alias("q")).select(F.col("q.title").alias("query_id"), "q.text", "q.constraint", "q.model")


def weighted_terms(topics: DataFrame) -> DataFrame:
    """query_id, term, qw: of '#weight( w term ... )', or of plain text, each word with weight 1 (repeats add up)."""
    pair = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s+([^\s()]+)"
    inner = F.regexp_extract("text", r"(?s)#weight\s*\((.*)\)", 1)
    weighted = F.transform(F.arrays_zip(F.regexp_extract_all(inner, F.lit(pair), F.lit(1)).alias("w"), F.regexp_extract_all(inner, F.lit(pair), F.lit(2)).alias("t")), lambda z: F.struct(z["t"].alias("term"), z["w"].cast("double").alias("qw")))
    plain = F.transform(F.filter(F.split("text", r"\s+"), lambda x: x != ""), lambda x: F.struct(x.alias("term"), F.lit(1.0).alias("qw")))
    each = topics.select("query_id", F.explode(F.when(F.col("text").startswith("#weight"), weighted).otherwise(plain)).alias("z"))
    return each.groupBy("query_id", F.col("z.term").alias("term")).agg(F.sum("z.qw").alias("qw"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="query_id string, iter string, doc_id string, rel int").select("query_id", "doc_id", "rel")


def series(spark: SparkSession, path: str) -> DataFrame:
    """term, bin, freq of lines 'term,c0,c1,...' (compressed or not); a short row reads as 0 beyond its end. Row _total_ gives the width."""
    rows = spark.read.text(path).select(F.split("value", ",").alias("v")).select(F.col("v")[0].alias("term"), F.expr("transform(slice(v, 2, size(v)), x -> cast(x as double))").alias("xs"))
    width = rows.filter("term = '_total_'").agg(F.max(F.size("xs")).alias("n"))
    return rows.crossJoin(F.broadcast(width)).select("term", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda b: F.coalesce(F.get("xs", b), F.lit(0.0)))).alias("bin", "freq"))


def trec_eval(spark: SparkSession, path: str) -> DataFrame:
    """params (the file's name), measure, query_id, value; summary rows and values that are no numbers are left out."""
    read = spark.read.csv(path, sep="\t", schema="measure string, query_id string, value string").withColumn("params", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1))
    read = read.select("params", F.trim("measure").alias("measure"), F.trim("query_id").alias("query_id"), F.expr("try_cast(value as double)").alias("value"))
    return read.filter("measure not in ('runid', 'relstring') and query_id <> 'all' and value is not null")


def loocv(spark: SparkSession, path: str) -> DataFrame:
    v = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter("trim(value) <> ''").select(v[0].alias("query_id"), v[1].alias("params"), v[2].cast("double").alias("value"))


def doc_topics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="doc_id string, topic int, p double")


def topic_terms(spark: SparkSession, path: str) -> DataFrame:
    """The probability is the fifth column."""
    return spark.read.csv(path, schema="topic int, term string, a string, b string, p double").select("topic", "term", "p")


def binned_topics(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """kind: 'doc' or 'term'; files are named <bin>-<kind>-topics.txt(.gz)."""
    schema = "doc_id string, topic int, p double" if kind == "doc" else "topic int, term string, a string, b string, p double"
    read = spark.read.csv(f"{folder}/*-{kind}-topics.txt*", schema=schema)
    return read.withColumn("bin", F.regexp_extract(F.input_file_name(), r"(\d+)-[^/]*$", 1).cast("int")).drop("a", "b")


def clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("doc_id", "cluster")


def priors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="doc_id string, prior double")


def profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="time double, p double")


def term_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="query_id string, term string")


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("term")).filter("term <> ''").distinct()


def weight_grid(spark: SparkSession, path: str, terms: int) -> DataFrame:
    """weights: sorted upwards, padded with zeros in front to the number of terms, without repeats."""
    w = F.array_sort(F.transform(F.split("value", ","), lambda x: x.cast("double")))
    pad = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(terms) - F.size(w)))
    return spark.read.text(path).filter("trim(value) <> ''").select(F.concat(pad, w).alias("weights")).distinct()


def trec_text(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, epoch, text of <DOC>...</DOC> records, in folders at any depth; paragraph marks and other tags go."""
    docs = spark.read.option("recursiveFileLookup", True).text(path, lineSep="</DOC>").filter(F.col("value").contains("<DOC>"))
    doc_id = F.trim(F.regexp_extract("value", "(?s)<DOCNO>(.*?)</DOCNO>", 1))
    epoch = F.expr("try_cast(trim(regexp_extract(value, '(?s)<EPOCH>(.*?)</EPOCH>', 1)) as long)")
    body = F.regexp_replace("value", "(?s)<DOCNO>.*?</DOCNO>|<EPOCH>.*?</EPOCH>", " ")
    clean = F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return docs.select(doc_id.alias("doc_id"), epoch.alias("epoch"), F.trim(F.regexp_replace(_unescaped(clean), r"\s+", " ")).alias("text"))


def html_text(html: Column) -> tuple[Column, Column]:
    """Title and visible text of a page."""
    html = F.coalesce(html, F.lit(""))
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " "), "<[^>]*>", " ")
    return _unescaped(title), F.trim(F.regexp_replace(_unescaped(body), r"\s+", " "))


def blog_feed(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, epoch, title, text of blog records: DATE_XML gives the time, the header is passed over, the rest is a page."""
    docs = spark.read.text(path, lineSep="</DOC>").filter(F.col("value").contains("<DOC>"))
    when = F.regexp_extract("value", r"<DATE_XML>\s*([0-9T:-]{19})", 1)
    title, text = html_text(F.regexp_replace("value", "(?s)^.*?</DOCHDR>", ""))
    return docs.select(
        F.trim(F.regexp_extract("value", "(?s)<DOCNO>(.*?)</DOCNO>", 1)).alias("doc_id"),
        F.unix_timestamp(F.try_to_timestamp(F.nullif(when, F.lit("")), F.lit("yyyy-MM-dd'T'HH:mm:ss"))).alias("epoch"),
        title.alias("title"),
        text.alias("text"),
    )


def within(docs: DataFrame, lang: str | None = "en", start: int | None = None, end: int | None = None) -> DataFrame:
    """Documents of one language (lang) and of a span of time (epoch), both ends in it; those without an epoch go if a span is given."""
    if lang is not None:
        docs = docs.filter(F.col("lang") == lang)
    if start is not None or end is not None:
        docs = docs.filter(F.col("epoch").between(start if start is not None else -(1 << 62), end if end is not None else 1 << 62))
    return docs


def day(text: Column) -> Column:
    """Seconds of a date such as 950131, at midnight UTC; years from 70 on are of the last century; null where it is none."""
    full = F.concat(F.when(F.substring(text, 1, 2) >= "70", "19").otherwise("20"), text)
    return F.unix_timestamp(F.try_to_timestamp(full, F.lit("yyyyMMdd")))


def long_lines(text: Column, words: int = 15) -> Column:
    """The lines of more than so many words."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: F.size(F.split(x, " ")) > words), "\n")
