"""Writers of the toolkit's file formats. Every writer is one Spark write: parts of a folder, safe to repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_lines(run: DataFrame, run_id: str, limit: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """'query Q0 doc rank score run' lines; ids of under two letters, and lines with two spaces together, are left out."""
    run = run.filter(F.col("rank") <= limit) if limit else run
    line = F.concat_ws(" ", "query_id", F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), F.col("score").cast("string"), F.lit(run_id))
    return run.filter(F.length(F.col("doc_id").cast("string")) >= 2).select(*keep, "query_id", line.alias("value")).filter(~F.col("value").contains("  "))


def write_run(run: DataFrame, path: str, run_id: str, limit: int | None = None, mode: str = "ignore") -> None:
    """Nothing is written where the output is there already (mode 'ignore'): a batch can be taken up again."""
    run_lines(run, run_id, limit).sortWithinPartitions("query_id").select("value").write.mode(mode).text(path)


def indri_queries(weights: DataFrame) -> DataFrame:
    """query_id, value: '<query>' elements with #weight; weights that are no numbers are left out."""
    w = weights.filter("qw is not null and not isnan(qw)")
    pair = F.concat_ws(" ", F.format_number("qw", 5), "term")
    one = w.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("qw")).alias("k"), "term", F.replace(pair, F.lit(","), F.lit("")).alias("s")))).alias("x"))
    text = F.concat(F.lit("#weight( "), F.array_join(F.transform("x", lambda z: z["s"]), " "), F.lit(" )"))
    return one.select("query_id", F.concat(F.lit("<query>\n<number>"), "query_id", F.lit("</number>\n<text>"), text, F.lit("</text>\n</query>")).alias("value"))


def write_queries(weights: DataFrame, path: str) -> None:
    """Queries as they were after expansion, a JSON object each: query_id and its terms with their weights, the heaviest first."""
    one = weights.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("qw")).alias("k"), "term", "qw"))).alias("x"))
    one.select("query_id", F.transform("x", lambda z: F.struct(z["term"].alias("term"), z["qw"].alias("weight"))).alias("terms")).write.mode("overwrite").json(path)


def series_lines(series: DataFrame) -> DataFrame:
    """'term,c0,c1,...' of (term, bin, freq)."""
    per = series.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("bin", "freq"))).alias("x"))
    return per.select(F.concat_ws(",", "term", F.array_join(F.transform("x", lambda z: z["freq"].cast("string")), ",")).alias("value"))


def write_series(series: DataFrame, path: str) -> None:
    series_lines(series).write.mode("overwrite").option("compression", "gzip").text(path)


def predictor_table(long: DataFrame) -> DataFrame:
    """(query_id, predictor, value) -> one column for each predictor, in the order of names."""
    names = sorted(r[0] for r in long.select("predictor").distinct().collect())
    return long.groupBy("query_id").pivot("predictor", names).agg(F.first("value"))


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header)


def topic_input(docs: DataFrame, tokens: Column) -> DataFrame:
    """'doc,tokens' lines for topic models."""
    return docs.select(F.concat_ws(",", F.col("doc_id").cast("string"), F.array_join(tokens, " ")).alias("value"))


def write_partitioned(df: DataFrame, path: str, by: str, text: Column) -> None:
    """One folder for each bin or part."""
    df.select(F.col(by), text.alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def write_split(topics: DataFrame, qrels: DataFrame, folder: str) -> None:
    """Topics at even places of the order of ids, with their judgements, under train, those at odd places under test: CSV files of each."""
    for part, own in zip(("train", "test"), split_by_position(topics, "query_id"), strict=True):
        write_csv(own, f"{folder}/{part}/topics")
        write_csv(qrels.join(own.select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.lit(0).alias("iter"), "doc_id", "rel"), f"{folder}/{part}/qrels", " ", False)


def split_by_position(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows at even and at odd positions of the distinct keys."""
    place = df.select(key).distinct().withColumn("_at", F.row_number().over(Window.orderBy(key)) - 1)  # of topics: a short list
    both = df.join(place, key)
    return both.filter("_at % 2 = 0").drop("_at"), both.filter("_at % 2 = 1").drop("_at")
