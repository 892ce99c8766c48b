"""A corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Stages return the columns of documents but for the last, which returns doc_id, lang, source and the ids of the text's pieces. Null
texts, null ids, repeated rows and empty tables pass through as each stage's docstring says; columns beyond those of documents are
left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import lines, mixing, pieces, similar, toxicity
from tideline.llm.common import durable, join_sized, remove, shared_folder, table, text_hash

#: A line goes if it stands in more than LINE_RATIO of a source's documents, and in at least LINE_LEAST different texts. Sources hold far
#: more than hosts do, so that the ratio is far below that of hosts.
LINE_RATIO, LINE_LEAST = 0.001, 5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; null and empty texts have no features and get the base rate."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = toxicity.score_column(spark, model)
    return docs.select(*COLUMNS).withColumn("_score", score("text")).filter("_score < 0.5").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in more than a thousandth of a source's documents, and five different texts at least, go; every document stays.

    Copies of a whole text count once, so that they are left to the next stage. n_chars is that of the text that is left.
    """
    kept = lines.drop_boilerplate(docs, F.col("text"), F.col("source"), ("doc_id", "lang", "source", "n_chars"), LINE_RATIO, LINE_LEAST, copies=False)
    n = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", n).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays, that of the smallest doc_id (then of the smallest hash of its text).

    Texts link when they share at least 0.8 of their five-word shingles, which is verified on the whole sets. Texts without words form
    one group. Rows with the same doc_id and text count as one document: that of the smallest lang, source and n_chars stays, nulls first.
    Decisions are made on ids and hashes; texts are read again once, and are moved only if what goes is too much to be sent.
    """
    whole = F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS))
    docs = docs.select(*COLUMNS).withColumn("_key", F.struct("doc_id", text_hash(F.col("text")).alias("h"))).withColumn("_row", whole)
    found = durable(similar.near_duplicates(docs, id_col="_key"))
    gone = found.filter("not (_key <=> component_id)").select("_key").distinct()
    ids = durable(docs.select("_key", "_row", "lang", "source", "n_chars"))  # no texts
    rows = durable(ids.join(found.filter("_key <=> component_id").groupBy("_key").count().filter("count > 1"), "_key", "left_semi"))
    first = rows.groupBy("_key").agg(F.min(F.struct("lang", "source", "n_chars", "_row")).alias("_first"))
    others = rows.join(first, "_key").filter("_row <> _first._row").select("_row").distinct()
    kept = join_sized(docs, durable(gone), ["_key"], "left_anti", 32)
    kept = join_sized(kept, durable(others), ["_row"], "left_anti", 16)
    again = durable(rows.groupBy("_row").count().filter("count > 1").select("_row"))  # whole rows that repeat
    once, more = join_sized(kept, again, ["_row"], "left_anti", 16), join_sized(kept, again, ["_row"], "left_semi", 16)
    return once.unionByName(more.dropDuplicates(["_row"])).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as many times as the mix takes it: not at all, once or twice. Texts without words are never taken."""
    mix = mixing.Mix(durable(mixing.sized(docs, "doc_id", "text", "source")))
    rows = mixing.sized(docs, "doc_id", "text", "source", F.struct(*COLUMNS).alias("_doc"))
    taken = mix.copies(rows).filter("copies > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and ids of every document."""
    return pieces.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]
#: Language models, fingerprints and pieces have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder named in spark.checkpoint.dir, and goes when the next stage is written."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
