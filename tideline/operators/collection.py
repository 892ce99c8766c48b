"""A timestamped collection: documents, a stored index, statistics, retrieval, and the matrix that scorers read."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import series as S
from tideline.functions.text import counts, tokens
from tideline.session import exists, shared_folder, table

START, INTERVAL, BINS = 1704067200, 86400, 30
TOPICS = {
    "T1": ["thble", "thtion"], "T2": ["thing", "attion"], "T3": ["erble", "ertion", "ering"], "T4": ["thanea", "eriner"],
    "T5": ["oning", "antion"], "T6": ["ontion", "retion"], "T7": ["thanedble", "onble", "reing"], "T8": ["thing", "erble", "thtion"],
}
NUM_RESULTS = 1000
#: Parts of the stored index, by a checksum of the term; a part has a file of each task that wrote postings.
PARTS = 32
#: How much of the counts by document a task turns into postings.
SPLIT_BYTES = 32 << 20
#: Rows of a page of postings and of statistics of terms: the least that is read for a term.
PAGE_ROWS = 1000
#: The most bytes of a table that is sent to every executor.
BROADCAST_BYTES = 32 << 20


def bin_of(epoch: Column, start: int = START, interval: int = INTERVAL) -> Column:
    """Quotient cut towards zero: what lies less than an interval before the start is in bin 0."""
    return ((epoch - F.lit(start)) / F.lit(interval)).cast("long")


def few(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """df, to be sent to every executor if so many rows, which are known before anything is computed, are small enough."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def either(conditions: list[Column]) -> Column:
    """Any of the conditions, as a balanced tree: a chain of some hundreds is too deep for the planner."""
    half = len(conditions) // 2
    return either(conditions[:half]) | either(conditions[half:]) if half else conditions[0]


@dataclass(frozen=True)
class Params:
    """Parameters of scorers and of query expansion; those that a scorer doesn't read have no effect."""

    mu: float = 2500.0
    lam: float = 0.5
    alpha: float = 0.5
    beta: float = 0.5
    gamma: float = 1000.0
    rate: float = 0.1
    lag: int = 2
    k: int = 1000
    fb_docs: int = 50
    fb_terms: int = 20

    #: What a scorer's expression may read.
    COLUMNS = ("mu", "lam", "alpha", "beta", "gamma", "rate")

    def label(self, names: tuple[str, ...], sign: str = "=") -> str:
        return ",".join(f"{n}{sign}{getattr(self, n):g}" for n in names)


# --- the stored index ---------------------------------------------------------------


def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, epoch, bin, len, toks of the documents within the bins."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    threads = spark.sparkContext.defaultParallelism
    if d.rdd.getNumPartitions() < min(threads, 32):  # a table of a few files: spread before it is tokenised
        d = d.repartition(threads)
    d = d.select("doc_id", tokens(F.col("text")).alias("toks"))
    epoch = F.lit(START) + (F.col("doc_id") * 7919 * 3600) % (BINS * INTERVAL)
    return d.withColumn("epoch", epoch.cast("long")).withColumn("bin", bin_of(F.col("epoch")).cast("int")).withColumn("len", F.size("toks").cast("double")).filter(F.col("bin").between(0, BINS - 1))


def part_of(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(PARTS)).cast("int")


def write_index(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """docs, counts by document, postings by term, statistics of terms and of the whole as Parquet, the last two kinds in parts that a term names.

    Texts are tokenised once, and counted where they are. Postings aren't shuffled: each task writes its documents' as files of its own in
    every part, sorted by term, from pieces of SPLIT_BYTES of the counts. The last table written tells that the index is whole.
    """
    toks, ids = tokenised(spark, sf_dir), table(spark, sf_dir, "documents").groupBy("doc_id").count()
    once = ids.filter("count > 1").isEmpty()
    if not once:  # rows of one id and length are one document
        toks.select("doc_id", "epoch", "bin", "len").write.mode("overwrite").parquet(f"{folder}/docs")
        toks = toks.groupBy("doc_id", "epoch", "bin", "len").agg(F.flatten(F.collect_list("toks")).alias("toks"))
    counted = toks.select("doc_id", "epoch", "bin", "len", counts(F.col("toks")).alias("counts"))
    counted.write.mode("overwrite").option("parquet.block.size", SPLIT_BYTES).parquet(f"{folder}/by_doc")
    by_doc = spark.read.parquet(f"{folder}/by_doc")
    if once:
        by_doc.select("doc_id", "epoch", "bin", "len").write.mode("overwrite").parquet(f"{folder}/docs")
    postings = by_doc.select("doc_id", "bin", "epoch", "len", F.inline("counts")).withColumn("part", part_of(F.col("term")))
    # a writer for each part at once: rows are sorted by the term's first bytes, not by whole rows inside a part
    names = {"spark.sql.files.maxPartitionBytes": str(SPLIT_BYTES), "spark.sql.maxConcurrentOutputFileWriters": str(PARTS + 1)}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        postings.sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy("part").parquet(f"{folder}/by_term")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    per = spark.read.parquet(f"{folder}/by_term").groupBy("part", "term", "bin").agg(F.sum("tf").alias("x"), F.count("*").alias("d"))
    xs, ds = (S.dense(F.collect_list(F.struct("bin", F.col(c).cast("double").alias("x"))), BINS).alias(n) for c, n in (("x", "xs"), ("d", "ds")))
    stats = per.groupBy("part", "term").agg(F.sum("x").alias("cf"), F.sum("d").cast("double").alias("df"), xs, ds)
    stats.hint("rebalance", "part").sortWithinPartitions("part", "term").write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy("part").parquet(f"{folder}/terms")
    docs = spark.read.parquet(f"{folder}/docs")
    bg = docs.groupBy("bin").agg(F.sum("len").alias("x"), F.count("*").alias("n"))
    whole = bg.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n_docs"), F.sum("x").alias("n_tokens"), S.dense(F.collect_list(F.struct("bin", "x")), BINS).alias("bg"))
    whole.coalesce(1).write.mode("overwrite").parquet(f"{folder}/whole")


_WRITTEN: dict[tuple[str, str], str] = {}


def index_folder(spark: SparkSession, sf_dir: str) -> str:
    """The index of a session's tables, in its shared folder; written when it is first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        folder = f"{shared_folder(spark)}/tideline-index-{key[0]}-{crc32(sf_dir.encode()):08x}"
        write_index(spark, sf_dir, folder)
        _WRITTEN[key] = folder
    return _WRITTEN[key]


@dataclass
class Collection:
    """Plans over the index of documents(doc_id, text). Only the index is computed before a result is asked for.

    index: the folder of an index written before by write_index(); else the session's own. What is persisted is bounded by the topics
    (at most NUM_RESULTS documents each, and the weights of their terms).
    """

    spark: SparkSession
    sf_dir: str
    topics: dict[str, list[str]] = field(default_factory=lambda: TOPICS)
    mu: float = 2500.0
    index: str | None = None

    @cached_property
    def folder(self) -> str:
        if self.index is not None:
            if not exists(self.spark, f"{self.index}/whole/_SUCCESS"):
                write_index(self.spark, self.sf_dir, self.index)
            return self.index
        return index_folder(self.spark, self.sf_dir)

    @property
    def n_terms(self) -> int:
        return sum(map(len, self.topics.values()))

    @property
    def n_hits(self) -> int:
        """At most."""
        return len(self.topics) * NUM_RESULTS

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def stored(self, name: str, df: DataFrame) -> DataFrame:
        """df, written beside the index when it is first asked for."""
        if not exists(self.spark, f"{self.folder}/{name}/_SUCCESS"):
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self._read(name)

    @cached_property
    def tokenised(self) -> DataFrame:
        return tokenised(self.spark, self.sf_dir)

    @cached_property
    def docs(self) -> DataFrame:
        """doc_id, epoch, bin, len"""
        return self._read("docs")

    @cached_property
    def postings(self) -> DataFrame:
        """doc_id, bin, epoch, len, term, tf: the whole index, by term"""
        return self._read("by_term").drop("part")

    @cached_property
    def query_terms(self) -> DataFrame:
        rows = ", ".join("('{}', '{}', 1D)".format(q.replace("'", "\\'"), t.replace("'", "\\'")) for q, ts in self.topics.items() for t in ts)
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(query_id, term, qw)")

    @cached_property
    def whole(self) -> DataFrame:
        """n_docs, n_tokens, bg (tokens of each bin): one row"""
        return self._read("whole")

    @cached_property
    def totals(self) -> DataFrame:
        return self.whole.select("n_docs", "n_tokens")

    @cached_property
    def background(self) -> DataFrame:
        return self.whole.select("bg")

    def _of_topics(self, name: str) -> DataFrame:
        """Rows of the topics' terms: their parts, and in these their pages, are known to the plan."""
        terms = sorted({t for ts in self.topics.values() for t in ts})
        parts = sorted({crc32(t.encode()) % PARTS for t in terms})
        # of a list Parquet reads all pages between the least and the greatest value; of alternatives only theirs
        return self._read(name).filter(F.col("part").isin(parts) & F.col("term").isin(terms) & either([F.col("term") == t for t in terms])).drop("part")

    def occurrences(self, terms: DataFrame | None = None) -> DataFrame:
        """doc_id, bin, epoch, len, term, tf; only of the topics' terms, if these are given, or of other given terms, which are few"""
        if terms is None:
            return self.postings
        if terms is self.query_terms:
            return self._of_topics("by_term")
        return self.postings.join(few(terms.select("term").distinct(), 1000 * len(self.topics)), "term", "left_semi")

    def term_stats(self, terms: DataFrame | None = None) -> DataFrame:
        """term, cf, df, xs (tokens by bin), cp and the totals"""
        if terms is self.query_terms:
            found = self._of_topics("terms")
        else:
            found = self._read("terms").drop("part")
            if terms is not None:
                found = found.join(few(terms.select("term").distinct(), 1000 * len(self.topics)), "term", "left_semi")
        out = found.select("term", "cf", "df", "xs")
        return out.crossJoin(F.broadcast(self.totals)).withColumn("cp", (1 + F.col("cf")) / F.col("n_tokens"))

    @cached_property
    def hits(self) -> DataFrame:
        """query_id, doc_id, bin, epoch, len, ql, rank: the best NUM_RESULTS documents with a topic term, by Dirichlet query likelihood"""
        qt = few(self.query_terms, self.n_terms)
        found = self.occurrences(self.query_terms).join(qt.select("query_id", "term"), "term")
        found = found.groupBy("query_id", "doc_id", "bin", "epoch", "len").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("tfs"))
        stats = few(self.term_stats(self.query_terms).select("term", "cp"), self.n_terms)
        pairs = found.join(qt.join(stats, "term"), "query_id")
        tf = F.coalesce(F.try_element_at("tfs", F.col("term")), F.lit(0.0))
        pairs = pairs.withColumn("s", F.col("qw") * F.ln((tf + self.mu * F.col("cp")) / (F.col("len") + self.mu)))
        scored = pairs.groupBy("query_id", "doc_id", "bin", "epoch", "len").agg(F.sum("s").alias("ql"))
        return ranked(scored, "ql").filter(F.col("rank") <= NUM_RESULTS).persist()

    @cached_property
    def hit_tokens(self) -> DataFrame:
        """query_id, doc_id, bin, epoch, len, ql, rank, e, term, tf: the whole vectors of the hits; e: exp(ql) over the query's highest"""
        top = self.hits.withColumn("e", F.exp(F.col("ql") - F.max("ql").over(Window.partitionBy("query_id"))))
        top = few(top.select("query_id", "doc_id", "ql", "rank", "e"), self.n_hits)
        each = self._read("by_doc").join(top, "doc_id")
        return each.select("query_id", "doc_id", "bin", "epoch", "len", "ql", "rank", "e", F.inline("counts")).persist()

    def matrix(self, weights: DataFrame | None = None) -> DataFrame:
        """A row for each hit and term of weights([point,] query_id, term, qw): tf, cp, cf, df, xs, ts and total of the hit's bin, qlen

        Weights are computed once. Of the hits' vectors only the weights' terms are moved.
        """
        w = self.query_terms if weights is None else weights.persist()
        point = [c for c in ("point",) if c in w.columns]
        stats = self.term_stats(w)
        w = w.withColumn("qlen", F.sum("qw").over(Window.partitionBy(*point, "query_id")))
        wanted = few(w.select("query_id", "term").distinct(), 1000 * len(self.topics))
        tf = self.hit_tokens.join(wanted, ["query_id", "term"], "left_semi").select("query_id", "doc_id", "term", "tf")
        pairs = self.hits.join(w.join(stats, "term"), "query_id").join(tf, ["query_id", "doc_id", "term"], "left")
        pairs = pairs.crossJoin(F.broadcast(self.background))
        return pairs.withColumns({"tf": F.coalesce("tf", F.lit(0.0)), "ts": F.get("xs", F.col("bin")), "total": F.get("bg", F.col("bin"))}).withColumn("tp", F.col("ts") / F.col("total"))


def ranked(scored: DataFrame, score: str = "score", key: str = "doc_id", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Ranks by the rounded score, then by id: copies tie exactly."""
    order = Window.partitionBy(*by).orderBy(F.round(score, 6).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order).cast("long"))
