"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import WORD, durable, join_sized, table

# The weights that sources take in turn, the share of all words that is wanted, and the most copies of a document.
WEIGHTS = [5.0, 2.0, 1.0]
SHARE = 1.5
MOST = 2
#: Rank intervals of a source that are summed; the one with the cut is divided as often again, LEVELS times in all, before its rows are looked at.
INTERVALS, LEVELS = 1 << 10, 2


def capped_shares(df: DataFrame, group: list[str], total: Column, weight: str, cap: str, out: str) -> DataFrame:
    """df with `out`: of `total`, what each row of a group gets in proportion to `weight` without any getting more than `cap`; the excess goes round by weight.

    Rows are filled in the order of cap over weight; the first that is not full gives the common rate, and none after it is full.
    """
    order = Window.partitionBy(*group).orderBy(F.expr(f"`{cap}` / `{weight}`"), F.col("_key"))
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = df.withColumn("_rate", (total - F.coalesce(F.sum(cap).over(past), F.lit(0.0))) / F.sum(weight).over(rest))
    df = df.withColumn("_full", F.expr(f"_rate * `{weight}` >= `{cap}`"))
    df = df.withColumn("_last", F.max(F.when(~F.col("_full"), F.col("_rate"))).over(Window.partitionBy(*group)))
    return df.withColumn(out, F.when(F.col("_last").isNull(), F.col(cap)).otherwise(F.least(F.col(cap), F.col("_last") * F.col(weight)))).drop("_rate", "_full", "_last")


def targets(sources: DataFrame, weights: list[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(src, words) -> with target. One row for each source: a catalogue, ordered as a whole to deal the weights out."""
    ranked = sources.withColumn("_key", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())))
    ranked = ranked.withColumn("_w", F.element_at(F.lit(weights), ((F.col("_key") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_all", share * F.sum("words").over(Window.partitionBy())).withColumn("_cap", F.col("words") * float(most))
    return capped_shares(ranked, [], F.col("_all"), "_w", "_cap", "target").select("src", "words", "target")


def class_of(size: Column) -> Column:
    """The number of binary digits of a size."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def uniform(id_: Column, seed: int) -> Column:
    """A number in (0, 1) made from 48 bits of the MD5 of seed and id: reruns agree."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 48))


class Mix:
    """What a mix takes of each row: small tables by source and size class, fitted on all rows."""

    def __init__(self, rows: DataFrame, weights: list[float] = WEIGHTS, share: float = SHARE, seed: int = 17) -> None:
        """rows: durable rows made by sized()."""
        self.seed = seed
        classes = rows.groupBy("_src", "_class").agg(F.sum("_size").alias("_words"))
        self.sources = durable(targets(classes.groupBy(F.col("_src").alias("src")).agg(F.sum("_words").alias("words")), weights, share))
        named = self.sources.select(F.col("src").alias("_s"), "target")
        parts = classes.filter("_words > 0").join(named, F.col("_src").eqNullSafe(F.col("_s"))).drop("_s")
        parts = parts.withColumn("_x", (1 + F.col("_class") / 8.0) * F.col("_words")).withColumn("_cap", F.col("_words") * float(MOST)).withColumn("_key", F.col("_class"))
        parts = capped_shares(parts, ["_src"], F.col("target"), "_x", "_cap", "_share").withColumn("_copies", F.round(F.col("_share") / F.col("_words"), 12))
        parts = parts.withColumn("_whole", F.floor("_copies").cast("int")).withColumn("_p", F.col("_copies") - F.floor("_copies"))
        parts = parts.withColumn("_want", F.sum(F.col("_p") * F.col("_words")).over(Window.partitionBy("_src")))
        self.plan = durable(parts.select(F.col("_src").alias("src"), F.col("_class").alias("cls"), "_whole", "_p", "_want"))
        ranked = self._ranked(rows).filter("_rank is not null")
        cut = None
        for level in range(1, LEVELS + 1):
            wide = F.floor(F.col("_place") / float(INTERVALS ** (LEVELS - level))).cast("int")
            inside = ranked.withColumn("before", F.lit(0.0)) if cut is None else self._at(ranked, cut).filter(F.floor(wide / float(INTERVALS)) == F.col("cut"))
            sums = inside.groupBy("_src", wide.alias("_wide"), "_want", "before").agg(F.sum("_size").alias("_in"))
            sums = sums.withColumn("_before", F.col("before") + F.sum("_in").over(Window.partitionBy("_src").orderBy("_wide")) - F.col("_in"))
            found = sums.filter("_before < _want and _before + _in >= _want").groupBy(F.col("_src").alias("src")).agg(F.min_by(F.struct(F.col("_wide").alias("cut"), F.col("_before").alias("before")), "_wide").alias("_c"))
            cut = durable(found.select("src", "_c.*"))
        edge = self._at(ranked, cut).filter("_place = cut")  # a source's rows within one of its smallest intervals of ranks
        mine = Window.partitionBy("_src").orderBy("_rank", "_id", "_size", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edge = edge.withColumn("_mid", F.col("before") + F.sum("_size").over(mine) - F.col("_size") / 2.0)
        last = edge.filter("_mid <= _want").groupBy(F.col("_src").alias("_s")).agg(F.max(F.struct("_rank", "_id", "_size", "_row")).alias("_to"))
        self.ends = durable(cut.join(last, F.col("src").eqNullSafe(F.col("_s")), "left").drop("_s", "before"))

    @staticmethod
    def _at(left: DataFrame, right: DataFrame, *more: Column) -> DataFrame:
        """right has a row for each source and class, or for each source."""
        named = right.select(F.struct(F.col("src"), *more).alias("_on"), *(c for c in right.columns if c not in ("src", "cls")))
        on = F.struct(F.col("_src").alias("src"), *(F.col("_class").alias("cls") for _ in more))
        return join_sized(left.withColumn("_on", on), named, ["_on"]).drop("_on")

    def _ranked(self, rows: DataFrame) -> DataFrame:
        u = uniform(F.col("_id"), self.seed)
        rank = (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))
        rows = self._at(rows, self.plan, F.col("cls"))
        rows = rows.withColumn("_rank", F.when((F.col("_p") > 0) & (F.col("_size") > 0), rank))
        return rows.withColumn("_place", F.floor(F.col("_rank") / (1 + F.col("_rank")) * INTERVALS**LEVELS).cast("int"))

    def copies(self, rows: DataFrame) -> DataFrame:
        """rows, made by sized(), with words (of the source), target and copies. The tables are small, so rows aren't moved."""
        rows = self._at(self._at(self._ranked(rows), self.ends), self.sources)
        to = F.coalesce(F.struct("_rank", "_id", "_size", "_row") <= F.col("_to"), F.lit(False))
        extra = F.col("_rank").isNotNull() & (F.col("cut").isNull() | (F.col("_place") < F.col("cut")) | ((F.col("_place") == F.col("cut")) & to))
        return rows.withColumn("copies", (F.coalesce("_whole", F.lit(0)) + F.when(extra, 1).otherwise(0)).cast("int"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *keep: Column) -> DataFrame:
    """_row (a hash of id, source and text, the same in every scan), _id, _src, _size and _class of every row, and what else is to be kept."""
    size = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), size.alias("_size"), *keep)
    return rows.withColumn("_class", class_of(F.col("_size")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: list[float] = WEIGHTS, share: float = SHARE, seed: int = 17) -> DataFrame:
    """One row for each row of docs: id, size, source_size, target, copies (0 to 2), taken = copies * size.

    Longer documents have higher inclusion odds: within a source a document's expected copies are 2 or in proportion to 1 + an eighth of the
    binary digits of its size, such that expected words meet the target. Whole expected copies are certain. For the
    fraction p that is left, documents are ranked by random odds u/(1-u) over inclusion odds p/(1-p), and taken in that order until
    the source's words are those wanted; the one at the cut is taken if its middle lies within.

    Null texts have size 0; null is a source of its own, the last. Repeated rows each count; equal ranks go by id, size and a hash of the row, so
    reruns agree; whole copies of a row, id included, are taken alike. A source without words has target 0. Other columns of docs are not looked at. Empty tables give an empty result.
    """
    rows = durable(sized(docs, id_col, text_col, source_col))  # no texts from here
    found = Mix(rows, weights, share, seed).copies(rows)
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("words").cast("long").alias("source_size"),
        F.round("target", 6).alias("target"),
        "copies",
        (F.col("copies") * F.col("_size")).cast("long").alias("taken"),
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


QUERIES = {"op3_mix_sources": op3_mix_sources}

_CAPPED = """
{name}_r AS (SELECT *, ({total} - coalesce(sum(cap) OVER (PARTITION BY {by} ORDER BY cap / wt, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
  / sum(wt) OVER (PARTITION BY {by} ORDER BY cap / wt, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM {name}),
{name}_s AS (SELECT *, max(CASE WHEN NOT (rate * wt >= cap) THEN rate END) OVER (PARTITION BY {by}) AS low FROM {name}_r),
{name}_t AS (SELECT *, CASE WHEN low IS NULL THEN cap ELSE least(cap, low * wt) END AS got FROM {name}_s)"""

ORACLE_SQL = {
    "op3_mix_sources": f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
e AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS cls, row_number() OVER () AS r,
  (CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) + 0.5e0) / {float(1 << 48)!r} AS u FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM e GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k, {SHARE}e0 * sum(words) OVER () AS everything, {MOST}e0 * words AS cap FROM s0),
s AS (SELECT *, [5e0, 2e0, 1e0][(k - 1) % 3 + 1] AS wt FROM s1),
{_CAPPED.format(name="s", total="everything", by="1")},
c AS (SELECT e.source, cls, CAST(sum(size) AS BIGINT) AS cw, any_value(got) AS target, (1 + cls / 8e0) * sum(size) AS wt, 2e0 * sum(size) AS cap, cls AS k
  FROM e JOIN s_t ON e.source IS NOT DISTINCT FROM s_t.source GROUP BY e.source, cls HAVING sum(size) > 0),
{_CAPPED.format(name="c", total="target", by="source")},
p AS (SELECT source, cls, cw, round(got / cw, 12) AS copies FROM c_t),
q AS (SELECT *, floor(copies) AS whole, copies - floor(copies) AS p, sum((copies - floor(copies)) * cw) OVER (PARTITION BY source) AS want FROM p),
r AS (SELECT e.*, whole, p, want, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank
  FROM e LEFT JOIN q ON e.source IS NOT DISTINCT FROM q.source AND e.cls = q.cls),
t AS (SELECT *, sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2e0 AS mid FROM r)
SELECT t.doc_id, t.size, s_t.words AS source_size, round(s_t.got, 6) AS target,
  CAST((coalesce(whole, 0) + CASE WHEN rank IS NOT NULL AND mid <= want THEN 1 ELSE 0 END) * t.size AS BIGINT) AS taken
FROM t JOIN s_t ON t.source IS NOT DISTINCT FROM s_t.source"""
}
