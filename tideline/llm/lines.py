"""Line dedup by site-relative frequency: a line on more than a ratio of a site's pages is boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import durable, join_sized, table, text_hash
from tideline.llm.urls import split_url

#: A line goes if it stands on more than RATIO of its site's pages. LEAST: the pages from which it is repeated at all; a line of one page is no boilerplate, whatever its share of a small site.
RATIO, LEAST = 0.1, 2
#: Parts of a site's list of lines, by hash, of which a line is looked for in one.
BUCKETS = 64

# What of a page is no text, and where its lines end. What isn't closed goes on to the page's end, and a tag ends before the next one
# at least, so that each pattern reads a page once.
UNREAD = r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)"
BREAKS = r"(?i)<(?:br|hr|/?(?:p|div|li|ul|ol|h[1-6]|nav|article|section|header|footer|body|head|html|title|table|tr))\b[^<>]*>"
TAG = r"<[^<>]*>"


def html_lines(html: Column) -> Column:
    """The text of a page, line by line, without tags."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), UNREAD, " "), BREAKS, "\n"), TAG, "")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def boilerplate(rows: DataFrame, ratio: float = RATIO, least: int = LEAST, copies: bool = True) -> DataFrame:
    """(site, bad array<array<long>>) from (site, text): hashes of a site's boilerplate lines, in BUCKETS parts. Without `copies`, rows of the same text count once for a line.

    A site's pages have L different lines on average, so that fewer than L / ratio of them can stand on more than that ratio of its
    pages: the array is bounded, however large the site. Counting is a partial aggregate on (site, line).
    """
    each = F.array_distinct(F.transform(F.filter(_lines(F.col("_text")), lambda x: F.btrim(x, F.lit(" \t\r")) != ""), _hash))
    held = rows.select("_site", text_hash(F.col("_text")).alias("_t"), F.explode(each).alias("line"))
    if not copies:
        held = held.distinct()
    held = held.groupBy("_site", "line").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least)
    total = rows.groupBy("_site").agg(F.count("*").alias("total"))
    bad = held.join(total, "_site").filter(F.col("pages") > ratio * F.col("total")).groupBy("_site", F.pmod("line", F.lit(BUCKETS)).alias("_at")).agg(F.collect_list("line").alias("part"))
    by = F.map_from_entries(F.collect_list(F.struct("_at", "part")))
    parts = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.coalesce(F.try_element_at("by", k.cast("long")), F.array().cast("array<long>")))
    return bad.groupBy("_site").agg(by.alias("by")).select("_site", parts.alias("bad"))


def site_key(site: Column) -> Column:
    """Null is a site of its own; the empty string is none, and gives null."""
    return F.when(site.isNull(), "null").when(site.cast("string") != "", F.concat(F.lit("="), site.cast("string")))


def drop_boilerplate(docs: DataFrame, text: Column, site: Column, keep: tuple[str, ...], ratio: float = RATIO, least: int = LEAST, copies: bool = True) -> DataFrame:
    """(*keep, text, n_lines, n_dropped) of every row of docs: text without its site's boilerplate lines, joined by line ends again.

    A line counts once for a page, compared without white space at its ends; empty lines are never boilerplate. Null texts stay null.
    Rows of which every line goes stay, with an empty text. Repeated rows each count as a page, and rows of the same text too unless `copies` is false.
    Rows whose site is the empty string belong to none and lose nothing; null is a site. `keep` are columns of docs; others, whatever their names, are
    not looked at.
    """
    rows = docs.select(*(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)), text.alias("_text"), site_key(site).alias("_site"))
    bad = durable(boilerplate(rows.filter("_text is not null and _site is not null"), ratio, least, copies))
    rows = join_sized(rows, bad, ["_site"], size=F.length("_site") + 8 * F.size(F.flatten("bad")) + 16 * BUCKETS)
    lines = _lines(F.col("_text"))
    listed = lambda h: F.array_contains(F.element_at("bad", (F.pmod(h, F.lit(BUCKETS)) + 1).cast("int")), h)
    rows = rows.withColumn("_kept", F.when(F.col("bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~listed(_hash(x)))))
    n = F.coalesce(F.size(lines), F.lit(0))
    return rows.select(
        *(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)),
        F.when(F.col("_text").isNotNull(), F.array_join("_kept", "\n")).alias("text"),
        F.when(F.col("_text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col("_text").isNull(), 0).otherwise(n - F.size("_kept")).cast("long").alias("n_dropped"),
    )


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")  # pages without a host belong to no site
    host, _ = split_url(F.col("url"))
    out = drop_boilerplate(pages.withColumn("_host", host), html_lines(F.col("html")), F.col("_host"), ("page_id", "_host"))
    return out.select("page_id", F.col("_host").alias("host"), "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


QUERIES = {"op4_line_frequency": op4_line_frequency}

ORACLE_SQL = {
    "op4_line_frequency": f"""
WITH a AS (SELECT row_number() OVER () AS r, page_id,
  translate(regexp_extract(CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{UNREAD}', ' ', 'g'), '{BREAKS}', chr(10), 'g'), '{TAG}', '', 'g'), chr(10)) AS ls FROM pages),
b AS (SELECT r, host, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM a),
c AS (SELECT r, host, i, line, trim(line, chr(32) || chr(9) || chr(13)) AS t FROM b),
n AS (SELECT host, count(*) AS total FROM a GROUP BY host),
bad AS (SELECT host, t FROM c JOIN n USING (host) WHERE t <> '' AND host <> '' GROUP BY host, t, total HAVING count(DISTINCT r) >= {LEAST} AND count(DISTINCT r) > {RATIO}e0 * total),
d AS (SELECT r, count(*) AS n_lines, count(bad.t) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (bad.t IS NULL), '') AS text
  FROM c LEFT JOIN bad ON c.host = bad.host AND c.t = bad.t GROUP BY r)
SELECT page_id, host, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, md5(text) AS text_md5 FROM a JOIN d USING (r)"""
}
