"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import durable, table

# The patterns of the base kinds and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = r"(?i:passw|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
LEAST = {"assign": 12, "access": 18}
#: A run that may be a credential of no known form, if it has a digit and letters of both cases.
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "opaque"]
#: A value that as many owners, or as many repositories of whatever owners, hold is a widely copied example. A value of a single owner in fewer
#: repositories that doesn't read like a placeholder is live-looking.
WIDE_OWNERS, WIDE_REPOS = 3, 10
#: What placeholders hold, and how many different characters a random value has at least.
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|change_?me|your_?|xxxx|test_?key|0123456|1234567|abcdef"
LEAST_DISTINCT = 8


def random_looking(secret: Column) -> Column:
    """Enough different characters, a digit, a letter and no placeholder."""
    return (F.size(F.array_distinct(F.split(secret, ""))) >= LEAST_DISTINCT) & secret.rlike("[0-9]") & secret.rlike("[A-Za-z]") & ~secret.rlike(PLACEHOLDER)


def _found(text: Column, kind: int, pattern: str, maybe: Column, secret, good) -> Column:
    """array<struct(kind, gap, len, hash, random)>: all matches in order; gap: code points since the last one; hash null: it fails."""

    def item(gap: Column, m: Column) -> Column:
        return F.when(
            m.isNotNull(),
            F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.length(m).alias("len"), F.when(good(m), F.sha2(secret(m), 256)).alias("hash"), random_looking(secret(m)).alias("random")),
        )

    found = F.filter(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), item), lambda x: x.isNotNull())
    return F.when(maybe, found).otherwise(F.array().cast("array<struct<kind:int,gap:int,len:int,hash:string,random:boolean>>"))


def candidates(text: Column) -> Column:
    """All matches of all kinds in one array."""
    return F.concat(
        _found(text, 0, ASSIGN, text.rlike(ASSIGN_WORDS), lambda m: F.regexp_extract(m, ASSIGN, 2), lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST["assign"]),
        _found(text, 1, ACCESS, text.contains("AKIA"), lambda m: m, lambda m: F.length(m) >= LEAST["access"]),
        _found(text, 2, HEX, text.rlike(HEX), lambda m: m, lambda m: F.lit(True)),
        _found(text, 3, OPAQUE, text.rlike("[0-9]") & text.rlike(OPAQUE), lambda m: m, lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", wide_owners: int = WIDE_OWNERS, wide_repos: int = WIDE_REPOS) -> DataFrame:
    """One row for each row of docs: id, spans (array of struct start, kind, end, owners, repos, name, verdict) and the counts wide and live.

    Candidates are hashed and their hashes counted over the whole corpus by distinct repositories and owners. verdict: "copied" if
    `wide_owners` owners or `wide_repos` repositories or more hold the value; else "live" if one owner holds it and it looks random; else
    "unclear". Spans of the base kinds always stand; an opaque run is a span only if it is live. wide, live: spans of the
    row by verdict; owners, repos: the most that a span of the row has, 0 without spans.

    Null texts count as empty and have no spans; null owners and null repositories count as one each. Repeated rows each get a
    row. Positions are code points. Other columns of docs are not looked at.
    """
    kind = "array<string>"
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("_id"),
        F.col(owner_col).cast("string").alias("_owner"),
        F.col(repo_col).cast("string").alias("_repo"),
        candidates(F.coalesce(F.col(text_col), F.lit(""))).alias("_found"),
    )
    rows = durable(rows)  # without texts; the regular expressions run once
    each = rows.filter(F.size("_found") > 0).select("_row", "_owner", "_repo", F.posexplode("_found").alias("_at", "_m"))
    before = Window.partitionBy("_row", "_m.kind").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("_end", F.sum(F.col("_m.gap") + F.col("_m.len")).over(before)).filter(F.col("_m.hash").isNotNull())
    each = each.select("_row", "_owner", "_repo", F.col("_m.kind").alias("kind"), (F.col("_end") - F.col("_m.len")).alias("start"), F.col("_end").alias("end"), F.col("_m.hash").alias("hash"), F.col("_m.random").alias("random"))
    held = each.select("hash", "_owner", "_repo").distinct().groupBy("hash", "_owner").agg(F.count("*").alias("repos"))
    held = held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    wide = (F.col("owners") >= wide_owners) | (F.col("repos") >= wide_repos)
    verdict = F.when(wide, "copied").when((F.col("owners") == 1) & F.col("random"), "live").otherwise("unclear")
    spans = each.join(held, "hash", "left").withColumn("verdict", verdict).filter((F.col("kind") < 3) | (F.col("verdict") == "live"))
    named = F.element_at(F.lit(KINDS).cast(kind), F.col("kind") + 1)
    spans = spans.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repos", named.alias("name"), "verdict"))).alias("spans"),
    )
    out = rows.select("_row", "_id").join(spans, "_row", "left")
    empty = F.array().cast(spans.schema["spans"].dataType)
    out = out.select(F.col("_id").alias(id_col), F.coalesce("spans", empty).alias("spans"))
    return out.withColumns(
        {
            "wide": F.size(F.filter("spans", lambda s: s.verdict == "copied")),
            "live": F.size(F.filter("spans", lambda s: s.verdict == "live")),
            "owners": F.coalesce(F.array_max(F.transform("spans", lambda s: s.owners)), F.lit(0)).cast("long"),
            "repos": F.coalesce(F.array_max(F.transform("spans", lambda s: s.repos)), F.lit(0)).cast("long"),
        }
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.filter("spans", lambda s: s.kind < 3)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.col("wide").cast("long").alias("n_widely_copied"),
        F.col("live").cast("long").alias("n_owner_specific"),
        F.col("owners").alias("most_owners"),
        F.col("repos").alias("most_repositories"),
    )


def _sql_kind(kind: int, pattern: str, secret: str, good: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT r, doc_id, source, {kind} AS kind, i, length(gaps[i]) AS gap, length(ms[i]) AS len, ms[i] AS m, {secret.replace("$p", quoted)} AS secret, {good.replace("$p", quoted)} AS good,
      len(list_distinct(string_split({secret.replace("$p", quoted)}, ''))) >= {LEAST_DISTINCT} AND regexp_matches({secret.replace("$p", quoted)}, '[0-9]') AND regexp_matches({secret.replace("$p", quoted)}, '[A-Za-z]') AND NOT regexp_matches({secret.replace("$p", quoted)}, '{PLACEHOLDER}') AS random
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT r, doc_id, source, regexp_extract_all(text, '{quoted}') AS ms, regexp_split_to_array(text, '{quoted}') AS gaps FROM docs))"""


ORACLE_SQL = {
    "op1_secret_scan": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
found AS ({
        " UNION ALL ".join(
            (
                _sql_kind(0, ASSIGN, "regexp_extract(ms[i], '$p', 2)", "length(regexp_extract(ms[i], '$p', 2)) >= 12"),
                _sql_kind(1, ACCESS, "ms[i]", "length(ms[i]) >= 18"),
                _sql_kind(2, HEX, "ms[i]", "true"),
                _sql_kind(3, OPAQUE, "ms[i]", "regexp_matches(ms[i], '[0-9]') AND regexp_matches(ms[i], '[a-z]') AND regexp_matches(ms[i], '[A-Z]')"),
            )
        )
    }),
placed AS (SELECT *, CAST(sum(gap + len) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS stop FROM found),
held AS (SELECT secret, count(DISTINCT source) + CAST(bool_or(source IS NULL) AS INT) AS owners, count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS INT) AS repos FROM placed WHERE good GROUP BY secret),
judged AS (SELECT *, CASE WHEN owners >= {WIDE_OWNERS} OR repos >= {WIDE_REPOS} THEN 'copied' WHEN owners = 1 AND random THEN 'live' ELSE 'unclear' END AS verdict FROM placed JOIN held USING (secret) WHERE good),
spans AS (SELECT r, kind, stop - len AS start, owners, repos, verdict,
  ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || (stop - len) || ':' || stop AS span
  FROM judged WHERE kind < 3 OR verdict = 'live'),
per AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
  string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans,
  count(*) FILTER (verdict = 'copied') AS wide, count(*) FILTER (verdict = 'live') AS live, max(owners) AS owners, max(repos) AS repos FROM spans GROUP BY r)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  CAST(coalesce(wide, 0) AS BIGINT) AS n_widely_copied, CAST(coalesce(live, 0) AS BIGINT) AS n_owner_specific,
  CAST(coalesce(owners, 0) AS BIGINT) AS most_owners, CAST(coalesce(repos, 0) AS BIGINT) AS most_repositories
FROM docs LEFT JOIN per USING (r)"""
}
QUERIES = {"op1_secret_scan": op1_secret_scan}
