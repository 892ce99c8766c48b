"""URL filters: host and path rules, then a Bloom filter cascade over listed domains, in DataFrame functions only."""

from __future__ import annotations

from math import ceil, log, log2, sqrt
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import ascii_lower, durable, join_sized, table

# Fixed values: (verdict, host, path); the longest rule that fits wins.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: The query's list of domains, one a line: a listed domain stands for its subdomains too.
DOMAINS = (Path(__file__).parent / "listed_domains.txt").read_text().split()
#: Bytes of the first level of a part of the cascade; a longer list is kept in more parts, by hash of the key.
PART_BYTES = 1 << 20


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where there is no "://"."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


class Cascade:
    """Levels of Bloom filters; odd ones encode listed keys, even ones keys that are not listed but pass all levels before.

    The filters are a durable table with a row for each part (keys are dealt by hash) and a column of 64-bit words for each level, so
    that they may outgrow the driver. A key asks the row of its part: it is sent everywhere while the whole table, as measured, is small, else
    rows meet their part by a shuffle on its number. The answer is the cascade's either way.
    """

    def __init__(self, parts: int) -> None:
        self.parts = parts
        self.levels: list[tuple[int, int]] = []  # bits of a part, hashes
        self.filters: DataFrame | None = None  # _part, l0, l1, ...

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.parts)).cast("int")

    def places(self, key: Column, level: int) -> list[Column]:
        bits, k = self.levels[level]
        return [F.pmod(F.xxhash64(key, F.lit(level * 64 + j)), F.lit(bits).cast("long")) for j in range(k)]

    def passes(self, key: Column, level: int) -> Column:
        """Asked beside the filters' columns."""
        found = F.lit(True)
        for at in self.places(key, level):
            word = F.coalesce(F.get(F.col(f"l{level}"), F.floor(at / 64).cast("int")), F.lit(0).cast("long"))
            found = found & (F.call_function("shiftright", word, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) != 0)
        return found

    def contains(self, key: Column) -> Column:
        """Exact for the keys of the universe: the first level that a key fails tells which kind it is of."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self.passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out

    def beside(self, rows: DataFrame, key: str) -> DataFrame:
        """rows with the filters of their key's part."""
        if self.filters is None:
            return rows
        bytes_ = sum((8 * F.size(f"l{k}") for k in range(len(self.levels))), F.lit(16))
        return join_sized(rows.withColumn("_part", self.part(F.col(key))), self.filters, ["_part"], size=bytes_).drop("_part")

    def add(self, keys: DataFrame, bits: int, k: int) -> None:
        """One more level, of the given keys. A word is set by a partial aggregate; words of a part become one array."""
        level = len(self.levels)
        self.levels.append((bits, k))
        at = keys.select(self.part(F.col("key")).alias("_part"), F.explode(F.array(*self.places(F.col("key"), level))).alias("at"))
        words = at.groupBy("_part", F.floor(F.col("at") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("b"))
        by = words.groupBy("_part").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("by"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(ceil(bits / 64) - 1)), lambda w: F.coalesce(F.try_element_at("by", w), F.lit(0).cast("long")))
        made = by.select("_part", dense.alias(f"l{level}"))
        parts = self.filters if self.filters is not None else keys.sparkSession.range(self.parts).select(F.col("id").cast("int").alias("_part"))
        none = F.array_repeat(F.lit(0).cast("long"), ceil(bits / 64))
        self.filters = durable(parts.join(made, "_part", "left").withColumn(f"l{level}", F.coalesce(f"l{level}", none)))


def build_cascade(universe: DataFrame, part_bytes: int = PART_BYTES) -> Cascade:
    """From durable (key, listed) rows with distinct keys. Only counts reach the driver.

    A level's false positives are a fraction of the keys before; building ends when there are none. Without listed keys there are
    no levels, and nothing is contained.
    """
    n_listed, n_all = universe.agg(F.count_if("listed"), F.count("*")).first()
    encode, other, n, n_other = universe.filter("listed"), universe.filter("not listed"), n_listed, n_all - n_listed
    rate = min(0.5, max(1e-9, n / max(n_other, 1) * sqrt(0.5)))
    out = Cascade(max(1, ceil(n * log2(1 / rate) / log(2) / 8 / part_bytes)))
    while n:
        bits = max(64, ceil(n / out.parts * log2(1 / rate) / log(2)))
        out.add(encode, bits, max(1, round(log2(1 / rate))))
        level = len(out.levels) - 1
        encode, other = durable(out.beside(other, "key").filter(out.passes(F.col("key"), level)).select("key")), encode.select("key")
        n, rate = encode.count(), 0.5
    return out


def under(host: Column) -> Column:
    """A host and all domains above it."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n - k + 1), "."))


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each row of pages: id, host, path, rule, listed, verdict.

    listed: (domain), the list; a host is listed if it or a domain above it is. The distinct hosts of all pages are the
    cascade's universe, and are held against the list once, when it is built. A url that no rule fits is blocked if the cascade says that its
    host is listed. Null urls and urls without "://" have empty host and path and are allowed. Repeated rows each get a row; repeated, null
    and empty domains of the list do nothing; an empty list blocks nothing. Other columns are not looked at.
    """
    host, path = split_url(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select("_id", host.alias("host"), path.alias("path"))
    hosts = rows.select("host").distinct()
    domains = durable(listed.select(ascii_lower(F.col("domain")).alias("_domain")).filter("_domain <> ''").distinct())
    found = join_sized(hosts.select("host", F.explode(under(F.col("host"))).alias("_domain")), domains, ["_domain"], "left_semi").select("host").distinct()
    universe = durable(hosts.join(found.withColumn("listed", F.lit(True)), "host", "left").select(F.col("host").alias("key"), F.coalesce("listed", F.lit(False)).alias("listed")))
    cascade = build_cascade(universe, part_bytes)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = cascade.beside(rows, "host").withColumn("listed", cascade.contains(F.col("host")))
    return out.select(F.col("_id").alias(id_col), "host", "path", name.alias("rule"), "listed", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def domain_table(spark: SparkSession, domains: list[str] = DOMAINS) -> DataFrame:
    return spark.sql("SELECT explode(array({})) AS domain".format(", ".join(f"'{d}'" for d in domains)))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), domain_table(spark)).drop("listed")


QUERIES = {"op6_url_filter": op6_url_filter}
_CASES = sorted(RULES, key=lambda r: -len(r[1] + r[2]))


def _case(value: int | str) -> str:
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if value == 'rule' else w}'" for w, h, p in _CASES) + " END"


ORACLE_SQL = {
    "op6_url_filter": f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
l(domain) AS (VALUES {", ".join(f"('{d}')" for d in DOMAINS)}),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b)
SELECT page_id, host, path, {_case("rule")} AS rule, coalesce({_case("verdict")}, CASE WHEN EXISTS (SELECT 1 FROM l WHERE c.host = l.domain OR ends_with(c.host, '.' || l.domain)) THEN 'block' ELSE 'allow' END) AS verdict FROM c"""
}
