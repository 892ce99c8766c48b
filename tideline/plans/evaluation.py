"""Evaluation of rankings: average precision, gain, precision, cross-validation over a grid, comparison, predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import series as S
from tideline.operators import feedback as FB
from tideline.operators import scorers as SC
from tideline.operators.collection import Collection, Params, few
from tideline.plans import duck
from tideline.plans import ranking as R
from tideline.session import table

QUERIES, ORACLE_SQL = {}, {}


CUT = 20


def _gain(at: Column) -> Column:
    return (F.pow(F.lit(2.0), F.col("rel").cast("double")) - 1) / F.ln(at + 1)


def judged(run: DataFrame, qrels: DataFrame, cut: int = CUT) -> DataFrame:
    """run with rel (0 where not judged), the number of relevant documents of the query and the gain of its best `cut` judgements, whether retrieved or not."""
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id"))
    relevant = qrels.filter("rel > 0").withColumn("best", best).groupBy("query_id").agg(F.count("*").cast("double").alias("n_rel"), F.sum(F.when(F.col("best") <= cut, _gain(F.col("best")))).alias("ideal"))
    run = run.join(qrels, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    return run.join(F.broadcast(relevant), "query_id", "left").withColumns({"n_rel": F.coalesce("n_rel", F.lit(0.0)), "ideal": F.coalesce("ideal", F.lit(0.0))})


def measures(run: DataFrame, by: tuple[str, ...] = ("query_id",), cut: int = CUT) -> DataFrame:
    """map, ndcg, p_5, p_10, p_20 and p_legacy (the first 10, of 11) for each group of a judged run, of the same cut."""
    w = Window.partitionBy(*by).orderBy("rank")
    run = run.withColumn("hit", (F.col("rel") > 0).cast("double")).withColumn("prec", F.sum("hit").over(w) / F.col("rank"))
    return run.groupBy(*by).agg(
        F.coalesce(F.sum(F.col("hit") * F.col("prec")) / F.nullif(F.max("n_rel"), F.lit(0.0)), F.lit(0.0)).alias("map"),
        F.coalesce(F.sum(F.when(F.col("rank") <= cut, _gain(F.col("rank")))) / F.nullif(F.max("ideal"), F.lit(0.0)), F.lit(0.0)).alias("ndcg"),
        *((F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0.0)) / k).alias(f"p_{k}") for k in (5, 10, 20)),
        (F.sum(F.when(F.col("rank") <= 10, F.col("hit")).otherwise(0.0)) / F.when(F.count("*") >= 11, 11).otherwise(F.count("*") + 1)).alias("p_legacy"),
    )


def metric(run: DataFrame, name: str = "map") -> DataFrame:
    """query_id, value of a judged run: a measure by its name; average precision for names that are none."""
    return measures(run).select("query_id", F.col(name if name in MEASURES else "map").alias("value"))


def qrels(c: Collection) -> DataFrame:
    """query_id, doc_id, rel: quality labels of all documents that hold a term of the topic, of whatever rank."""
    terms = few(c.query_terms.select("query_id", "term"), c.n_terms)
    found = c.occurrences(c.query_terms).join(terms, "term").select("query_id", "doc_id").distinct()
    return found.join(table(c.spark, c.sf_dir, "labels").select("doc_id", F.col("quality").alias("rel")), "doc_id")


def run_measures(c: Collection, run: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    return measures(judged(run, qrels(c)), by)


_REL = """
qrels AS (SELECT DISTINCT query_id, p.doc_id, quality AS rel FROM post p JOIN qt USING (term) JOIN labels USING (doc_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS b FROM qrels WHERE rel > 0),
nrel AS (SELECT query_id, CAST(count(*) AS DOUBLE) AS n_rel, sum(CASE WHEN b <= 20 THEN (pow(2e0, rel) - 1) / ln(b + 1) END) AS ideal FROM best GROUP BY query_id)"""


def _measures_sql(run: str, by: str, name: str = "ev") -> str:
    return f"""
{name}_j AS (SELECT r.*, coalesce(q.rel, 0) AS rel, coalesce(n.n_rel, 0e0) AS n_rel, coalesce(n.ideal, 0e0) AS ideal FROM {run} r LEFT JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id LEFT JOIN nrel n ON n.query_id = r.query_id),
{name}_k AS (SELECT *, CASE WHEN rel > 0 THEN 1e0 ELSE 0e0 END AS hit, sum(CASE WHEN rel > 0 THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY {by} ORDER BY rank) / rank AS prec FROM {name}_j),
{name} AS (SELECT {by}, coalesce(sum(hit * prec) / nullif(max(n_rel), 0), 0e0) AS map,
  coalesce(sum(CASE WHEN rank <= 20 THEN (pow(2e0, rel) - 1) / ln(rank + 1) END) / nullif(max(ideal), 0), 0e0) AS ndcg,
  sum(CASE WHEN rank <= 5 THEN hit ELSE 0 END) / 5 AS p_5, sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) / 10 AS p_10, sum(CASE WHEN rank <= 20 THEN hit ELSE 0 END) / 20 AS p_20,
  sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) / CASE WHEN count(*) >= 11 THEN 11 ELSE count(*) + 1 END AS p_legacy FROM {name}_k GROUP BY {by})"""


MEASURES = ["map", "ndcg", "p_5", "p_10", "p_20", "p_legacy"]
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in MEASURES)
_rounded = lambda: [F.round(m, 6).alias(m) for m in MEASURES]


def _runs() -> dict:
    one = lambda scorer: f"{duck.matrix()}, {R.scored_sql('m', *R.SCORER_SQL[scorer])}, run AS ({duck.ranking('f')})"
    return {
        "dirichlet": (lambda c: SC.rank_with(c, "dirichlet"), one("dirichlet")),
        "tsm_linear": (lambda c: SC.rank_with(c, "tsm_linear"), one("tsm_linear")),
        "rm3": (lambda c: SC.rank_with(c, "dirichlet", FB.expanded(c, "rm3")), f"{R.RM}, {R.EXPANSION_SQL['rm3']}, {duck.matrix('wz')}, {R.scored_sql('m', R.DIRICHLET)}, run AS ({duck.ranking('f')})"),
    }


RUNS = _runs()
for _name, (_run, _sql) in RUNS.items():
    QUERIES[f"eval_{_name}"] = lambda spark, sf, r=_run: run_measures(c := Collection(spark, sf), r(c)).select("query_id", *_rounded())
    ORACLE_SQL[f"eval_{_name}"] = f"WITH {duck.HITS}, {_REL}, {_sql}, {_measures_sql('run', 'query_id')} SELECT query_id, {_ROUNDED} FROM ev"


def grid_values(c: Collection, points: list[Params], names: tuple[str, ...], expansion: str = "") -> DataFrame:
    """params ("name=value,..."), query_id, value: average precision of each point of a grid, all in one plan. expansion: "rm3", or the query alone."""
    grid = SC.grid_table(c, points)
    m = c.matrix(FB.rm3_grid(c, grid)) if expansion == "rm3" else c.matrix()
    run = SC.apply(m, SC.SCORERS["dirichlet"], grid)
    label = c.spark.createDataFrame([(i, p.label(names)) for i, p in enumerate(points)], "point int, params string")
    return run_measures(c, run, ("point", "query_id")).join(F.broadcast(label), "point").select("params", "query_id", F.round("map", 6).alias("value"))


def grid(c: Collection) -> DataFrame:
    """params, query_id, value: average precision of each mu."""
    found = grid_values(c, [Params(mu=m) for m in R.MUS], ("mu",))
    return found.select(F.replace("params", F.lit("mu=")).cast("double").alias("params"), "query_id", "value")


#: A part of the grid that query expansion is tuned over.
RM3_POINTS = [Params(fb_docs=d, fb_terms=t, lam=x) for d in (10, 50) for t in (10, 25) for x in (0.3, 0.7)]
RM3_NAMES = ("fb_docs", "fb_terms", "lam")
_RM3_GRID = f"""
pt AS (SELECT d AS fb_docs, t AS fb_terms, l AS lam, 'fb_docs=' || d || ',fb_terms=' || t || ',lam=' || l AS params FROM (SELECT unnest([10, 50]) AS d), (SELECT unnest([10, 25]) AS t), (SELECT unnest([0.3e0, 0.7e0]) AS l)),
g0 AS (SELECT d AS fb_docs, query_id, p.term, sum(tf / h.len * e) AS rm FROM hits h JOIN post p ON p.doc_id = h.doc_id JOIN (SELECT unnest([10, 50]) AS d) ON rank <= d GROUP BY ALL),
g1 AS (SELECT *, row_number() OVER (PARTITION BY fb_docs, query_id ORDER BY round(rm, 10) DESC, term) AS k FROM g0),
g2 AS (SELECT params, lam, query_id, term, rm / sum(rm) OVER (PARTITION BY params, query_id) AS rm FROM g1 JOIN pt ON pt.fb_docs = g1.fb_docs AND k <= fb_terms),
g3 AS (SELECT params, lam, query_id, term, qw / sum(qw) OVER (PARTITION BY params, query_id) AS qw FROM qt, pt),
gw AS (SELECT coalesce(a.params, b.params) AS params, coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.term, b.term) AS term, coalesce(a.lam, b.lam) * coalesce(qw, 0e0) + (1 - coalesce(a.lam, b.lam)) * coalesce(rm, 0e0) AS qw
  FROM g3 a FULL JOIN g2 b ON a.params = b.params AND a.query_id = b.query_id AND a.term = b.term),
gs AS (SELECT params, h.query_id, h.doc_id, sum(qw * ln((coalesce(p.tf, 0e0) + 2500e0 * cp) / (h.len + 2500e0))) AS score FROM hits h JOIN gw ON gw.query_id = h.query_id JOIN stats s ON s.term = gw.term LEFT JOIN post p ON p.doc_id = h.doc_id AND p.term = gw.term GROUP BY ALL),
run AS (SELECT params, query_id, doc_id, row_number() OVER (PARTITION BY params, query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM gs),
{_measures_sql("run", "params, query_id")}, grid AS (SELECT params, query_id, round(map, 6) AS value FROM ev)"""


_GRID = f"""{duck.matrix()}, {R.MU_GRID_SQL}, run AS (SELECT mu, query_id, doc_id, row_number() OVER (PARTITION BY mu, query_id ORDER BY score DESC, doc_id) AS rank FROM g),
{_measures_sql("run", "mu, query_id")}, grid AS (SELECT mu AS params, query_id, round(map, 6) AS value FROM ev)"""


def leave_one_out(values: DataFrame) -> DataFrame:
    """For each topic, the parameters of the best mean over the other topics (the lowest of equal ones), and their value on the topic."""
    rest = (F.sum("value").over(Window.partitionBy("params")) - F.col("value")) / (F.count("*").over(Window.partitionBy("params")) - 1)
    order = Window.partitionBy("query_id").orderBy(F.round("rest", 9).desc(), "params")
    return values.withColumn("rest", rest).withColumn("k", F.row_number().over(order)).filter("k = 1").select("query_id", "params", "value")


def best_params(values: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("value"), "params")
    return values.withColumn("k", F.row_number().over(order)).filter("k = 1").select("query_id", "params", "value")


QUERIES["eval_grid"] = lambda spark, sf: grid(Collection(spark, sf))
ORACLE_SQL["eval_grid"] = f"WITH {duck.HITS}, {_REL}, {_GRID} SELECT * FROM grid"
QUERIES["loocv"] = lambda spark, sf: leave_one_out(grid(Collection(spark, sf)))
ORACLE_SQL["loocv"] = f"""WITH {duck.HITS}, {_REL}, {_GRID}, r AS (SELECT a.params, a.query_id, a.value, (SELECT avg(b.value) FROM grid b WHERE b.params = a.params AND b.query_id <> a.query_id) AS rest FROM grid a)
SELECT query_id, params, value FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rest, 9) DESC, params) = 1"""
QUERIES["eval_rm3_grid"] = lambda spark, sf: grid_values(Collection(spark, sf), RM3_POINTS, RM3_NAMES, "rm3")
ORACLE_SQL["eval_rm3_grid"] = f"WITH {duck.HITS}, {_REL}, {_RM3_GRID} SELECT * FROM grid"
_LOOCV = """r AS (SELECT a.params, a.query_id, a.value, (SELECT avg(b.value) FROM grid b WHERE b.params = a.params AND b.query_id <> a.query_id) AS rest FROM grid a)
SELECT query_id, params, value FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rest, 9) DESC, params) = 1"""
QUERIES["loocv_rm3"] = lambda spark, sf: leave_one_out(grid_values(Collection(spark, sf), RM3_POINTS, RM3_NAMES, "rm3"))
ORACLE_SQL["loocv_rm3"] = f"WITH {duck.HITS}, {_REL}, {_RM3_GRID}, {_LOOCV}"
QUERIES["max_param"] = lambda spark, sf: best_params(grid(Collection(spark, sf)))
ORACLE_SQL["max_param"] = f"WITH {duck.HITS}, {_REL}, {_GRID} SELECT query_id, params, value FROM grid QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY value DESC, params) = 1"


def paired(c: Collection, a: str, b: str) -> DataFrame:
    """query_id, x, y: average precision of two runs."""
    x, y = (run_measures(c, RUNS[r][0](c)).select("query_id", F.round("map", 6).alias(k)) for r, k in ((a, "x"), (b, "y")))
    return x.join(y, "query_id")


def _paired_sql(a: str, b: str) -> str:
    one = {n: f"WITH {duck.HITS}, {_REL}, {RUNS[n][1]}, {_measures_sql('run', 'query_id')} SELECT query_id, round(map, 6) AS value FROM ev" for n in (a, b)}
    return f"x AS ({one[a]}), y AS ({one[b]}), xy AS (SELECT query_id, x.value AS x, y.value AS y FROM x JOIN y USING (query_id))"


QUERIES["win_loss"] = lambda spark, sf: paired(Collection(spark, sf), "dirichlet", "tsm_linear").agg(
    F.sum((F.col("y") > F.col("x")).cast("long")).alias("wins"),
    F.sum((F.col("y") < F.col("x")).cast("long")).alias("losses"),
    F.sum((F.abs(F.col("y") - F.col("x")) > 0.02).cast("long")).alias("far"),
    F.round(F.avg(F.greatest("x", "y")), 6).alias("mean_of_max"),
)
ORACLE_SQL["win_loss"] = f"WITH {_paired_sql('dirichlet', 'tsm_linear')} SELECT CAST(count(*) FILTER (y > x) AS BIGINT) AS wins, CAST(count(*) FILTER (y < x) AS BIGINT) AS losses, CAST(count(*) FILTER (abs(y - x) > 0.02e0) AS BIGINT) AS far, round(avg(greatest(x, y)), 6) AS mean_of_max FROM xy"
QUERIES["ttest_stat"] = lambda spark, sf: paired(Collection(spark, sf), "dirichlet", "tsm_linear").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x") - F.col("y")) / F.nullif(F.stddev_samp(F.col("x") - F.col("y")) / F.sqrt(F.count("*")), F.lit(0.0)), 4).alias("t"))
ORACLE_SQL["ttest_stat"] = f"WITH {_paired_sql('dirichlet', 'tsm_linear')} SELECT count(*) AS n, round(avg(x - y) / nullif(stddev_samp(x - y) / sqrt(count(*)), 0), 4) AS t FROM xy"

# --- predictors of query performance -------------------------------------------------------


def pre_retrieval(c: Collection) -> DataFrame:
    t = c.query_terms.join(c.term_stats(c.query_terms), "term")
    t = t.withColumn("idf", F.ln(F.col("n_docs") / F.col("df"))).withColumn("ictf", F.ln(F.col("n_tokens") / F.col("cf"))).withColumn("scq", (1 + F.ln("cf")) * F.col("idf"))
    t = t.withColumn("pwq", F.col("qw") / F.sum("qw").over(Window.partitionBy("query_id"))).withColumn("pwc", F.col("cf") / F.col("n_tokens"))
    spread = [f(x).alias(f"{n}_{x}") for x in ("idf", "ictf", "scq") for n, f in (("var", F.var_samp), ("avg", F.avg), ("min", F.min), ("max", F.max))]
    out = t.groupBy("query_id").agg(*spread, F.sum("scq").alias("sum_scq"), F.sum(F.col("pwq") * F.ln(F.col("pwq") / F.col("pwc"))).alias("scs"), F.sum(-F.col("pwc") * F.ln("pwc")).alias("qentropy"), F.count("*").alias("qlen"))
    out = out.withColumn("qent_r3", F.ln("scs"))
    return out.select("query_id", "qlen", *(F.round(x, 6).alias(x) for x in out.columns if x not in ("query_id", "qlen")))


_SPREAD = [f"{n}_{x}" for x in ("idf", "ictf", "scq") for n in ("var", "avg", "min", "max")]
_PRE = [*_SPREAD, "sum_scq", "scs", "qentropy", "qent_r3"]
QUERIES["qpp_pre"] = lambda spark, sf: pre_retrieval(Collection(spark, sf))
ORACLE_SQL["qpp_pre"] = f"""WITH {duck.BASE}, t AS (SELECT query_id, term, qw, qw / sum(qw) OVER (PARTITION BY query_id) AS pwq, cf / n_tokens AS pwc, ln(n_docs / df) AS idf, ln(n_tokens / cf) AS ictf, (1 + ln(cf)) * ln(n_docs / df) AS scq FROM qt JOIN stats USING (term)),
a AS (SELECT query_id, count(*) AS qlen, {", ".join(f"{ {'var': 'var_samp'}.get(n, n)}({x}) AS {n}_{x}" for x in ("idf", "ictf", "scq") for n in ("var", "avg", "min", "max"))}, sum(scq) AS sum_scq, sum(pwq * ln(pwq / pwc)) AS scs, sum(-pwc * ln(pwc)) AS qentropy FROM t GROUP BY query_id),
b AS (SELECT *, ln(scs) AS qent_r3 FROM a) SELECT query_id, qlen, {", ".join(f"round({x}, 6) AS {x}" for x in _PRE)} FROM b"""


def post_retrieval(c: Collection, k: int = 100) -> DataFrame:
    """clarity, entropies, divergence from the pooled hits, deviation and drift of the first k scores, perplexity of the pool."""
    rm = FB.relevance_model(c, fb_terms=50)
    stats = c.term_stats(rm).select("term", "cf", "n_tokens")
    top = c.hit_tokens.filter(F.col("rank") <= k)
    pool = top.groupBy("query_id", "term").agg(F.sum("tf").alias("tf")).withColumn("p", F.col("tf") / F.sum("tf").over(Window.partitionBy("query_id")))
    m = rm.join(stats, "term").join(pool.select("query_id", "term", "p"), ["query_id", "term"], "left")
    a = m.groupBy("query_id").agg(
        F.sum(F.col("rm") * F.ln(F.col("rm") / (F.col("cf") / F.col("n_tokens")))).alias("clarity"),
        F.sum(-F.col("rm") * F.ln("rm")).alias("qent_a"),
        F.sum(F.when((F.col("rm") > 0) & (F.col("p") > 0), F.col("rm") * F.ln(F.col("rm") / F.col("p")))).alias("qfbdiv"),
    )
    b = pool.groupBy("query_id").agg(F.exp(F.sum(F.col("p") * F.log2("p"))).alias("perplexity"))
    d = c.hits.filter(F.col("rank") <= k).groupBy("query_id").agg(F.stddev_samp("ql").alias("deviation"), F.stddev_pop("ql").alias("sdp"))
    q = c.query_terms.join(c.term_stats(c.query_terms).select("term", "cf", "n_tokens"), "term").withColumn("pwq", F.col("qw") / F.sum("qw").over(Window.partitionBy("query_id")))
    q = q.groupBy("query_id").agg(F.abs(F.sum(F.col("pwq") * F.ln(F.col("cf") / F.col("n_tokens")))).alias("base"))
    out = a.join(b, "query_id").join(d, "query_id").join(q, "query_id").withColumn("drift", F.col("sdp") / F.col("base")).withColumn("qent_r4", F.exp("clarity"))
    return out.select("query_id", *(F.round(x, 6).alias(x) for x in _POST))


_POST = ["clarity", "qent_r4", "qent_a", "qfbdiv", "perplexity", "deviation", "drift"]
QUERIES["qpp_post"] = lambda spark, sf: post_retrieval(Collection(spark, sf))
ORACLE_SQL["qpp_post"] = f"""WITH {duck.HITS}, {R.RM}, rx AS (SELECT * FROM rm_0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rm, 10) DESC, term) <= 50),
ry AS (SELECT query_id, term, rm / sum(rm) OVER (PARTITION BY query_id) AS rm FROM rx),
pl AS (SELECT query_id, p.term, sum(tf) AS tf FROM hits h JOIN post p ON p.doc_id = h.doc_id WHERE rank <= 100 GROUP BY ALL), pp AS (SELECT *, tf / sum(tf) OVER (PARTITION BY query_id) AS p FROM pl),
a AS (SELECT query_id, sum(rm * ln(rm / (cf / n_tokens))) AS clarity, sum(-rm * ln(rm)) AS qent_a, sum(CASE WHEN p > 0 THEN rm * ln(rm / p) END) AS qfbdiv FROM ry JOIN stats USING (term) LEFT JOIN pp USING (query_id, term) GROUP BY query_id),
b AS (SELECT query_id, exp(sum(p * log2(p))) AS perplexity FROM pp GROUP BY query_id), d AS (SELECT query_id, stddev_samp(ql) AS deviation, stddev_pop(ql) AS sdp FROM hits WHERE rank <= 100 GROUP BY query_id),
q AS (SELECT query_id, abs(sum(pwq * ln(cf / n_tokens))) AS base FROM (SELECT *, qw / sum(qw) OVER (PARTITION BY query_id) AS pwq FROM qt) JOIN stats USING (term) GROUP BY query_id),
z AS (SELECT *, sdp / base AS drift, exp(clarity) AS qent_r4 FROM a JOIN b USING (query_id) JOIN d USING (query_id) JOIN q USING (query_id)) SELECT query_id, {", ".join(f"round({x}, 6) AS {x}" for x in _POST)} FROM z"""

# --- statistics of series as predictors and features ----------------------------------------

_SPREADS = (("var", F.var_samp), ("avg", F.avg), ("min", F.min), ("max", F.max))
#: Names of the series predictors of a term, and of the columns below that they are of. Correlations have 1 added, so that they are positive.
_TERM_PREDICTORS = {
    "qacf": "1 + q_acf2", "cacf": "1 + c_acf2", "qccf": "1 + q_ccf", "cccf": "1 + c_ccf", "qdp": "q_dp", "qdps": "q_dps", "cdp": "c_dp", "cdps": "c_dps",
    "tkli": "q_tkli", "tklc": "q_tklc", "tkl": "q_tkl", "qent": "q_ent", "cent": "c_ent", "qami": "q_mi2", "cami": "c_mi2",
}
_QUERY_COLUMNS, _COLLECTION_COLUMNS = ("acf1", "acf2", "ccf", "dp", "dps", "tkl", "tklc", "tkli", "ent", "mi1", "mi2"), ("acf2", "sacf2", "ccf", "dp", "dps", "ent", "mi1", "mi2")


def series_table(c: Collection, terms: DataFrame) -> DataFrame:
    """query_id, term and the statistics of its query-time series (q_), smoothed, and of the collection's (c_)."""
    q = FB.with_stats(FB.query_series(c, terms, FB.SMOOTH), "q_").select("query_id", "term", *(f"q_{x}" for x in _QUERY_COLUMNS))
    s = FB.with_stats(FB.collection_series(c, terms), "c_").select("term", "cf", "df", "n_docs", "n_tokens", *(f"c_{x}" for x in _COLLECTION_COLUMNS))
    return q.join(s, "term")


def series_spread(c: Collection) -> DataFrame:
    """For each query, variance, mean, least and most of its terms' predictors."""
    each = series_table(c, c.query_terms).selectExpr("query_id", *(f"{x} AS {n}" for n, x in _TERM_PREDICTORS.items()))
    return each.groupBy("query_id").agg(*(F.round(f(x), 6).alias(f"{n}_{x}") for x in _TERM_PREDICTORS for n, f in _SPREADS))


def hit_series(c: Collection) -> DataFrame:
    """Predictors from the smoothed share of score mass by bin of a query's hits (fb_*); ccf and divergences against the collection's counts by bin, which are no shares."""
    per = FB.score_mass(c).withColumn("_s", S.sma(F.col("bg"), FB.SMOOTH)).withColumn("_t", S.total(F.col("_s")))
    per = per.select("query_id", S.normalise(F.col("_s"), F.col("_t")).alias("xs")).crossJoin(F.broadcast(c.background))
    s = FB.with_stats(per)
    of = {"fb_acf": "1 + acf2", "fb_ccf": "1 + ccf", "fb_dp": "dp", "fb_dps": "dps", "fb_tkl": "tkl_raw", "fb_tklc": "1 - exp(-tkl_raw)", "fb_tkli": "exp(-1 / tkl_raw)"}
    return s.selectExpr("query_id", *(f"{x} AS {n}" for n, x in of.items())).select("query_id", *(F.round(n, 6).alias(n) for n in of))


def _share(x: str) -> str:
    return f"coalesce({x} / nullif(sum({x}) OVER (PARTITION BY query_id), 0), 0e0)"


#: The features of a query's term, in the reference's names.
_FEATURES = {
    "rm": "rm", "rmn": _share("rm"), "idf": "idf", "nidf": _share("idf"), "qacf2": "q_acf2", "qacfs2": _share("(q_acf2 + 1)"), "cacf2": "c_acf2", "cacf2s": _share("(c_acf2 + 1)"),
    "ccfq": "q_ccf", "ccfqs": _share("(q_ccf + 1)"), "ccfc": "c_ccf", "ccfcs": _share("(c_ccf + 1)"), "rmqacf": _share("rm_q"), "rmcacf": _share("rm_c"), "tkl": "q_tkl", "tkln": _share("q_tkl"),
    "dps": "q_dps", "dpsn": _share("q_dps"), "dp": "q_dp", "dpn": _share("q_dp"), "qent": "q_ent", "qentn": _share("q_ent"), "cent": "c_ent", "centn": _share("c_ent"),
    "qami": "q_mi1", "qamin": _share("q_mi1"), "cami": "c_mi1", "camin": _share("c_mi1"),
}


def feature_table(c: Collection) -> DataFrame:
    """query_id, term and 28 features. Unlike in the reference, qent is the raw entropy and dpn sums to 1."""
    rm = FB.relevance_model(c, fb_terms=None)
    t = series_table(c, c.query_terms).join(rm, ["query_id", "term"], "left").withColumn("rm", F.coalesce("rm", F.lit(0.0))).withColumn("idf", F.ln(1 + F.col("n_docs") / F.col("df")))
    t = t.withColumn("rm_q", F.col("rm") * F.expr(_share("(q_acf2 + 1)"))).withColumn("rm_c", F.col("rm") * F.expr(_share("(c_acf2 + 1)")))
    t = t.select("query_id", "term", *(F.expr(x).alias(n) for n, x in _FEATURES.items()))
    return t.select("query_id", "term", *(F.round(n, 6).alias(n) for n in _FEATURES))


#: The features of an expansion term.
_RM_FEATURES = {
    "rmn": "rm", "dpn": _share("q_dp"), "dpsn": _share("q_dps"), "tkln": _share("s_tkl"), "tklin": _share("s_tkli"), "tklcn": _share("s_tklc"), "pwr": _share("n_hits"), "pwc": "cf / n_tokens",
    "nidf": _share("idf"), "qacf": "fb_acf1", "acf": "q_acf1", "acfn": _share("q_acf1"), "acfs": _share("(q_acf1 + 1)"), "cacfs": _share("(c_acf2 + 1)"), "dpc": _share("c_dp"), "dpsc": _share("c_dps"), "scacf": _share("(c_sacf2 + 1)"),
}


def expansion_features(c: Collection, params: Params | None = None) -> DataFrame:
    """query_id, term and features of the heaviest terms of the relevance model that aren't numbers (bursts, the eighteenth, have no relational form)."""
    p = params or Params()
    rm = FB.relevance_model(c, p.fb_docs, p.fb_terms, "not term rlike '^[0-9]*$'")
    per = FB.score_mass(c).select("query_id", S.sma(F.col("bg"), FB.SMOOTH).alias("xs")).select("query_id", S.acf(F.col("xs"), 1).alias("fb_acf1"))
    counts = c.hit_tokens.join(few(rm.select("query_id", "term"), p.fb_terms * len(c.topics)), ["query_id", "term"], "left_semi").groupBy("query_id", "term").agg(F.sum("tf").alias("n_hits"))
    t = series_table(c, rm).join(rm, ["query_id", "term"]).join(counts, ["query_id", "term"], "left").join(per, "query_id")
    t = t.withColumn("n_hits", F.coalesce("n_hits", F.lit(0.0))).withColumn("idf", F.ln(1 + F.col("n_docs") / F.col("df")))
    t = t.withColumns({f"s_{x}": F.expr(f"q_{x} + greatest(0e0, -min(q_{x}) OVER (PARTITION BY query_id))") for x in ("tkl", "tkli", "tklc")})
    t = t.select("query_id", "term", *(F.expr(x).alias(n) for n, x in _RM_FEATURES.items()))
    return t.select("query_id", "term", *(F.round(n, 6).alias(n) for n in _RM_FEATURES))


def _series_sql(terms: str) -> str:
    """CTEs ending in tt, by hand: statistics of both series of a table of terms."""
    qs, cs = "query_id, term", "term"
    return f"""{R.query_dense(terms, "dq", 3)}, {duck.stats_of("dq", qs, "sq")}, {duck.mutual("dq", qs, "q1", 1)}, {duck.mutual("dq", qs, "q2", 2)},
{duck.dense_terms(terms, "dc")}, {duck.stats_of("dc", cs, "sc")}, {duck.mutual("dc", cs, "c1", 1)}, {duck.mutual("dc", cs, "c2", 2)}, {duck.smooth_acf("dc", cs, "c3")},
tt AS (SELECT sq.query_id, sq.term, cf, stats.df, n_docs, n_tokens, sq.acf1, sq.acf2, sq.ccf, sq.dp, sq.dps, sq.tkl, sq.tklc, sq.tkli, sq.ent, q1.mi AS mi1, q2.mi AS mi2,
  sc.acf2 AS cacf2, sc.ccf AS cccf, sc.dp AS cdp, sc.dps AS cdps, sc.ent AS cent, c1.mi AS cmi1, c2.mi AS cmi2, sacf2
  FROM sq JOIN sc USING (term) JOIN stats USING (term) JOIN q1 ON q1.query_id = sq.query_id AND q1.term = sq.term JOIN q2 ON q2.query_id = sq.query_id AND q2.term = sq.term JOIN c1 ON c1.term = sq.term JOIN c2 ON c2.term = sq.term JOIN c3 ON c3.term = sq.term)"""


_P = "OVER (PARTITION BY query_id)"
QUERIES["qpp_series"] = lambda spark, sf: series_spread(Collection(spark, sf))
_SPREAD_SQL = {"qacf": "1 + acf2", "cacf": "1 + cacf2", "qccf": "1 + ccf", "cccf": "1 + cccf", "qdp": "dp", "qdps": "dps", "cdp": "cdp", "cdps": "cdps", "tkli": "tkli", "tklc": "tklc", "tkl": "tkl", "qent": "ent", "cent": "cent", "qami": "mi2", "cami": "cmi2"}
ORACLE_SQL["qpp_series"] = f"""WITH {duck.HITS}, {_series_sql("qt")} SELECT query_id, {", ".join(f"round({f}({x}), 6) AS {n}_{k}" for k, x in _SPREAD_SQL.items() for n, f in (("var", "var_samp"), ("avg", "avg"), ("min", "min"), ("max", "max")))} FROM tt GROUP BY query_id"""
QUERIES["qpp_hit_series"] = lambda spark, sf: hit_series(Collection(spark, sf))
_MASS = """ms AS (SELECT q.query_id, b.bin AS t, coalesce(sum(e), 0e0) AS x0 FROM (SELECT DISTINCT query_id FROM hits) q CROSS JOIN bins b LEFT JOIN hits h ON h.query_id = q.query_id AND h.bin = b.bin GROUP BY ALL),
mm AS (SELECT *, coalesce((x0 + lag(x0, 1) OVER (PARTITION BY query_id ORDER BY t) + lag(x0, 2) OVER (PARTITION BY query_id ORDER BY t)) / 3, 0e0) AS y FROM ms),
mn AS (SELECT query_id, t, y / sum(y) OVER (PARTITION BY query_id) AS x, total AS bg FROM mm JOIN tot ON tot.bin = t)"""
ORACLE_SQL["qpp_hit_series"] = f"""WITH {duck.HITS}, {_MASS}, {duck.stats_of("mn", "query_id", "st")} SELECT query_id, round(1 + acf2, 6) AS fb_acf, round(1 + ccf, 6) AS fb_ccf, round(dp, 6) AS fb_dp, round(dps, 6) AS fb_dps, round(tkl_raw, 6) AS fb_tkl,
round(1 - exp(-tkl_raw), 6) AS fb_tklc, round(exp(-1 / tkl_raw), 6) AS fb_tkli FROM st"""
QUERIES["feature_table"] = lambda spark, sf: feature_table(Collection(spark, sf))
_NORMED = lambda x, n: f"round(coalesce({x} / nullif(sum({x}) {_P}, 0), 0e0), 6) AS {n}"
ORACLE_SQL["feature_table"] = f"""WITH {duck.HITS}, {_series_sql("qt")}, {R.RM}, rr AS (SELECT query_id, term, rm / sum(rm) {_P} AS rm FROM rm_0),
u AS (SELECT tt.*, coalesce(rr.rm, 0e0) AS rm, ln(1 + n_docs / df) AS idf FROM tt LEFT JOIN rr ON rr.query_id = tt.query_id AND rr.term = tt.term),
v AS (SELECT *, (acf2 + 1) / nullif(sum(acf2 + 1) {_P}, 0) AS qs, (cacf2 + 1) / nullif(sum(cacf2 + 1) {_P}, 0) AS cs FROM u), y AS (SELECT *, coalesce(rm * qs, 0e0) AS rq, coalesce(rm * cs, 0e0) AS rc FROM v)
SELECT query_id, term, round(rm, 6) AS rm, {_NORMED("rm", "rmn")}, round(idf, 6) AS idf, {_NORMED("idf", "nidf")}, round(acf2, 6) AS qacf2, round(coalesce(qs, 0e0), 6) AS qacfs2, round(cacf2, 6) AS cacf2, round(coalesce(cs, 0e0), 6) AS cacf2s,
round(ccf, 6) AS ccfq, {_NORMED("(ccf + 1)", "ccfqs")}, round(cccf, 6) AS ccfc, {_NORMED("(cccf + 1)", "ccfcs")}, {_NORMED("rq", "rmqacf")}, {_NORMED("rc", "rmcacf")}, round(tkl, 6) AS tkl, {_NORMED("tkl", "tkln")}, round(dps, 6) AS dps, {_NORMED("dps", "dpsn")},
round(dp, 6) AS dp, {_NORMED("dp", "dpn")}, round(ent, 6) AS qent, {_NORMED("ent", "qentn")}, round(cent, 6) AS cent, {_NORMED("cent", "centn")}, round(mi1, 6) AS qami, {_NORMED("mi1", "qamin")}, round(cmi1, 6) AS cami, {_NORMED("cmi1", "camin")} FROM y"""
QUERIES["feature_table_rm"] = lambda spark, sf: expansion_features(Collection(spark, sf))
ORACLE_SQL["feature_table_rm"] = f"""WITH {duck.HITS}, {R.RM}, ra AS (SELECT * FROM rm_0 WHERE NOT regexp_full_match(term, '[0-9]*')), rb AS (SELECT * FROM ra QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rm, 10) DESC, term) <= 20),
rx AS (SELECT query_id, term, rm / sum(rm) {_P} AS rm FROM rb), {_series_sql("rx")}, nh AS (SELECT query_id, p.term, sum(tf) AS n_hits FROM hits h JOIN post p ON p.doc_id = h.doc_id GROUP BY ALL),
{_MASS}, mq AS (SELECT query_id, t, y AS x, total AS bg FROM mm JOIN tot ON tot.bin = t), {duck.stats_of("mq", "query_id", "mst")},
u AS (SELECT tt.*, rx.rm, coalesce(n_hits, 0e0) AS n_hits, ln(1 + n_docs / df) AS idf, mst.acf1 AS fb1 FROM tt JOIN rx ON rx.query_id = tt.query_id AND rx.term = tt.term LEFT JOIN nh ON nh.query_id = tt.query_id AND nh.term = tt.term JOIN mst ON mst.query_id = tt.query_id),
v AS (SELECT *, tkl - least(0e0, min(tkl) {_P}) AS s1, tkli - least(0e0, min(tkli) {_P}) AS s2, tklc - least(0e0, min(tklc) {_P}) AS s3 FROM u)
SELECT query_id, term, round(rm, 6) AS rmn, {_NORMED("dp", "dpn")}, {_NORMED("dps", "dpsn")}, {_NORMED("s1", "tkln")}, {_NORMED("s2", "tklin")}, {_NORMED("s3", "tklcn")}, {_NORMED("n_hits", "pwr")}, round(cf / n_tokens, 6) AS pwc, {_NORMED("idf", "nidf")}, round(fb1, 6) AS qacf,
round(acf1, 6) AS acf, {_NORMED("acf1", "acfn")}, {_NORMED("(acf1 + 1)", "acfs")}, {_NORMED("(cacf2 + 1)", "cacfs")}, {_NORMED("cdp", "dpc")}, {_NORMED("cdps", "dpsc")}, {_NORMED("(sacf2 + 1)", "scacf")} FROM v"""


def _predicted(c: Collection) -> DataFrame:
    """predictor, value, map of every query."""
    m = run_measures(c, SC.rank_with(c, "dirichlet")).select("query_id", F.round("map", 6).alias("map")).join(pre_retrieval(c), "query_id")
    return m.select("query_id", "map", F.explode(F.array(*(F.struct(F.lit(x).alias("predictor"), F.col(x).alias("value")) for x in _PRE))).alias("p")).select("map", "p.*")


def correlations(c: Collection) -> DataFrame:
    """Pearson correlation of each predictor with average precision, and its t statistic."""
    r = _predicted(c).groupBy("predictor").agg(F.count("value").alias("n"), F.corr("value", "map").alias("r"))
    t = F.when(F.abs("r") < 1, F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))
    return r.select("predictor", "n", F.round("r", 5).alias("r"), F.round(t, 4).alias("t"))


_PREDICTED = f"""pre AS ({ORACLE_SQL["qpp_pre"]}), ev AS ({ORACLE_SQL["eval_dirichlet"]}), l AS ({" UNION ALL ".join(f"SELECT '{x}' AS predictor, {x} AS value, map FROM pre JOIN ev USING (query_id)" for x in _PRE)})"""
QUERIES["predictor_corr"] = lambda spark, sf: correlations(Collection(spark, sf))
ORACLE_SQL["predictor_corr"] = f"""WITH {_PREDICTED}, c AS (SELECT predictor, count(value) AS n, corr(value, map) AS r FROM l GROUP BY predictor)
SELECT predictor, n, round(r, 5) AS r, round(CASE WHEN abs(r) < 1 THEN r / sqrt((1 - r * r) / (n - 2)) END, 4) AS t FROM c"""


def regressions(c: Collection) -> DataFrame:
    """Each predictor alone as a line through average precision: intercept, slope, share of variance explained and F statistic."""
    fit = _predicted(c).groupBy("predictor").agg(F.regr_count("map", "value").alias("n"), F.regr_intercept("map", "value").alias("intercept"), F.regr_slope("map", "value").alias("slope"), F.regr_r2("map", "value").alias("r2"))
    f = F.when(F.col("r2") < 1, F.col("r2") / (1 - F.col("r2")) * (F.col("n") - 2))
    return fit.select("predictor", "n", *(F.round(x, 4).alias(x) for x in ("intercept", "slope", "r2")), F.round(f, 4).alias("f"))


QUERIES["predictor_regression"] = lambda spark, sf: regressions(Collection(spark, sf))
ORACLE_SQL["predictor_regression"] = f"""WITH {_PREDICTED}, d AS (SELECT *, avg(value) OVER (PARTITION BY predictor) AS mx, avg(map) OVER (PARTITION BY predictor) AS my FROM l WHERE value IS NOT NULL),
s AS (SELECT predictor, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, sum((value - mx) * (map - my)) AS xy, sum((value - mx) ** 2) AS xx, sum((map - my) ** 2) AS yy FROM d GROUP BY predictor),
t AS (SELECT *, xy / nullif(xx, 0) AS b, xy * xy / nullif(xx * yy, 0) AS r2 FROM s)
SELECT predictor, n, round(my - b * mx, 4) AS intercept, round(b, 4) AS slope, round(r2, 4) AS r2, round(CASE WHEN r2 < 1 THEN r2 / (1 - r2) * (n - 2) END, 4) AS f FROM t"""


def box_cox(c: Collection) -> DataFrame:
    """For each predictor the power, of -2 to 2 in tenths, that makes average precision fit a line best (0: its logarithm); zeros count as a millionth."""
    each = _predicted(c).withColumn("y", F.greatest("map", F.lit(1e-6))).withColumn("k", F.explode(F.sequence(F.lit(-20), F.lit(20))))
    power = F.col("k") / 10.0
    each = each.withColumn("z", F.when(F.col("k") == 0, F.ln("y")).otherwise((F.pow("y", power) - 1) / power))
    fit = each.groupBy("predictor", "k").agg(F.count("value").alias("n"), (F.regr_syy("z", "value") * (1 - F.regr_r2("z", "value"))).alias("rest"), F.sum(F.ln("y")).alias("logs"))
    like = F.round(-F.col("n") / 2 * F.ln(F.col("rest") / F.col("n")) + (F.col("k") / 10.0 - 1) * F.col("logs"), 6)
    return fit.filter("rest > 0").groupBy("predictor").agg(F.round(F.min_by(F.col("k") / 10.0, F.struct(-like, F.col("k"))), 1).alias("power"))


QUERIES["predictor_boxcox"] = lambda spark, sf: box_cox(Collection(spark, sf))
ORACLE_SQL["predictor_boxcox"] = f"""WITH {_PREDICTED}, e AS (SELECT predictor, value, greatest(map, 1e-6) AS y, k FROM l, (SELECT unnest(range(-20, 21)) AS k) WHERE value IS NOT NULL),
z AS (SELECT *, CASE WHEN k = 0 THEN ln(y) ELSE (pow(y, k / 10e0) - 1) / (k / 10e0) END AS z FROM e), m AS (SELECT *, avg(value) OVER (PARTITION BY predictor, k) AS mx, avg(z) OVER (PARTITION BY predictor, k) AS mz FROM z),
s AS (SELECT predictor, k, count(*) AS n, sum((z - mz) ** 2) - pow(sum((value - mx) * (z - mz)), 2) / nullif(sum((value - mx) ** 2), 0) AS rest, sum(ln(y)) AS logs FROM m GROUP BY predictor, k),
b AS (SELECT predictor, k, round(-n / 2e0 * ln(rest / n) + (k / 10e0 - 1) * logs, 6) AS ll FROM s WHERE rest > 0)
SELECT predictor, round(k / 10e0, 1) AS power FROM b QUALIFY row_number() OVER (PARTITION BY predictor ORDER BY ll DESC, k) = 1"""

#: Documents judged relevant by bin: when what a topic is about happened.
QUERIES["relevant_bins"] = lambda spark, sf: (c := Collection(spark, sf)) and qrels(c).filter("rel > 0").join(c.docs.select("doc_id", "bin"), "doc_id").groupBy("query_id", "bin").agg(F.count("*").alias("n"))
ORACLE_SQL["relevant_bins"] = f"WITH {duck.BASE}, {_REL} SELECT query_id, bin, count(*) AS n FROM qrels JOIN docs USING (doc_id) WHERE rel > 0 GROUP BY query_id, bin"


def train_test(c: Collection) -> DataFrame:
    order = Window.orderBy("query_id")
    return c.query_terms.select("query_id").distinct().withColumn("part", F.when((F.row_number().over(order) - 1) % 2 == 0, "train").otherwise("test"))


QUERIES["train_test_split"] = lambda spark, sf: train_test(Collection(spark, sf))
ORACLE_SQL["train_test_split"] = f"WITH qt(query_id, term, qw) AS (VALUES {duck._TOPICS}), d AS (SELECT DISTINCT query_id FROM qt) SELECT query_id, CASE WHEN (row_number() OVER (ORDER BY query_id) - 1) % 2 = 0 THEN 'train' ELSE 'test' END AS part FROM d"
