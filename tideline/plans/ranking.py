"""Ranking queries: every scorer over the documents' own collection, with the SQL each is checked against.

The SQL is written from each scorer's definition, not from the plan's expressions: it has numbers for parameters, sums logarithms where
plans multiply powers, and joins and windows where plans use arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import series as S
from tideline.operators import feedback as FB
from tideline.operators import scorers as SC
from tideline.operators.collection import BINS, Collection, Params, few
from tideline.plans import duck

QUERIES, ORACLE_SQL = {}, {}

# --- scorers of documents ------------------------------------------------------------

_TAU = "((1706659200 - epoch) // 86400)"
#: name: (sum over the query's terms, score from the sum s). pd: Dirichlet probability with 2500, pj: half the document's, half the collection's.
SCORER_SQL = {
    "dirichlet": ("qw * ln(pd)", "s"),
    "jelinek_mercer": ("qw * ln(pj)", "s"),
    "two_stage_linear": ("qw * ln((pd + cp) / 2)", "s"),
    "two_stage_loglinear": ("qw * (ln(pd) + ln(cp)) / 2", "s"),
    "loglinear": ("qw * CASE WHEN tf > 0 THEN (ln(tf / len) + ln(cp)) / 2 ELSE ln(cp) END", "s"),
    "cer": ("qw / qlen * (ln(pd) - ln(cp))", "s"),
    "tsm_linear": ("qw * ln(CASE WHEN ts > 0 THEN (pd + ts / total) / 2 ELSE pd END)", "s"),
    "tsm_loglinear": ("qw * CASE WHEN ts > 0 THEN (ln(pd) + ln(ts) - ln(total)) / 2 ELSE ln(pd) END", "s"),
    "tsm_own": ("qw * CASE WHEN ts > 0 THEN (ln(pd) + ln(ts) - ln(cf)) / 2 ELSE ln(pd) END", "s"),
    "tsm_unsmoothed": ("qw * CASE WHEN ts > 0 THEN ln(pd) + ln(ts / total) - ln(cp) ELSE ln(pd) END", "s"),
    "tsm_jm_linear": ("qw * ln(CASE WHEN ts > 0 THEN (pj + ts / total) / 2 ELSE pj END)", "s"),
    "tsm_jm_loglinear": ("qw * CASE WHEN ts > 0 THEN (ln(pj) + ln(ts / total)) / 2 ELSE ln(pj) END", "s"),
    "tsm_dirichlet": ("qw * (ln(ts + 1000e0 * cp) - ln(total + 1000e0))", "s"),
    "tsm_jm_old": ("qw * ln(tf / (2 * len) + ts / total / 4 + cp / 4)", "s"),
    "tim": ("qw * (coalesce(ln(nullif(ts, 0) / total), 0e0) + ln(pd)) / 2", "s"),
    "timq": ("qw * (ln(1 + ts) - ln(total + n_tokens) + ln(pd)) / 2", "s"),
    "tpmq": ("qw * (ln(1 + ts) - ln(total + n_tokens) + ln(pd))", "s"),
    "tcer": ("qw / qlen * (ln(pd) + ln(9 * ts / total + cp) - ln(10e0) - ln(cp))", "s"),
    "bin_dirichlet": ("qw * ln((ts + 1000e0 * cp) / (total + 1000e0))", "s"),
    "recency_exp": ("qw * ln(pd)", f"s + 0.1e0 * exp(-{_TAU} / 10e0)"),
    "recency_log": ("qw * ln(pd)", f"s + ln(0.1e0) - {_TAU} / 10e0"),
    "recency_bins": ("qw * ln(pd)", f"s - {_TAU} / 10e0 - ln((SELECT sum(exp(-b / 10e0)) FROM (SELECT unnest(range(31)) AS b)))"),
}


def scored_sql(source: str, summand: str, final: str = "s", name: str = "f") -> str:
    """CTE `name` with score of each hit, over a matrix."""
    return f"""
{name}_p AS (SELECT *, (tf + 2500e0 * cp) / (len + 2500e0) AS pd, (tf / len + cp) / 2 AS pj FROM {source}),
{name}_s AS (SELECT query_id, doc_id, bin, epoch, ql, sum({summand}) AS s FROM {name}_p GROUP BY ALL),
{name} AS (SELECT *, {final} AS score FROM {name}_s)"""


DIRICHLET = SCORER_SQL["dirichlet"][0]
for _name in SC.SCORERS:
    QUERIES[f"rank_{_name}"] = lambda spark, sf, n=_name: SC.rank_with(Collection(spark, sf), n)
    ORACLE_SQL[f"rank_{_name}"] = f"WITH {duck.HITS}, {duck.matrix()}, {scored_sql('m', *SCORER_SQL[_name])} {duck.ranking('f')}"

#: A grid of one parameter in one pass.
MUS = [500.0, 1000.0, 2500.0]


def rank_mu_grid(spark, sf) -> DataFrame:
    c = Collection(spark, sf)
    grid = SC.grid_table(c, [Params(mu=m) for m in MUS])
    return SC.scored(c.matrix(), SC.SCORERS["dirichlet"], grid).join(F.broadcast(grid.select("point", "mu")), "point").select("mu", "query_id", "doc_id", F.round("score", 6).alias("score"))


MU_GRID_SQL = f"""g AS (SELECT mu, query_id, doc_id, round(sum(qw * (ln(tf + mu * cp) - ln(len + mu))), 6) AS score FROM m, (SELECT unnest([{", ".join(f"{x}e0" for x in MUS)}]) AS mu) GROUP BY mu, query_id, doc_id)"""
QUERIES["rank_mu_grid"] = rank_mu_grid
ORACLE_SQL["rank_mu_grid"] = f"WITH {duck.HITS}, {duck.matrix()}, {MU_GRID_SQL} SELECT * FROM g"


def priors(c: Collection) -> DataFrame:
    """A prior of every document but each seventh."""
    return c.docs.filter("doc_id % 7 <> 0").select("doc_id", (1 / (1 + F.col("doc_id") % 10)).alias("prior"))


_PRIORS = "pri AS (SELECT doc_id, 1e0 / (1 + doc_id % 10) AS prior FROM docs WHERE doc_id % 7 <> 0)"
for _how, _with in (("linear", "(f0.score + prior) / 2"), ("sum", "f0.score + prior")):
    QUERIES[f"rank_prior_{_how}"] = lambda spark, sf, h=_how: SC.rank_prior(c := Collection(spark, sf), priors(c), h)
    ORACLE_SQL[f"rank_prior_{_how}"] = f"WITH {duck.HITS}, {duck.matrix()}, {scored_sql('m', DIRICHLET, name='f0')}, {_PRIORS}, f AS (SELECT query_id, doc_id, {_with} AS score FROM f0 JOIN pri USING (doc_id)) {duck.ranking('f')}"

# --- best bins ------------------------------------------------------------------------

#: A bin's, topic's or cluster's probability bp by the mode of its mixture with the document and the collection, each with a half.
MODE_SQL = {
    1: "qw * ln(((tf + 2500e0 * bp) / (len + 2500e0) + cp) / 2)",
    2: "qw * ln((pd + bp) / 2)",
    3: "qw * (ln(tf + 1250e0 * bp + 1250e0 * cp) - ln(len + 2500e0))",
}
_QB = """
qb0 AS (SELECT query_id, b.bin AS b, sum(qw * ln((coalesce(tb.ts, 0e0) + 1) / (total + n_tokens))) AS ll
  FROM qt JOIN stats USING (term) CROSS JOIN bins b LEFT JOIN tb ON tb.term = qt.term AND tb.bin = b.bin JOIN tot ON tot.bin = b.bin GROUP BY ALL),
qb AS (SELECT *, exp(ll - max(ll) OVER (PARTITION BY query_id)) AS e FROM qb0)"""
_BEST = "first AS (SELECT query_id, b FROM qb QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(ll, 6) DESC, b) = 1)"
_AT = "x AS (SELECT m.*, coalesce(tb.ts, 0e0) / tot2.total AS bp FROM m JOIN first USING ({on}) LEFT JOIN tb ON tb.term = m.term AND tb.bin = first.b JOIN tot tot2 ON tot2.bin = first.b)"
_DOC = """
hd AS (SELECT DISTINCT doc_id FROM hits),
dl0 AS (SELECT p.doc_id, p.bin, p.len, tb.bin AS b, sum(tf * ln(ts + 1 - CASE WHEN tb.bin = p.bin THEN tf ELSE 0e0 END)) AS gain FROM post p JOIN hd USING (doc_id) JOIN tb ON tb.term = p.term GROUP BY ALL),
dl AS (SELECT doc_id, b, gain - len * ln(total - CASE WHEN b = dl0.bin THEN len ELSE 0e0 END + n_tokens) AS ll FROM dl0 JOIN tot ON tot.bin = b, coll),
first AS (SELECT doc_id, b FROM dl QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(ll, 6) DESC, b) = 1)"""
for _mode in SC.MODES:
    _x = scored_sql("x", MODE_SQL[_mode])
    QUERIES[f"rank_query_bin_mode{_mode}"] = lambda spark, sf, k=_mode: SC.rank_query_bin(Collection(spark, sf), k)
    ORACLE_SQL[f"rank_query_bin_mode{_mode}"] = f"WITH {duck.HITS}, {duck.matrix()}, {_QB}, {_BEST}, {_AT.format(on='query_id')}, {_x} {duck.ranking('f')}"
    QUERIES[f"rank_posterior_mode{_mode}"] = lambda spark, sf, k=_mode: SC.rank_posterior(Collection(spark, sf), k)
    ORACLE_SQL[f"rank_posterior_mode{_mode}"] = f"""WITH {duck.HITS}, {duck.matrix()}, {_QB},
pt AS (SELECT qt.query_id, qt.term, sum(e / z * coalesce(tb.ts, 0e0) / total) AS bp FROM qt JOIN (SELECT *, sum(e) OVER (PARTITION BY query_id) AS z FROM qb) w USING (query_id)
  JOIN tot ON tot.bin = w.b LEFT JOIN tb ON tb.term = qt.term AND tb.bin = w.b GROUP BY ALL),
x AS (SELECT m.*, bp FROM m JOIN pt USING (query_id, term)), {_x} {duck.ranking("f")}"""
    QUERIES[f"rank_document_bin_mode{_mode}"] = lambda spark, sf, k=_mode: SC.rank_document_bin(Collection(spark, sf), k)
    ORACLE_SQL[f"rank_document_bin_mode{_mode}"] = f"WITH {duck.HITS}, {duck.matrix()}, {_DOC}, {_AT.format(on='doc_id')}, {_x} {duck.ranking('f')}"

# --- density over time ------------------------------------------------------------------


def kde_sql(k: int, weight: str = "ql / sum(ql) OVER (PARTITION BY query_id)") -> str:
    return f"""
near AS (SELECT query_id, epoch / 86400e0 AS t, {weight} AS w, 1.06e0 * stddev_samp(epoch / 86400e0) OVER (PARTITION BY query_id) * pow(count(*) OVER (PARTITION BY query_id), -0.2e0) AS h FROM hits WHERE rank <= {k}),
kd AS (SELECT h0.query_id, h0.doc_id, ql, sum(w * exp(-0.5e0 * pow((epoch / 86400e0 - t) / near.h, 2)) / (near.h * sqrt(2 * pi()))) AS dens FROM hits h0 JOIN near USING (query_id) WHERE near.h > 0 GROUP BY ALL)"""


ALIKE = "1e0 / count(*) OVER (PARTITION BY query_id)"
for _name, _k, _guard in (("rank_kde", 50, True), ("rank_kde_all", 1000, True), ("rank_kde_oracle", 1000, False)):
    QUERIES[_name] = lambda spark, sf, k=_k, g=_guard: SC.rank_kde(Collection(spark, sf), k, guard=g)
    _score = "(CASE WHEN dens > 0 THEN ln(dens) ELSE 0e0 END + ql) / 2" if _guard else "(ln(dens) + ql) / 2"
    ORACLE_SQL[_name] = f"WITH {duck.HITS}, {kde_sql(_k)}, f AS (SELECT *, {_score} AS score FROM kd{'' if _guard else ' WHERE dens > 0'}) {duck.ranking('f')}"
QUERIES["rank_kde_filter"] = lambda spark, sf: SC.rank_kde_filter(Collection(spark, sf), 50)
ORACLE_SQL["rank_kde_filter"] = f"""WITH {duck.HITS}, {kde_sql(50)}, ends AS (SELECT query_id, min(t) - 3 * any_value(h) AS lo, max(t) + 3 * any_value(h) AS hi FROM near GROUP BY query_id),
grid AS (SELECT query_id, lo + i * (hi - lo) / 1023 AS at FROM ends, (SELECT unnest(range(1024)) AS i)),
gy AS (SELECT g.query_id, g.at, sum(w * exp(-0.5e0 * pow((g.at - t) / h, 2)) / (h * sqrt(2 * pi()))) AS y FROM grid g JOIN near USING (query_id) GROUP BY ALL),
mo AS (SELECT query_id, avg(y) AS mean, stddev_samp(y) AS sd FROM gy GROUP BY query_id), f AS (SELECT kd.query_id, doc_id, ql AS score FROM kd JOIN mo USING (query_id) WHERE round(dens + sd - mean, 9) > 0) {duck.ranking("f")}"""

_BLEND = "f AS (SELECT f0.query_id, f0.doc_id, (ln(dens) + score) / 2 AS score FROM f0 JOIN kd ON kd.query_id = f0.query_id AND kd.doc_id = f0.doc_id WHERE dens > 0)"
_HV = "hv AS (SELECT DISTINCT p.doc_id, p.term, p.tf FROM post p JOIN hits h ON h.doc_id = p.doc_id)"
QUERIES["rank_document_bins_kde"] = lambda spark, sf: SC.rank_document_bins_kde(Collection(spark, sf))
ORACLE_SQL["rank_document_bins_kde"] = f"""WITH {duck.HITS}, {duck.matrix()}, {kde_sql(1000, ALIKE)}, {_HV},
hb AS (SELECT hv.*, b.bin AS b, coalesce(tb.ts, 0e0) AS bts, 1e0 / count(*) OVER (PARTITION BY hv.doc_id, b.bin) AS add_, sum(coalesce(tb.ts, 0e0)) OVER (PARTITION BY hv.doc_id, b.bin) AS tlen FROM hv CROSS JOIN bins b LEFT JOIN tb ON tb.term = hv.term AND tb.bin = b.bin),
hl AS (SELECT doc_id, b, any_value(tlen) AS tlen, sum(tf * (ln(bts + add_) - ln(tlen + 1))) AS ll FROM hb GROUP BY doc_id, b), hw AS (SELECT *, ll / sum(ll) OVER (PARTITION BY doc_id) AS w FROM hl),
bp AS (SELECT m.query_id, m.doc_id, m.term, sum(w * coalesce(tb.ts, 0e0) / tlen) AS bp FROM m JOIN hw ON hw.doc_id = m.doc_id LEFT JOIN tb ON tb.term = m.term AND tb.bin = hw.b WHERE m.tf > 0 AND tlen > 0 GROUP BY ALL),
x AS (SELECT m.*, coalesce(bp, 0e0) AS bp FROM m LEFT JOIN bp USING (query_id, doc_id, term)), {scored_sql("x", MODE_SQL[3], name="f0")}, {_BLEND} {duck.ranking("f")}"""
QUERIES["rank_divergent_bin_kde"] = lambda spark, sf: SC.rank_divergent_bin_kde(Collection(spark, sf))
ORACLE_SQL["rank_divergent_bin_kde"] = f"""WITH {duck.HITS}, {duck.matrix()}, {kde_sql(1000, ALIKE)}, {_HV},
hb AS (SELECT hv.doc_id, b.bin AS b, tf / sum(tf) OVER (PARTITION BY hv.doc_id, b.bin) AS dp, coalesce(tb.ts, 0e0) / nullif(sum(coalesce(tb.ts, 0e0)) OVER (PARTITION BY hv.doc_id, b.bin), 0) AS pp FROM hv CROSS JOIN bins b LEFT JOIN tb ON tb.term = hv.term AND tb.bin = b.bin),
hk AS (SELECT doc_id, b, round(sum(CASE WHEN pp > 0 THEN pp * ln(pp / dp) END), 9) AS kl FROM hb GROUP BY doc_id, b),
first AS (SELECT d.doc_id, coalesce(k.b, 0) AS b FROM (SELECT DISTINCT doc_id FROM hv) d LEFT JOIN (SELECT doc_id, b FROM hk WHERE kl > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kl, b) = 1) k USING (doc_id)),
x AS (SELECT m.*, CASE WHEN m.tf > 0 THEN coalesce(tb.ts, 0e0) / tot2.total ELSE 0e0 END AS bp FROM m JOIN first USING (doc_id) LEFT JOIN tb ON tb.term = m.term AND tb.bin = first.b JOIN tot tot2 ON tot2.bin = first.b),
{scored_sql("x", MODE_SQL[3], name="f0")}, {_BLEND} {duck.ranking("f")}"""

# --- query weights ----------------------------------------------------------------

_SUMS = {
    "norm": "SELECT query_id, term, qw / nullif(sum(qw) OVER (PARTITION BY query_id), 0) AS qw FROM {0}",
    "shift": "SELECT query_id, term, qw / nullif(sum(qw) OVER (PARTITION BY query_id), 0) AS qw FROM (SELECT query_id, term, qw + greatest(0e0, -min(qw) OVER (PARTITION BY query_id)) AS qw FROM {0})",
    "scale": "SELECT query_id, term, (qw + 1) / nullif(sum(qw + 1) OVER (PARTITION BY query_id), 0) AS qw FROM {0}",
}


def query_dense(terms: str, name: str, sma: int = 0) -> str:
    """The query-time series as shares."""
    return f"""{duck.dense_query(terms, name + "_r", sma)},
{name} AS (SELECT query_id, term, t, coalesce(x / nullif(sum(x) OVER (PARTITION BY query_id, term), 0), 0e0) AS x, coalesce(bg / nullif(sum(bg) OVER (PARTITION BY query_id, term), 0), 0e0) AS bg FROM {name}_r)"""


_QUERY_STATS = f"{query_dense('qt', 'dq', 3)}, {duck.stats_of('dq', 'query_id, term', 'st')}"
_QUERY_RAW = f"{query_dense('qt', 'dq')}, {duck.stats_of('dq', 'query_id, term', 'st')}"
_QUERY_MI = f"{query_dense('qt', 'dq', 3)}, {duck.mutual('dq', 'query_id, term', 'st')}"
_TERM_STATS = f"{duck.dense_terms('qt', 'dc')}, {duck.stats_of('dc', 'term', 'sc')}, st AS (SELECT query_id, qt.term, sc.* EXCLUDE (term), stats.n_docs, stats.df FROM qt JOIN sc USING (term) JOIN stats USING (term))"
_ERF = "(1 - (0.254829592e0 * z + -0.284496736e0 * z * z + 1.421413741e0 * z ** 3 + -1.453152027e0 * z ** 4 + 1.061405429e0 * z ** 5) * exp(-u * u))"
#: name: (CTEs that end in st(query_id, term, ...), weight, how it is made to sum to 1)
WEIGHT_SQL = {
    "qacf": (_QUERY_STATS, "acf2", "scale"),
    "qami": (_QUERY_MI, "mi", "scale"),
    "qccf": (_QUERY_STATS, "ccf", "scale"),
    "qdps": (_QUERY_STATS, "dps", "norm"),
    "qdp": (_QUERY_STATS, "30e0 / kmax", "norm"),
    "qent": (_QUERY_STATS, "coalesce(1 / nullif(greatest(ent, 0e0), 0), 0e0)", "norm"),
    "qtklc": (_QUERY_STATS, "1 - exp(-tkl)", "norm"),
    "qtkli": (_QUERY_STATS, "coalesce(exp(-1 / nullif(greatest(tkl, 0e0), 0)), 0e0)", "shift"),
    "tbp": (_QUERY_RAW, "0.57e0 * bp + 0.25e0", "norm"),
    "qregression": (_QUERY_STATS, "acf2", "shift"),
    "qcacf": (_TERM_STATS, "acf2", "scale"),
    "qprcacf": (_TERM_STATS, f"(SELECT 0.5e0 + sign(v) * 0.5e0 * {_ERF} FROM (SELECT v, u, 1 / (1 + 0.3275911e0 * u) AS z FROM (SELECT (acf2 - 0.1e0) / 0.2e0 AS v, abs((acf2 - 0.1e0) / 0.2e0) / sqrt(2e0) AS u)))", "norm"),
    "qcpacf": (_TERM_STATS, "acf1", "norm"),
    "qcccf": (_TERM_STATS, "CASE WHEN ccf > 0 THEN 1 - ccf ELSE 1e0 END", "scale"),
    "qcent": (_TERM_STATS, "coalesce(1 / nullif(greatest(ent, 0e0), 0), 0e0)", "norm"),
    "qctklc": (_TERM_STATS, "1 - exp(-tkl)", "shift"),
    "qctkli": (_TERM_STATS, "coalesce(exp(-1 / nullif(greatest(tkl, 0e0), 0)), 0e0)", "shift"),
    "qnidf": (_TERM_STATS, "ln(1 + n_docs / df)", "norm"),
}


def weights_sql(name: str) -> str:
    """CTEs ending in wz(query_id, term, qw)."""
    ctes, weight, how = WEIGHT_SQL[name]
    return f"{ctes}, rw AS (SELECT query_id, term, {weight} AS qw FROM st), w AS ({_SUMS[how].format('rw')}), wz AS (SELECT query_id, term, coalesce(qw, 0e0) AS qw FROM w)"


for _name in FB.REWEIGHTERS:
    QUERIES[f"reweight_{_name}"] = lambda spark, sf, n=_name: FB.reweighted(Collection(spark, sf), n).select("query_id", "term", F.round("qw", 6).alias("weight"))
    QUERIES[f"rank_{_name}"] = lambda spark, sf, n=_name: SC.rank_with(c := Collection(spark, sf), "dirichlet", FB.reweighted(c, n))
    _w = f"WITH {duck.HITS}, {weights_sql(_name)}"
    ORACLE_SQL[f"reweight_{_name}"] = f"{_w} SELECT query_id, term, round(qw, 6) AS weight FROM wz"
    ORACLE_SQL[f"rank_{_name}"] = f"{_w}, {duck.matrix('wz')}, {scored_sql('m', DIRICHLET)} {duck.ranking('f')}"
QUERIES["rank_qacf_tsm_loglinear"] = lambda spark, sf: SC.rank_with(c := Collection(spark, sf), "tsm_loglinear", FB.reweighted(c, "qacf"))
ORACLE_SQL["rank_qacf_tsm_loglinear"] = f"WITH {duck.HITS}, {weights_sql('qacf')}, {duck.matrix('wz')}, {scored_sql('m', *SCORER_SQL['tsm_loglinear'])} {duck.ranking('f')}"

# --- relevance models -----------------------------------------------------------------

RM = """
rm_0 AS (SELECT query_id, p.term, sum(tf / h.len * e) AS rm FROM hits h JOIN post p ON p.doc_id = h.doc_id WHERE rank <= 50 GROUP BY ALL),
rm_1 AS (SELECT * FROM rm_0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rm, 10) DESC, term) <= 20),
rm1 AS (SELECT query_id, term, rm / sum(rm) OVER (PARTITION BY query_id) AS rm FROM rm_1),
rm_2 AS (SELECT * FROM rm_0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rm, 10) DESC, term) <= 100),
rm100 AS (SELECT query_id, term, rm / sum(rm) OVER (PARTITION BY query_id) AS rm FROM rm_2),
rm0 AS (SELECT query_id, term, rm / sum(rm) OVER (PARTITION BY query_id) AS rm FROM rm_0 JOIN qt USING (query_id, term))"""
_MIX = "(SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.term, b.term) AS term, (coalesce(a.{x}, 0e0) + coalesce(b.{y}, 0e0)) / 2 AS qw FROM {a} a FULL JOIN {b} b ON a.query_id = b.query_id AND a.term = b.term)"
_SUM_OF = "sum({0}) OVER (PARTITION BY query_id)"


def _series(model: str, sma: int = 0) -> str:
    """z(query_id, term, rm, ...): a model's terms with the statistics of their query-time series."""
    return f"{query_dense(model, 'dq', sma)}, {duck.stats_of('dq', 'query_id, term', 'sq')}, z AS (SELECT * FROM {model} JOIN sq USING (query_id, term))"


def _collected(model: str) -> str:
    """z: a model's terms with the statistics of the collection's series."""
    return f"{duck.dense_terms(model, 'dc')}, {duck.stats_of('dc', 'term', 'sc')}, z AS (SELECT * FROM {model} JOIN sc USING (term))"


_WHOLE = "bs AS (SELECT bin AS t, total AS x, 0e0 AS bg, 1 AS one FROM tot), " + duck.stats_of("bs", "one", "bst")
_WITH_QUERY = f"wn AS ({_SUMS['norm'].format('rw')}), qn AS ({_SUMS['norm'].format('qt')}), wz AS {_MIX.format(a='qn', b='wn', x='qw', y='qw')}"
_ALONE = f"wz AS ({_SUMS['norm'].format('rw')})"
_SCALED = f"ws AS ({_SUMS['scale'].format('rw')})"
_PLUS = "(1 - exp(-tkl_plus))"
#: name: CTEs that end in wz(query_id, term, qw)
EXPANSION_SQL = {
    "rm0": "wz AS (SELECT query_id, term, rm AS qw FROM rm0)",
    "rm1": "wz AS (SELECT query_id, term, rm AS qw FROM rm1)",
    "rm3": f"rw AS (SELECT query_id, term, rm AS qw FROM rm1), {_WITH_QUERY}",
    "rm0_cacf": f"{_collected('rm0')}, rw AS (SELECT query_id, term, acf2 AS qw FROM z), {_SCALED}, wz AS {_MIX.format(a='ws', b='rm0', x='qw', y='rm')}",
    "rm0_qacf": f"{_series('rm0', 3)}, rw AS (SELECT query_id, term, acf2 AS qw FROM z), {_SCALED}, wz AS {_MIX.format(a='ws', b='rm0', x='qw', y='rm')}",
    "rm1_cacf": f"{_collected('rm1')}, {_WHOLE}, rw AS (SELECT query_id, term, abs(z.acf2) AS qw FROM z, bst WHERE z.acf2 > abs(bst.acf2)), {_SCALED}, wz AS {_MIX.format(a='ws', b='rm1', x='qw', y='rm')}",
    "rm1_cccf": f"{_collected('rm1')}, rw AS (SELECT query_id, term, CASE WHEN ccf > 0 THEN rm - rm * ccf ELSE rm END AS qw FROM z), {_ALONE}",
    "rm1_qacf": f"{_series('rm1', 3)}, rw AS (SELECT query_id, term, acf2 AS qw FROM z), {_SCALED}, wz AS {_MIX.format(a='ws', b='rm1', x='qw', y='rm')}",
    "rm1_qacf_loglinear": f"{_series('rm1', 3)}, rw0 AS (SELECT query_id, term, rm, acf2 AS qw FROM z), ws AS ({_SUMS['scale'].format('rw0')}), rw AS (SELECT query_id, term, sqrt(ws.qw) * sqrt(rm1.rm) AS qw FROM ws JOIN rm1 USING (query_id, term)), {_ALONE}",
    "qcacf_rm3": f"{_series('rm100', 3)}, rw AS (SELECT query_id, term, acf2 AS qw FROM z), {_SCALED}, wz AS (SELECT * FROM ws QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(qw, 10) DESC, term) <= 20)",
    "rm1_tklcn": f"{_series('rm1')}, rw AS (SELECT query_id, term, rm - rm * exp(-tkl) AS qw FROM z), {_ALONE}",
    "rm1_tklin": f"{_series('rm1')}, rw AS (SELECT query_id, term, CASE WHEN tkl > 0 THEN rm * exp(-1 / tkl) ELSE 0e0 END AS qw FROM z), {_ALONE}",
    "rm_tklcn": f"{_series('rm1')}, rw AS (SELECT query_id, term, rm - rm * exp(-tkl) AS qw FROM z), {_WITH_QUERY}",
    "rm_tklin": f"{_series('rm1')}, rw AS (SELECT query_id, term, CASE WHEN tkl > 0 THEN rm * exp(-1 / tkl) ELSE 0e0 END AS qw FROM z), {_WITH_QUERY}",
    "rm_tkl": f"{_series('rm1')}, n AS (SELECT *, tkl_plus / {_SUM_OF.format('tkl_plus')} AS n0 FROM z), rw AS (SELECT query_id, term, n0 + n0 * rm AS qw FROM n), {_WITH_QUERY}",
    "trm": f"{_series('rm1', 3)}, rw AS (SELECT query_id, term, rm - rm * exp(-tkl) AS qw FROM z), {_WITH_QUERY}",
    "trm_loglinear": f"{_series('rm1')}, rw AS (SELECT query_id, term, sqrt({_PLUS} * rm) AS qw FROM z), {_WITH_QUERY}",
    "trm_bp": f"{_series('rm1')}, rw AS (SELECT query_id, term, sqrt(bp * rm) AS qw FROM z), {_WITH_QUERY}",
    "trm_dps": f"{_series('rm1')}, rw AS (SELECT query_id, term, sqrt(dps / {_SUM_OF.format('dps')} * rm) AS qw FROM z), {_WITH_QUERY}",
    "brm_dps": f"{_series('rm0')}, rw AS (SELECT query_id, term, (rm + dps / {_SUM_OF.format('dps')}) / 2 AS qw FROM z), {_ALONE}",
    "rm_regression": f"{_series('rm0')}, rw AS (SELECT query_id, term, 0.05e0 + 0.43e0 * rm + 0.45e0 * {_PLUS} / {_SUM_OF.format(_PLUS)} AS qw FROM z), {_ALONE}",
}
for _name in FB.EXPANSIONS:
    QUERIES[f"expand_{_name}"] = lambda spark, sf, n=_name: FB.expanded(Collection(spark, sf), n).select("query_id", "term", F.round("qw", 6).alias("weight"))
    QUERIES[f"rank_{_name}"] = lambda spark, sf, n=_name: SC.rank_with(c := Collection(spark, sf), "dirichlet", FB.expanded(c, n))
    _w = f"WITH {duck.HITS}, {RM}, {EXPANSION_SQL[_name]}"
    ORACLE_SQL[f"expand_{_name}"] = f"{_w} SELECT query_id, term, round(qw, 6) AS weight FROM wz"
    ORACLE_SQL[f"rank_{_name}"] = f"{_w}, {duck.matrix('wz')}, {scored_sql('m', DIRICHLET)} {duck.ranking('f')}"
QUERIES["rank_rm1_tsm_loglinear"] = lambda spark, sf: SC.rank_with(c := Collection(spark, sf), "tsm_loglinear", FB.expanded(c, "rm1"))
ORACLE_SQL["rank_rm1_tsm_loglinear"] = f"WITH {duck.HITS}, {RM}, {EXPANSION_SQL['rm1']}, {duck.matrix('wz')}, {scored_sql('m', *SCORER_SQL['tsm_loglinear'])} {duck.ranking('f')}"

# --- scorers with the query's own series ------------------------------------------------


def rank_query_series(c: Collection, params: Params | None = None) -> DataFrame:
    """The document model mixed log-linearly with the share of the term's query-time series in the document's bin, where that is positive."""
    own = few(FB.query_series(c, c.query_terms, FB.SMOOTH).select("query_id", "term", F.col("xs").alias("own")), c.n_terms, 8 * BINS)
    m = c.matrix().join(own, ["query_id", "term"]).withColumn("bp", F.get("own", F.col("bin")))
    return SC.apply(m, SC.Scorer(f"(CASE WHEN bp > 0 THEN pow({SC.DIR}, lam) * pow(bp, 1 - lam) ELSE {SC.DIR} END)"), params or Params(mu=c.mu))


def rank_query_acf(c: Collection, params: Params | None = None) -> DataFrame:
    """The document model mixed log-linearly with the term's scaled autocorrelation; terms whose weight isn't positive are left out."""
    w = few(FB.reweighted(c, "qacf", params).withColumnRenamed("qw", "bp"), c.n_terms)
    m = c.matrix().join(w, ["query_id", "term"])
    return SC.apply(m, SC.Scorer(term=f"CASE WHEN bp > 0 THEN qw * ln(pow({SC.DIR}, lam) * pow(bp, 1 - lam)) ELSE 0e0 END"), params or Params(mu=c.mu))


#: The normal reference bandwidth of a regular grid of bins.
BIN_WIDTH = 1.06 * ((BINS * BINS - 1) / 12 * BINS / (BINS - 1)) ** 0.5 * BINS**-0.2


def rank_term_density(c: Collection, params: Params | None = None) -> DataFrame:
    """The document model times the density, in the document's bin, of the term's query-time series over bins (Gaussian, by the normal reference rule).

    Terms without a series have density 1. (The reference asks the density of bins for a time in seconds; here it is asked for a bin.)
    """
    own = few(FB.query_series(c, c.query_terms, FB.SMOOTH).select("query_id", "term", F.col("xs").alias("own")), c.n_terms, 8 * BINS)
    m = c.matrix().join(own, ["query_id", "term"])
    near = F.zip_with("own", F.sequence(F.lit(0), F.lit(BINS - 1)), lambda x, b: x * F.exp(-0.5 * F.pow((F.col("bin") - b) / F.lit(BIN_WIDTH), F.lit(2))))
    m = m.withColumn("bp", F.when(S.total(F.col("own")) > 0, S.total(near) / F.lit(BIN_WIDTH * (2 * 3.141592653589793) ** 0.5)).otherwise(1.0))
    return SC.apply(m, SC.Scorer(f"({SC.DIR} * bp)"), params or Params(mu=c.mu))


QUERIES["rank_query_series"] = lambda spark, sf: rank_query_series(Collection(spark, sf))
ORACLE_SQL["rank_query_series"] = f"""WITH {duck.HITS}, {duck.matrix()}, {query_dense("qt", "dq", 3)}, x AS (SELECT m.*, dq.x AS bp FROM m JOIN dq ON dq.query_id = m.query_id AND dq.term = m.term AND dq.t = m.bin),
{scored_sql("x", "qw * CASE WHEN bp > 0 THEN (ln(pd) + ln(bp)) / 2 ELSE ln(pd) END")} {duck.ranking("f")}"""
QUERIES["rank_query_acf"] = lambda spark, sf: rank_query_acf(Collection(spark, sf))
ORACLE_SQL["rank_query_acf"] = f"""WITH {duck.HITS}, {weights_sql("qacf")}, {duck.matrix()}, x AS (SELECT m.*, wz.qw AS bp FROM m JOIN wz ON wz.query_id = m.query_id AND wz.term = m.term),
{scored_sql("x", "CASE WHEN bp > 0 THEN qw * (ln(pd) + ln(bp)) / 2 ELSE 0e0 END")} {duck.ranking("f")}"""
QUERIES["rank_term_density"] = lambda spark, sf: rank_term_density(Collection(spark, sf))
ORACLE_SQL["rank_term_density"] = f"""WITH {duck.HITS}, {duck.matrix()}, {query_dense("qt", "dq", 3)}, hb AS (SELECT 1.06e0 * stddev_samp(bin) * pow(30, -0.2e0) AS h FROM bins),
kd AS (SELECT query_id, term, b.bin, CASE WHEN sum(x) > 0 THEN sum(x * exp(-pow((b.bin - t) / h, 2) / 2e0)) / any_value(h * sqrt(2 * pi())) ELSE 1e0 END AS bp FROM dq, bins b, hb GROUP BY ALL),
x AS (SELECT m.*, kd.bp FROM m JOIN kd ON kd.query_id = m.query_id AND kd.term = m.term AND kd.bin = m.bin), {scored_sql("x", "qw * (ln(pd) + ln(bp))")} {duck.ranking("f")}"""
