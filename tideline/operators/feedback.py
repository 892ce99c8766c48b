"""Query weights from time series and from feedback documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import series as S
from tideline.operators.collection import BINS, Collection, Params, few

#: The window of the moving average that query-time series are smoothed by, for most weights.
SMOOTH = 3


def with_stats(df: DataFrame, prefix: str = "", lag: int = 2) -> DataFrame:
    """Adds the statistics of a series xs against a background bg (dense arrays); what isn't read is not computed."""
    x = F.col("xs")
    df = df.withColumn("_sx", S.total(x)).withColumn("_sb", S.total(F.col("bg")))
    df = df.withColumn("_p", S.normalise(x, F.col("_sx"))).withColumn("_q", S.normalise(F.col("bg"), F.col("_sb"))).withColumn("_m", S.mean(x)).withColumn("_spec", S.spectrum(x))
    df = df.withColumn("_tkl", S.kl(F.col("_p"), F.col("_q")))
    stats = {
        "acf": S.acf(x, lag),
        "acf1": S.acf(x, 1),
        "acf2": S.acf(x, 2),
        "acf3": S.acf(x, 3),
        "sacf2": S.acf(F.slice(S.sma(x, SMOOTH), SMOOTH, BINS), 2),
        "pacf2": S.pacf2(x),
        "ccf": S.ccf(x, F.col("bg")),
        "ent": S.entropy(F.col("_p")),
        "tkl": F.col("_tkl"),
        "tkl_raw": S.kl(F.col("_p"), F.col("bg")),
        "tkl_plus": S.total(F.zip_with("_p", "_q", lambda p, q: (p + 1e-10) * F.ln((p + 1e-10) / (q + 1e-10)))),
        "tklc": 1 - F.exp(-F.col("_tkl")),
        "tkli": F.when(F.col("_tkl") > 0, F.exp(-1 / F.col("_tkl"))).otherwise(0.0),
        "bp": S.share_positive(x),
        "dps": S.peak(F.col("_spec")),
        "dp": S.period(x, F.col("_spec")),
        "avg_spec": S.mean(F.col("_spec")),
        "skew": S.skewness(x, F.col("_m")),
        "kurt": S.kurtosis(x, F.col("_m")),
        "mi": S.mutual_information(x, lag),
        "mi1": S.mutual_information(x, 1),
        "mi2": S.mutual_information(x, 2),
    }
    return df.withColumns({prefix + k: v for k, v in stats.items()})


def collection_series(c: Collection, terms: DataFrame | None = None) -> DataFrame:
    """term, cf, df, xs, bg"""
    return c.term_stats(terms).crossJoin(F.broadcast(c.background))


def score_mass(c: Collection, k: int = 1000) -> DataFrame:
    """query_id, bg: the hits' own weight by bin (exp(ql) over the query's highest), of the k best."""
    hits = c.hits.withColumn("e", F.exp(F.col("ql") - F.max("ql").over(Window.partitionBy("query_id")))).filter(F.col("rank") <= k)
    return hits.groupBy("query_id", "bin").agg(F.sum("e").alias("x")).groupBy("query_id").agg(S.dense(F.collect_list(F.struct("bin", "x")), BINS).alias("bg"))


def query_series(c: Collection, terms: DataFrame, sma: int = 0, k: int = 1000) -> DataFrame:
    """query_id, term, xs, bg: shares of score-weighted term frequency by bin over a query's k best hits, and of the hits' own weight.

    sma: the window of a trailing average that both are smoothed by before they are made shares.
    """
    wanted = few(terms.select("query_id", "term").distinct(), 1000 * len(c.topics))
    each = c.hit_tokens.filter(F.col("rank") <= k).join(wanted, ["query_id", "term"], "left_semi")
    each = each.groupBy("query_id", "term", "bin").agg(F.sum(F.col("tf") / F.col("len") * F.col("e")).alias("x"))
    xs = each.groupBy("query_id", "term").agg(S.dense(F.collect_list(F.struct("bin", "x")), BINS).alias("xs"))
    # a term of no hit has a series of zeros
    none = F.array_repeat(F.lit(0.0), BINS)
    out = terms.select("query_id", "term").distinct().join(xs, ["query_id", "term"], "left").join(score_mass(c, k), "query_id").withColumn("xs", F.coalesce("xs", none))
    if sma:
        out = out.withColumn("xs", S.sma(F.col("xs"), sma)).withColumn("bg", S.sma(F.col("bg"), sma))
    out = out.withColumn("_x", S.total(F.col("xs"))).withColumn("_b", S.total(F.col("bg")))
    return out.select("query_id", "term", S.normalise(F.col("xs"), F.col("_x")).alias("xs"), S.normalise(F.col("bg"), F.col("_b")).alias("bg"))


def normalised(df: DataFrame, how: str = "norm", col: str = "qw") -> DataFrame:
    """Weights of each query that sum to 1: as they are, shifted up by the least if that is negative, or each with 1 added; or all as they are."""
    over = Window.partitionBy(*(c for c in ("point",) if c in df.columns), "query_id")
    if how == "raw":
        return df
    if how == "shift":
        low = F.min(col).over(over)
        df = df.withColumn(col, F.col(col) + F.when(low < 0, -low).otherwise(0.0))
    if how == "scale":
        df = df.withColumn(col, F.col(col) + 1)
    total = F.sum(col).over(over)
    return df.withColumn(col, F.when(total != 0, F.col(col) / total).otherwise(0.0))


def spread(df: DataFrame, col: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """(x - least) / (most - least) of each query, or of given bounds."""
    over = Window.partitionBy("query_id")
    a, b = (F.lit(low) if low is not None else F.min(col).over(over)), (F.lit(high) if high is not None else F.max(col).over(over))
    return df.withColumn(col, F.when(b > a, (F.col(col) - a) / (b - a)).otherwise(0.0))


def pnorm(z: str) -> str:
    """The normal distribution function by a polynomial of the error function (five terms)."""
    x = f"(abs({z}) / sqrt(2e0))"
    t = f"(1 / (1 + 0.3275911e0 * {x}))"
    erf = f"(1 - ({t} * (0.254829592e0 + {t} * (-0.284496736e0 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0))))) * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN 0.5e0 * (1 + {erf}) ELSE 0.5e0 * (1 - {erf}) END)"


def pexp(x: str, rate: str) -> str:
    """The exponential distribution function."""
    return f"(CASE WHEN {x} > 0 THEN 1 - exp(-{rate} * {x}) ELSE 0e0 END)"


@dataclass(frozen=True)
class Weight:
    """A query term's weight from its series: that of the query's hits ("q", smoothed by a window `sma`) or of the collection ("c")."""

    series: str
    weight: str
    how: str
    sma: int = 0


_INVERSE_ENTROPY = "CASE WHEN ent > 0 THEN 1 / ent ELSE 0e0 END"
REWEIGHTERS = {
    "qacf": Weight("q", "acf", "scale", SMOOTH),
    "qami": Weight("q", "mi", "scale", SMOOTH),
    "qccf": Weight("q", "ccf", "scale", SMOOTH),
    "qdps": Weight("q", "dps", "norm", SMOOTH),
    "qdp": Weight("q", "dp", "norm", SMOOTH),
    "qent": Weight("q", _INVERSE_ENTROPY, "norm", SMOOTH),
    "qtklc": Weight("q", "tklc", "norm", SMOOTH),
    "qtkli": Weight("q", "tkli", "shift", SMOOTH),
    "tbp": Weight("q", "0.25e0 + 0.57e0 * bp", "norm"),
    "qregression": Weight("q", "acf2", "shift", SMOOTH),
    "qcacf": Weight("c", "acf", "scale"),
    "qprcacf": Weight("c", pnorm("((acf2 - 0.1e0) / 0.2e0)"), "norm"),
    "qcpacf": Weight("c", "acf1", "norm"),
    "qcccf": Weight("c", "1 - greatest(0e0, ccf)", "scale"),
    "qcent": Weight("c", _INVERSE_ENTROPY, "norm"),
    "qctklc": Weight("c", "tklc", "shift"),
    "qctkli": Weight("c", "tkli", "shift"),
    "qnidf": Weight("c", "ln(1 + n_docs / df)", "norm"),
}


def reweighted(c: Collection, name: str, params: Params | None = None) -> DataFrame:
    """query_id, term, qw"""
    w, p = REWEIGHTERS[name], params or Params()
    if w.series == "q":
        stats = with_stats(query_series(c, c.query_terms, w.sma, p.k), lag=p.lag)
    else:
        stats = c.query_terms.select("query_id", "term").join(with_stats(collection_series(c, c.query_terms), lag=p.lag), "term")
    return normalised(stats.select("query_id", "term", F.expr(w.weight).alias("qw")), w.how)


def clipped(df: DataFrame, k: int, col: str = "rm") -> DataFrame:
    """The k heaviest terms of each query; equal ones by term."""
    order = Window.partitionBy("query_id").orderBy(F.round(col, 10).desc(), "term")
    return df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k).drop("_k")


def relevance_model(c: Collection, fb_docs: int = Params.fb_docs, fb_terms: int | None = Params.fb_terms, keep: str = "", weights: DataFrame | None = None) -> DataFrame:
    """query_id, term, rm: sum over the feedback documents of tf / len times the score's exponential, clipped and normalised.

    keep: a condition on terms, before they are clipped. weights: (query_id, doc_id, w), a further weight of documents; those without
    one count once.
    """
    each = c.hit_tokens.filter(F.col("rank") <= fb_docs)
    x = F.col("tf") / F.col("len") * F.col("e")
    if weights is not None:
        each = each.join(few(weights.select("query_id", "doc_id", "w"), c.n_hits), ["query_id", "doc_id"], "left")
        x = x * F.coalesce("w", F.lit(1.0))
    rm = each.groupBy("query_id", "term").agg(F.sum(x).alias("rm"))
    if keep:
        rm = rm.filter(keep)
    return normalised(clipped(rm, fb_terms) if fb_terms else rm, col="rm")


def relevance_grid(c: Collection, grid: DataFrame) -> DataFrame:
    """point, query_id, term, rm for each point's fb_docs and fb_terms: one pass over the feedback documents of the largest."""
    sizes = F.broadcast(grid.select("fb_docs").distinct())
    each = c.hit_tokens.join(sizes, F.col("rank") <= F.col("fb_docs"))
    rm = each.groupBy("fb_docs", "query_id", "term").agg(F.sum(F.col("tf") / F.col("len") * F.col("e")).alias("rm"))
    order = Window.partitionBy("fb_docs", "query_id").orderBy(F.round("rm", 10).desc(), "term")
    rm = rm.withColumn("_k", F.row_number().over(order)).join(F.broadcast(grid.select("point", "fb_docs", "fb_terms")), "fb_docs").filter("_k <= fb_terms")
    return normalised(rm.select("point", "query_id", "term", "rm"), col="rm")


def rm3_grid(c: Collection, grid: DataFrame) -> DataFrame:
    """point, query_id, term, qw: the query interpolated with each point's relevance model, by the point's lam."""
    rm = relevance_grid(c, grid).withColumnRenamed("rm", "b")
    query = normalised(c.query_terms.select("query_id", "term", "qw")).withColumnRenamed("qw", "a")
    query = query.crossJoin(F.broadcast(grid.select("point")))
    both = query.join(rm, ["point", "query_id", "term"], "full_outer").join(F.broadcast(grid.select("point", "lam")), "point")
    return both.select("point", "query_id", "term", (F.col("lam") * F.coalesce("a", F.lit(0.0)) + (1 - F.col("lam")) * F.coalesce("b", F.lit(0.0))).alias("qw"))


def restricted(rm: DataFrame, terms: DataFrame) -> DataFrame:
    return normalised(rm.join(F.broadcast(terms.select("query_id", "term")), ["query_id", "term"], "left_semi"), col="rm")


def interpolated(a: DataFrame, b: DataFrame, weight: float = Params.lam) -> DataFrame:
    """weight * a + (1 - weight) * b over the union of their terms; both have query_id, term, qw."""
    both = a.withColumnRenamed("qw", "a").join(b.withColumnRenamed("qw", "b"), ["query_id", "term"], "full_outer")
    return both.select("query_id", "term", (weight * F.coalesce("a", F.lit(0.0)) + (1 - weight) * F.coalesce("b", F.lit(0.0))).alias("qw"))


@dataclass(frozen=True)
class Expansion:
    """A query from the relevance model: of the query's terms ("rm0") or its heaviest ("rm1").

    weight: from rm, from q_* of the query-time series (smoothed by a window `sma`) and from c_* of the collection's (cb_*: of the whole collection). how: how weights are
    normalised; with_query: interpolated with the query; only: the terms that enter, and with_model: interpolated with the model
    after that; wide: terms of the model before the weights are clipped.
    """

    model: str
    weight: str
    sma: int = 0
    with_query: bool = False
    how: str = "norm"
    only: str = ""
    with_model: bool = False
    wide: int = 0


_SHARE = "({0} / sum({0}) OVER (PARTITION BY query_id))"
_ALPHA = "pow({0}, {{alpha}}) * pow(rm, 1 - {{alpha}})"
EXPANSIONS = {
    "rm0": Expansion("rm0", "rm"),
    "rm1": Expansion("rm1", "rm"),
    "rm3": Expansion("rm1", "rm", with_query=True),
    "rm0_cacf": Expansion("rm0", "c_acf2", how="scale", with_model=True),
    "rm0_qacf": Expansion("rm0", "q_acf", SMOOTH, how="scale", with_model=True),
    "rm1_cacf": Expansion("rm1", "abs(c_acf)", how="scale", only="c_acf > abs(cb_acf)", with_model=True),
    "rm1_cccf": Expansion("rm1", "rm * (1 - greatest(0e0, c_ccf))"),
    "rm1_qacf": Expansion("rm1", "q_acf", SMOOTH, how="scale", with_model=True),
    "rm1_qacf_loglinear": Expansion("rm1", "pow(" + _SHARE.format("(q_acf + 1)") + ", {lam}) * pow(rm, 1 - {lam})", SMOOTH),
    "qcacf_rm3": Expansion("rm1", "q_acf2", SMOOTH, how="scale", wide=100),
    "rm1_tklcn": Expansion("rm1", "rm * q_tklc"),
    "rm1_tklin": Expansion("rm1", "rm * q_tkli"),
    "rm_tklcn": Expansion("rm1", "rm * q_tklc", with_query=True),
    "rm_tklin": Expansion("rm1", "rm * q_tkli", with_query=True),
    "rm_tkl": Expansion("rm1", _SHARE.format("q_tkl_plus") + " * (1 + rm)", with_query=True),
    "trm": Expansion("rm1", "q_tklc * rm", SMOOTH, with_query=True),
    "trm_loglinear": Expansion("rm1", _ALPHA.format("(1 - exp(-q_tkl_plus))"), with_query=True),
    "trm_bp": Expansion("rm1", _ALPHA.format("q_bp"), with_query=True),
    "trm_dps": Expansion("rm1", _ALPHA.format(_SHARE.format("q_dps")), with_query=True),
    "brm_dps": Expansion("rm0", "{lam} * rm + (1 - {lam}) * " + _SHARE.format("q_dps")),
    "rm_regression": Expansion("rm0", "0.05e0 + 0.45e0 * " + _SHARE.format("(1 - exp(-q_tkl_plus))") + " + 0.43e0 * rm"),
}


def expanded(c: Collection, name: str, params: Params | None = None) -> DataFrame:
    """query_id, term, qw"""
    e, p = EXPANSIONS[name], params or Params()
    rm = relevance_model(c, p.fb_docs, e.wide or p.fb_terms)
    if e.model == "rm0":
        rm = restricted(relevance_model(c, p.fb_docs, None), c.query_terms)
    rm = rm.persist()  # few rows, read by each step that follows
    out, weight = rm, e.weight.format(lam=f"{p.lam!r}D", alpha=f"{p.alpha!r}D")
    if "q_" in weight:
        q = with_stats(query_series(c, rm, e.sma), "q_", p.lag)
        out = out.join(q.select("query_id", "term", *(x for x in q.columns if x.startswith("q_"))), ["query_id", "term"])
    if "c_" in weight:
        s = with_stats(collection_series(c, rm), "c_", p.lag)
        out = out.join(s.select("term", *(x for x in s.columns if x.startswith("c_"))), "term")
    if e.only:
        whole = with_stats(c.background.withColumnRenamed("bg", "xs").withColumn("bg", F.col("xs")), "cb_", p.lag).select("cb_acf")
        out = out.crossJoin(F.broadcast(whole)).filter(e.only)
    out = normalised(out.select("query_id", "term", F.expr(weight).alias("qw")), e.how)
    if e.wide:
        out = clipped(out, p.fb_terms, "qw")
    if e.with_model:
        out = interpolated(out, rm.withColumnRenamed("rm", "qw"), p.lam)
    if e.with_query:
        out = interpolated(normalised(c.query_terms.select("query_id", "term", "qw")), out, p.lam)
    return out
