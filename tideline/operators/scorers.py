"""Document scorers as expressions over the matrix of hits and query terms.

Symbols: tf, len, cp (collection probability), qw, qlen, ts / total (term and bin counts in the hit's bin), tp = ts / total, cf, n_docs,
n_tokens; parameters mu, lam, alpha, beta, gamma, rate; for whole documents s (the sum over terms), ql (query likelihood), bin, epoch.
Parameters are columns, so that a grid of them is one plan.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import series as S
from tideline.operators.collection import BINS, INTERVAL, START, Collection, Params, few, ranked

DIR = "((tf + mu * cp) / (len + mu))"
JM = "((1 - lam) * tf / len + lam * cp)"
TAU = f"floor(({START + BINS * INTERVAL} - epoch) / {INTERVAL}e0)"
RATE_Z = f"aggregate(sequence(0, {BINS}), 0e0, (x, b) -> x + rate * exp(-rate * b))"


@dataclass(frozen=True)
class Scorer:
    """p: what the weighted logarithm is taken of; term: the whole summand, where it is another; final: the score from the sum.

    reads: the parameters it has.
    """

    p: str = DIR
    term: str = ""
    final: str = "s"
    reads: tuple[str, ...] = ("mu",)
    ids: str = ""

    @property
    def summand(self) -> str:
        return self.term or f"qw * ln({self.p})"


def _if_seen(mixed: str, else_: str = DIR) -> str:
    return f"(CASE WHEN tp > 0 THEN {mixed} ELSE {else_} END)"


SCORERS = {
    "dirichlet": Scorer(ids="R01 R02"),
    "jelinek_mercer": Scorer(JM, reads=("lam",), ids="R03 R04"),
    "two_stage_linear": Scorer(f"((1 - lam) * {DIR} + lam * cp)", reads=("mu", "lam"), ids="R05 R06"),
    "two_stage_loglinear": Scorer(f"(pow({DIR}, 1 - lam) * pow(cp, lam))", reads=("mu", "lam"), ids="R07"),
    "loglinear": Scorer("(CASE WHEN tf > 0 THEN pow(tf / len, 1 - alpha) * pow(cp, alpha) ELSE cp END)", reads=("alpha",), ids="R08"),
    "cer": Scorer(term=f"qw / qlen * ln({DIR} / cp)", ids="R09"),
    "tsm_linear": Scorer(_if_seen(f"lam * {DIR} + (1 - lam) * tp"), reads=("mu", "lam"), ids="R11"),
    "tsm_loglinear": Scorer(_if_seen(f"pow({DIR}, lam) * pow(tp, 1 - lam)"), reads=("mu", "lam"), ids="R12"),
    "tsm_own": Scorer(f"(CASE WHEN ts > 0 THEN pow({DIR}, lam) * pow(ts / cf, 1 - lam) ELSE {DIR} END)", reads=("mu", "lam"), ids="R13"),
    "tsm_unsmoothed": Scorer(_if_seen(f"{DIR} * tp / cp"), ids="R14"),
    "tsm_jm_linear": Scorer(_if_seen(f"alpha * {JM} + (1 - alpha) * tp", JM), reads=("lam", "alpha"), ids="R15"),
    "tsm_jm_loglinear": Scorer(_if_seen(f"pow({JM}, alpha) * pow(tp, 1 - alpha)", JM), reads=("lam", "alpha"), ids="R16"),
    "tsm_dirichlet": Scorer("((ts + gamma * cp) / (total + gamma))", reads=("gamma",), ids="R17"),
    "tsm_jm_old": Scorer("((1 - lam) * tf / len + lam * ((1 - beta) * tp + beta * cp))", reads=("lam", "beta"), ids="R18"),
    "tim": Scorer(term=f"alpha * (CASE WHEN tp > 0 THEN qw * ln(tp) ELSE 0e0 END) + (1 - alpha) * qw * ln({DIR})", reads=("mu", "alpha"), ids="R19"),
    "timq": Scorer(term=f"alpha * qw * ln((1 + ts) / (total + n_tokens)) + (1 - alpha) * qw * ln({DIR})", reads=("mu", "alpha"), ids="R20"),
    "tpmq": Scorer(term=f"qw * ln((1 + ts) / (total + n_tokens)) + qw * ln({DIR})", ids="R21"),
    "tcer": Scorer(term=f"qw / qlen * ln({DIR} * (0.9e0 * tp + 0.1e0 * cp) / cp)", ids="R22"),
    "bin_dirichlet": Scorer("((ts + 1000e0 * cp) / (total + 1000e0))", reads=(), ids="R29"),
    "recency_exp": Scorer(final=f"s + rate * exp(-rate * {TAU})", reads=("mu", "rate"), ids="R30"),
    "recency_log": Scorer(final=f"s + ln(rate * exp(-rate * {TAU}))", reads=("mu", "rate"), ids="R31"),
    "recency_bins": Scorer(final=f"s + ln(rate * exp(-rate * {TAU}) / {RATE_Z})", reads=("mu", "rate"), ids="R32"),
}

#: Smoothing with a probability bp of a bin, topic or cluster that stands in for the bin's: by the mode of the mixture.
MODES = {
    1: "(lam * (tf + mu * bp) / (len + mu) + (1 - lam) * cp)",
    2: f"(lam * {DIR} + (1 - lam) * bp)",
    3: "((tf + mu * (lam * bp + (1 - lam) * cp)) / (len + mu))",
}


def grid_table(c: Collection, points: list[Params]) -> DataFrame:
    """point (its number) and every parameter."""
    names = [f.name for f in fields(Params)]
    return c.spark.createDataFrame([(i, *(float(x) if isinstance(x, float) else int(x) for x in astuple(p))) for i, p in enumerate(points)], "point int, " + ", ".join(f"{n} {'double' if isinstance(v, float) else 'int'}" for n, v in zip(names, astuple(Params()), strict=True)))


def scored(matrix: DataFrame, scorer: Scorer, params: Params | DataFrame | None = None) -> DataFrame:
    """[point,] query_id, doc_id, bin, epoch, ql, score of all hits. params: one set, or a grid_table(), whose points are then all scored at once."""
    if isinstance(params, DataFrame):
        on = ["point"] if "point" in matrix.columns else []
        grid = F.broadcast(params.select("point", *Params.COLUMNS))
        m, by = matrix.join(grid, on) if on else matrix.crossJoin(grid), ["point"]
    else:
        p = params or Params()
        m, by = matrix.withColumns({n: F.lit(getattr(p, n)) for n in Params.COLUMNS}), []
    out = m.groupBy(*by, *Params.COLUMNS, "query_id", "doc_id", "bin", "epoch", "ql").agg(F.sum(F.expr(scorer.summand)).alias("s"))
    out = out.withColumn("score", F.expr(scorer.final)).filter("score is not null and not isnan(score)")
    return out.select(*by, "query_id", "doc_id", "bin", "epoch", "ql", "score")


def final(out: DataFrame) -> DataFrame:
    """[point,] query_id, doc_id, score, rank"""
    by = [c for c in ("point",) if c in out.columns]
    return ranked(out, by=(*by, "query_id")).select(*by, "query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def apply(matrix: DataFrame, scorer: Scorer, params: Params | DataFrame | None = None) -> DataFrame:
    return final(scored(matrix, scorer, params))


def rank_with(c: Collection, name: str, weights: DataFrame | None = None, params: Params | None = None) -> DataFrame:
    """The smoothing is that of the retrieval, unless params say otherwise."""
    return apply(c.matrix(weights), SCORERS[name], params or Params(mu=c.mu))


def rank_prior(c: Collection, priors: DataFrame, how: str = "linear", params: Params | None = None) -> DataFrame:
    """Query likelihood with a document's prior (doc_id, prior): alpha * score + (1 - alpha) * prior, or score + prior. Documents without one go."""
    p = params or Params(mu=c.mu)
    out = scored(c.matrix(), SCORERS["dirichlet"], p).join(priors.select("doc_id", "prior"), "doc_id")
    return final(out.withColumn("score", F.col("score") + F.col("prior") if how == "sum" else p.alpha * F.col("score") + (1 - p.alpha) * F.col("prior")))


def best_query_bins(c: Collection) -> DataFrame:
    """query_id, bin, ll, post: the query's log likelihood in each bin's model (one added), and its posterior."""
    stats = c.query_terms.join(c.term_stats(c.query_terms), "term").crossJoin(F.broadcast(c.background))
    each = stats.select("query_id", "qw", "n_tokens", F.posexplode(F.arrays_zip("xs", "bg")).alias("b", "z"))
    ll = each.groupBy("query_id", "b").agg(F.sum(F.col("qw") * F.ln((F.col("z.xs") + 1) / (F.col("z.bg") + F.col("n_tokens")))).alias("ll"))
    over = Window.partitionBy("query_id")
    e = F.exp(F.col("ll") - F.max("ll").over(over))
    return ll.withColumn("e", e).withColumn("post", F.col("e") / F.sum("e").over(over)).select("query_id", "b", "ll", "post")


def rank_query_bin(c: Collection, mode: int, params: Params | None = None) -> DataFrame:
    """The bin that likes the query best gives the bin's probability; the first of equal ones."""
    first = best_query_bins(c).groupBy("query_id").agg(F.min_by("b", F.struct(-F.round("ll", 6), F.col("b"))).alias("b"))
    m = c.matrix().join(few(first, len(c.topics)), "query_id")
    return apply(m.withColumn("bp", F.get("xs", F.col("b")) / F.get("bg", F.col("b"))), Scorer(MODES[mode]), params)


def rank_posterior(c: Collection, mode: int, params: Params | None = None) -> DataFrame:
    """Bins weighted by their posterior given the query."""
    post = best_query_bins(c).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("b", "post"))).alias("posts"))
    m = c.matrix().join(few(post, len(c.topics), 16 * BINS), "query_id")
    share = F.zip_with(F.col("xs"), F.col("bg"), lambda x, y: x / y)
    bp = S.total(F.zip_with(F.col("posts"), share, lambda p, s: p["post"] * s))
    return apply(m.withColumn("bp", bp), Scorer(MODES[mode]), params)


def document_bins(c: Collection) -> DataFrame:
    """doc_id, b: the bin whose model (one added; without the document, in its own bin) likes a hit's text best.

    Only bins that hold one of the document's terms are looked at; the others differ by their length alone. Counts by bin come with the
    index: one row a term. All bins of a document are summed in one row, so that no row is made for a term and bin.
    """
    # a document that several queries found is read once
    one = c.hits.groupBy("doc_id").agg(F.min(F.struct("query_id", "rank")).alias("z")).select("doc_id", "z.query_id", "z.rank")
    terms = c.hit_tokens.join(few(one, c.n_hits), ["doc_id", "query_id", "rank"], "left_semi").select("doc_id", "bin", "len", "term", "tf")
    each = terms.join(c.term_stats().select("term", "xs"), "term")
    ts = [F.get("xs", F.lit(b)) for b in range(BINS)]
    gains = [F.sum(F.col("tf") * F.ln(x + 1 - F.when(F.col("bin") == b, F.col("tf")).otherwise(0.0))) for b, x in enumerate(ts)]
    rows = each.groupBy("doc_id", "bin", "len").agg(F.array(*gains).alias("gain"), F.array(*map(F.max, ts)).alias("most"))
    sizes = c.whole.select("n_tokens", "bg")
    gain = rows.crossJoin(F.broadcast(sizes)).select("doc_id", "bin", "len", "n_tokens", F.posexplode(F.arrays_zip("gain", "most", F.col("bg").alias("total"))).alias("b", "z"))
    gain = gain.filter("z.most > 0").select("doc_id", "bin", "len", "n_tokens", "b", "z.gain", "z.total")
    ll = F.col("gain") - F.col("len") * F.ln(F.col("total") - F.when(F.col("b") == F.col("bin"), F.col("len")).otherwise(0.0) + F.col("n_tokens"))
    return gain.withColumn("ll", ll).groupBy("doc_id").agg(F.min_by("b", F.struct(-F.round("ll", 6), F.col("b"))).alias("b"))


def rank_document_bin(c: Collection, mode: int, params: Params | None = None) -> DataFrame:
    m = c.matrix().join(document_bins(c), "doc_id")
    return apply(m.withColumn("bp", F.get("xs", F.col("b")) / F.get("bg", F.col("b"))), Scorer(MODES[mode]), params)


# --- density of the hits over time ----------------------------------------------------

#: Points of a density's grid, which reaches three bandwidths beyond the data.
POINTS = 1024


def bandwidths(hits: DataFrame, k: int, weight: str = "score") -> DataFrame:
    """query_id, h, ts (array of day and weight) of the k best hits; weights are shares of the scores, or alike. Queries whose hits have one time have none."""
    over = Window.partitionBy("query_id")
    day = F.col("epoch") / float(INTERVAL)
    w = F.col("ql") / F.sum("ql").over(over) if weight == "score" else 1 / F.count("*").over(over)
    near = hits.filter(F.col("rank") <= k).select("query_id", day.alias("t"), w.alias("w"), (1.06 * F.stddev_samp(day).over(over) * F.pow(F.count("*").over(over).cast("double"), F.lit(-0.2))).alias("h"))
    return near.filter("h > 0").groupBy("query_id", "h").agg(F.collect_list(F.struct("t", "w")).alias("ts"))


def _kernel(ts, h, x):
    return S.total(F.transform(ts, lambda p: p["w"] * F.exp(-0.5 * F.pow((x - p["t"]) / h, F.lit(2)))) ) / (h * F.sqrt(2 * F.pi()))


def densities(c: Collection, k: int, weight: str = "score") -> DataFrame:
    """query_id, doc_id, dens: Gaussian kernel density, at each hit's time in days, of the k best hits, weighted by their share of the scores."""
    near = few(bandwidths(c.hits, k, weight), len(c.topics), 16 * k)
    at = c.hits.select("query_id", "doc_id", (F.col("epoch") / float(INTERVAL)).alias("x")).join(near, "query_id")
    return at.select("query_id", "doc_id", _kernel(F.col("ts"), F.col("h"), F.col("x")).alias("dens"))


def density_moments(c: Collection, k: int) -> DataFrame:
    """query_id, mean, sd of the density over its grid of POINTS."""
    near = bandwidths(c.hits, k)
    lo, hi = (f(F.transform("ts", lambda p: p["t"])) for f in (F.array_min, F.array_max))
    near = near.withColumn("lo", lo - 3 * F.col("h")).withColumn("step", (hi + 3 * F.col("h") - F.col("lo")) / (POINTS - 1))
    each = near.select("query_id", "h", "ts", "lo", "step", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))).alias("i"))
    return each.withColumn("y", _kernel(F.col("ts"), F.col("h"), F.col("lo") + F.col("i") * F.col("step"))).groupBy("query_id").agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"))


def rank_kde(c: Collection, k: int, alpha: float = 0.5, guard: bool = True) -> DataFrame:
    """alpha * ln(density) + (1 - alpha) * query likelihood; where the density is 0, its part is 0, or without `guard` the hit goes."""
    m = c.hits.join(densities(c, k), ["query_id", "doc_id"])
    kde = F.when(F.col("dens") > 0, F.ln("dens"))
    return final(blended(m.drop("rank"), kde, alpha, guard))


def blended(m: DataFrame, log_density, alpha: float, guard: bool, score: str = "ql") -> DataFrame:
    if guard:
        log_density = F.coalesce(log_density, F.lit(0.0))
    return m.withColumn("score", alpha * log_density + (1 - alpha) * F.col(score)).filter("score is not null")


def rank_kde_filter(c: Collection, k: int) -> DataFrame:
    """Hits stay where the density, plus its deviation over the grid, is above its mean over the grid."""
    m = c.hits.join(densities(c, k), ["query_id", "doc_id"]).join(few(density_moments(c, k), len(c.topics)), "query_id")
    return final(m.filter(F.round(F.col("dens") + F.col("sd") - F.col("mean"), 9) > 0).drop("rank").withColumn("score", F.col("ql")))


def rank_with_density(c: Collection, matrix: DataFrame, p: str, params: Params | None = None) -> DataFrame:
    """A smoothed likelihood blended with the density of all hits, weighted alike; hits of density 0 go."""
    q = params or Params(mu=c.mu)
    out = scored(matrix, Scorer(p), q).withColumnRenamed("score", "s").join(densities(c, NUM_ALL, "alike"), ["query_id", "doc_id"])
    return final(blended(out, F.when(F.col("dens") > 0, F.ln("dens")), q.alpha, False, "s"))


NUM_ALL = 1_000_000


def document_bin_weights(c: Collection) -> DataFrame:
    """doc_id, ws: for every bin the document's log likelihood in the bin's model of the document's own terms, as a share of the sum over bins.

    The model adds 1 / (the document's distinct terms) to each count and one to the sum. Shares are of logarithms: worse bins weigh more.
    """
    terms = c.hit_tokens.select("doc_id", "term", "tf").distinct()
    each = terms.join(c.term_stats().select("term", "xs"), "term").withColumn("add", 1 / F.count("*").over(Window.partitionBy("doc_id")))
    # the terms of a document are together by now, so that its rows by bin are summed where they are made
    long = each.select("doc_id", "tf", "add", F.posexplode("xs").alias("b", "ts"))
    ll = long.groupBy("doc_id", "b").agg(F.sum(F.col("tf") * F.ln(F.col("ts") + F.col("add"))).alias("gain"), F.sum("tf").alias("n"), F.sum("ts").alias("tlen"))
    ll = ll.withColumn("ll", F.col("gain") - F.col("n") * F.ln(F.col("tlen") + 1))
    w = F.col("ll") / F.sum("ll").over(Window.partitionBy("doc_id"))
    ll = ll.withColumn("w", F.when(F.col("tlen") > 0, w / F.col("tlen")).otherwise(0.0))
    return ll.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "w"))), lambda z: z["w"]).alias("ws"))


def rank_document_bins_kde(c: Collection, params: Params | None = None) -> DataFrame:
    """All bins, weighted for each document, give the probability of the document's own terms (mode 3); blended with the density."""
    m = c.matrix().join(document_bin_weights(c), "doc_id").withColumn("bp", F.when(F.col("tf") > 0, S.total(F.zip_with("ws", "xs", lambda w, x: w * x))).otherwise(0.0))
    return rank_with_density(c, m, MODES[3], params)


def divergent_bins(c: Collection) -> DataFrame:
    """doc_id, b: the bin of the least positive divergence from the document, both as shares over the document's terms; the first of equal ones, else 0."""
    terms = c.hit_tokens.select("doc_id", "term", "tf").distinct()
    each = terms.join(c.term_stats().select("term", "xs"), "term").withColumn("dp", F.col("tf") / F.sum("tf").over(Window.partitionBy("doc_id")))
    each = each.select("doc_id", "dp", F.posexplode("xs").alias("b", "ts"))
    # the sum of p ln(p / q) with p = ts over their total is the mean of ln(ts / q) by ts, less the total's logarithm: no row needs the total
    kl = each.groupBy("doc_id", "b").agg(F.sum("ts").alias("total"), F.sum(F.when(F.col("ts") > 0, F.col("ts") * F.ln(F.col("ts") / F.col("dp")))).alias("mass"))
    kl = kl.withColumn("kl", F.when(F.col("total") > 0, F.col("mass") / F.col("total") - F.ln("total")))
    kl = kl.withColumn("kl", F.round("kl", 9))
    return kl.groupBy("doc_id").agg(F.coalesce(F.min_by("b", F.when(F.col("kl") > 0, F.struct("kl", "b"))), F.lit(0)).alias("b"))


def rank_divergent_bin_kde(c: Collection, params: Params | None = None) -> DataFrame:
    """The bin nearest to the document by divergence gives the probability of the document's own terms (mode 3); blended with the density."""
    m = c.matrix().join(divergent_bins(c), "doc_id")
    bp = F.when(F.col("tf") > 0, F.get("xs", F.col("b")) / F.get("bg", F.col("b"))).otherwise(0.0)
    return rank_with_density(c, m.withColumn("bp", bp), MODES[3], params)
