"""Topic, cluster and density models, feedback by bin, and the routines that need numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import numeric as N
from tideline.functions import series as S
from tideline.operators import feedback as FB
from tideline.operators import scorers as SC
from tideline.operators.collection import BINS, Collection, Params, few
from tideline.plans import duck, evaluation
from tideline.plans import ranking as R
from tideline.session import table

QUERIES, ORACLE_SQL = {}, {}
TOPIC_COUNT = 10

# --- topics: a document's mixture leans to its own topic, a topic's words are those of its documents ---


def topic_tables(c: Collection) -> tuple[DataFrame, DataFrame]:
    """doc_topics(doc_id, topic, p) and topic_terms(topic, term, p): 0.55 for topic doc_id mod TOPIC_COUNT, 0.05 for each other."""
    topics = F.explode(F.sequence(F.lit(0), F.lit(TOPIC_COUNT - 1)))
    own = F.col("doc_id") % TOPIC_COUNT
    docs = c.docs.select("doc_id", topics.alias("topic")).withColumn("p", F.when(F.col("topic") == own, 0.55).otherwise(0.05))
    words = c.postings.withColumn("topic", own.cast("int")).groupBy("topic", "term").agg(F.sum("tf").alias("n"))
    return docs, words.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("topic"))).select("topic", "term", "p")


def topic_probability(c: Collection) -> DataFrame:
    """query_id, doc_id, term, bp: sum over topics of p(z|d) p(w|z) for the hits and the query's terms."""
    docs, words = topic_tables(c)
    pairs = c.hits.select("query_id", "doc_id").join(docs, "doc_id")
    words = words.join(few(c.query_terms.select("query_id", "term"), c.n_terms), "term").withColumnRenamed("p", "pw")
    return pairs.join(few(words, c.n_terms * TOPIC_COUNT), ["query_id", "topic"]).groupBy("query_id", "doc_id", "term").agg(F.sum(F.col("p") * F.col("pw")).alias("bp"))


def with_topics(c: Collection) -> DataFrame:
    return c.matrix().join(topic_probability(c), ["query_id", "doc_id", "term"], "left").withColumn("bp", F.coalesce("bp", F.lit(0.0)))


_TOPIC_SQL = f"""
dt AS (SELECT doc_id, topic, CASE WHEN topic = doc_id % {TOPIC_COUNT} THEN 0.55e0 ELSE 0.05e0 END AS p FROM docs, (SELECT unnest(range({TOPIC_COUNT})) AS topic)),
tw AS (SELECT doc_id % {TOPIC_COUNT} AS topic, term, sum(tf) AS n FROM post GROUP BY ALL), tt AS (SELECT topic, term, n / sum(n) OVER (PARTITION BY topic) AS p FROM tw),
bp AS (SELECT h.query_id, h.doc_id, qt.term, sum(dt.p * tt.p) AS bp FROM hits h JOIN qt USING (query_id) JOIN dt USING (doc_id) JOIN tt ON tt.topic = dt.topic AND tt.term = qt.term GROUP BY ALL),
x AS (SELECT m.*, coalesce(bp, 0e0) AS bp FROM m LEFT JOIN bp USING (query_id, doc_id, term))"""
QUERIES["lda_prob"] = lambda spark, sf: topic_probability(Collection(spark, sf)).select("query_id", "doc_id", "term", F.round("bp", 9).alias("p"))
ORACLE_SQL["lda_prob"] = f"WITH {duck.HITS}, {duck.matrix()}, {_TOPIC_SQL} SELECT query_id, doc_id, term, round(bp, 9) AS p FROM bp"
TOPIC_SCORERS = {
    **{f"lda_mode{k}": SC.Scorer(p) for k, p in SC.MODES.items()},
    "lda_linear": SC.Scorer(f"(lam * {SC.DIR} + (1 - lam) * bp)"),
    "lda_loglinear": SC.Scorer(f"(CASE WHEN bp > 0 THEN pow({SC.DIR}, lam) * pow(bp, 1 - lam) ELSE {SC.DIR} END)"),
    "time_lda": SC.Scorer("((tf + mu * ((1 - lam) * cp)) / (len + mu))"),
}
_TOPIC_SUMS = {**{f"lda_mode{k}": x for k, x in R.MODE_SQL.items()}, "lda_linear": "qw * ln((pd + bp) / 2)", "lda_loglinear": "qw * CASE WHEN bp > 0 THEN (ln(pd) + ln(bp)) / 2 ELSE ln(pd) END", "time_lda": "qw * (ln(tf + 1250e0 * cp) - ln(len + 2500e0))"}
for _name, _scorer in TOPIC_SCORERS.items():
    QUERIES[f"rank_{_name}"] = lambda spark, sf, s=_scorer: SC.apply(with_topics(Collection(spark, sf)), s)
    ORACLE_SQL[f"rank_{_name}"] = f"WITH {duck.HITS}, {duck.matrix()}, {_TOPIC_SQL}, {R.scored_sql('x', _TOPIC_SUMS[_name])} {duck.ranking('f')}"
QUERIES["rank_lda_kde"] = lambda spark, sf: SC.rank_with_density(c := Collection(spark, sf), with_topics(c), SC.MODES[3])
ORACLE_SQL["rank_lda_kde"] = f"WITH {duck.HITS}, {duck.matrix()}, {_TOPIC_SQL}, {R.kde_sql(1000, R.ALIKE)}, {R.scored_sql('x', R.MODE_SQL[3], name='f0')}, {R._BLEND} {duck.ranking('f')}"


def binned_topics(c: Collection) -> DataFrame:
    """bin, topic, term, p: a topic's words among the documents of a bin (of its own topic, doc_id mod TOPIC_COUNT)."""
    words = c.occurrences().withColumn("topic", (F.col("doc_id") % TOPIC_COUNT).cast("int")).groupBy("bin", "topic", "term").agg(F.sum("tf").alias("n"))
    return words.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("bin", "topic"))).select("bin", "topic", "term", "p")


def binned_topic_probability(c: Collection) -> DataFrame:
    """query_id, doc_id, term, bp: sum over topics of p(z|d) p(w|z, the document's bin)."""
    docs, _ = topic_tables(c)
    words = binned_topics(c).join(few(c.query_terms.select("query_id", "term"), c.n_terms), "term").withColumnRenamed("p", "pw")
    pairs = c.hits.select("query_id", "doc_id", "bin").join(docs, "doc_id")
    return pairs.join(few(words, c.n_terms * TOPIC_COUNT * BINS), ["query_id", "bin", "topic"]).groupBy("query_id", "doc_id", "term").agg(F.sum(F.col("p") * F.col("pw")).alias("bp"))


def topic_time_probability(c: Collection) -> DataFrame:
    """query_id, doc_id, term, p: sum over topics of p(z|d) p(w|z) p(the document's bin|z), a join of three tables."""
    docs, words = topic_tables(c)
    when = c.docs.groupBy((F.col("doc_id") % TOPIC_COUNT).cast("int").alias("topic"), "bin").agg(F.sum("len").alias("n"))
    when = when.select("topic", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("topic"))).alias("pt"))
    words = words.join(few(c.query_terms.select("query_id", "term"), c.n_terms), "term").withColumnRenamed("p", "pw")
    pairs = c.hits.select("query_id", "doc_id", "bin").join(docs, "doc_id").join(few(when, TOPIC_COUNT * BINS), ["topic", "bin"])
    return pairs.join(few(words, c.n_terms * TOPIC_COUNT), ["query_id", "topic"]).groupBy("query_id", "doc_id", "term").agg(F.round(F.sum(F.col("p") * F.col("pw") * F.col("pt")), 9).alias("p"))


def with_binned_topics(c: Collection) -> DataFrame:
    return c.matrix().join(binned_topic_probability(c), ["query_id", "doc_id", "term"], "left").withColumn("bp", F.coalesce("bp", F.lit(0.0)))


_DT = f"dt AS (SELECT doc_id, topic, CASE WHEN topic = doc_id % {TOPIC_COUNT} THEN 0.55e0 ELSE 0.05e0 END AS p FROM docs, (SELECT unnest(range({TOPIC_COUNT})) AS topic))"
for _mode in SC.MODES:
    QUERIES[f"rank_binned_lda_mode{_mode}"] = lambda spark, sf, k=_mode: SC.apply(with_binned_topics(Collection(spark, sf)), SC.Scorer(SC.MODES[k]))
    ORACLE_SQL[f"rank_binned_lda_mode{_mode}"] = f"""WITH {duck.HITS}, {duck.matrix()}, {_DT}, bw AS (SELECT bin, doc_id % {TOPIC_COUNT} AS topic, term, sum(tf) AS n FROM post GROUP BY ALL), bt AS (SELECT *, n / sum(n) OVER (PARTITION BY bin, topic) AS p FROM bw),
bp AS (SELECT h.query_id, h.doc_id, qt.term, sum(dt.p * bt.p) AS bp FROM hits h JOIN qt USING (query_id) JOIN dt ON dt.doc_id = h.doc_id JOIN bt ON bt.bin = h.bin AND bt.topic = dt.topic AND bt.term = qt.term GROUP BY ALL),
x AS (SELECT m.*, coalesce(bp, 0e0) AS bp FROM m LEFT JOIN bp USING (query_id, doc_id, term)), {R.scored_sql("x", R.MODE_SQL[_mode])} {duck.ranking("f")}"""
QUERIES["lda_time_prob"] = lambda spark, sf: topic_time_probability(Collection(spark, sf))
ORACLE_SQL["lda_time_prob"] = f"""WITH {duck.HITS}, {_DT}, tw AS (SELECT doc_id % {TOPIC_COUNT} AS topic, term, sum(tf) AS n FROM post GROUP BY ALL), tt AS (SELECT topic, term, n / sum(n) OVER (PARTITION BY topic) AS p FROM tw),
tn AS (SELECT doc_id % {TOPIC_COUNT} AS topic, bin, sum(len) AS n FROM docs GROUP BY ALL), tm AS (SELECT topic, bin, n / sum(n) OVER (PARTITION BY topic) AS p FROM tn)
SELECT h.query_id, h.doc_id, qt.term, round(sum(dt.p * tt.p * tm.p), 9) AS p FROM hits h JOIN qt USING (query_id) JOIN dt ON dt.doc_id = h.doc_id JOIN tt ON tt.topic = dt.topic AND tt.term = qt.term JOIN tm ON tm.topic = dt.topic AND tm.bin = h.bin GROUP BY ALL"""


def with_clusters(c: Collection) -> DataFrame:
    """The matrix of hits with bp: the term's share of the tokens of the hit's cluster (the label of the embedding of the same id); 0 for a hit without one."""
    member = table(c.spark, c.sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster"))
    tokens = c.postings.join(member, "doc_id").groupBy("cluster", "term").agg(F.sum("tf").alias("n")).withColumn("bp", F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))).drop("n")
    m = c.matrix().join(member, "doc_id", "left")
    return m.join(tokens, ["cluster", "term"], "left").withColumn("bp", F.coalesce("bp", F.lit(0.0)))


QUERIES["rank_cluster"] = lambda spark, sf: SC.apply(with_clusters(Collection(spark, sf)), SC.Scorer(SC.MODES[3]))
ORACLE_SQL["rank_cluster"] = f"""WITH {duck.HITS}, {duck.matrix()}, cm AS (SELECT vec_id AS doc_id, label AS cluster FROM embeddings), ct AS (SELECT cluster, term, sum(tf) AS n FROM post JOIN cm USING (doc_id) GROUP BY ALL),
cp2 AS (SELECT cluster, term, n / sum(n) OVER (PARTITION BY cluster) AS bp FROM ct), x AS (SELECT m.*, coalesce(cp2.bp, 0e0) AS bp FROM m LEFT JOIN cm USING (doc_id) LEFT JOIN cp2 ON cp2.cluster = cm.cluster AND cp2.term = m.term),
{R.scored_sql("x", R.MODE_SQL[3])} {duck.ranking("f")}"""

#: A relevance model whose documents also weigh by the density of the hits at their time.
QUERIES["rm_density"] = lambda spark, sf: FB.relevance_model(c := Collection(spark, sf), weights=SC.densities(c, 1000).withColumnRenamed("dens", "w")).select("query_id", "term", F.round("rm", 6).alias("rm"))
ORACLE_SQL["rm_density"] = f"""WITH {duck.HITS}, {R.kde_sql(1000)}, r0 AS (SELECT h.query_id, p.term, sum(tf / h.len * e * dens) AS rm FROM hits h JOIN post p ON p.doc_id = h.doc_id JOIN kd ON kd.query_id = h.query_id AND kd.doc_id = h.doc_id WHERE rank <= 50 GROUP BY ALL),
r1 AS (SELECT * FROM r0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rm, 10) DESC, term) <= 20) SELECT query_id, term, round(rm / sum(rm) OVER (PARTITION BY query_id), 6) AS rm FROM r1"""

# --- feedback by bin ---------------------------------------------------------------------------


def bin_models(c: Collection) -> DataFrame:
    """query_id, bin, term, rm: one relevance model for each bin, over the documents of the bin among the feedback documents."""
    each = c.hit_tokens.filter(F.col("rank") <= Params.fb_docs)
    docs = c.hits.filter(F.col("rank") <= Params.fb_docs).groupBy("query_id", "bin").agg(F.count("*").alias("n"))
    out = each.groupBy("query_id", "bin", "term").agg(F.sum(F.col("tf") / F.col("len") * F.col("e")).alias("x")).join(F.broadcast(docs), ["query_id", "bin"])
    return out.select("query_id", "bin", "term", F.round(F.col("x") / F.col("n"), 9).alias("rm"))


QUERIES["rm_per_bin"] = lambda spark, sf: bin_models(Collection(spark, sf))
ORACLE_SQL["rm_per_bin"] = f"""WITH {duck.HITS}, n AS (SELECT query_id, bin, count(*) AS n FROM hits WHERE rank <= {Params.fb_docs} GROUP BY ALL)
SELECT h.query_id, h.bin, p.term, round(sum(tf / h.len * e) / any_value(n.n), 9) AS rm FROM hits h JOIN post p ON p.doc_id = h.doc_id JOIN n ON n.query_id = h.query_id AND n.bin = h.bin WHERE rank <= {Params.fb_docs} GROUP BY h.query_id, h.bin, p.term"""


def kernel_models(c: Collection, sd: float = 2.0) -> DataFrame:
    """query_id, bin, term, rm: every feedback document counts in every bin by a normal density around its own; terms of under three letters or with digits go, the heaviest of a bin stay."""
    bins = F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("b")
    first = FB.clipped(c.hit_tokens.filter(F.col("rank") <= Params.fb_docs).filter("length(term) >= 3 and not term rlike '[0-9]'").groupBy("query_id", "term").agg(F.sum(F.col("tf") / F.col("len") * F.col("e")).alias("rm")), 100)
    each = c.hit_tokens.filter(F.col("rank") <= Params.fb_docs).join(few(first.select("query_id", "term"), 100 * len(c.topics)), ["query_id", "term"], "left_semi").select("query_id", "bin", "term", (F.col("tf") / F.col("len") * F.col("e")).alias("x"), bins)
    near = F.exp(-F.pow(F.col("bin") - F.col("b"), F.lit(2)) / (2 * sd * sd)) / (sd * np.sqrt(2 * np.pi))
    out = each.groupBy("query_id", "b", "term").agg(F.sum(F.col("x") * near).alias("rm"))
    order = Window.partitionBy("query_id", "b").orderBy(F.round("rm", 12).desc(), "term")
    out = out.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= Params.fb_terms)
    return out.select("query_id", F.col("b").alias("bin"), "term", F.round(F.col("rm") / F.sum("rm").over(Window.partitionBy("query_id", "b")), 6).alias("rm"))


QUERIES["rm_kernel"] = lambda spark, sf: kernel_models(Collection(spark, sf))
ORACLE_SQL["rm_kernel"] = f"""WITH {duck.HITS}, k0 AS (SELECT query_id, p.term, h.bin, tf / h.len * e AS x FROM hits h JOIN post p ON p.doc_id = h.doc_id WHERE rank <= {Params.fb_docs} AND length(p.term) >= 3 AND NOT regexp_matches(p.term, '[0-9]')),
k1a AS (SELECT query_id, term, sum(x) AS rm FROM k0 GROUP BY query_id, term),
k1 AS (SELECT query_id, term FROM k1a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rm, 10) DESC, term) <= 100),
k2 AS (SELECT query_id, b.bin, term, sum(x * exp(-pow(k0.bin - b.bin, 2) / 8e0) / (2e0 * sqrt(2 * pi()))) AS rm FROM k0 JOIN k1 USING (query_id, term), bins b GROUP BY ALL),
k3 AS (SELECT * FROM k2 QUALIFY row_number() OVER (PARTITION BY query_id, bin ORDER BY round(rm, 12) DESC, term) <= {Params.fb_terms}) SELECT query_id, bin, term, round(rm / sum(rm) OVER (PARTITION BY query_id, bin), 6) AS rm FROM k3"""
QUERIES["bin_likelihood"] = lambda spark, sf: SC.best_query_bins(Collection(spark, sf)).select("query_id", F.col("b").alias("bin"), F.round("ll", 6).alias("ll"), F.round("post", 6).alias("post"))
ORACLE_SQL["bin_likelihood"] = f"WITH {duck.BASE}, {R._QB} SELECT query_id, CAST(b AS INTEGER) AS bin, round(ll, 6) AS ll, round(e / sum(e) OVER (PARTITION BY query_id), 6) AS post FROM qb"


# --- routines that need numpy: one query's hits, or one series, at a time ----------------------


def _by_query(c: Collection, fn, schema: str) -> DataFrame:
    """A query has at most NUM_RESULTS hits, which bounds each group."""
    return c.hits.select("query_id", "doc_id", "epoch", "bin", "ql", "rank").groupBy("query_id").applyInPandas(fn, schema)


def kde_grid(c: Collection) -> DataFrame:
    def fn(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rank")
        x = p.epoch.to_numpy(float) / 86400
        grid, y = N.density(x, (p.ql / p.ql.sum()).to_numpy(), N.plug_in(x))
        return pd.DataFrame({"query_id": p.query_id.iloc[0], "doc_id": p.doc_id, "density": N.nearest(grid, y, p.epoch.to_numpy(float) / 86400), "mean": y.mean(), "sd": y.std(ddof=1)})

    return _by_query(c, fn, "query_id string, doc_id long, density double, mean double, sd double")


def modes(c: Collection) -> DataFrame:
    def fn(p: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(p.epoch.to_numpy(float) / 86400)
        top, low = N.extrema(N.density(x)[1])
        return pd.DataFrame([(p.query_id.iloc[0], len(top), len(low), N.multimodality(x, draws=50))], columns=["query_id", "maxima", "minima", "p"])

    return _by_query(c, fn, "query_id string, maxima int, minima int, p double")


def cluster_feedback(c: Collection) -> DataFrame:
    """query_id, cluster, term, rm: a Gaussian mixture over time and score groups the feedback documents; each document weighs by its own score and its group's mean."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        p = p[p["rank"] <= Params.fb_docs].sort_values("rank")
        labels = N.mixture(np.stack([p.epoch.to_numpy(float), p.ql.to_numpy()], axis=1))
        means = pd.Series(np.exp(p.ql - p.ql.max())).groupby(labels).transform("mean").to_numpy()
        return pd.DataFrame({"query_id": p.query_id, "doc_id": p.doc_id, "cluster": labels, "w": means})

    member = _by_query(c, fn, "query_id string, doc_id long, cluster int, w double")
    each = c.hit_tokens.join(few(member, c.n_hits), ["query_id", "doc_id"])
    rm = each.groupBy("query_id", "cluster", "term").agg(F.sum(F.col("tf") / F.col("len") * F.col("e") * F.exp("w")).alias("rm"))
    order = Window.partitionBy("query_id", "cluster").orderBy(F.round("rm", 10).desc(), "term")
    return rm.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= Params.fb_terms).drop("k")


def _by_series(df: DataFrame, fn, schema: str) -> DataFrame:
    return df.select("name", "xs", "bg").mapInPandas(lambda it: (fn(p) for p in it), schema)


def _event_series(spark, sf):
    from tideline.plans.timeseries import event_series

    return event_series(spark, sf)


def bursts(spark, sf) -> DataFrame:
    def fn(p: pd.DataFrame) -> pd.DataFrame:
        states = [N.bursts(np.array(x), np.array(b)) for x, b in zip(p["xs"], p["bg"], strict=True)]
        return pd.DataFrame({"name": p["name"], "bins": [s.tolist() for s in states], "duration": [float(s.mean()) for s in states]})

    return _by_series(_event_series(spark, sf), fn, "name string, bins array<int>, duration double")


def changes(spark, sf) -> DataFrame:
    def fn(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": p["name"], "at": [N.changepoints(np.array(x)) for x in p["xs"]]})

    return _by_series(_event_series(spark, sf), fn, "name string, at array<int>")


def mixture_series(c: Collection, weight: float = 0.5, rounds: int = 50, change: float = 1e-6) -> DataFrame:
    """bin, term, p: a bin's own model in the mixture weight * own + (1 - weight) * collection, by expectation maximisation from a uniform start.

    A term's probability after k rounds follows from its count, its background and the k sums that its bin was divided by: only these sums, a
    number for each bin and round, are carried along, and each round is one aggregate. A bin stops when its likelihood changes by less
    than `change` of itself.
    """
    each = c.term_stats().select("term", (F.col("cf") / F.col("n_tokens")).alias("bg"), F.posexplode("xs").alias("bin", "n")).filter("n > 0")
    counts = c.stored("bin_models", each)
    sizes = {r["bin"]: r["k"] for r in counts.groupBy("bin").agg(F.count("*").alias("k")).collect()}  # a row a bin
    sums: dict[int, list[float]] = {b: [] for b in sizes}
    last, open_ = dict.fromkeys(sizes, float("-inf")), set(sizes)

    def own(state: DataFrame) -> DataFrame:
        step = lambda p, z: F.col("n") * weight * p / (weight * p + (1 - weight) * F.col("bg")) / z
        return counts.join(F.broadcast(state), "bin").withColumn("p", F.aggregate("zs", 1 / F.col("k"), step))

    def state(bins: set[int]) -> DataFrame:
        return c.spark.createDataFrame([(b, float(sizes[b]), sums[b]) for b in sorted(bins)], "bin int, k double, zs array<double>")

    for _ in range(rounds):
        if not open_:
            break
        mixed = weight * F.col("p") + (1 - weight) * F.col("bg")
        found = own(state(open_)).groupBy("bin").agg(F.sum(F.col("n") * weight * F.col("p") / mixed).alias("z"), F.sum(F.col("n") * F.ln(mixed)).alias("ll"))
        for r in found.collect():
            done = abs(r["ll"] - last[r["bin"]]) < change * abs(r["ll"])
            last[r["bin"]] = r["ll"]
            if done:
                open_.discard(r["bin"])
            else:
                sums[r["bin"]].append(r["z"])
    return own(state(set(sizes))).select("bin", "term", "p")


def t_test(c: Collection) -> DataFrame:
    d = evaluation.paired(c, "dirichlet", "tsm_linear").agg(F.count("*").alias("n"), F.avg(F.col("x") - F.col("y")).alias("m"), F.stddev_samp(F.col("x") - F.col("y")).alias("sd"))

    def fn(it):
        for p in it:
            t = (p.m / (p.sd / np.sqrt(p.n))).fillna(0.0).to_numpy(float)
            yield pd.DataFrame({"t": t.round(4), "p_less": [round(N.student_below(v, n - 1), 3) if np.isfinite(v) else 0.5 for v, n in zip(t, p.n, strict=True)]})

    return d.mapInPandas(fn, "t double, p_less double")


def p_less(t: str, n: str) -> str:
    """SQL: the chance that Student's t with n - 1 degrees lies below t, by Simpson's rule over tan-spaced points (the density in an angle is a power of its cosine)."""
    f = f"pow(cos(a), {n} - 2)"
    return f"(SELECT sum(w * {f}) FROM (SELECT CASE WHEN i IN (0, 1000) THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END AS w, -pi() / 2 + i / 1000e0 * (atan({t} / sqrt({n} - 1e0)) + pi() / 2) AS a FROM (SELECT unnest(range(1001)) AS i))) * (atan({t} / sqrt({n} - 1e0)) + pi() / 2) / (SELECT sum(w * {f}) FROM (SELECT CASE WHEN i IN (0, 1000) THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END AS w, -pi() / 2 + i / 1000e0 * pi() AS a FROM (SELECT unnest(range(1001)) AS i))) / pi()"


def lasso(c: Collection) -> DataFrame:
    """predictor, coefficient of a lasso of average precision on the pre-retrieval predictors."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = evaluation.run_measures(c, SC.rank_with(c, "dirichlet")).select("query_id", F.col("map").alias("label")).join(evaluation.pre_retrieval(c), "query_id").fillna(0.0)
    names = list(evaluation._PRE)
    model = LinearRegression(elasticNetParam=1.0, regParam=0.01).fit(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    return c.spark.createDataFrame(list(zip(names, map(float, model.coefficients), strict=True)), "predictor string, coefficient double")


QUERIES |= {
    "kde_grid": lambda spark, sf: kde_grid(Collection(spark, sf)),
    "kde_modes": lambda spark, sf: modes(Collection(spark, sf)),
    "gmm_feedback": lambda spark, sf: cluster_feedback(Collection(spark, sf)),
    "bursts": bursts,
    "changepoints": changes,
    "em_mixture": lambda spark, sf: mixture_series(Collection(spark, sf)),
    "ttest": lambda spark, sf: t_test(Collection(spark, sf)),
    "lasso": lambda spark, sf: lasso(Collection(spark, sf)),
    "stem": lambda spark, sf: stems(Collection(spark, sf)),
}


#: The most frequent terms of the collection that are known words to the stemmer, and how often they occur at least.
LEXICON, LEXICON_LEAST = 100_000, 20


def stems(c: Collection) -> DataFrame:
    """stem, tokens and terms of it; the collection's frequent terms are the lexicon."""
    from tideline.functions.text import stemmer

    words = c.term_stats().filter((F.col("cf") >= LEXICON_LEAST) & ~F.col("term").rlike("[0-9]")).orderBy(F.desc("cf"), "term").limit(LEXICON).select("term")
    stem = stemmer(c.spark, {r[0] for r in words.collect()})
    return c.term_stats().withColumn("stem", stem("term")).groupBy("stem").agg(F.sum("cf").cast("long").alias("tf"), F.count("*").alias("terms"))


def query_statistics(c: Collection) -> DataFrame:
    """For each query: moments of its hits' times and scores, and of its score mass over bins."""
    hits = c.hits.withColumn("e", F.exp(F.col("ql") - F.max("ql").over(Window.partitionBy("query_id"))))
    per = hits.groupBy("query_id", "bin").agg(F.sum("e").alias("x")).groupBy("query_id").agg(S.dense(F.collect_list(F.struct("bin", "x")), BINS).alias("xs"))
    per = per.withColumn("bg", F.col("xs"))
    stats = FB.with_stats(per).select("query_id", *(F.round(x, 6).alias(x) for x in ("acf1", "acf2", "acf3", "kurt", "skew", "ent", "dp")))
    times = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.skewness("bin"), 6).alias("time_skew"), F.round(F.kurtosis("bin") + 3, 6).alias("time_kurt"), F.round(F.avg("ql"), 6).alias("score_avg"), F.round(F.stddev_samp("ql"), 6).alias("score_sd"))
    return stats.join(times, "query_id")


QUERIES["query_statistics"] = lambda spark, sf: query_statistics(Collection(spark, sf))
ORACLE_SQL["query_statistics"] = f"""WITH {duck.HITS}, d AS (SELECT q.query_id, b.bin AS t, coalesce(sum(e), 0e0) AS x, coalesce(sum(e), 0e0) AS bg FROM (SELECT DISTINCT query_id FROM hits) q CROSS JOIN bins b LEFT JOIN hits h ON h.query_id = q.query_id AND h.bin = b.bin GROUP BY ALL),
{duck.stats_of("d", "query_id", "st")}, c AS (SELECT *, bin - avg(bin) OVER (PARTITION BY query_id) AS z FROM hits),
ti AS (SELECT query_id, count(*) AS n, round(avg(pow(z, 3)) / pow(avg(pow(z, 2)), 1.5e0), 6) AS time_skew, round(avg(pow(z, 4)) / pow(avg(pow(z, 2)), 2), 6) AS time_kurt, round(avg(ql), 6) AS score_avg, round(stddev_samp(ql), 6) AS score_sd FROM c GROUP BY query_id)
SELECT query_id, {", ".join(f"round({x}, 6) AS {x}" for x in ("acf1", "acf2", "acf3", "kurt", "skew", "ent", "dp"))}, ti.n AS n, time_skew, time_kurt, score_avg, score_sd FROM st JOIN ti USING (query_id)"""


ORACLE_SQL["ttest"] = f"""WITH {evaluation._paired_sql("dirichlet", "tsm_linear")}, s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(x - y) / nullif(stddev_samp(x - y) / sqrt(count(*)), 0) AS v FROM xy)
SELECT round(coalesce(v, 0e0), 4) AS t, round({p_less("coalesce(v, 0e0)", "n")}, 3) AS p_less FROM s"""


def logistic(c: Collection, level: float = 0.5) -> DataFrame:
    """query_id, high, p: whether a topic's average precision is above the given part of the best, and its chance by a ridge logistic regression on the pre-retrieval predictors of all other topics."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = evaluation.run_measures(c, SC.rank_with(c, "dirichlet")).join(evaluation.pre_retrieval(c), "query_id").fillna(0.0)
    rows = rows.withColumn("high", (F.col("map") > level * F.max("map").over(Window.partitionBy(F.lit(1)))).cast("double"))
    rows = VectorAssembler(inputCols=list(evaluation._PRE), outputCol="features").transform(rows).select("query_id", "high", "features").persist()
    out = None
    for q in sorted(c.topics):  # one model for each topic: as many as there are topics
        model = LogisticRegression(labelCol="high", regParam=0.1, elasticNetParam=0.0).fit(rows.filter(F.col("query_id") != q))
        own = model.transform(rows.filter(F.col("query_id") == q)).select("query_id", F.col("high").cast("int").alias("high"), F.element_at(vector_to_array("probability"), -1).alias("p"))
        out = own if out is None else out.unionByName(own)
    return out


QUERIES["logistic_loo"] = lambda spark, sf: logistic(Collection(spark, sf))
