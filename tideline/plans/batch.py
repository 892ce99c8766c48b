"""Batches of scorers over grids of parameters, and the search for a query's best term weights."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from itertools import groupby, permutations, product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators import feedback as FB
from tideline.operators import scorers as SC
from tideline.operators.collection import NUM_RESULTS, Collection, Params, few
from tideline.plans import duck, evaluation
from tideline.plans import ranking as R
from tideline.session import exists
from tideline.sources import writers

QUERIES, ORACLE_SQL = {}, {}


@dataclass
class Batch:
    """scorers: (scorer, weights): a name of SCORERS, and of REWEIGHTERS or EXPANSIONS or nothing. grid: a list of values for each parameter that varies."""

    sf_dir: str
    out: str
    scorers: list[tuple[str, str]]
    grid: dict[str, list] = field(default_factory=lambda: {"mu": [2500.0]})
    topics: dict[str, list[str]] | None = None

    @classmethod
    def from_config(cls, config: dict, sf_dir: str, out: str = "") -> list[Batch]:
        """One batch for each scorer of a configuration: {"outputDir": ..., "scorers": [{"name": ..., "params": {"mu": "500,1000", "lambda": ...}}]}."""
        names = {"lambda": "lam", "fbDocs": "fb_docs", "fbTerms": "fb_terms"} | {f.name: f.name for f in fields(Params)}
        kinds = {f.name: type(f.default) for f in fields(Params)}
        found = []
        for s in config["scorers"]:
            grid = {names[k]: [kinds[names[k]](float(v)) for v in str(values).split(",")] for k, values in s.get("params", {}).items()}
            pair = (s["name"], "") if s["name"] in SC.SCORERS else ("dirichlet", s["name"])
            found.append(cls(sf_dir, out or config["outputDir"], [pair], grid or {"mu": [2500.0]}))
        return found

    def points(self) -> list[Params]:
        return [Params(**dict(zip(self.grid, v, strict=True))) for v in product(*self.grid.values())]

    def path(self, scorer: str, weights: str, p: Params) -> str:
        return f"{self.out}/{scorer}:{weights or 'query'}/params={p.label(tuple(self.grid), '-')}"


def run_points(c: Collection, scorer: str, weights: str, points: list[Params]) -> DataFrame:
    """point, query_id, doc_id, score, rank: all points of a grid that retrieve alike (by mu) in one plan.

    Weights that depend on feedback are made for all points at once for rm3, else once for each different set of what they depend on.
    """
    grid = SC.grid_table(c, points)
    if not weights:
        m = c.matrix()
    elif weights == "rm3":
        m = c.matrix(FB.rm3_grid(c, grid))
    else:
        make = FB.reweighted if weights in FB.REWEIGHTERS else FB.expanded
        key = lambda p: (p.lag, p.k, p.fb_docs, p.fb_terms, p.lam, p.alpha)
        parts = None
        for _, same in groupby(sorted(range(len(points)), key=lambda i: key(points[i])), lambda i: key(points[i])):
            at = list(same)
            own = make(c, weights, points[at[0]]).withColumn("point", F.explode(F.array(*map(F.lit, at))))
            parts = own if parts is None else parts.unionByName(own)
        m = c.matrix(parts)
    return SC.apply(m, SC.SCORERS[scorer], grid)


def run_batch(spark: SparkSession, batch: Batch) -> list[str]:
    """One run in TREC lines for each point of the grid; what is there already is left as it is. The folders written or found.

    All points that retrieve with the same mu are one job, which writes a folder for each.
    """
    done = []
    for scorer, weights in batch.scorers:
        points = batch.points()
        done += [batch.path(scorer, weights, p) for p in points]
        todo = [p for p in points if not exists(spark, batch.path(scorer, weights, p))]
        for mu, same in groupby(sorted(todo, key=lambda p: p.mu), lambda p: p.mu):
            own = list(same)
            c = Collection(spark, batch.sf_dir, mu=mu, **({"topics": batch.topics} if batch.topics else {}))
            run = run_points(c, scorer, weights, own)
            label = spark.createDataFrame([(i, p.label(tuple(batch.grid), "-")) for i, p in enumerate(own)], "point int, params string")
            lines = writers.run_lines(run.join(F.broadcast(label), "point"), f"{scorer}-{weights or 'query'}", keep=("params",))
            lines.repartition("params").sortWithinPartitions("params", "query_id").select("params", "value").write.mode("append").partitionBy("params").text(f"{batch.out}/{scorer}:{weights or 'query'}")
    return done


def read_config(path: str) -> dict:
    """A batch configuration in the block form of YAML: 'key: value' lines, nested by indentation, and lists of such after '- '. Values are strings."""
    rows = []
    with open(path) as f:
        for line in f:
            text = line.split(" #")[0].rstrip()
            if text.strip() and not text.lstrip().startswith("#"):
                rows.append((len(text) - len(text.lstrip()), text.strip()))

    def block(at: int, depth: int) -> tuple[dict | list, int]:
        out: dict | list = [] if rows[at][1].startswith("- ") else {}
        while at < len(rows) and rows[at][0] == depth:
            text = rows[at][1]
            if isinstance(out, list):
                inner = depth + 2
                rows[at] = (inner, text[2:].strip())
                item, at = block(at, inner)
                out.append(item)
                continue
            key, _, value = text.partition(":")
            at += 1
            if value.strip():
                out[key.strip()] = value.strip()
            elif at < len(rows) and (rows[at][0] > depth or rows[at][0] == depth and rows[at][1].startswith("- ")):
                out[key.strip()], at = block(at, rows[at][0])
            else:
                out[key.strip()] = ""
        return out, at

    return block(0, rows[0][0])[0] if rows else {}


# --- the search for the best weights ------------------------------------------------------


def weight_vectors(terms: int, step: int = 10) -> list[list[float]]:
    """All positive weights in steps of 1 / step that sum to 1, in all orders; a count that the topic's length bounds."""
    if terms == 1:
        return [[1.0]]
    return [[k / step, *[x * (step - k) / step for x in rest]] for k in range(1, step) for rest in _rest(terms - 1, step - k)]


def _rest(terms: int, units: int) -> list[list[float]]:
    if terms == 1:
        return [[1.0]]
    return [[k / units, *[x * (units - k) / units for x in rest]] for k in range(1, units) for rest in _rest(terms - 1, units - k)]


def searched(c: Collection, grid: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, k, value: average precision of each weight vector k of grid(query_id, k, term, w), whose terms are those of terms(query_id, term)."""
    p = F.ln((F.col("tf") + c.mu * F.col("cp")) / (F.col("len") + c.mu))
    m = c.matrix(terms.select("query_id", "term").withColumn("qw", F.lit(1.0))).select("query_id", "doc_id", "term", p.alias("p")).join(grid, ["query_id", "term"])
    s = m.groupBy("query_id", "k", "doc_id").agg(F.sum(F.col("w") * F.col("p")).alias("score"))
    order = Window.partitionBy("query_id", "k").orderBy(F.round("score", 6).desc(), "doc_id")
    ap = evaluation.run_measures(c, s.withColumn("rank", F.row_number().over(order).cast("long")), ("query_id", "k"))
    return ap.select("query_id", "k", F.round("map", 6).alias("value"))


def best_of(found: DataFrame, grid: DataFrame) -> DataFrame:
    """query_id, weights, value: the best vector of each query, the first of equal ones."""
    top = found.groupBy("query_id").agg(F.min_by("k", F.struct(-F.col("value"), F.col("k"))).alias("k"), F.max("value").alias("value"))
    named = grid.groupBy("query_id", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term", "w"))), lambda x: F.format_string("%s:%.1f", x["term"], x["w"])), " ").alias("weights"))
    return top.join(named, ["query_id", "k"]).select("query_id", "weights", "value")


def best_weights(c: Collection) -> DataFrame:
    """query_id, weights, value: of all weight vectors of a query, the one of the highest average precision, the first of equal ones."""
    rows = [(q, k, t, w) for q, ts in c.topics.items() for k, v in enumerate(weight_vectors(len(ts))) for t, w in zip(sorted(ts), v, strict=True)]
    grid = few(c.spark.createDataFrame(rows, "query_id string, k int, term string, w double"), len(rows))
    return best_of(searched(c, grid, c.query_terms), grid)


#: Weights of the heaviest terms of a relevance model, in any order.
VECTORS = [[0.6, 0.3, 0.1], [0.5, 0.5], [1.0], [0.4, 0.3, 0.3]]


def orders(vectors: list[list[float]], terms: int) -> list[tuple[float, ...]]:
    """Every different order of each vector, filled up with zeros to the number of terms."""
    return sorted({o for v in vectors for o in permutations(sorted(v) + [0.0] * (terms - len(v)))})


def best_model_weights(c: Collection, vectors: list[list[float]] = VECTORS, fb_docs: int = Params.fb_docs, terms: int = 3) -> DataFrame:
    """query_id, weights, value: of all orders of the given vectors over a relevance model's heaviest terms (numbers left out), the best.

    The orders are made of the vectors, which are a parameter; terms are numbered in each query by falling weight.
    """
    rm = FB.relevance_model(c, fb_docs, terms, "not term rlike '^[0-9]*$'").persist()  # few rows, read by all that follows
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("rm", 10).desc(), "term")) - 1
    rows = [(k, i, w) for k, v in enumerate(orders(vectors, terms)) for i, w in enumerate(v)]
    each = F.broadcast(c.spark.createDataFrame(rows, "k int, at int, w double"))
    grid = rm.withColumn("at", place).join(each, "at").select("query_id", "k", "term", "w")
    return best_of(searched(c, grid, rm), grid)


def _searched_sql(grid: str) -> str:
    """From g(query_id, k, term, w): query_id, weights, value."""
    return f"""{grid}, gs AS (SELECT h.query_id, g.k, h.doc_id, sum(w * ln((coalesce(p.tf, 0e0) + 2500e0 * cp) / (h.len + 2500e0))) AS score FROM hits h JOIN g ON g.query_id = h.query_id JOIN stats s ON s.term = g.term
  LEFT JOIN post p ON p.doc_id = h.doc_id AND p.term = g.term GROUP BY ALL),
run AS (SELECT query_id, k, doc_id, row_number() OVER (PARTITION BY query_id, k ORDER BY round(score, 6) DESC, doc_id) AS rank FROM gs), {evaluation._measures_sql("run", "query_id, k")},
top AS (SELECT query_id, k, round(map, 6) AS value FROM ev QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(map, 6) DESC, k) = 1)
SELECT top.query_id, string_agg(g.term || ':' || printf('%.1f', g.w), ' ' ORDER BY g.term) AS weights, any_value(value) AS value FROM top JOIN g ON g.query_id = top.query_id AND g.k = top.k GROUP BY top.query_id"""


QUERIES["best_weights"] = lambda spark, sf: best_weights(Collection(spark, sf))
# vectors in tenths, in the order in which nested loops over the first, then the second weight make them
ORACLE_SQL["best_weights"] = f"""WITH {duck.HITS}, {evaluation._REL}, {_searched_sql('''tm AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY term) AS i, count(*) OVER (PARTITION BY query_id) AS n FROM qt),
v AS (SELECT 2 AS n, a - 1 AS k, [a, 10 - a] AS w FROM (SELECT unnest(range(1, 10)) AS a) UNION ALL
  SELECT 3, row_number() OVER (ORDER BY a, b) - 1, [a, b, 10 - a - b] FROM (SELECT unnest(range(1, 10)) AS a), (SELECT unnest(range(1, 10)) AS b) WHERE a + b < 10),
g AS (SELECT query_id, k, term, w[i] / 10e0 AS w FROM tm JOIN v USING (n))''')}"""
QUERIES["best_model_weights"] = lambda spark, sf: best_model_weights(Collection(spark, sf))
_VECTOR_ROWS = ", ".join(f"({k}, {i + 1}, {w!r}e0)" for k, v in enumerate(orders(VECTORS, 3)) for i, w in enumerate(v))
ORACLE_SQL["best_model_weights"] = f"""WITH {duck.HITS}, {evaluation._REL}, {R.RM}, ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rm, 10) DESC, term) AS i FROM rm_0 WHERE NOT regexp_full_match(term, '[0-9]*')),
rn AS (SELECT *, rm / sum(rm) OVER (PARTITION BY query_id) AS share FROM ra WHERE i <= 3), ri AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY round(share, 10) DESC, term) AS i FROM rn),
{_searched_sql(f"v(k, i, w) AS (VALUES {_VECTOR_ROWS}), g AS (SELECT query_id, k, term, w FROM ri JOIN v USING (i))")}"""
