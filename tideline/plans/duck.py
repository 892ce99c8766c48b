"""Independent SQL formulations of the ranking plans, for checking: relational, with windows where the plans use arrays."""

from __future__ import annotations

from tideline.operators.collection import BINS, INTERVAL, NUM_RESULTS, START, TOPICS

_TOPICS = ", ".join(f"('{q}', '{t}', 1e0)" for q, ts in TOPICS.items() for t in ts)

BASE = f"""
raw AS (SELECT doc_id, {START} + (doc_id * 7919 * 3600) % {BINS * INTERVAL} AS epoch,
  list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9 ]', ' ', 'g')), ' '), lambda x: x <> '') AS toks FROM documents),
docs AS (SELECT doc_id, CAST(epoch AS BIGINT) AS epoch, CAST((epoch - {START}) // {INTERVAL} AS INTEGER) AS bin, CAST(len(toks) AS DOUBLE) AS len, toks FROM raw),
tok AS (SELECT doc_id, bin, epoch, len, unnest(toks) AS term FROM docs),
post AS (SELECT doc_id, bin, epoch, len, term, CAST(count(*) AS DOUBLE) AS tf FROM tok GROUP BY ALL),
qt(query_id, term, qw) AS (VALUES {_TOPICS}),
coll AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, CAST(sum(len) AS DOUBLE) AS n_tokens FROM docs),
stats AS (SELECT term, sum(tf) AS cf, CAST(count(*) AS DOUBLE) AS df, (1 + sum(tf)) / any_value(n_tokens) AS cp, any_value(n_docs) AS n_docs, any_value(n_tokens) AS n_tokens FROM post, coll GROUP BY term),
bins AS (SELECT CAST(unnest(range({BINS})) AS INTEGER) AS bin),
tot AS (SELECT b.bin, coalesce(sum(len), 0e0) AS total FROM bins b LEFT JOIN docs d ON b.bin = d.bin GROUP BY b.bin),
tb AS (SELECT term, bin, sum(tf) AS ts FROM post GROUP BY term, bin)"""

HITS = f"""{BASE},
cand AS (SELECT DISTINCT query_id, doc_id, p.bin, epoch, len FROM post p JOIN qt USING (term)),
hit0 AS (SELECT c.query_id, c.doc_id, c.bin, c.epoch, c.len, sum(qw * ln((coalesce(tf, 0e0) + 2500e0 * cp) / (c.len + 2500e0))) AS ql
  FROM cand c JOIN qt USING (query_id) JOIN stats USING (term) LEFT JOIN post p ON p.doc_id = c.doc_id AND p.term = qt.term GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ql, 6) DESC, doc_id) AS rank, exp(ql - max(ql) OVER (PARTITION BY query_id)) AS e FROM hit0
  QUALIFY rank <= {NUM_RESULTS})"""


def matrix(weights: str = "qt", name: str = "m") -> str:
    """CTE `name`: hits by terms of a table of weights."""
    return f"""
{name}w AS (SELECT query_id, term, qw, sum(qw) OVER (PARTITION BY query_id) AS qlen FROM {weights}),
{name} AS (SELECT h.*, w.term, w.qw, w.qlen, coalesce(p.tf, 0e0) AS tf, cp, cf, df, n_docs, n_tokens, coalesce(tb.ts, 0e0) AS ts, tot.total, coalesce(tb.ts, 0e0) / tot.total AS tp,
  cf AS tsum
  FROM hits h JOIN {name}w w ON h.query_id = w.query_id JOIN stats s ON s.term = w.term LEFT JOIN post p ON p.doc_id = h.doc_id AND p.term = w.term
  LEFT JOIN tb ON tb.term = w.term AND tb.bin = h.bin JOIN tot ON tot.bin = h.bin)"""


def ranking(source: str, score: str = "score") -> str:
    return f"""SELECT query_id, doc_id, round({score}, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 6) DESC, doc_id) AS rank FROM {source}"""


def stats_of(dense: str, keys: str, name: str) -> str:
    """CTEs ending in `name`: statistics of dense(keys, t, x, bg), with keys as a comma-separated list."""
    part = f"PARTITION BY {keys}"
    return f"""
{name}_a AS (SELECT *, avg(x) OVER ({part}) AS m, avg(bg) OVER ({part}) AS mb, sum(x) OVER ({part}) AS sx, sum(bg) OVER ({part}) AS sb, count(*) OVER ({part}) AS n,
  lead(x, 1) OVER ({part} ORDER BY t) AS x1, lead(x, 2) OVER ({part} ORDER BY t) AS x2, lead(x, 3) OVER ({part} ORDER BY t) AS x3 FROM {dense}),
{name}_b AS (SELECT {keys}, any_value(n) AS n, any_value(m) AS m, any_value(sx) AS sx,
  CASE WHEN sum((x - m) * (x - m)) > 1e-12 THEN sum((x - m) * (x1 - m)) / sum((x - m) * (x - m)) ELSE 0e0 END AS acf1,
  CASE WHEN sum((x - m) * (x - m)) > 1e-12 THEN sum((x - m) * (x2 - m)) / sum((x - m) * (x - m)) ELSE 0e0 END AS acf2,
  CASE WHEN sum((x - m) * (x - m)) > 1e-12 THEN sum((x - m) * (x3 - m)) / sum((x - m) * (x - m)) ELSE 0e0 END AS acf3,
  CASE WHEN sum((x - m) * (x - m)) > 1e-12 AND sum((bg - mb) * (bg - mb)) > 1e-12 THEN sum((x - m) * (bg - mb)) / sqrt(sum((x - m) * (x - m)) * sum((bg - mb) * (bg - mb))) ELSE 0e0 END AS ccf,
  sum(CASE WHEN x > 0 THEN -(x / sx) * ln(x / sx) ELSE 0e0 END) AS ent,
  sum(CASE WHEN x > 0 AND bg > 0 THEN (x / sx) * ln((x / sx) / (bg / sb)) ELSE 0e0 END) AS tkl,
  sum(CASE WHEN x > 0 AND bg > 0 THEN (x / sx) * ln((x / sx) / bg) ELSE 0e0 END) AS tkl_raw,
  sum((coalesce(x / nullif(sx, 0), 0e0) + 1e-10) * ln((coalesce(x / nullif(sx, 0), 0e0) + 1e-10) / (coalesce(bg / nullif(sb, 0), 0e0) + 1e-10))) AS tkl_plus,
  avg(CASE WHEN x > 0 THEN 1e0 ELSE 0e0 END) AS bp,
  CASE WHEN avg((x - m) ** 2) > 1e-12 THEN avg((x - m) ** 3) / pow(avg((x - m) ** 2), 1.5e0) ELSE 0e0 END AS skew,
  CASE WHEN avg((x - m) ** 2) > 1e-12 THEN avg((x - m) ** 4) / pow(avg((x - m) ** 2), 2e0) ELSE 0e0 END AS kurt
  FROM {name}_a GROUP BY {keys}),
{name}_f AS (SELECT {keys}, k, round(any_value(CASE WHEN 2 * k = n THEN 0.5e0 ELSE 1e0 END) * 2 * (pow(sum(x * cos(2 * pi() * k * t / n)), 2) + pow(sum(x * sin(2 * pi() * k * t / n)), 2)) / any_value(n), 9) AS pw
  FROM {name}_a, (SELECT unnest(range(1, {BINS // 2 + 1})) AS k) GROUP BY {keys}, k),
{name}_g AS (SELECT {keys}, max(pw) AS dps, avg(pw) AS avg_spec FROM {name}_f GROUP BY {keys}),
{name}_h AS (SELECT {keys}, min(k) AS kmax FROM {name}_f JOIN {name}_g USING ({keys}) WHERE pw = dps GROUP BY {keys}),
{name} AS (SELECT *, CASE WHEN abs(1 - acf1 * acf1) > 1e-12 THEN (acf2 - acf1 * acf1) / (1 - acf1 * acf1) ELSE 0e0 END AS pacf2, n / CAST(kmax AS DOUBLE) AS dp,
  1 - exp(-tkl) AS tklc, CASE WHEN tkl > 0 THEN exp(-1 / tkl) ELSE 0e0 END AS tkli FROM {name}_b JOIN {name}_g USING ({keys}) JOIN {name}_h USING ({keys}))"""


def dense_terms(terms: str, name: str) -> str:
    """CTE: collection series of the terms of a table, with the bin totals as background."""
    return f"""{name} AS (SELECT k.term, b.bin AS t, coalesce(tb.ts, 0e0) AS x, tot.total AS bg FROM (SELECT DISTINCT term FROM {terms}) k, bins b LEFT JOIN tb ON tb.term = k.term AND tb.bin = b.bin JOIN tot ON tot.bin = b.bin)"""


def dense_query(terms: str, name: str, sma: int = 0) -> str:
    """CTE: query-time series of the terms (query_id, term) of a table, in weight tf / len * e, with the query's totals as background."""
    smooth = lambda c: f"CASE WHEN t >= {sma - 1} THEN (sum({c}) OVER (PARTITION BY query_id, term ORDER BY t ROWS BETWEEN {sma - 1} PRECEDING AND CURRENT ROW)) / {sma} ELSE 0e0 END" if sma else c
    return f"""
{name}_w AS (SELECT h.query_id, p.term, h.bin, sum(tf / h.len * e) AS x FROM hits h JOIN post p ON p.doc_id = h.doc_id JOIN (SELECT DISTINCT query_id, term FROM {terms}) k ON k.query_id = h.query_id AND k.term = p.term GROUP BY ALL),
{name}_t AS (SELECT query_id, bin, sum(e) AS x FROM hits GROUP BY ALL),
{name}_d AS (SELECT k.query_id, k.term, b.bin AS t, coalesce(w.x, 0e0) AS x, coalesce(g.x, 0e0) AS bg FROM (SELECT DISTINCT query_id, term FROM {terms}) k, bins b
  LEFT JOIN {name}_w w ON w.query_id = k.query_id AND w.term = k.term AND w.bin = b.bin LEFT JOIN {name}_t g ON g.query_id = k.query_id AND g.bin = b.bin),
{name} AS (SELECT query_id, term, t, {smooth("x")} AS x, {smooth("bg")} AS bg FROM {name}_d)"""


def mutual(dense: str, keys: str, name: str, lag: int = 2, levels: int = 4) -> str:
    """CTEs ending in `name`: mi of x at t and t + lag, in classes of equal width, of dense(keys, t, x)."""
    part = f"PARTITION BY {keys}"
    return f"""
{name}_c AS (SELECT {keys}, t, CASE WHEN hi > lo THEN least(CAST(floor((x - lo) / ((hi - lo) / {levels})) AS INTEGER), {levels - 1}) ELSE 0 END AS k
  FROM (SELECT *, min(x) OVER ({part}) AS lo, max(x) OVER ({part}) AS hi FROM {dense})),
{name}_p AS (SELECT {keys}, k AS a, lead(k, {lag}) OVER ({part} ORDER BY t) AS b FROM {name}_c),
{name}_j AS (SELECT {keys}, a, b, CAST(count(*) AS DOUBLE) AS n FROM {name}_p WHERE b IS NOT NULL GROUP BY {keys}, a, b),
{name}_m AS (SELECT *, sum(n) OVER ({part}) AS total, sum(n) OVER ({part}, a) AS na, sum(n) OVER ({part}, b) AS nb FROM {name}_j),
{name} AS (SELECT {keys}, sum(n / total * ln(n * total / (na * nb))) AS mi FROM {name}_m GROUP BY {keys})"""


def smooth_acf(dense: str, keys: str, name: str) -> str:
    """CTEs ending in `name`: sacf2, the autocorrelation at lag 2 of the average of three, without its first two values."""
    part = f"PARTITION BY {keys}"
    return f"""
{name}_s AS (SELECT {keys}, t, (x + lag(x, 1) OVER ({part} ORDER BY t) + lag(x, 2) OVER ({part} ORDER BY t)) / 3 AS y FROM {dense}),
{name}_u AS (SELECT *, avg(y) OVER ({part}) AS m, lead(y, 2) OVER ({part} ORDER BY t) AS y2 FROM {name}_s WHERE y IS NOT NULL),
{name} AS (SELECT {keys}, CASE WHEN sum((y - m) * (y - m)) > 1e-12 THEN sum((y - m) * (y2 - m)) / sum((y - m) * (y - m)) ELSE 0e0 END AS sacf2 FROM {name}_u GROUP BY {keys})"""
