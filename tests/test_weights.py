"""Query weights and scores against plain versions, computed term by term from the collected hits of one small table."""

import math
from collections import Counter, defaultdict

import pytest

from tideline.operators import feedback as FB
from tideline.operators import scorers as SC
from tideline.operators.collection import BINS, Collection, Params
from tideline.plans import ranking as R

SF = "/root/testdata/sf0.001"
TOPICS = {"T1": ["thble", "thtion"], "T3": ["erble", "ertion", "ering"]}


@pytest.fixture(scope="module")
def c(spark):
    return Collection(spark, SF, TOPICS)


@pytest.fixture(scope="module")
def plain(c):
    """Documents, hits in order and collection counts, as Python values."""
    docs = {r["doc_id"]: r for r in c.tokenised.collect()}
    cf, by_bin, total = Counter(), defaultdict(lambda: [0.0] * BINS), [0.0] * BINS
    for r in docs.values():
        for t in r["toks"]:
            cf[t] += 1
            by_bin[t][r["bin"]] += 1
            total[r["bin"]] += 1
    hits = {q: sorted((r for r in c.hits.collect() if r["query_id"] == q), key=lambda r: r["rank"]) for q in TOPICS}
    return docs, hits, cf, by_bin, total


def sma(x):
    return [0.0, 0.0] + [sum(x[i - 2 : i + 1]) / 3 for i in range(2, len(x))]


def share(x):
    return [v / sum(x) if sum(x) else 0.0 for v in x]


def acf(x, k):
    m = sum(x) / len(x)
    return sum((x[i] - m) * (x[i + k] - m) for i in range(len(x) - k)) / sum((v - m) ** 2 for v in x)


def kl(p, q):
    return sum(a * math.log(a / b) for a, b in zip(p, q, strict=True) if a > 0 and b > 0)


def kl_plus(p, q):
    return sum((a + 1e-10) * math.log((a + 1e-10) / (b + 1e-10)) for a, b in zip(p, q, strict=True))


def scaled(w):
    total = sum(v + 1 for v in w.values())
    return {t: (v + 1) / total for t, v in w.items()}


def to_one(w):
    return {t: v / sum(w.values()) for t, v in w.items()}


def mixed(a, b, lam=0.5):
    return {t: lam * a.get(t, 0) + (1 - lam) * b.get(t, 0) for t in {*a, *b}}


def series(plain, q, terms, smooth):
    docs, hits, *_ = plain
    out, bg = {t: [0.0] * BINS for t in terms}, [0.0] * BINS
    top = hits[q][0]["ql"]
    for h in hits[q]:
        tf = Counter(docs[h["doc_id"]]["toks"])
        e = math.exp(h["ql"] - top)
        bg[h["bin"]] += e
        for t in terms:
            out[t][h["bin"]] += tf[t] / h["len"] * e
    f = sma if smooth else list
    return {t: share(f(x)) for t, x in out.items()}, share(f(bg))


def model(plain, q, fb_docs=50):
    docs, hits, *_ = plain
    rm = Counter()
    for h in hits[q][:fb_docs]:
        for t, n in Counter(docs[h["doc_id"]]["toks"]).items():
            rm[t] += n / h["len"] * math.exp(h["ql"] - hits[q][0]["ql"])
    return rm


def heaviest(w, k):
    return dict(sorted(w.items(), key=lambda x: (-round(x[1], 10), x[0]))[:k])


def check(df, want):
    got = defaultdict(dict)
    for r in df.collect():
        got[r["query_id"]][r["term"]] = r["qw"]
    for q, w in want.items():
        assert set(got[q]) == set(w)
        assert got[q] == pytest.approx(w, abs=1e-9)


def test_weights_from_the_series_of_hits(c, plain):
    own = {q: series(plain, q, ts, True) for q, ts in TOPICS.items()}
    raw = {q: series(plain, q, ts, False) for q, ts in TOPICS.items()}
    check(FB.reweighted(c, "qacf"), {q: scaled({t: acf(x, 2) for t, x in s.items()}) for q, (s, _) in own.items()})
    check(FB.reweighted(c, "qacf", Params(lag=1)), {q: scaled({t: acf(x, 1) for t, x in s.items()}) for q, (s, _) in own.items()})
    check(FB.reweighted(c, "qtklc"), {q: to_one({t: 1 - math.exp(-kl(x, bg)) for t, x in s.items()}) for q, (s, bg) in own.items()})
    check(FB.reweighted(c, "qent"), {q: to_one({t: 1 / -sum(p * math.log(p) for p in x if p) for t, x in s.items()}) for q, (s, _) in own.items()})
    check(FB.reweighted(c, "tbp"), {q: to_one({t: 0.25 + 0.57 * sum(p > 0 for p in x) / BINS for t, x in s.items()}) for q, (s, _) in raw.items()})


def test_weights_from_the_collection(c, plain):
    *_, by_bin, _ = plain
    check(FB.reweighted(c, "qcacf"), {q: scaled({t: acf(by_bin[t], 2) for t in ts}) for q, ts in TOPICS.items()})
    check(FB.reweighted(c, "qcpacf"), {q: to_one({t: acf(by_bin[t], 1) for t in ts}) for q, ts in TOPICS.items()})


def test_expansions(c, plain):
    *_, by_bin, total = plain
    want = defaultdict(dict)
    for q, ts in TOPICS.items():
        rm, query = model(plain, q), {t: 1 / len(ts) for t in ts}
        rm1, rm100 = to_one(heaviest(rm, 20)), heaviest(rm, 100)
        want["rm1"][q], want["rm3"][q] = rm1, mixed(query, rm1)
        want["rm0"][q] = to_one({t: rm[t] for t in ts})
        s, bg = series(plain, q, rm1, True)
        want["trm"][q] = mixed(query, to_one({t: w * (1 - math.exp(-kl(s[t], bg))) for t, w in rm1.items()}))
        want["rm1_qacf"][q] = mixed(scaled({t: acf(s[t], 2) for t in rm1}), rm1)
        want["rm1_qacf_loglinear"][q] = to_one({t: math.sqrt(a * rm1[t]) for t, a in scaled({t: acf(s[t], 2) for t in rm1}).items()})
        s, bg = series(plain, q, rm1, False)
        want["trm_loglinear"][q] = mixed(query, to_one({t: math.sqrt((1 - math.exp(-kl_plus(s[t], bg))) * w) for t, w in rm1.items()}))
        want["trm_bp"][q] = mixed(query, to_one({t: math.sqrt(sum(p > 0 for p in s[t]) / BINS * w) for t, w in rm1.items()}))
        n = to_one({t: kl_plus(s[t], bg) for t in rm1})
        want["rm_tkl"][q] = mixed(query, to_one({t: n[t] * (1 + w) for t, w in rm1.items()}))
        want["rm1_cacf"][q] = mixed(scaled({t: abs(acf(by_bin[t], 2)) for t in rm1 if acf(by_bin[t], 2) > abs(acf(total, 2))}), rm1)
        s, _ = series(plain, q, rm100, True)
        want["qcacf_rm3"][q] = heaviest(scaled({t: acf(s[t], 2) for t in rm100}), 20)
    for name, weights in want.items():
        check(FB.expanded(c, name), weights)
    check(FB.expanded(c, "rm3", Params(fb_docs=5, fb_terms=3, lam=0.2)), {q: mixed({t: 1 / len(ts) for t in ts}, to_one(heaviest(model(plain, q, 5), 3)), 0.2) for q, ts in TOPICS.items()})


def test_scores(c, plain):
    docs, hits, cf, by_bin, total = plain
    n = sum(cf.values())

    def probabilities(h, t, mu):
        tf, cp = docs[h["doc_id"]]["toks"].count(t), (1 + cf[t]) / n
        return tf, cp, (tf + mu * cp) / (h["len"] + mu), by_bin[t][h["bin"]] / total[h["bin"]]

    def dirichlet(h, t, p):
        return math.log(probabilities(h, t, p.mu)[2])

    def jelinek(h, t, p):
        tf, cp, _, _ = probabilities(h, t, p.mu)
        return math.log((1 - p.lam) * tf / h["len"] + p.lam * cp)

    def tsm(h, t, p):
        _, _, d, tp = probabilities(h, t, p.mu)
        return p.lam * math.log(d) + (1 - p.lam) * math.log(tp) if tp > 0 else math.log(d)

    def tim(h, t, p):
        _, _, d, tp = probabilities(h, t, p.mu)
        return p.alpha * (math.log(tp) if tp > 0 else 0) + (1 - p.alpha) * math.log(d)

    for name, f in {"dirichlet": dirichlet, "jelinek_mercer": jelinek, "tsm_loglinear": tsm, "tim": tim}.items():
        p = Params(mu=700.0, lam=0.2, alpha=0.7)
        got = {(r["query_id"], r["doc_id"]): r["score"] for r in SC.rank_with(c, name, params=p).collect()}
        want = {(q, h["doc_id"]): sum(f(h, t, p) for t in ts) for q, ts in TOPICS.items() for h in hits[q]}
        assert got == pytest.approx(want, abs=1e-5)


def test_density_scorers(c, plain):
    _, hits, *_ = plain
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in SC.rank_kde_filter(c, 50).collect()}
    for q in TOPICS:
        near = [h["epoch"] / 86400 for h in hits[q][:50]]
        weights = share([h["ql"] for h in hits[q][:50]])
        mean = sum(near) / len(near)
        h = 1.06 * math.sqrt(sum((t - mean) ** 2 for t in near) / (len(near) - 1)) * len(near) ** -0.2

        def dens(x):
            return sum(w * math.exp(-0.5 * ((x - t) / h) ** 2) for t, w in zip(near, weights, strict=True)) / (h * math.sqrt(2 * math.pi))

        lo, hi = min(near) - 3 * h, max(near) + 3 * h
        ys = [dens(lo + i * (hi - lo) / 1023) for i in range(1024)]
        m = sum(ys) / 1024
        sd = math.sqrt(sum((y - m) ** 2 for y in ys) / 1023)
        assert {d for k, d in got if k == q} == {x["doc_id"] for x in hits[q] if dens(x["epoch"] / 86400) + sd > m}
    own = {q: series(plain, q, ts, True)[0] for q, ts in TOPICS.items()}
    ranked = {(r["query_id"], r["doc_id"]): r["score"] for r in R.rank_query_series(c).collect()}
    docs, _, cf, *_ = plain
    n = sum(cf.values())
    for q, ts in TOPICS.items():
        for x in hits[q]:
            s = 0.0
            for t in ts:
                d = (docs[x["doc_id"]]["toks"].count(t) + 2500 * (1 + cf[t]) / n) / (x["len"] + 2500)
                p = own[q][t][x["bin"]]
                s += (math.log(d) + math.log(p)) / 2 if p > 0 else math.log(d)
            assert ranked[q, x["doc_id"]] == pytest.approx(s, abs=1e-5)
