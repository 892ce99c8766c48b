import numpy as np
import pytest

from tideline.functions import numeric as N


def test_density_sums_to_one_and_finds_modes():
    x = np.array([0.0] * 25 + [10.0] * 15) + np.linspace(-0.5, 0.5, 40)
    grid, y = N.density(x, h=0.5)
    assert np.trapezoid(y, grid) == pytest.approx(1, abs=0.02)
    top, low = N.extrema(y)
    assert len(top) == 2 and len(low) == 1
    assert N.nearest(grid, y, np.array([grid[7]]))[0] == y[7]
    assert N.multimodality(x, draws=40) < 0.1


def test_plug_in_bandwidth():
    x = np.random.default_rng(0).standard_normal(400)
    assert 0.6 < N.plug_in(x) / (1.06 * x.std(ddof=1) * 400**-0.2) < 1.2  # near the rule for normal data, below it for two humps
    assert N.plug_in(np.concatenate([x, x + 8])) < 0.5 * N.bandwidth(np.concatenate([x, x + 8]))
    assert N.plug_in(x * 3) == pytest.approx(3 * N.plug_in(x))


def test_changes_and_bursts():
    x = np.array([1.0, 2, 1, 2, 1, 9, 8, 9, 8, 9])
    assert N.changepoints(x) == [5]
    assert N.bursts(np.array([1.0] * 10 + [40] * 5 + [1] * 10), np.full(25, 100.0)).tolist() == [0] * 10 + [1] * 5 + [0] * 10


def test_mixtures():
    r = np.random.default_rng(0)
    p = np.concatenate([r.normal(0, 0.1, (30, 2)), r.normal(5, 0.1, (30, 2))])
    labels = N.mixture(p)
    assert len(set(labels[:30])) == 1 and len(set(labels[30:])) == 1 and labels[0] != labels[-1]
    own = N.against_background(np.array([50.0, 50, 100]), np.array([0.5, 0.25, 0.25]))
    assert own.sum() == pytest.approx(1) and own[2] > own[1] > own[0]


def test_probabilities():
    assert N.student_below(0, 5) == pytest.approx(0.5)
    assert N.student_below(2.015, 5) == pytest.approx(0.95, abs=1e-3)
    assert N.student_below(-1.812, 10) == pytest.approx(0.05, abs=1e-3)
    assert N.chi_square_p(3.841) == pytest.approx(0.05, abs=1e-3)


def test_mixture_by_rounds(spark):
    from pyspark.sql import functions as F

    from tideline.operators.collection import Collection
    from tideline.plans.models import mixture_series

    c = Collection(spark, "/root/testdata/sf0.001")
    got = {(r["bin"], r["term"]): r["p"] for r in mixture_series(c).collect()}
    n = c.totals.first()["n_tokens"]
    rows = c.occurrences().filter("bin = 25").groupBy("term").agg(F.sum("tf").alias("n")).join(c.term_stats().select("term", "cf"), "term").collect()
    want = N.against_background(np.array([r["n"] for r in rows]), np.array([r["cf"] / n for r in rows]))
    assert {k[1]: v for k, v in got.items() if k[0] == 25} == pytest.approx({r["term"]: w for r, w in zip(rows, want, strict=True)}, rel=1e-4, abs=1e-7)
