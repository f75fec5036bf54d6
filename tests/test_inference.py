"""Two-way analysis of variance, comparisons of means and the report of tests: every row recomputed
from the single values, with p-values by integrating the densities."""

import math

import numpy as np
import pytest

from claimloom.operators import stats as S


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    a, b = rng.choice(list("pqrs"), 600, p=[0.1, 0.2, 0.3, 0.4]), rng.choice(list("xyz"), 600, p=[0.5, 0.3, 0.2])
    v = rng.normal(0, 2, 600).round(1) + (a == "q") * 0.6 + (b == "z") * 0.3 + ((a == "s") & (b == "y")) * 0.4
    return a, b, v


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(str(x), str(y), float(z)) for x, y, z in zip(*data)]
    rows += [("p", "x", None), (None, "x", 3.0), ("q", None, 2.0)]  # left out where they lack what a test needs
    return spark.createDataFrame(rows, "a string, b string, v double").repartition(5)


def integral(f, low, high, steps=200_000):
    x = np.linspace(low, high, steps + 1)
    return float(np.trapezoid(f(x), x))


def f_upper(f, d1, d2):
    log_c = math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2) + d1 / 2 * math.log(d1 / d2)
    density = lambda u: 2 * u ** (d1 - 1) * np.exp(log_c - (d1 + d2) / 2 * np.log1p(d1 * u * u / d2))  # noqa: E731  of the root
    return 1 - integral(density, 0, math.sqrt(f))


def chi2_upper(x, df):
    return 1 - integral(lambda u: 2 * u ** (df - 1) * np.exp(-u * u / 2 - df / 2 * math.log(2) - math.lgamma(df / 2)), 0, math.sqrt(x))


def range_upper(q, k, df):
    """P(studentized range > q): the range of k normal values over an independent scale."""
    z = np.linspace(-9, 9, 3001)
    cdf = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])
    dens = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    s = np.linspace(max(1e-3, 1 - 9 / math.sqrt(2 * df)), 1 + 9 / math.sqrt(2 * df), 301)
    scale = np.exp(math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2)
    inner = [np.trapezoid(k * dens * np.clip(np.interp(z + q * x, z, cdf, right=1.0) - cdf, 0, None) ** (k - 1), z) for x in s]
    return 1 - float(np.trapezoid(scale * np.array(inner), s))


def residuals(columns, v):
    x = np.stack(columns, 1)
    beta, _, rank, _ = np.linalg.lstsq(x, v, rcond=None)
    return float(((v - x @ beta) ** 2).sum()), int(rank)


def test_twoway(data, frame):
    a, b, v = data
    one, da, db = [np.ones(len(v))], [(a == x) + 0.0 for x in "qrs"], [(b == y) + 0.0 for y in "yz"]
    both = [x * y for x in da for y in db]
    fits = {k: residuals(c, v) for k, c in {"a": one + da, "b": one + db, "ab": one + da + db, "full": one + da + db + both}.items()}
    df = len(v) - fits["full"][1]
    got = {r.test: r for r in S.anova_twoway(frame, "a", "b", "v").collect()}
    assert len(got) == 3
    for name, small, large in (("a", "b", "ab"), ("b", "a", "ab"), ("a:b", "ab", "full")):
        d1 = fits[large][1] - fits[small][1]
        f = (fits[small][0] - fits[large][0]) / d1 / (fits["full"][0] / df)
        r = got[f"anova_twoway {name}"]
        assert (r.statistic, r.p) == (pytest.approx(f, rel=1e-8), pytest.approx(f_upper(f, d1, df), abs=1e-6))
        assert (r.df1, r.df2) == (d1, df)


def test_twoway_with_an_empty_cell(spark):
    rows = [("p", "x", 1.0), ("p", "x", 2.0), ("p", "y", 4.0), ("p", "y", 4.5), ("q", "x", 3.0), ("q", "x", 3.5)]  # none of q and y
    got = {r.test: r for r in S.anova_twoway(spark.createDataFrame(rows, "a string, b string, v double"), "a", "b", "v").collect()}
    assert got["anova_twoway a:b"].statistic is None and got["anova_twoway a"].df2 == 3
    v = np.array([r[2] for r in rows])
    one, q, y = np.ones(6), np.array([r[0] == "q" for r in rows]) + 0.0, np.array([r[1] == "y" for r in rows]) + 0.0
    full = residuals([one, q, y], v)[0]
    assert got["anova_twoway a"].statistic == pytest.approx((residuals([one, y], v)[0] - full) / (full / 3))


def test_tukey(data, frame):
    a, _, _ = data
    v = np.append(data[2], 2.0)  # the row without a level of b counts here
    a = np.append(a, "q")
    groups = {x: v[a == x] for x in "pqrs"}
    df = len(v) - 4
    mse = sum(((g - g.mean()) ** 2).sum() for g in groups.values()) / df
    got = {r.test: r for r in S.tukey(frame, "a", "v").collect()}
    assert set(got) == {f"tukey {x} - {y}" for i, x in enumerate("pqrs") for y in "pqrs"[i + 1 :]}
    for k, r in got.items():
        x, y = groups[k[6]], groups[k[10]]
        q = abs(x.mean() - y.mean()) / math.sqrt(mse / 2 * (1 / len(x) + 1 / len(y)))
        assert (r.statistic, r.df1, r.df2) == (pytest.approx(q, rel=1e-8), 4, df)
        assert r.p == pytest.approx(range_upper(q, 4, df), abs=2e-4)
    # tabled 5 % points of k groups and df degrees of freedom
    for q, k, n in ((3.151, 2, 10), (3.958, 4, 20), (3.685, 4, 120), (4.232, 5, 20)):
        assert S.range_tail(q, k, n) == pytest.approx(0.05, abs=1e-3) == range_upper(q, k, n)


def mid_rank(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_report(data, frame):
    got = {r.test: r for r in S.report(frame, "v", ["a", "b"]).collect()}
    every = np.concatenate([data[2], [3.0, 2.0]])
    t = every.mean() / (every.std(ddof=1) / math.sqrt(len(every)))
    r = got["one_sample_t"]
    assert (r.statistic, r.df1) == (pytest.approx(t, rel=1e-8), len(every) - 1)
    assert r.p == pytest.approx(f_upper(t * t, 1, len(every) - 1) / 2 if t > 0 else 1 - f_upper(t * t, 1, len(every) - 1) / 2, abs=1e-6)
    for k, levels, extra in ((0, "pqrs", ("q", 2.0)), (1, "xyz", ("x", 3.0))):
        name, f, v = "ab"[k], np.append(data[k], extra[0]), np.append(data[2], extra[1])
        groups = [v[f == x] for x in levels]
        n, m = len(v), len(levels)
        stat = (sum(len(g) * (g.mean() - v.mean()) ** 2 for g in groups) / (m - 1)) / (sum(((g - g.mean()) ** 2).sum() for g in groups) / (n - m))
        r = got[f"anova {name}"]
        assert (r.statistic, r.df1, r.df2, r.p) == (pytest.approx(stat, rel=1e-8), m - 1, n - m, pytest.approx(f_upper(stat, m - 1, n - m), abs=1e-6))
        rank, ties = mid_rank(v), np.unique(v, return_counts=True)[1].astype(float)
        h = (12 / (n * (n + 1)) * sum(rank[f == x].sum() ** 2 / (f == x).sum() for x in levels) - 3 * (n + 1)) / (1 - (ties**3 - ties).sum() / (n**3 - n))
        r = got[f"kruskal {name}"]
        assert (r.statistic, r.df1, r.p) == (pytest.approx(h, rel=1e-8), m - 1, pytest.approx(chi2_upper(h, m - 1), abs=1e-6))
        r = got[f"chi2 {name}"]
        assert r.p is None or r.p == pytest.approx(chi2_upper(r.statistic, r.df1), abs=1e-6)


def test_nothing_to_test(spark):
    none = spark.createDataFrame([], "a string, b string, v double")
    assert [r.statistic for r in S.anova_twoway(none, "a", "b", "v").collect()] == [None] * 3
    assert S.tukey(none, "a", "v").count() == 0
    flat = spark.createDataFrame([("p", "x", 1.0), ("q", "x", 1.0), (None, "y", 1.0)], "a string, b string, v double")
    assert all(r.statistic is None for r in S.tukey(flat, "a", "v").collect())
    assert all(r.statistic is None for r in S.anova_twoway(flat, "a", "b", "v").collect())
