"""Shapiro and Wilk's test: a published example, a plain version over sorted values, ties, edge cases."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest

from claimloom.operators import stats as S


def plain(x):
    """By its definition over the sorted values, with exact normal scores."""
    x = np.sort(np.array(x, float))
    n = len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, mm = 1 / math.sqrt(n), float((m * m).sum())
    a = np.zeros(n)
    first = m[-1] / math.sqrt(mm) + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    second = m[-2] / math.sqrt(mm) + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    if n <= 5:
        a = m / math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * first**2))
    else:
        a = m / math.sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * first**2 - 2 * second**2))
        a[-2], a[1] = second, -second
    a[-1], a[0] = first, -first
    return float((a * x).sum() ** 2 / ((x - x.mean()) ** 2).sum())


def of(spark, x):
    return S.shapiro_wilk(spark.createDataFrame([(None if v is None else float(v),) for v in x], "v double").repartition(3), "v").first()


def test_published_example(spark):
    """Weights of eleven men, as in the paper that introduced the test: W = 0.79, p below 0.01."""
    r = of(spark, [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0])
    assert r.n == 11 and round(r.w, 4) == 0.7888 and round(r.p, 4) == 0.0067


@pytest.mark.parametrize("n", [4, 5, 6, 12, 60, 700])
def test_against_the_sorted_values(spark, monkeypatch, n):
    rng = random.Random(n)
    monkeypatch.setattr(S, "RANGE_ROWS", 50)
    for draw in (lambda: rng.gauss(5, 2), lambda: rng.expovariate(1), lambda: float(rng.randrange(4))):
        x = [draw() for _ in range(n)]
        if len(set(x)) > 1:
            assert of(spark, [*x, None]).w == pytest.approx(plain(x), abs=1e-7)


def test_normal_values_pass_and_others_fail(spark):
    rng = random.Random(1)
    assert of(spark, [rng.gauss(0, 1) for _ in range(2000)]).p > 0.05
    assert of(spark, [rng.expovariate(1) for _ in range(2000)]).p < 1e-6


def test_scores_of_many_ties_by_their_integral(monkeypatch):
    exact = S._scores(1000, 50_000, 100_000)
    monkeypatch.setattr(S, "TIES", 10)
    assert S._scores(1000, 50_000, 100_000) == pytest.approx(exact, rel=1e-5)


def test_quantiles():
    p = np.array([1e-12, 1e-4, 0.02, 0.3, 0.5, 0.77, 0.99, 1 - 1e-9])
    assert np.allclose(S.normal_quantile(p), [NormalDist().inv_cdf(x) for x in p], rtol=1e-8, atol=1e-9)


def test_few_equal_or_no_values(spark):
    assert tuple(of(spark, [])) == (0, None, None) and tuple(of(spark, [1.0, 2.0])) == (2, None, None) and tuple(of(spark, [3.0] * 9)) == (9, None, None)
    assert of(spark, [1.0, 2.0, 3.0]).w == pytest.approx(1.0) and of(spark, [1.0, 1.0, 4.0]).w == pytest.approx(0.75)
