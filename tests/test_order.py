"""Exact order statistics by range refinement against numpy, with many rounds, ties and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.operators import aggregates as A
from claimloom.operators import order as O
from claimloom.operators import stats as S


def sample(rng):
    """Groups of many shapes: skewed over many magnitudes, nearly all ties, two values, one value, none."""
    rows = [("skewed", 10.0 ** rng.uniform(-200, 200) * rng.choice((1, -1))) for _ in range(3000)]
    rows += [("ties", 5.0 if rng.random() < 0.97 else rng.random() * 10) for _ in range(2500)]
    rows += [("two", float(i % 2)) for i in range(2000)] + [("one", 7.0)] * 1500 + [("few", float(rng.randrange(9))) for _ in range(11)]
    rows += [(None, rng.gauss(0, 1)) for _ in range(1200)] + [("none", None)] * 5 + [("skewed", None)] * 40 + [("single", -3.5)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    data = sample(random.Random(21))
    return data, spark.createDataFrame(data, "g string, v double").repartition(6).cache()


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.93, 1.0])
def test_quantiles_with_rounds(rows, p):
    data, df = rows
    got = {r.g: (r.n, r.quantile) for r in O.quantiles(df, ["g"], "v", p, few=60, cuts=8).collect()}
    for g in {g for g, _ in data}:
        v = np.sort([x for h, x in data if h == g and x is not None])
        at = (len(v) - 1) * p
        want = None if not len(v) else v[int(at)] + (v[int(np.ceil(at))] - v[int(at)]) * (at - int(at))
        assert got[g] == (len(v), want if want is None else pytest.approx(want, rel=1e-12))


def test_no_rounds_for_small_groups_and_other_types(rows, spark):
    data, df = rows
    assert {tuple(r) for r in O.quantiles(df, ["g"], "v", 0.5).collect()} == {tuple(r) for r in O.quantiles(df, ["g"], "v", 0.5, few=60, cuts=8).collect()}
    d = spark.range(1001).select(F.lit(1).alias("a"), F.lit("x").alias("b"), F.col("id").alias("v"))
    assert [tuple(r) for r in O.quantiles(d, ["a", "b"], "v", 0.5, few=20, cuts=4).collect()] == [(1, "x", 1001, 500.0)]
    ranks = spark.createDataFrame([(1, 0, 1001), (1, 17, 1001), (1, 1000, 1001), (1, 1001, 1001), (1, -1, 1001)], "a int, rank long, n long")
    assert {(r["rank"], r.found) for r in O.at_ranks(d, ["a"], "v", ranks, few=20, cuts=4).collect()} == {(0, 0), (17, 17), (1000, 1000)}
    assert O.quantiles(df.limit(0), ["g"], "v", 0.5).count() == 0


def test_medians_and_levene_use_them(rows, monkeypatch):
    data, df = rows
    tame = df.where("g <> 'skewed' or g is null")
    whole = {r.g: tuple(r) for r in A.medians(tame, "g", "v").collect()}
    f = S.levene(tame, "g", "v").first()
    monkeypatch.setattr(O.quantiles, "__defaults__", (60, 8))
    assert {r.g: tuple(r) for r in A.medians(tame, "g", "v").collect()} == whole and None in whole and whole["none"][-1] is None
    again = S.levene(tame, "g", "v").first()
    assert again.k == f.k and again.f == pytest.approx(f.f)


def test_ranges_of_ranks_do_not_change_them(spark, monkeypatch):
    rng = random.Random(5)
    d = spark.createDataFrame([(rng.choice("abc"), float(rng.choice((rng.randrange(50), rng.gauss(0, 9))))) for _ in range(3000)], "g string, v double")
    h = S.kruskal(d, "g", "v").first()
    monkeypatch.setattr(S, "RANGE_ROWS", 40)
    again = S.kruskal(d, "g", "v").first()
    assert again.h == pytest.approx(h.h, rel=1e-9) and again.n == 3000
