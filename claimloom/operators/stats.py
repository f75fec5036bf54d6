"""Hypothesis tests: sufficient statistics are Spark aggregates, and p-values are computed from the
few numbers that come back."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .order import quantiles

SCHEMA = "test string, statistic double, df1 double, df2 double, p double, result string"


# --- tails -----------------------------------------------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_tail(t: float, df: float) -> float:
    """P(T > t)."""
    half = beta_cdf(df / (df + t * t), df / 2, 0.5) / 2
    return half if t > 0 else 1 - half


def f_tail(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def range_tail(q: float, k: int, df: float, steps: int = 160) -> float:
    """P(studentized range > q) of k groups, by quadrature over the scale and the least value."""
    phi, dens = (lambda z: 1 - normal_tail(z)), (lambda z: math.exp(-z * z / 2) / math.sqrt(2 * math.pi))

    def given(w: float) -> float:
        h = 16 / steps
        return k * sum((1 if i in (0, steps) else 4 if i % 2 else 2) * dens(z) * max(0.0, phi(z + w) - phi(z)) ** (k - 1) for i in range(steps + 1) for z in (-8 + i * h,)) * h / 3

    if df > 2000:
        return 1 - given(q)
    log_c = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2)
    lo, hi = max(1e-6, 1 - 8 / math.sqrt(2 * df)), 1 + 8 / math.sqrt(2 * df)
    h = (hi - lo) / 60
    total = sum((1 if i in (0, 60) else 4 if i % 2 else 2) * math.exp(log_c + (df - 1) * math.log(s) - df * s * s / 2) * given(q * s) for i in range(61) for s in (lo + i * h,)) * h / 3
    return min(1.0, max(0.0, 1 - total))


def stars(p: float | None) -> str:
    return "undefined" if p is None or math.isnan(p) else "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "not significant"


def _row(spark: SparkSession, test: str, statistic: float | None, df1: float | None, df2: float | None, p: float | None) -> DataFrame:
    num = lambda x: None if x is None else float(x)
    return spark.createDataFrame([(test, num(statistic), num(df1), num(df2), num(p), stars(p))], SCHEMA)


# --- statistics as tables --------------------------------------------------------------------


def one_sample(rows: DataFrame, value: str, mu: float = 0.0) -> DataFrame:
    n, m, s = F.count(value), F.avg(value), F.stddev_samp(value)
    return rows.agg(n.alias("n"), m.alias("mean"), s.alias("std"), F.try_divide(m - mu, s / F.sqrt(n)).alias("t"))


def two_sample(rows: DataFrame, value: str, first: Column) -> DataFrame:
    """Pooled t of the rows where `first` holds against the rest."""
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    g = rows.agg(F.count(a).alias("n1"), F.avg(a).alias("m1"), F.var_samp(a).alias("v1"), F.count(b).alias("n2"), F.avg(b).alias("m2"), F.var_samp(b).alias("v2"))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    return g.withColumn("t", F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))))


def anova(rows: DataFrame, factor: str, value: str) -> DataFrame:
    """One row: k, n and F of a one-way analysis of variance."""
    g = rows.where(F.col(value).isNotNull() & F.col(factor).isNotNull()).groupBy(factor).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("between"))
    return t.select("k", "n", F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f"))


def chi2_table(rows: DataFrame, a: str, b: str) -> DataFrame:
    """chi-square of a contingency table; with Yates' correction when it is 2 x 2."""
    c = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    marg = lambda k: c.groupBy(k).agg(F.sum("n").alias(f"n_{k}"))
    full = marg(a).crossJoin(F.broadcast(marg(b))).join(c, [a, b], "left").na.fill(0, ["n"])  # cells: levels x levels
    total = F.sum("n").over(Window.partitionBy())
    cells = full.withColumn("e", F.col(f"n_{a}") * F.col(f"n_{b}") / total)
    dims = cells.agg(F.countDistinct(a).alias("r"), F.countDistinct(b).alias("c"), F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e")).alias("x"), F.sum(F.greatest(F.abs(F.col("n") - F.col("e")) - F.least(F.lit(0.5), F.abs(F.col("n") - F.col("e"))), F.lit(0.0)) ** 2 / F.col("e")).alias("y"))
    df = (F.col("r") - 1) * (F.col("c") - 1)
    return dims.select(df.cast("long").alias("df"), F.when(df == 1, F.col("y")).otherwise(F.col("x")).alias("chi2"))


def chi2_uniform(rows: DataFrame, factor: str) -> DataFrame:
    g = rows.groupBy(factor).agg(F.count("*").alias("n"))
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return t.select((F.col("k") - 1).alias("df"), (F.col("q") * F.col("k") / F.col("s") - F.col("s")).alias("chi2"))


#: Distinct values that one task ranks.
RANGE_ROWS = 100_000


def range_of(values: DataFrame, column: str, parts: int | None = None) -> Column:
    """A range number for each value of a column of doubles: ranges of about as many rows each, whatever the
    distribution, cut at approximate quantiles. Equal values are in one range, and ranges are in order.
    Their number follows from the number of values, up to 1,024; few values are one range."""
    parts = parts or min(1024, -(-values.count() // RANGE_ROWS))
    cuts = (values.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []) if parts > 1 else []
    cuts = sorted(set(cuts))  # parts - 1 numbers at most

    def below(lo: int, hi: int) -> Column:  # by halves: how many cuts are less than the value
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) > F.lit(cuts[mid]), below(mid + 1, hi)).otherwise(below(lo, mid))

    return below(0, len(cuts))


def mid_ranks(rows: DataFrame, factor: str, value: str) -> DataFrame:
    """(factor, value, n, ties, rank): counts of the distinct values with the mean rank of each. The
    running count is over distinct values, and in two steps: inside ranges, then over the ranges.
    Both counts are written once."""
    c = written(rows.where(F.col(value).isNotNull() & F.col(factor).isNotNull()).groupBy(F.col(factor).alias("factor"), F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n")), "counts")
    v = written(c.groupBy("value").agg(F.sum("n").alias("ties")), "ties")
    v = v.withColumn("_b", range_of(v, "value"))
    starts = v.groupBy("_b").agg(F.sum("ties").alias("_n")).select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))  # 1,024 rows at most
    upto = F.sum("ties").over(Window.partitionBy("_b").orderBy("value")) + F.col("_before")
    ranks = v.join(F.broadcast(starts), "_b").select("value", "ties", (upto - F.col("ties") + (F.col("ties") + 1) / 2).alias("rank"))
    return c.join(ranks, "value")


def kruskal(rows: DataFrame, factor: str, value: str) -> DataFrame:
    """H with tie correction, and eta squared."""
    r = mid_ranks(rows, factor, value)
    g = r.groupBy("factor").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    ties = r.select("value", "ties").distinct().agg(F.sum(F.col("ties").cast("double") ** 3 - F.col("ties")).alias("t"), F.sum("ties").alias("N"))
    t = g.agg(F.count("*").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q")).crossJoin(F.broadcast(ties))  # one row each
    n = F.col("N").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    return t.select("k", F.col("N").alias("n"), h.alias("h"), ((h - F.col("k") + 1) / (n - F.col("k"))).alias("eta2"))


def mann_whitney(rows: DataFrame, factor: str, value: str, first: str, second: str) -> DataFrame:
    """U of the first level, z with tie correction, and rank-biserial correlation."""
    r = mid_ranks(rows.where(F.col(factor).isin(first, second)), factor, value)
    ties = r.select("value", "ties").distinct().agg(F.sum(F.col("ties").cast("double") ** 3 - F.col("ties")).alias("t"))
    one = F.col("factor") == first
    t = r.agg(F.sum(F.when(one, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(one, 0).otherwise(F.col("n"))).alias("n2"), F.sum(F.when(one, F.col("n") * F.col("rank")).otherwise(0.0)).alias("r1")).crossJoin(F.broadcast(ties))  # one row each
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u, n = F.col("r1") - n1 * (n1 + 1) / 2, n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("t") / (n * (n - 1))))
    return t.select("n1", "n2", u.alias("u"), F.try_divide(u - n1 * n2 / 2, sd).alias("z"), (1 - F.try_divide(2 * u, n1 * n2)).alias("rank_biserial"))


def levene(rows: DataFrame, factor: str, value: str) -> DataFrame:
    """Analysis of variance of the distances from the group medians."""
    med = quantiles(rows, [factor], value, 0.5).select(factor, F.col("quantile").alias("_m"))
    return anova(rows.join(med, factor).withColumn("_z", F.abs(F.col(value) - F.col("_m"))), factor, "_z")


def jarque_bera(rows: DataFrame, value: str) -> DataFrame:
    """A normality screen from skewness and kurtosis."""
    s, k, n = F.skewness(value), F.kurtosis(value), F.count(value)
    return rows.agg(n.alias("n"), s.alias("skewness"), k.alias("kurtosis"), (n / 6 * (s * s + k * k / 4)).alias("jb"))


# Acklam's rational approximation of the normal quantile, numerators and denominators of its middle and tails.
QUANTILE = {
    "a": (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    "b": (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
    "c": (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    "d": (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
}
QUANTILE_TAIL = 0.02425
# Royston's corrections of the two outermost weights, by powers of 1 / sqrt(n) from the first.
OUTER = (0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
NEXT = (0.042981, -0.293762, -1.752461, 5.682633, -3.582633)


def normal_quantile(p):
    """Of an array of probabilities between 0 and 1."""
    import numpy as np

    p = np.asarray(p, float)
    tail = np.minimum(p, 1 - p)
    q = np.sqrt(-2 * np.log(np.minimum(tail, QUANTILE_TAIL)))
    low = np.polyval(QUANTILE["c"], q) / np.polyval(QUANTILE["d"], q)
    x = p - 0.5
    mid = x * np.polyval(QUANTILE["a"], x * x) / np.polyval(QUANTILE["b"], x * x)
    return np.where(tail < QUANTILE_TAIL, np.where(p < 0.5, low, -low), mid)


#: Equal values whose normal scores are summed one by one; of more, by their integral.
TIES = 100_000


def _scores(before: float, ties: int, n: int) -> tuple[float, float]:
    """Sum and sum of squares of the normal scores of the ranks after `before`."""
    import numpy as np

    at = lambda i: normal_quantile((np.asarray(i, float) - 0.375) / (n + 0.25))
    if ties <= TIES:
        m = at(before + 1 + np.arange(ties))
        return float(m.sum()), float((m * m).sum())
    z0, z1 = (float(at(before + x)) for x in (0.5, ties + 0.5))  # the midpoint rule, backwards
    d0, d1 = (math.exp(-z * z / 2) / math.sqrt(2 * math.pi) for z in (z0, z1))
    return (n + 0.25) * (d0 - d1), ties + (n + 0.25) * (z0 * d0 - z1 * d1)


def shapiro_wilk(rows: DataFrame, value: str) -> DataFrame:
    """One row (n, w, p): Shapiro and Wilk's test of normality, with Royston's weights and p-value.

    The ordered values are weighted by normal scores of their ranks, which are counted in ranges as for the
    rank tests; only the four outermost values and a few sums reach the driver. Nulls are left out, equal values
    take the scores of their ranks; fewer than three values or all equal ones give a null w. The p-value is
    fitted for up to 5,000 values and an extrapolation beyond.
    """
    import numpy as np
    import pyarrow as pa

    from pyspark.sql.types import StructType

    spark = rows.sparkSession
    v = written(mid_ranks(rows.withColumn("_one", F.lit(1)), "_one", value).select("value", F.col("ties").cast("long").alias("ties"), (F.col("rank") - (F.col("ties") + 1) / 2).alias("before")), "ranks")
    total = v.agg(F.sum("ties").alias("n"), (F.sum(F.col("value") * F.col("ties")) / F.sum("ties")).alias("m")).first()
    n, mean, out = total.n or 0, total.m, "n long, w double, p double"
    ends = [[x for r in v.orderBy(o).limit(2).collect() for x in [r.value] * min(r.ties, 2)][:2] for o in ("value", F.desc("value"))]
    if n < 3 or ends[0][0] == ends[1][0]:
        return spark.createDataFrame([(n, None, None)], out)

    def sums(batches):
        t = np.zeros(3)
        for b in batches:
            for x, k, at in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                s, q = _scores(at, k, n)
                t += (s * (x - mean), q, k * (x - mean) ** 2)
        yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in t], ["mx", "mm", "xx"])

    g = v.select("value", "ties", "before").mapInArrow(sums, StructType.fromDDL("mx double, mm double, xx double")).agg(*[F.sum(c).alias(c) for c in ("mx", "mm", "xx")]).first()
    m = normal_quantile((np.array([n, n - 1.0]) - 0.375) / (n + 0.25))
    u = 1 / math.sqrt(n)
    weight = [float(x / math.sqrt(g.mm)) + sum(c * u ** (i + 1) for i, c in enumerate(f)) for x, f in zip(m, (OUTER, NEXT), strict=True)]
    wide = [ends[1][i] - ends[0][i] for i in (0, 1)]
    k = 1 if n <= 5 else 2
    if n == 3:
        top = math.sqrt(0.5) * wide[0]
    else:
        scale = math.sqrt((g.mm - 2 * float((m[:k] ** 2).sum())) / (1 - 2 * sum(a * a for a in weight[:k])))
        top = (g.mx - float((m[:k] * wide[:k]).sum())) / scale + sum(a * x for a, x in zip(weight[:k], wide[:k], strict=True))
    w = min(1.0, top * top / g.xx)
    return spark.createDataFrame([(n, w, _shapiro_tail(w, n))], out)


def _shapiro_tail(w: float, n: int) -> float:
    # Royston's fits of the distribution, by powers of n or of its logarithm.
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return 1.0
    poly = lambda c, x: sum(a * x**i for i, a in enumerate(c))
    if n <= 11:
        gamma = poly((-2.273, 0.459), n)
        y = math.log(1 - w)
        if y >= gamma:
            return 0.0
        z = (-math.log(gamma - y) - poly((0.5440, -0.39978, 0.025054, -0.0006714), n)) / math.exp(poly((1.3822, -0.77857, 0.062767, -0.0020322), n))
    else:
        x = math.log(n)
        z = (math.log(1 - w) - poly((-1.5861, -0.31082, -0.083751, 0.0038915), x)) / math.exp(poly((-0.4803, -0.082676, 0.0030302), x))
    return 0.5 * math.erfc(z / math.sqrt(2))


def effect_size(rows: DataFrame, value: str) -> DataFrame:
    d = F.try_divide(F.avg(value), F.stddev_samp(value))
    return rows.agg(d.alias("d")).withColumn("size", F.when(F.abs("d") < 0.2, "negligible").when(F.abs("d") < 0.5, "small").when(F.abs("d") < 0.8, "medium").otherwise("large"))


def anova_twoway(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Type II tests of two factors and their interaction, by least squares on the cells' sums. Rows with a
    null value or level are left out; a test without degrees of freedom or residuals has a null statistic."""
    import numpy as np

    cells = rows.where(F.col(value).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")).orderBy(a, b).collect()  # levels x levels
    la, lb = sorted({r[a] for r in cells}), sorted({r[b] for r in cells})
    n, s = np.array([r.n for r in cells], float), np.array([r.s for r in cells], float)
    total = float(sum(r.q for r in cells))

    if not cells:
        return rows.sparkSession.createDataFrame([(f"anova_twoway {x}", None, None, None, None, stars(None)) for x in (a, b, f"{a}:{b}")], SCHEMA)

    def rss(use_a: bool, use_b: bool, use_ab: bool) -> tuple[float, int]:
        cols = [np.ones(len(cells))]
        cols += [np.array([float(r[a] == x) for r in cells]) for x in la[1:]] if use_a else []
        cols += [np.array([float(r[b] == y) for r in cells]) for y in lb[1:]] if use_b else []
        cols += [np.array([float(r[a] == x and r[b] == y) for r in cells]) for x in la[1:] for y in lb[1:]] if use_ab else []
        x = np.stack(cols, 1)
        gram = x.T @ (n[:, None] * x)
        beta = np.linalg.pinv(gram) @ (x.T @ s)
        return total - float(beta @ (x.T @ s)), int(np.linalg.matrix_rank(gram))

    full, both, only_a, only_b = rss(True, True, True), rss(True, True, False), rss(True, False, False), rss(False, True, False)
    df = n.sum() - full[1]
    out = []
    for name, small, large in ((a, only_b, both), (b, only_a, both), (f"{a}:{b}", both, full)):
        d1 = large[1] - small[1]
        f = ((small[0] - large[0]) / d1) / (full[0] / df) if d1 and df > 0 and full[0] > 0 else None
        out.append((f"anova_twoway {name}", None if f is None else float(f), float(d1), float(df), None if f is None else float(f_tail(float(f), d1, float(df)))))
    return rows.sparkSession.createDataFrame([(*r, stars(r[4])) for r in out], SCHEMA)


def tukey(rows: DataFrame, factor: str, value: str) -> DataFrame:
    """Pairwise comparisons of the means of all levels, unequal sizes by Kramer's rule. Rows with a null value or level are left out."""
    g = rows.where(F.col(value).isNotNull() & F.col(factor).isNotNull()).groupBy(factor).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v")).orderBy(factor).collect()  # a row a level
    df = sum(r.n for r in g) - len(g)
    mse = sum((r.n - 1) * r.v for r in g) / df if df > 0 else float("nan")
    out = []
    for i, x in enumerate(g):
        for y in g[i + 1 :]:
            q = abs(x.m - y.m) / math.sqrt(mse / 2 * (1 / x.n + 1 / y.n)) if mse > 0 else None
            p = None if q is None else range_tail(q, len(g), df)
            out.append((f"tukey {x[factor]} - {y[factor]}", q, float(len(g)), float(df), p, stars(p)))
    return rows.sparkSession.createDataFrame(out, SCHEMA)


def report(rows: DataFrame, value: str, factors: Sequence[str]) -> DataFrame:
    """The usual tests of a value, one row each, with p-values and significance; null where a test is undefined."""
    tail = lambda x, df: chi2_tail(x, df) if x is not None and df else None
    spark, out = rows.sparkSession, None
    o = one_sample(rows, value).first()
    parts = [_row(spark, "one_sample_t", o.t, o.n - 1, None, None if o.t is None else t_tail(o.t, o.n - 1))]
    for f in factors:
        a, k, c = anova(rows, f, value).first(), kruskal(rows, f, value).first(), chi2_table(rows.withColumn("_hit", F.col(value) > 0), f, "_hit").first()
        parts.append(_row(spark, f"anova {f}", a.f, a.k - 1, a.n - a.k, None if a.f is None else f_tail(a.f, a.k - 1, a.n - a.k)))
        parts.append(_row(spark, f"kruskal {f}", k.h, k.k - 1, None, tail(k.h, k.k - 1)))
        parts.append(_row(spark, f"chi2 {f}", c.chi2, c.df, None, tail(c.chi2, c.df)))
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out
