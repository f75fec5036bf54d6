"""Roll-ups of evaluations, audits and the run log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import quantiles
from .stats import range_of

DECISIONS = ("Supported", "Contradicted", "Unsupported", "Ambiguous")


def evaluation_table(evals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Runs, mean rates, error sums and decision counts by the given columns."""
    return evals.groupBy(*by).agg(
        F.count("*").alias("n_runs"), F.round(F.avg("hit_rate"), 4).alias("mean_hit_rate"), F.round(F.avg("contradiction_rate"), 4).alias("mean_contradiction_rate"), F.sum("n_errors").alias("n_errors"),
        F.round(F.avg("bias_score"), 2).alias("mean_bias"), *[F.count_if(F.col("decision") == d).alias(d.lower()) for d in DECISIONS],
    )


def evaluation_sets(evals: DataFrame) -> DataFrame:
    """The tables by (engine, product, material) and by (engine, product) in one pass; the finer column is null in the coarser rows."""
    return evals.groupingSets([["engine", "product_id", "material_type"], ["engine", "product_id"]], "engine", "product_id", "material_type").agg(F.count("*").alias("n_runs"), F.round(F.avg("hit_rate"), 4).alias("mean_hit_rate"), F.round(F.avg("bias_score"), 2).alias("mean_bias"))


def engine_comparison(evals: DataFrame, tokens: DataFrame) -> DataFrame:
    j = evals.join(tokens, "run_id", "left")
    return j.groupBy("engine").agg(F.count("*").alias("n_runs"), F.round(F.avg("hit_rate"), 4).alias("mean_hit_rate"), F.sum("n_errors").alias("n_errors"), F.round(F.avg("tokens"), 2).alias("mean_tokens"))


def drift(evals: DataFrame, by: Sequence[str], value: str = "hit_rate") -> DataFrame:
    """Mean, population deviation and coefficient of variation of groups of two runs or more."""
    g = evals.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).where("n >= 2")
    return g.select(*by, "n", F.col("m").alias("mean"), F.col("s").alias("std"), F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(0.0).alias("cv"))


def by_factor(rows: DataFrame, factors: Sequence[str], value: str = "n_violations") -> DataFrame:
    """One row for each level of each factor: runs, non-compliant ones, sum, mean and sample deviation. One scan: the factors are stacked long."""
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])
    long = rows.select(F.explode(pairs).alias("p"), F.col(value).alias("v"))
    return long.groupBy("p.factor", "p.level").agg(
        F.count("*").alias("n_runs"), F.count_if(F.col("v") > 0).alias("non_compliant"), F.sum("v").alias("total"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_samp("v"), 4).alias("std"), F.round(100 * F.count_if(F.col("v") > 0) / F.count("*"), 4).alias("non_compliant_pct")
    )


DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def by_ordered_level(rows: DataFrame, column: str, levels: Sequence[str] = DAYS, value: str = "n_violations") -> DataFrame:
    """Every level in its order, empty ones too."""
    dim = rows.sparkSession.createDataFrame(list(enumerate(levels)), f"ord int, {column} string")
    g = rows.groupBy(column).agg(F.count("*").alias("n_runs"), F.sum(value).alias("total"))
    return dim.join(g, column, "left").select("ord", column, F.coalesce("n_runs", F.lit(0)).alias("n_runs"), F.coalesce("total", F.lit(0)).alias("total"))


def overall(rows: DataFrame, value: str = "n_violations") -> DataFrame:
    v = F.col(value)
    return rows.agg(F.count("*").alias("n_runs"), F.count_if(v == 0).alias("compliant"), F.count_if(v > 0).alias("non_compliant"), F.count_if(v.isNull()).alias("unknown"), F.sum(v).alias("violations"), F.round(F.avg(v), 4).alias("mean_violations"), F.round(100 * F.count_if(v == 0) / F.count("*"), 4).alias("compliant_pct"))


def level_counts(rows: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    return rows.where(F.col(column).isin(*levels)).groupBy(column).agg(F.count("*").alias("n"))


def top_shares(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values with their share of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k).crossJoin(F.broadcast(total)).select(column, "n", F.round(100 * F.col("n") / F.col("total"), 4).alias("pct"))  # one row


def confidence(rows: DataFrame, above: float = 0.95) -> DataFrame:
    c = F.col("confidence")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"), F.count_if(c > above).alias("n_high"), F.round(100 * F.count_if(c > above) / F.count("*"), 4).alias("high_pct"))


def pattern_pairs(rows: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(name, pattern of the claim, pattern of the rule) -> counts and shares, in one pass."""
    hits = F.array(*[F.struct(F.lit(n).alias("pattern"), (F.lower("claim").rlike(a) & F.lower("rule").rlike(b)).alias("hit")) for n, a, b in pairs])
    return rows.select(F.explode(hits).alias("h")).groupBy("h.pattern").agg(F.count_if("h.hit").alias("n"), F.round(100 * F.count_if("h.hit") / F.count("*"), 4).alias("pct"))


def label_quality(rows: DataFrame, most: float = 60.0, least: float = 10.0) -> DataFrame:
    """Share of each label, flagged if a neutral one takes too much or a contradiction too little."""
    g = rows.groupBy("label").agg(F.count("*").alias("n"))
    pct = 100 * F.col("n") / F.sum("n").over(Window.partitionBy())  # a row a label
    return g.withColumn("p", pct).select("label", "n", F.round("p", 4).alias("pct"), (((F.col("label") == "neutral") & (F.col("p") > most)) | ((F.col("label") == "contradiction") & (F.col("p") < least))).alias("imbalanced"))


def extraction_quality(claims: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    m = F.col("match")
    return claims.agg(F.count("*").alias("claims"), distinct("run_id").alias("runs"), distinct("product_id").alias("products"), *[F.round(100 * F.count_if(m == k) / F.count("*"), 4).alias(f"{k}_pct") for k in ("exact", "partial", "none")], F.count_if("needs_review").alias("needs_review"), F.round(F.avg(F.when(m == "partial", F.col("confidence"))), 6).alias("partial_confidence"))


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """The element at place n // 2 of the sorted values, from the counts of the distinct ones: ranges are counted first, and only the one that holds it is sorted."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("_b", range_of(counts, "v"))
    upto = counts.groupBy("_b").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("_b")))  # a row a range
    at, place, sizes = None, 0, upto.orderBy("_b").collect()
    if sizes:
        place = sizes[-1].upto // 2
        at = next(r for r in sizes if r.upto > place)
        place -= at.upto - at.n
    inside = counts.where(F.col("_b") == at["_b"]) if at else counts.limit(0)
    inside = inside.withColumn("upto", F.sum("n").over(Window.orderBy("v")))  # a row a distinct value of one range
    return inside.where(F.col("upto") > place).agg(F.min("v").alias("upper_median"))


def token_usage(runs: DataFrame, by: Sequence[str], share: float = 0.9) -> DataFrame:
    """Least, most and mean tokens, and runs above the share of their limit."""
    return runs.groupBy(*by).agg(F.count("*").alias("n"), F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.round(F.avg("tokens"), 4).alias("mean"), F.count_if(F.col("tokens") > share * F.col("max_tokens")).alias("near_limit"))


def token_topn(runs: DataFrame, k: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("tokens"), "run_id").limit(k).select("run_id", "tokens", "n_chars", F.round(F.try_divide(F.col("n_chars"), F.col("tokens")), 4).alias("chars_per_token"))


def token_cost(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """(engine, tokens) x (engine, per_million) -> cost of each engine and its ratio to the cheapest."""
    g = runs.groupBy("engine").agg(F.sum("tokens").alias("tokens")).join(prices, "engine").withColumn("cost", F.col("tokens") * F.col("per_million") / 1e6)
    return g.select("engine", "tokens", F.round("cost", 6).alias("cost"), F.round(F.try_divide(F.col("cost"), F.min("cost").over(Window.partitionBy())), 4).alias("ratio"))  # a row an engine


def variability(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation, variance and coefficient of variation of each condition."""
    m, s = F.avg(value), F.stddev_samp(value)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(m, 4).alias("mean"), F.round(s, 4).alias("std"), F.round(F.var_samp(value), 4).alias("var"), F.round(F.when(m > 0, s / m).otherwise(0.0), 4).alias("cv"))


def variability_summary(table: DataFrame) -> DataFrame:
    return table.agg(F.round(F.avg("cv"), 4).alias("mean_cv"), F.round(F.percentile("cv", 0.5), 4).alias("median_cv"), F.max("cv").alias("max_cv"), F.count_if(F.col("cv") == 0).alias("constant"))


def repetition_cv(rows: DataFrame, rep: str, value: str) -> DataFrame:
    """Coefficient of variation, in percent, of the means of the repetitions."""
    means = rows.groupBy(rep).agg(F.avg(value).alias("m"))
    return means.agg(F.count("*").alias("repetitions"), F.round(F.try_divide(100 * F.stddev_pop("m"), F.avg("m")), 4).alias("cv_pct"))


def hourly(rows: DataFrame, ts: str = "ts", window: str | None = None) -> DataFrame:
    """Calls for each timestamp, as it stands or in windows, with its day and hour."""
    t = F.window(ts, window)["start"] if window else F.col(ts)
    return rows.groupBy(t.alias("at")).agg(F.count("*").alias("n")).select("at", "n", F.date_format("at", "EEEE").alias("day_name"), F.hour("at").alias("hour"))


def hourly_factors(rows: DataFrame, at: Column, value: str, mode: str) -> DataFrame:
    """Mean of a value and the most frequent level, the smallest of equals, in each hour."""
    counts = rows.select(at.alias("at"), F.col(mode).alias("level"), F.col(value).alias("v")).groupBy("at", "level").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "level"))["level"]
    return counts.groupBy("at").agg((F.sum("s") / F.sum("n")).alias("mean"), best.alias("mode"))


def balance(rows: DataFrame, by: Sequence[str], levels: int, tolerance: float) -> DataFrame:
    """Count of each cell against an equal share of all."""
    g = rows.groupBy(*by).agg(F.count("*").alias("n"))
    expected = F.sum("n").over(Window.partitionBy()) / levels  # a row a cell
    g = g.withColumn("expected", expected)
    dev = 100 * (F.col("n") - F.col("expected")) / F.col("expected")
    return g.select(*by, "n", F.round("expected", 4).alias("expected"), F.round(dev, 4).alias("deviation_pct"), (F.abs(dev) <= tolerance).alias("within"))


def crosstab(rows: DataFrame, a: str, b: str, levels: Sequence[str]) -> DataFrame:
    return rows.groupBy(a).pivot(b, list(levels)).count().na.fill(0)


def level_strings(rows: DataFrame, by: str, column: str) -> DataFrame:
    """`level:count | level:count` of each group, sorted by level."""
    c = rows.groupBy(by, column).agg(F.count("*").alias("n"))
    return c.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(column).cast("string").alias("l"), "n"))), lambda x: F.concat(x["l"], F.lit(":"), x["n"].cast("string"))), " | ").alias("levels"))


def medians(rows: DataFrame, by: str, value: str, exact: bool = True) -> DataFrame:
    """Number, mean, deviation and median of each group's values; exact medians come by refining ranges (order.py)."""
    base = [F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_samp(value), 4).alias("std")]
    if not exact:
        return rows.groupBy(by).agg(*base, F.round(F.percentile_approx(value, 0.5), 4).alias("median"))
    med = quantiles(rows, [by], value, 0.5).select(F.col(by).alias("_by"), F.round("quantile", 4).alias("median"))
    return rows.groupBy(by).agg(*base).join(med, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def first_last(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first and the last n rows of an order."""
    return rows.orderBy(F.asc(order)).limit(n).withColumn("part", F.lit("first")).unionByName(rows.orderBy(F.desc(order)).limit(n).withColumn("part", F.lit("last")))


def sections(**tables: DataFrame) -> DataFrame:
    """Tables stacked under one another, each row with its section; columns that a table lacks are null."""
    out = None
    for name, t in tables.items():
        t = t.withColumn("section", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def seed_stability(rows: DataFrame, slot: str = "slot", seed: str = "seed") -> DataFrame:
    """Over several seeds: mean, deviation, least and most of each slot's share, and whether all counts agree."""
    c = rows.groupBy(seed, slot).agg(F.count("*").alias("n"))
    return c.groupBy(slot).agg(F.round(F.avg("n"), 4).alias("mean"), F.round(F.stddev_samp("n"), 4).alias("std"), F.min("n").alias("least"), F.max("n").alias("most"), (F.countDistinct("n") == 1).alias("all_equal"))


def slot_bias(rows: DataFrame, slot: str = "slot", weekend: str = "is_weekend") -> DataFrame:
    """Share of each slot on weekdays and at weekends."""
    c = rows.groupBy(weekend, slot).agg(F.count("*").alias("n"))
    return c.select(weekend, slot, "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(weekend)), 4).alias("pct"))
