"""Detection methods against each other and against planted errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def violations_per_run(runs: DataFrame, violations: DataFrame) -> DataFrame:
    """Every run with its number of violations: aggregated first, then joined."""
    n = violations.groupBy("run_id").agg(F.count("*").alias("n"))
    return runs.join(n, "run_id", "left").withColumn("n_violations", F.coalesce("n", F.lit(0))).drop("n")


def clean_runs(runs: DataFrame, violations: DataFrame) -> DataFrame:
    return runs.join(violations.select("run_id").distinct(), "run_id", "left_anti")


def outer_methods(key: str, **methods: DataFrame) -> DataFrame:
    """(key, detected) of several methods side by side; what a method doesn't have it hasn't detected."""
    out = None
    for name, m in methods.items():
        m = m.select(key, F.col("detected").alias(name))
        out = m if out is None else out.join(m, key, "full_outer")
    return out.select(key, *[F.coalesce(n, F.lit(False)).alias(n) for n in methods])


def three_way_class(wide: DataFrame, a: str, b: str, c: str) -> DataFrame:
    x, y, z = F.col(a), F.col(b), F.col(c)
    k = F.when(x & y & z, "all_three").when(x & ~y & ~z, f"only_{a}").when(~x & y & z, f"both_{b}_{c}").when(~x & y & ~z, f"only_{b}").when(~x & ~y & z, f"only_{c}").when(~x & ~y & ~z, "none").otherwise("other")
    return wide.withColumn("class", k)


def keyword_matches(catalog: DataFrame, violations: DataFrame) -> DataFrame:
    """catalog (run_id, error, keywords), violations (run_id, pos, claim) -> (run_id, error, detected, keywords found, first claim)."""
    k = catalog.select("run_id", "error", F.explode("keywords").alias("keyword"))
    hits = k.join(violations, "run_id").where(F.contains(F.lower("claim"), F.lower("keyword")))
    g = hits.groupBy("run_id", "error").agg(F.array_sort(F.collect_set("keyword")).alias("found"), F.min_by("claim", "pos").alias("first_claim"))
    return catalog.select("run_id", "error").join(g, ["run_id", "error"], "left").select("run_id", "error", F.col("found").isNotNull().alias("detected"), F.coalesce("found", F.array().cast("array<string>")).alias("found"), "first_claim")


def top_matches(terms: DataFrame, violations: DataFrame, k: int = 3, around: int = 50) -> DataFrame:
    """terms (run_id, term), violations (run_id, pos, text, confidence) -> the k matches of highest
    confidence in each run with context, and how many there are. A term matches as a part of the text."""
    j = violations.join(terms, "run_id").where(F.contains(F.lower("text"), F.lower("term")))
    at = F.greatest(F.instr(F.lower("text"), F.lower("term")) - around, F.lit(1))
    w = Window.partitionBy("run_id")
    ranked = j.withColumn("rank", F.row_number().over(w.orderBy(F.desc("confidence"), "pos", "term"))).withColumn("total", F.count("*").over(w))
    return ranked.where(F.col("rank") <= k).select("run_id", "rank", "term", "confidence", F.substring("text", at, F.lit(2 * around) + F.length("term")).alias("context"), "total")


def funnel(planted: DataFrame, core: DataFrame, disclaimers: DataFrame) -> DataFrame:
    """planted (run_id, keyword) -> validated, only as disclaimer, or missed, with counts and shares."""
    has = lambda t, n: planted.join(t, "run_id").where(F.contains(F.lower("claim"), F.lower("keyword"))).select("run_id", "keyword").distinct().withColumn(n, F.lit(True))
    j = planted.join(has(core, "in_core"), ["run_id", "keyword"], "left").join(has(disclaimers, "in_disclaimer"), ["run_id", "keyword"], "left")
    g = j.groupBy(F.when(F.col("in_core"), "validated").when(F.col("in_disclaimer"), "disclaimer_only").otherwise("missed").alias("outcome")).agg(F.count("*").alias("n"))
    return g.select("outcome", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("pct"))  # three rows


def cumulative_errors(files: DataFrame, catalog: DataFrame, detected: DataFrame) -> DataFrame:
    """File n of a product holds its errors 1 to n: how many of them are detected."""
    held = files.join(catalog, "product_id").where("error_num <= file_num")
    d = detected.select("product_id", "file_num", "error_num").distinct().withColumn("hit", F.lit(True))
    return held.join(d, ["product_id", "file_num", "error_num"], "left").groupBy("product_id", "file_num").agg(F.count("*").alias("held"), F.count("hit").alias("detected"))


def missed_tail(counts: DataFrame, catalog: DataFrame) -> DataFrame:
    """(product_id, n, n_detected): of the errors 1 to n the last n - n_detected count as missed, by type."""
    m = counts.where("n_detected < n").select("product_id", F.explode(F.sequence(F.col("n_detected") + 1, F.col("n"))).alias("error_num"))
    return m.join(catalog, ["product_id", "error_num"]).groupBy("product_id", "type").agg(F.count("*").alias("missed"))


def filter_impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """(product_id, run_id, n) with and without a filter: reduction by product and overall (ALL)."""
    j = before.withColumnRenamed("n", "b").join(after.withColumnRenamed("n", "a"), ["product_id", "run_id"], "left").na.fill(0, ["a"])
    g = j.rollup("product_id").agg(F.grouping("product_id").alias("_g"), F.sum("b").alias("before"), F.sum("a").alias("after"), F.count("*").alias("runs"))
    return g.select(F.when(F.col("_g") == 1, "ALL").otherwise(F.col("product_id")).alias("product_id"), "before", "after", F.round(F.try_divide(100 * (F.col("before") - F.col("after")), F.col("before")), 4).alias("reduction_pct"), F.round(F.col("after") / F.col("runs"), 4).alias("per_run"))


def detection_rates(rows: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Detected and all errors by each factor and overall, in one pass of grouping sets."""
    g = rows.groupingSets([[f] for f in factors] + [[]], *factors).agg(F.grouping_id(*factors).alias("_g"), F.count("*").alias("total"), F.count_if("detected").alias("detected"))
    n = len(factors)
    category, level = F.lit("overall"), F.lit("ALL")
    for i, f in enumerate(factors):
        mine = F.col("_g") == (1 << n) - 1 - (1 << (n - 1 - i))
        category, level = F.when(mine, f).otherwise(category), F.when(mine, F.col(f).cast("string")).otherwise(level)
    return g.select(category.alias("category"), level.alias("subcategory"), "total", "detected", F.round(100 * F.col("detected") / F.col("total"), 1).alias("rate"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(run, a, b booleans) -> adds the class of agreement."""
    x, y = F.col(a), F.col(b)
    return rows.withColumn("agreement", F.when(x & y, "both_detected").when(~x & ~y, "both_missed").when(x, f"{a}_only").otherwise(f"{b}_only"))


def agreement_summary(rows: DataFrame, a: str, b: str) -> DataFrame:
    r = agreement(rows, a, b)
    k = lambda v: F.count_if(F.col("agreement") == v)
    return r.agg(F.count("*").alias("n"), *[k(v).alias(v) for v in ("both_detected", "both_missed", f"{a}_only", f"{b}_only")], F.round(100 * (k("both_detected") + k("both_missed")) / F.count("*"), 4).alias("agreement_pct"))


def false_positive_rate(rows: DataFrame) -> DataFrame:
    """(flags, true_positives) -> false positives and their share of the flags."""
    return rows.agg(F.sum("flags").alias("flags"), F.sum("true_positives").alias("true_positives"), (F.sum("flags") - F.sum("true_positives")).alias("false_positives"), F.round(F.try_divide(100 * (F.sum("flags") - F.sum("true_positives")), F.sum("flags")), 4).alias("fp_pct"))


def overlap_summary(rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Zero-filled counts of the agreement classes."""
    dim = rows.sparkSession.createDataFrame([(c,) for c in classes], "agreement string")
    return dim.join(rows.groupBy("agreement").agg(F.count("*").alias("n")), "agreement", "left").select("agreement", F.coalesce("n", F.lit(0)).alias("n"))


def rerun_stability(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, detected, claims array) of two runs -> identical, different_count or different_detection; counts of equal size need equal sorted claims."""
    x = a.select("file", F.col("detected").alias("d1"), F.array_sort("claims").alias("c1"))
    y = b.select("file", F.col("detected").alias("d2"), F.array_sort("claims").alias("c2"))
    j = x.join(y, "file", "full_outer")
    same = F.coalesce("d1", F.lit(False)) == F.coalesce("d2", F.lit(False))
    return j.select("file", F.when(~same, "different_detection").when(F.size(F.coalesce("c1", F.array())) != F.size(F.coalesce("c2", F.array())), "different_count").when(F.coalesce("c1", F.array()) == F.coalesce("c2", F.array()), "identical").otherwise("different_claims").alias("stability"))


def run_delta(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    x, y = a.groupBy(key).agg(F.sum(value).alias("first")), b.groupBy(key).agg(F.sum(value).alias("second"))
    j = x.join(y, key, "full_outer").na.fill(0, ["first", "second"])
    return j.select(key, "first", "second", (F.col("second") - F.col("first")).alias("delta"), F.round(F.try_divide(100 * (F.col("second") - F.col("first")), F.col("first")), 4).alias("delta_pct"))


def corruption_levels(rows: DataFrame, products: Sequence[str]) -> DataFrame:
    """Detected files of each level by product."""
    return rows.groupBy("level").pivot("product_id", list(products)).agg(F.count_if("detected")).na.fill(0)


def review_topn(violations: DataFrame, k: int = 10, width: int = 100) -> DataFrame:
    """The k violations of highest confidence in each run, cut to a width, and how many more there are."""
    w = Window.partitionBy("run_id")
    r = violations.withColumn("rank", F.row_number().over(w.orderBy(F.desc("confidence"), "pos", "claim"))).withColumn("n", F.count("*").over(w))
    return r.where(F.col("rank") <= k).select("run_id", "rank", F.substring("claim", 1, width).alias("claim"), "confidence", F.greatest(F.col("n") - k, F.lit(0)).alias("remaining"))
