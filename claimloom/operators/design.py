"""Samples and experiment designs. All randomness is a hash of a key and a seed: reruns agree, and
no row depends on the order of another."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of a condition that a task makes at a time.
STRETCH = 100_000


def draw(key: Column | str, seed: int) -> Column:
    """A hash order that other engines share."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", k.cast("string"), F.lit(str(seed))))


def uniform(key: Column | str, seed: int) -> Column:
    """0 to 1, from 48 bits of the draw."""
    return F.conv(F.substring(draw(key, seed), 1, 12), 16, 10).cast("double") / float(1 << 48)


def stratified(rows: DataFrame, by: Sequence[str], n: int, seed: int = 42, key: str = "run_id") -> DataFrame:
    """Up to n rows of each stratum. The rank filter is pushed below the shuffle as a window group limit."""
    w = Window.partitionBy(*by).orderBy(draw(key, seed), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def short_strata(rows: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("size")).where(F.col("size") < n)


def sample_n(rows: DataFrame, n: int, seed: int = 42, key: str = "run_id") -> DataFrame:
    return rows.orderBy(draw(key, seed), key).limit(n)


def review_sample(rows: DataFrame, n: int, seed: int = 42, key: str = "run_id") -> DataFrame:
    """One row a run outside HIGH and CRITICAL, half compliant and half not; a class that is short leaves its places to the other."""
    one = rows.where(~F.coalesce(F.col("severity").isin("HIGH", "CRITICAL"), F.lit(False))).dropDuplicates([key])
    have = {r.compliant: r.n for r in one.groupBy("compliant").agg(F.count("*").alias("n")).collect()}  # three rows at most
    yes, no = have.get(True, 0), have.get(False, 0)
    want_yes = min(yes, max(n // 2, n - no))
    want_no = min(no, n - want_yes)
    take = lambda flag, k: one.where(F.col("compliant") == flag).orderBy(draw(key, seed), key).limit(k)
    return take(True, want_yes).unionByName(take(False, want_no))


def head_per_group(rows: DataFrame, by: str, n: int, *order: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def one_per_group(rows: DataFrame, by: str, seed: int = 42, key: str = "run_id") -> DataFrame:
    return stratified(rows, [by], 1, seed, key).drop("rank")


def cartesian(spark: SparkSession, factors: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the levels of some factors: a handful of literals exploded in turn."""
    out = spark.range(1).select()
    for name, levels in factors.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in levels])).alias(name))
    return out


def replicated(conditions: DataFrame, r: int, start: str, days: int, seed: int = 42) -> DataFrame:
    """Every condition r times, each with a hashed day, slot, hour and minute."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in conditions.columns], F.col("repetition_id").cast("string"))
    out = conditions.select("*", F.explode(F.sequence(F.lit(1), F.lit(r))).alias("repetition_id")).withColumn("run_id", F.sha1(key))
    pick = lambda n, s: F.floor(uniform("run_id", seed + s) * n).cast("int")
    out = out.withColumn("day", pick(days, 0)).withColumn("slot", F.element_at(F.array(F.lit("morning"), F.lit("afternoon"), F.lit("evening")), pick(3, 1) + 1))
    first = F.when(F.col("slot") == "morning", 8).when(F.col("slot") == "afternoon", 12).otherwise(17)
    out = out.withColumn("hour", first + pick(4, 2)).withColumn("minute", pick(60, 3)).withColumn("date", F.date_add(F.to_date(F.lit(start)), F.col("day")))
    return out.withColumn("is_weekend", F.dayofweek("date").isin(1, 7))


def run_ids(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """sha1 of the canonical JSON (sorted keys, no spaces) of the columns."""
    return rows.withColumn("run_id", F.sha1(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})))


def duplicates(rows: DataFrame, key: str = "run_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def shuffled(rows: DataFrame, seed: int = 42, key: str = "run_id") -> DataFrame:
    """run_order: a permutation by hash. Ranks are counted inside hash ranges, with the sizes of the ranges before."""
    d = rows.withColumn("_h", draw(key, seed)).withColumn("_b", F.substring("_h", 1, 3))  # 4096 ranges
    before = d.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return d.join(F.broadcast(before), "_b").withColumn("run_order", F.col("_before") + at).drop("_h", "_b", "_before")


def scheduled(rows: DataFrame, start: str, hours: float, seed: int = 42, key: str = "run_id") -> DataFrame:
    """A uniform time in the window for every run."""
    micros = (uniform(key, seed) * hours * 3_600_000_000).cast("long")
    return rows.withColumn("scheduled", F.timestamp_micros(F.unix_micros(F.to_timestamp(F.lit(start))) + micros))


def balanced(rows: DataFrame, within: Sequence[str], column: str, levels: Sequence, seed: int = 42, key: str = "run_id") -> DataFrame:
    """Levels dealt round robin over the hashed order inside each cell: counts of a cell differ by one at most. Cells begin at a hashed level, so that remainders spread."""
    d = rows.withColumn("_h", draw(key, seed)).withColumn("_b", F.substring("_h", 1, 3))  # 4096 ranges of a cell: none is sorted in one task
    sizes = d.groupBy(*within, "_b").agg(F.count("*").alias("_n"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*within, "_b")]
    starts = sizes.select(*within, "_b", (F.sum("_n").over(Window.partitionBy(*within).orderBy("_b")) - F.col("_n")).alias("_before"))
    on = same[0]
    for c in same[1:]:
        on = on & c
    d = d.withColumn("_at", F.row_number().over(Window.partitionBy(*within, "_b").orderBy("_h", key)))
    # sorted on both sides: neither is broadcast, for rows made here look few to the planner
    rows = d.alias("d").join(starts.alias("s").hint("merge"), on).select("d.*", F.col("s._before").alias("_before"))
    at = F.col("_before") + F.col("_at") - 1
    offset = F.floor(uniform(F.concat_ws("|", *[F.col(c).cast("string") for c in within]), seed) * len(levels)).cast("int") if within else F.lit(0)
    return rows.withColumn(column, F.element_at(F.array(*[F.lit(v) for v in levels]), ((at + offset) % len(levels) + 1).cast("int"))).drop("_h", "_b", "_at", "_before")


def stratified_matrix(conditions: DataFrame, total: int, days: Sequence[str], slots: Sequence[str], seed: int = 42) -> DataFrame:
    """`total` runs over the conditions by quota, the remainder one each to conditions in hash order;
    days balanced in each condition, slots in each day."""
    n = max(1, conditions.count())
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in conditions.columns])
    c = shuffled(conditions.withColumn("run_id", key), seed).withColumn("quota", F.lit(total // n) + (F.col("run_order") <= total % n).cast("int"))
    stretch = F.explode(F.sequence(F.lit(1), F.col("quota"), F.lit(STRETCH))).alias("_from")
    c = c.where("quota > 0").select(*conditions.columns, F.col("run_id").alias("condition"), "quota", stretch).repartition(min(1000, n + total // STRETCH) or 1, "condition", "_from")
    upto = F.least("quota", F.col("_from") + (STRETCH - 1))
    runs = c.select(*conditions.columns, "condition", F.explode(F.sequence("_from", upto)).alias("repetition_id"))
    runs = runs.withColumn("run_id", F.sha1(F.concat_ws("#", "condition", F.col("repetition_id").cast("string"))))
    return balanced(balanced(runs, ["condition"], "day", days, seed), ["day"], "slot", slots, seed)


def matrix_checks(rows: DataFrame, expected: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """factor -> level -> expected count: (check, expected, actual, pass), and the total."""
    parts = None
    spark = rows.sparkSession
    for factor, levels in expected.items():
        dim = spark.createDataFrame([(str(k), v) for k, v in levels.items()], "level string, expected long")
        g = rows.groupBy(F.col(factor).cast("string").alias("level")).agg(F.count("*").alias("actual"))
        one = dim.join(g, "level", "left").select(F.concat(F.lit(f"{factor}="), "level").alias("check"), "expected", F.coalesce("actual", F.lit(0).cast("long")).alias("actual"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.withColumn("pass", F.col("expected") == F.col("actual"))


def fingerprint(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row that any change of the core columns changes and no order of rows does: the count and
    sums of two halves of each row's sha256."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(columns)]), 256)
    half = lambda k: F.sum(F.conv(F.substring(h, k, 12), 16, 10).cast("decimal(38,0)"))
    return rows.agg(F.count("*").alias("n"), half(1).cast("string").alias("sum1"), half(13).cast("string").alias("sum2"))
