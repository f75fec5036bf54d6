"""Exact order statistics of groups of any size, by refining ranges.

A group's values are counted in ranges between approximate quantiles, the range that holds the wanted
rank is chosen, and its rows are counted again in finer ranges, until few rows are left to sort or
all are equal. Only counts are shuffled; no group is held or sorted whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows of a range that are sorted; ranges of a round.
FEW, CUTS = 100_000, 64


def _same(a: DataFrame, b: DataFrame, by: Sequence[str]) -> Column:
    """Null groups are groups."""
    out = F.lit(True)
    for c in by:
        out = out & a[c].eqNullSafe(b[f"_{c}"])
    return out


def _named(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_{c}" for c in by})


def at_ranks(rows: DataFrame, by: Sequence[str], value: str, ranks: DataFrame, few: int = FEW, cuts: int = CUTS) -> DataFrame:
    """(*by, rank, found): the value at each wanted rank (from 0) of its group's non-null values in order.

    ranks has (*by, rank, n), n being the number of the group's values. Ranks outside give no row. Rounds
    number about log(n / few) / log(cuts); groups of up to `few` values need none.
    """
    values = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    # each wanted rank: the values its range is between (null: open), whether they are in it, rows below and inside
    t = values.schema["_v"].dataType
    none = F.lit(None).cast(t)
    state = ranks.where("rank >= 0 and rank < n").select(*by, "rank", none.alias("_lo"), none.alias("_hi"), F.lit(False).alias("_one"), F.lit(0).cast("long").alias("_below"), F.col("n").cast("long").alias("_n"))
    while not (wide := state.where(F.col("_n") > few).where("not _one")).isEmpty():
        inside = _inside(values, wide, by)
        at = inside.groupBy(*by, "rank").agg(F.percentile_approx("_v", [i / cuts for i in range(1, cuts)], 100 * cuts).alias("_cuts"))
        at = _named(at.withColumn("_cuts", F.array_distinct("_cuts")).withColumnRenamed("rank", "_rank"), by)
        bucket = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")  # a cut is a range of its own
        met = inside.join(at, _same(inside, at, by) & (inside["rank"] == at["_rank"])).withColumn("_b", bucket)
        counts = met.groupBy(*by, "rank", "_below", "_b").agg(F.count("*").alias("_k"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        upto = F.col("_below") + F.sum("_k").over(Window.partitionBy(*by, "rank").orderBy("_b"))  # at most 2 * cuts rows
        chosen = counts.withColumn("_upto", upto).where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("_k") <= F.col("rank")))
        finer = chosen.select(*by, "rank", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_least") == F.col("_most")).alias("_one"), (F.col("_upto") - F.col("_k")).alias("_below"), F.col("_k").alias("_n"))
        state = written(state.where((F.col("_n") <= few) | F.col("_one")).unionByName(finer), "ranges")
    single = state.where("_one").select(*by, "rank", F.col("_lo").alias("found"))
    counted = _inside(values, state.where("not _one"), by).groupBy(*by, "rank", "_below", "_v").agg(F.count("*").alias("_k"))
    upto = F.col("_below") + F.sum("_k").over(Window.partitionBy(*by, "rank").orderBy("_v"))  # at most `few` rows
    return single.unionByName(counted.withColumn("_upto", upto).where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("_k") <= F.col("rank"))).select(*by, "rank", F.col("_v").alias("found")))


def _inside(values: DataFrame, state: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows in the ranges, once for each rank that is wanted of their group."""
    s = _named(state, by)
    met = values.join(s, _same(values, s, by))
    return met.where((F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi")))).select(*by, "_v", "rank", "_below")


def quantiles(rows: DataFrame, by: Sequence[str], value: str, p: float, few: int = FEW, cuts: int = CUTS) -> DataFrame:
    """(*by, n, quantile): the exact quantile of each group's non-null values, between two of them by their distance.

    Null groups are groups, groups without values have a null quantile, an empty table no rows.
    """
    sizes = rows.groupBy(*by).agg(F.count(value).alias("n"))
    at = (F.col("n") - 1) * p
    ranks = sizes.where("n > 0").select(*by, "n", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank"))
    found = at_ranks(rows, by, value, ranks, few, cuts).groupBy(*by).agg(F.min(F.struct("rank", "found"))["found"].cast("double").alias("_a"), F.max(F.struct("rank", "found"))["found"].cast("double").alias("_b"))
    f = _named(found.withColumnsRenamed({"_a": "a__", "_b": "b__"}), by)
    return sizes.join(f, _same(sizes, f, by), "left").select(*by, "n", (F.col("a__") + (F.col("b__") - F.col("a__")) * (at - F.floor(at))).alias("quantile"))
