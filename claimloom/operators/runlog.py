"""The run log: selection, derived columns, overlays and upkeep."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import time_slot


def completed(runs: DataFrame, no_traps: bool = False) -> DataFrame:
    out = runs.where(F.col("status") == "completed")
    return out.where(~F.col("trap_flag")) if no_traps else out


def pending(runs: DataFrame, slot: str | None = None, engine: str | None = None, first: int | None = None) -> DataFrame:
    """Pending runs, optionally of one slot and engine; the first so many by run_order."""
    out = runs.where(F.col("status") == "pending")
    for column, value in (("time_slot", slot), ("engine", engine)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.orderBy("run_order").limit(first) if first is not None else out


def pool(runs: DataFrame, user: str, filters: Mapping[str, object], first: int | None = None) -> DataFrame:
    """What a user may claim: pending, unassigned or theirs, and all given equalities."""
    out = runs.where((F.col("status") == "pending") & (F.col("owner").isNull() | (F.col("owner") == user)))
    for column, value in filters.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.orderBy("run_id").limit(first) if first is not None else out


def due(runs: DataFrame, strict: bool = True) -> DataFrame:
    """Pending runs by schedule time; with strict, a run without a time is an error."""
    p = runs.where(F.col("status") == "pending")
    if strict and not p.where("scheduled is null").isEmpty():
        raise ValueError("pending runs without a schedule time")
    return p.orderBy("scheduled", "run_id")


def derived(runs: DataFrame) -> DataFrame:
    """prompt_id, output_path, material, and the parts of the schedule time."""
    material = F.regexp_replace("material_type", r"\.j2$", "")
    return runs.select(
        "run_id", F.concat_ws("_", "product_id", material, F.lit("v1")).alias("prompt_id"), F.concat(F.lit("outputs/"), F.col("run_id").cast("string"), F.lit(".txt")).alias("output_path"), material.alias("material"),
        F.hour("scheduled").alias("hour"), F.date_format("scheduled", "EEEE").alias("day_name"), (F.dayofweek("scheduled").isin(1, 7)).alias("is_weekend"), F.to_date("scheduled").alias("date"), time_slot(F.hour("scheduled")).alias("slot"),
    )


def delays(runs: DataFrame) -> DataFrame:
    """Seconds from start to end and from schedule to start; 0 where a time is missing or malformed (the times may be text)."""
    micros = lambda c: F.unix_micros(F.expr(f"try_to_timestamp(cast({c} as string))"))
    span = lambda a, b: F.coalesce((micros(b) - micros(a)) / 1e6, F.lit(0.0))
    return runs.select("run_id", span("started_at", "completed_at").alias("duration_sec"), span("scheduled", "started_at").alias("delay_sec"))


def overlay(runs: DataFrame, updates: DataFrame, columns: Mapping[str, object]) -> DataFrame:
    """The latest update of each run over its columns; a column that is null in both gets its default."""
    latest = updates.groupBy("run_id").agg(*[F.max_by(c, "updated_at").alias(f"new_{c}") for c in columns])
    j = runs.join(latest, "run_id", "left")
    return j.select(*[c for c in runs.columns if c not in columns], *[F.coalesce(F.col(f"new_{c}"), F.col(c), F.lit(d)).alias(c) for c, d in columns.items()])


def append_new(runs: DataFrame, extra: DataFrame) -> DataFrame:
    """Runs whose key is new are added; those known stay as they are."""
    return runs.unionByName(extra.dropDuplicates(["run_id"]).join(runs.select("run_id"), "run_id", "left_anti").select(runs.columns))


def append_counts(runs: DataFrame, extra: DataFrame) -> DataFrame:
    known = runs.select("run_id").distinct().withColumn("known", F.lit(True))
    return extra.join(known, "run_id", "left").agg(F.count_if(F.col("known").isNull()).alias("added"), F.count_if(F.col("known")).alias("skipped"))


def reset(runs: DataFrame, engine: str, clear: list[str]) -> DataFrame:
    hit = F.col("engine") == engine
    return runs.withColumns({"status": F.when(hit, "pending").otherwise(F.col("status"))} | {c: F.when(~F.coalesce(hit, F.lit(False)), F.col(c)) for c in clear})


def shift(runs: DataFrame, engine: str, days: int) -> DataFrame:
    moved = F.col("scheduled") + F.make_dt_interval(F.lit(days))
    return runs.withColumn("scheduled", F.when(F.col("engine") == engine, moved).otherwise(F.col("scheduled")))


def first_per_run(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key in an explicit order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def status_counts(runs: DataFrame, statuses: list[str]) -> DataFrame:
    """A row for each status, zero-filled, and the total."""
    dim = runs.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counted = runs.groupBy("status").agg(F.count("*").alias("n"))
    out = dim.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return out.unionByName(runs.agg(F.lit("total").alias("status"), F.count("*").alias("n")))


def shared_keys(claims: DataFrame) -> DataFrame:
    """Keys that more than one owner holds."""
    return claims.groupBy("key").agg(F.countDistinct("owner").alias("owners")).where("owners > 1")


def resume(runs: DataFrame, done: DataFrame) -> DataFrame:
    """Completed runs that no checkpoint has."""
    return completed(runs).join(done.select("run_id").distinct(), "run_id", "left_anti")
