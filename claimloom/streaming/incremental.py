"""Work on what is new: batches against a checkpoint, and the same as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_runs(runs: DataFrame, done: DataFrame) -> DataFrame:
    """Completed runs that the checkpoint doesn't have."""
    return runs.where("status = 'completed'").join(done.select("run_id").distinct(), "run_id", "left_anti")


def audit_stream(spark: SparkSession, source: str, schema: str, audit: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Audits the completed runs of new files once each. The batch number is part of the path, so that a batch
    that is run again after a failure replaces what it wrote."""
    runs = spark.readStream.schema(schema).parquet(source).where("status = 'completed'")

    def write(batch: DataFrame, n: int) -> None:
        audit(batch.dropDuplicates(["run_id"])).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return runs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CHANGES = "run_id long, status string, owner string, updated_at timestamp, prior string, version long"


def changes(updates: DataFrame) -> DataFrame:
    """A stream of updates (run_id, status, owner, updated_at) -> a row for each change of a run's latest state.

    The state of a run is its latest update, its version the number of changes so far. It is kept from batch
    to batch and comes back from the checkpoint; an update that is older than the state, however late it
    comes, changes nothing, and of those of one time the greatest status and owner counts. Updates without
    run_id or time are left out. `prior` is the status before, null at a run's first.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # times as whole microseconds, so that they compare exactly
        old = state.get if state.exists else None
        best = (old[2], old[0] or "", old[1] or "") if old else None
        now = old
        for f in frames:
            us = f["updated_at"].to_numpy("datetime64[us]").astype("int64").tolist()
            for t, status, owner in zip(us, f["status"], f["owner"], strict=True):
                status, owner = (x if isinstance(x, str) else None for x in (status, owner))
                if best is None or (t, status or "", owner or "") > best:
                    best, now = (t, status or "", owner or ""), (status, owner, t)
        if now is not old:
            version = (old[3] if old else 0) + 1
            state.update((*now, version))
            yield pd.DataFrame({"run_id": [key[0]], "status": [now[0]], "owner": [now[1]], "updated_at": [pd.Timestamp(now[2], unit="us")], "prior": [old[0] if old else None], "version": [version]})

    rows = updates.where("run_id is not null and updated_at is not null").select(F.col("run_id").cast("long").alias("run_id"), "status", "owner", F.col("updated_at").cast("timestamp").alias("updated_at"))
    return rows.groupBy("run_id").applyInPandasWithState(step, CHANGES, "status string, owner string, at long, version long", "update", GroupStateTimeout.NoTimeout)


def _written_by_batch(stream: DataFrame, sink: str, checkpoint: str, made: Callable[[DataFrame], DataFrame] = lambda b: b) -> StreamingQuery:
    """The batch number is part of the path, so that a batch that is run again after a failure replaces what it wrote."""

    def write(batch: DataFrame, n: int) -> None:
        made(batch).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def state_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Updates of new files, at most `files` a batch, as changes of the runs' latest states."""
    return _written_by_batch(changes(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)), sink, checkpoint)


def audit_changes_stream(spark: SparkSession, source: str, schema: str, audit: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Audits a run when its latest state becomes completed: once, whatever repeats or comes late in whatever
    batch; a run that was set back and is completed anew is audited again."""
    done = changes(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)).where("status = 'completed' and (prior is null or prior <> 'completed')")
    return _written_by_batch(done, sink, checkpoint, audit)


def latest(changes_: DataFrame) -> DataFrame:
    """The latest state of each run from the changes that state_stream() wrote."""
    newest = F.max_by(F.struct("status", "owner", "updated_at"), "version").alias("s")
    return changes_.groupBy("run_id").agg(newest).select("run_id", "s.status", "s.owner", "s.updated_at")


def deduplicated(stream: DataFrame, key: str = "run_id", ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def volume(rows: DataFrame, ts: str = "ts", window: str = "1 hour", lateness: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Calls in each window, on a table or a stream; late rows are dropped after the watermark on a stream."""
    w = F.window(ts, window)
    g = rows.withWatermark(ts, lateness).groupBy(w, by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), by, "n", "total")


def volume_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str) -> StreamingQuery:
    stream = spark.readStream.schema(schema).parquet(source)
    return volume(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
