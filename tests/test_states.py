"""Latest states kept in a stream: late and repeated updates over many batches, recovery from the checkpoint."""

import random
from datetime import datetime, timedelta

from claimloom.operators import runlog as L
from claimloom.streaming import incremental as I

SCHEMA = "run_id long, status string, owner string, updated_at timestamp"
T0 = datetime(2024, 1, 1)


def put(spark, src, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{src}/{n}")


def states(spark, out):
    return {r.run_id: (r.status, r.owner, r.updated_at) for r in I.latest(spark.read.parquet(out)).collect()}


def test_late_updates_and_recovery(spark, tmp_path):
    """Files come in any order; the query ends and starts anew between them, as after a failure."""
    rng = random.Random(7)
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    seen = []
    for n in range(4):
        rows = [(rng.randrange(25), rng.choice(["pending", "running", "completed", None]), rng.choice(["u1", None]), T0 + timedelta(seconds=rng.randrange(300), microseconds=rng.randrange(3))) for _ in range(60)]
        rows += seen[:5] + [(None, "x", "y", T0), (3, "x", "y", None)]  # repeats, and rows without key or time
        put(spark, src, n, rows)
        seen += rows
        I.state_stream(spark, src + "/*", SCHEMA, out, ck, files=1).awaitTermination()
        want = {}
        for i, s, o, t in seen:
            if i is not None and t is not None and (i not in want or (t, s or "", o or "") > (want[i][2], want[i][0] or "", want[i][1] or "")):
                want[i] = (s, o, t)
        assert states(spark, out) == want
    rows = spark.read.parquet(out)
    assert rows.groupBy("run_id", "version").count().where("count > 1").count() == 0  # every change once
    before = rows.count()
    I.state_stream(spark, src + "/*", SCHEMA, out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == before
    runs = spark.createDataFrame([(1, "pending", None), (1000, "running", None)], "run_id long, status string, owner string")
    o = {r.run_id: (r.status, r.owner) for r in L.overlay(runs, I.latest(rows), {"status": None, "owner": "nobody"}).collect()}
    assert o[1000] == ("running", "nobody") and o[1] == (want[1][0] or "pending", want[1][1] or "nobody")


def test_audits_once_and_again_after_a_reset(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [
        [(1, "completed", "a", at(5)), (1, "completed", "a", at(5)), (2, "running", "a", at(1))],
        [(1, "completed", "a", at(9)), (1, "running", "a", at(2)), (2, "completed", "a", at(3))],  # a repeat, a late one
        [(1, "pending", "a", at(20))],
        [(1, "completed", "a", at(30)), (2, "completed", "b", at(2))],
    ]
    audited = []
    for n, rows in enumerate(batches):
        put(spark, src, n, rows)
        I.audit_changes_stream(spark, src + "/*", SCHEMA, lambda b: b.select("run_id", "version"), out, ck).awaitTermination()
        audited.append(sorted(r.run_id for r in spark.read.parquet(out).collect()))
    assert audited == [[1], [1, 2], [1, 2], [1, 1, 2]]
