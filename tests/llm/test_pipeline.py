import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_and_columns(spark, tmp_path):
    rng = random.Random(3)
    w = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.choice('xyz')}{rng.randrange(60)}" for _ in range(n))
    item = "how many red apples does the small boy carry home from the market when it rains"
    rows, labels = [], []
    for i in range(200):
        good = i % 5 != 0
        rows.append((i, w(60) if good else " ".join(x + "***" for x in w(60).split()), "en", f"s{i % 3}", 1))
        labels.append((i, int(good), 0))
    rows += [(300, rows[1][1], "en", "s0", 1), (301, f"{w(30)}. {item} {w(20)}", "en", "s1", 1)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        left[name] = {r.doc_id for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {i for i in range(200) if i % 5} | {300, 301}
    assert left["quality"] == left["line_dedup"] == good
    assert left["near_dedup"] == good and left["decontaminate"] == good - {301} and left["mixing"] <= good - {300, 301}
    assert [name for name, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "mixing"]
    assert pipeline.run(spark, d).count() == docs.count()


def test_near_copies_go(spark):
    """Documents with one to three words of 100 changed, and one that shares less than 0.8 of its shingles."""
    rng = random.Random(8)
    w = lambda n: [f"{rng.choice('abcdefgh')}{rng.choice('xyz')}{rng.randrange(600)}" for _ in range(n)]
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    base = [w(100) for _ in range(30)]
    copies = [[*b] for b in base]
    for i, c in enumerate(copies[:-1]):
        for k in range(1 + i % 3):
            c[k * 2 + 5 + i] = "changed"
    for k in range(5, 100, 20):
        copies[-1][k] = "changed"
    near = {i for i, (b, c) in enumerate(zip(base, copies)) if len(shingles(b) & shingles(c)) >= 0.8 * len(shingles(b) | shingles(c))}
    assert near == set(range(29))
    rows = [(i, " ".join(t), 1) for i, t in enumerate(base + copies)] + [(None, " ".join(base[0]), 1), (90, None, 1), (91, " ", 1), (92, "one", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = dict(pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in out.collect()) == [-1, *range(30), 59, 90, 92]
    assert dict(pipeline.STAGES)["near_dedup"](spark, docs.limit(0), "").count() == 0


def test_repeated_rows_do_not_gather_the_others(spark):
    """One row that repeats, among many: one of it stays, no window takes the table, and no task gets all of it."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(40)), i) for i in range(400)]
    rows += [rows[7]] * 30 + [(None, None, 1), (None, "no id", 1)]
    out = dict(pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(8), "")
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert max(r["count"] for r in out.groupBy(__import__("pyspark.sql.functions", fromlist=["x"]).spark_partition_id()).count().collect()) < 200
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == [-1, -1, *range(400)]


def test_every_stage_on_edge_cases(spark, tmp_path):
    """Null, empty, very long, tied and repeated rows, clashing columns, then an empty table."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, long), (6, "same text here"), (7, "same text here"), (7, "same text here"), (None, "no id at all here"), (None, None), (8, "Größe ÄÖ été")]
    docs = spark.createDataFrame([(i, t, "en", None, None, 7, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key int, id string").withColumns({c: __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1) for c in ("d", "t", "norm", "root", "score", "taken", "n", "h")})
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "an item that no text holds")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    ids = lambda df: sorted(-1 if r.doc_id is None else r.doc_id for r in df.collect())
    every = sorted(-1 if i is None else i for i, _ in rows)
    want = {"quality": every, "line_dedup": every, "decontaminate": every, "near_dedup": [-1, -1, 1, 4, 5, 6, 8]}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, d)
        assert name == "mixing" or out.columns == docs.columns
        assert set(docs.columns) <= set(out.columns) and (ids(out) == want[name] if name in want else out.count() > 0)
        assert stage(spark, docs.limit(0), d).count() == 0
