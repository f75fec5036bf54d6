import math

import pytest
from pyspark.sql import functions as F

from claimloom.operators import aggregates as A
from claimloom.operators import audit as U
from claimloom.operators import compare as M
from claimloom.operators import design as D
from claimloom.operators import rules as R
from claimloom.operators import runlog as L
from claimloom.operators import stats as S
from claimloom.sources import io
from claimloom.streaming import incremental


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_overlay_and_append(spark):
    runs = spark.createDataFrame([(1, "pending", None), (2, "running", "a")], "run_id int, status string, owner string")
    up = spark.createDataFrame([(1, "running", "x", 1), (1, "completed", None, 2)], "run_id int, status string, owner string, updated_at int")
    assert rows(L.overlay(runs, up, {"status": "pending", "owner": "nobody"}), "run_id", "status", "owner") == [(1, "completed", "nobody"), (2, "running", "a")]
    assert rows(L.append_new(runs, runs.withColumn("run_id", F.col("run_id") + 1)), "run_id") == [(1,), (2,), (3,)]


def test_delays_default_to_zero(spark):
    d = spark.createDataFrame([(1, "2026-01-01 00:00:00", "2026-01-01 00:00:05", "2026-01-01 00:00:00"), (2, "2026-01-01 00:00:03", "", "soon")], "run_id int, started_at string, completed_at string, scheduled string")
    assert rows(L.delays(d), "run_id", "duration_sec", "delay_sec") == [(1, 5.0, 0.0), (2, 0.0, 0.0)]


def test_due_refuses_missing_times(spark):
    d = spark.createDataFrame([(1, "pending", None)], "run_id int, status string, scheduled timestamp")
    with pytest.raises(ValueError):
        L.due(d)


def test_audit_core(spark):
    s = spark.createDataFrame([(1, "authorized", 0, "a", 0.95, 0.0), (1, "prohibited", 1, "b", 0.0, 0.95), (2, "authorized", 0, "a", 0.2, 0.0)], "claim_id int, rule_type string, rule_idx int, rule_text string, contradiction double, entailment double")
    assert rows(U.reduce_scores(s), "claim_id", "side", "violation") == [(1, "factual", True), (2, "factual", False)]
    runs = spark.createDataFrame([(1,), (2,), (3,)], "run_id int")
    v, e = spark.createDataFrame([(1,), (1,)], "run_id int"), spark.createDataFrame([(3,)], "run_id int")
    assert rows(U.run_status(runs, v, e), "run_id", "audit_status", "n_violations") == [(1, "FAIL", 2), (2, "PASS", 0), (3, "ERROR", 0)]


def test_score_pairs_accepts_a_model(spark):
    import numpy as np

    p = spark.createDataFrame([(1, "x", "y"), (2, "x", "y")], "claim_id int, claim string, rule_text string")
    got = U.score_pairs(p, lambda: lambda a, b: np.tile([0.1, 0.2, 0.7], (len(a), 1)), tasks=2)
    assert rows(got, "claim_id", "neutral") == [(1, 0.7), (2, 0.7)]


def test_reduction_estimate(spark):
    c = spark.createDataFrame([("p",)] * 30, "product_id string")
    r = spark.createDataFrame([("p",)] * 25, "product_id string")
    assert U.reduction(c, r).first()[1:] == (750, 150, 80.0)


def test_keyword_and_range_joins(spark):
    k = spark.createDataFrame([(1, "e", ["red", "blue"]), (2, "e", ["x"])], "run_id int, error string, keywords array<string>")
    v = spark.createDataFrame([(1, 0, "A BLUE one"), (1, 1, "red")], "run_id int, pos int, claim string")
    assert rows(M.keyword_matches(k, v), "run_id", "detected", "found", "first_claim") == [(1, True, ["blue", "red"], "A BLUE one"), (2, False, [], None)]
    files = spark.createDataFrame([("p", n) for n in range(1, 11)], "product_id string, file_num int")
    cat = spark.createDataFrame([("p", n) for n in range(1, 11)], "product_id string, error_num int")
    assert M.cumulative_errors(files, cat, files.where("file_num < 0").withColumn("error_num", F.lit(1))).agg(F.sum("held")).first()[0] == 55


def test_three_way(spark):
    w = spark.createDataFrame([(True, True, True), (True, False, False), (False, True, True), (True, True, False)], "a boolean, b boolean, c boolean")
    assert sorted(r["class"] for r in M.three_way_class(w, "a", "b", "c").collect()) == ["all_three", "both_b_c", "only_a", "other"]


def test_designs_balance(spark):
    c = D.cartesian(spark, {"engine": ["a", "b"], "material": ["x", "y", "z"], "t": [0.2, 0.6]})
    assert c.count() == 12
    m = D.stratified_matrix(c, 100, ["Mon", "Tue"], ["am", "pm"])
    assert m.count() == 100 and m.select("run_id").distinct().count() == 100
    assert {r.n for r in m.groupBy("engine", "material", "t").agg(F.count("*").alias("n")).collect()} == {8, 9}
    slots = m.groupBy("day").pivot("slot").count().collect()
    assert all(abs(r.am - r.pm) <= 1 for r in slots)
    order = D.shuffled(m.drop("quota"))
    assert sorted(r.run_order for r in order.collect()) == list(range(1, 101))
    assert rows(D.fingerprint(m, ["run_id", "day"]), "n", "sum1") == rows(D.fingerprint(m.orderBy(F.desc("run_id")), ["run_id", "day"]), "n", "sum1")


def test_tails():
    assert S.t_tail(2.0, 10) == pytest.approx(0.036694, abs=1e-6)
    assert S.f_tail(4.0, 2, 20) == pytest.approx(0.034572, abs=1e-5)
    assert S.chi2_tail(5.991, 2) == pytest.approx(0.05, abs=1e-4)
    assert S.normal_tail(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert S.range_tail(3.877, 3, 10) == pytest.approx(0.05, abs=1e-3)  # tabled 5 % point
    assert S.stars(0.004) == "**" and S.stars(None) == "undefined"


def test_statistics_by_hand(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 4.0), ("b", 6.0)], "g string, v double")
    assert S.anova(d, "g", "v").first().f == pytest.approx(2.4)
    k = S.kruskal(d, "g", "v").first()
    assert k.h == pytest.approx(1.7647, abs=1e-3)
    m = S.mann_whitney(d, "g", "v", "a", "b").first()
    assert m.u == pytest.approx(1.5) and m.rank_biserial == pytest.approx(1 - 3 / 9)
    x = spark.createDataFrame([("a", "x")] * 8 + [("a", "y")] * 2 + [("b", "x")] * 3 + [("b", "y")] * 7, "g string, h string")
    assert S.chi2_table(x, "g", "h").first().chi2 == pytest.approx(3.2323, abs=1e-3)
    two = S.anova_twoway(spark.createDataFrame([(a, b, float(i + 2 * (a == "p") + j)) for i, b in enumerate("xy") for a in "pq" for j in range(3)], "a string, b string, v double"), "a", "b", "v").collect()
    assert two[0].statistic == pytest.approx(12.0) and two[2].statistic == pytest.approx(0.0, abs=1e-9)


def test_upper_median_and_drift(spark):
    d = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int")
    assert A.upper_median(d, "v").first()[0] == 3
    e = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0)], "g string, hit_rate double")
    assert rows(A.drift(e, ["g"]), "g", "mean", "std") == [("a", 2.0, 1.0)]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "runs.csv").write_text("run_id,tokens,flag\n1,5,True\n2,,x\n")
    got = io.read_csv(spark, str(tmp_path / "runs.csv"), "run_id int, tokens int, flag boolean")
    assert rows(got.na.fill(-1), "run_id", "tokens", "flag")[0] == (1, 5, True) and got.where("run_id = 2").first().flag is None
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("one\ntwo")
    texts = io.read_texts(spark, str(tmp_path / "t"))
    assert rows(texts, "run_id", "text") == [("a", "one\ntwo")]
    both = io.attach_texts(spark.createDataFrame([("a",), ("b",)], "run_id string"), texts)
    assert rows(both, "run_id", "skipped") == [("a", False), ("b", True)]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert io.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2
    assert io.bad_lines(spark, str(tmp_path / "x.jsonl"), "a int") == 1
    (tmp_path / "y").mkdir()
    (tmp_path / "y/phone.yaml").write_text("product_id: phone\nauthorized_claims:\n - statement: 120 Hz display\n - ''\nspecs:\n  camera:\n    main: [50 MP]\nprohibited_claims: [cures all]\n")
    (tmp_path / "y/phone_GROUND_TRUTH.yaml").write_text("product_id: phone\nspecs: {ram: [8 GB]}\n")
    r = io.read_rules(spark, str(tmp_path / "y"))
    assert rows(r.where("rule_set = 'regular'"), "rule_type", "category_path", "rule_text") == [("authorized", "", "120 Hz display"), ("prohibited", "", "cures all"), ("spec", "camera.main", "50 MP")]
    assert rows(io.preferred_rules(r), "rule_text") == [("8 GB",)]
    path = str(tmp_path / "out")
    d = spark.createDataFrame([(1, "a")], "a int, b string")
    io.append_checked(d, path), io.append_checked(d, path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        io.append_checked(d.withColumn("c", F.lit(1)), path)
    io.write_csv(spark.createDataFrame([(1.23456,)], "v double"), str(tmp_path / "csv"), ["v"], {"v": 2})
    assert io.merge_csvs(spark, str(tmp_path / "csv/*.csv"), "v double").first().v == 1.23
    io.write_jsonl(d, str(tmp_path / "json"))
    assert io.read_json_files(spark, str(tmp_path / "json/*.json"), "a int, b string").first().b == "a"
    assert rows(io.write_claims(spark.createDataFrame([(1, "p"), (1, "p")], "run_id int, product_id string"), str(tmp_path / "claims")), "run_id", "n_claims") == [(1, 2)]


def test_streams_do_each_file_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    runs = spark.createDataFrame([(1, "completed"), (1, "completed"), (2, "pending")], "run_id int, status string")
    runs.write.parquet(src)
    for _ in range(2):
        incremental.audit_stream(spark, src, "run_id int, status string", lambda b: b.withColumn("ok", F.lit(True)), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 1
    ev = str(tmp_path / "ev")
    spark.sql("select timestamp'2026-01-01 00:10:00' + make_interval(0,0,0,0,id) ts, 'a' event_type, 1.0D value from range(6)").write.parquet(ev)
    incremental.volume_stream(spark, ev, "ts timestamp, event_type string, value double", str(tmp_path / "vol"), str(tmp_path / "ck2")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "vol"))
    assert got.count() == 4 and got.agg(F.max("n")).first()[0] == 1  # hours past the watermark are closed


def test_mode_of_p_values():
    assert math.isclose(S.beta_cdf(0.5, 2, 2), 0.5)


def test_designs_broadcast_no_runs(spark):
    """Runs that are made from quotas look few to the planner; the only table that is sent to all tasks is that of hash ranges."""
    c = spark.range(3).select(F.col("id").cast("string").alias("engine"))
    plan = D.stratified_matrix(c, 50, ["a", "b"], ["x", "y"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [coalesce" in text and "BroadcastHashJoin [coalesce" not in text
    assert plan.count() == plan.select("run_id").distinct().count() == 50


def _pair_tables(spark):
    c = spark.createDataFrame([(i, "p", "size" if i % 3 else None, "50 GB" if i % 2 else "60 GB") for i in range(60)], "claim_id long, product_id string, category string, claim string")
    r = spark.createDataFrame([(j, "p", "size" if j % 2 else "general", "authorized", "50 GB" if j % 4 < 2 else None) for j in range(40, 0, -1)], "rule_idx long, product_id string, category string, rule_type string, rule_text string")
    return c, r


def test_candidates_of_one_file_go_to_all_cores(spark):
    c, r = _pair_tables(spark)
    pairs = U.candidate_pairs(c.coalesce(1), F.broadcast(r))
    assert pairs.rdd.getNumPartitions() >= 4 and pairs.count() == 40 * 20


def test_equal_numbers_are_compared_once(spark):
    c, r = _pair_tables(spark)
    v = U.numeric_violations(c, r)
    want = {(i, 1 if i % 3 else 4) for i in range(0, 60, 2)}
    assert {(x.claim_id, x.rule_idx) for x in v.collect()} == want and {x.rule_text for x in v.collect()} == {"50 GB"}
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 4, plan  # claims and specs by their numbers before they meet


def test_scores_of_candidates_are_those_of_pairs(spark):
    c, r = _pair_tables(spark)
    columns = ["claim_id", "rule_idx", "claim", "rule_text", "contradiction", "entailment", "neutral"]
    got, want = ([tuple(x) for x in df.select(columns).orderBy("claim_id", "rule_idx").collect()] for df in (U.score_candidates(c, r), U.score_pairs(U.candidate_pairs(c, r))))
    assert got == want and len(got) == 800


def test_numbers_meet_different_specs_and_come_back_for_every_one(spark):
    """2,500 repeats of a spec are three rows of the join, and 2,500 of the result."""
    numbers = spark.createDataFrame([(1, "p", 0, 10.0, "g"), (2, "p", 1, 20.0, "g"), (3, "q", 0, 10.0, "g"), (4, "p", 0, None, "g")], "run_id int, product_id string, ord int, value double, unit string")
    specs = spark.range(2500).selectExpr("'p' as product_id", "20.0D as value", "'g' as unit").union(spark.createDataFrame([("p", None, "g"), ("p", 15.0, "mg"), ("p", 15.0, "mg"), ("q", 10.0, "g")], "product_id string, value double, unit string"))
    assert R._different_specs(specs, "product_id", "value", "unit").count() == 3 + 3
    off = R.number_errors(numbers, specs).groupBy("run_id", "spec_value").count()
    assert {tuple(r) for r in off.collect()} == {(1, 20.0, 2500), (1, None, 1), (2, None, 1), (4, 20.0, 2500), (4, None, 1)}
    near = R.unit_errors(numbers, specs.withColumn("unit", F.when(F.col("unit") == "g", "l").otherwise("g"))).groupBy("run_id", "spec_value", "spec_unit").count()
    assert {tuple(r) for r in near.collect()} == {(2, 20.0, "l", 2500), (3, 10.0, "l", 1)}


def test_texts_are_written_by_tasks_as_files_named_by_their_keys(spark, tmp_path):
    rows_ = [("a", "one\r\ntwo"), ("b/c d", "é\x00"), ("d.e", "x" * 70_000), (None, "gone"), ("f", None)]
    docs = spark.createDataFrame(rows_, "run_id string, text string").repartition(3)
    for _ in range(2):  # a repeated task leaves the same files
        assert io.write_texts(docs, f"file://{tmp_path}/texts") == 3
    assert sorted(f.name for f in (tmp_path / "texts").rglob("*") if f.is_file()) == ["a.txt", "b%2Fc%20d.txt", "d.e.txt"]
    got = {r.run_id: r.text for r in io.read_texts(spark, f"file://{tmp_path}/texts/*").collect()}
    assert got["a"] == rows_[0][1] and got["d.e"] == rows_[2][1] and sorted(len(x) for x in got.values()) == [2, 8, 70_000]


def test_written_texts_are_listed_and_read_by_tasks(spark, tmp_path):
    """No file of the set is listed by the driver; what a broken task left is passed over."""
    texts = {"a": "one\r\ntwo", "b/c d": "é\x00", "_e.f": "x" * 70_000, "%": ""} | {str(i): str(i) for i in range(300)}
    path = f"file://{tmp_path}/texts"
    io.write_texts(spark.createDataFrame(list(texts.items()), "run_id string, text string").repartition(3), path)
    (next((tmp_path / "texts").iterdir()) / ("_" + "0" * 32)).write_text("half")
    got = io.read_written_texts(spark, path)
    assert {r.run_id: r.text for r in got.collect()} == texts and got.count() == len(texts)
    assert got.inputFiles() == [] and got.rdd.getNumPartitions() == io.FOLDERS


def test_pairs_of_rows_are_not_shuffled(spark, monkeypatch):
    """Scored pairs of texts become pairs of rows in the last stage, whatever is broadcast; null texts and long lists too."""
    monkeypatch.setattr(U, "LISTED", 3)
    c, r = _pair_tables(spark)
    c = c.union(c.limit(5).withColumn("claim", F.lit(None).cast("string")))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = U.score_candidates(c, r)
        columns = ["claim_id", "rule_idx", "claim", "rule_text", "rule_type", "contradiction", "entailment", "neutral"]
        rows = lambda df: sorted(map(str, df.select(columns).collect()))
        assert rows(got) == rows(U.score_pairs(U.candidate_pairs(c, r))) and len(got.columns) == len(set(got.columns))
        last = got._jdf.queryExecution().sparkPlan().toString().split("Join")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert last.count("Generate inline") == 2
