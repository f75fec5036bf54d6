"""Queries over the run log, evaluations, violations and methods."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import audit as U
from ..operators import compare as M
from ..operators import design as D
from ..operators import pair_scorer as PS
from ..operators import rules as R
from ..operators import runlog as L
from ..operators import stats as S
from ..sources import io
from ..sources.scratch import spread, written
from ..streaming import incremental
from . import tables as t
from .registry import query

def _clear(df):
    """Doubles to seven places."""
    return df.select(*[F.round(F.col(c), 7).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


# --- run log ----------------------------------------------------------------------------------


@query("filter_completed", "SELECT run_id, engine, tokens FROM runs WHERE status = 'completed' AND NOT trap_flag", "runs")
def filter_completed(spark, d):
    return L.completed(t.runs(spark, d), True).select("run_id", "engine", "tokens")


@query("filter_pending", "SELECT run_id, engine FROM runs WHERE status = 'pending' AND engine = '1-URGENT' ORDER BY run_order LIMIT 50", "runs")
def filter_pending(spark, d):
    return L.pending(t.runs(spark, d), engine="1-URGENT", first=50).select("run_id", "engine")


@query("filter_pool", "SELECT run_id FROM runs WHERE status = 'pending' AND (owner IS NULL OR owner = 'u3') AND engine = '5-LOW'", "runs")
def filter_pool(spark, d):
    return L.pool(t.runs(spark, d), "u3", {"engine": "5-LOW", "product_id": None}).select("run_id")


@query("due_jobs", "SELECT run_id, scheduled FROM runs WHERE status = 'pending'", "runs")
def due_jobs(spark, d):
    return L.due(t.runs(spark, d)).select("run_id", "scheduled")


@query("filter_severity", "SELECT run_id, pos, severity FROM violations WHERE severity IN ('HIGH', 'CRITICAL')", "violations")
def filter_severity(spark, d):
    return t.violations(spark, d).where(F.col("severity").isin("HIGH", "CRITICAL")).select("run_id", "pos", "severity")


@query("filter_confidence", "SELECT count(*) AS n, round(avg(confidence), 6) AS mean, min(confidence) AS least, max(confidence) AS most, count(*) FILTER (confidence > 0.95) AS n_high, round(100 * count(*) FILTER (confidence > 0.95) / count(*), 4) AS high_pct FROM violations", "violations")
def filter_confidence(spark, d):
    return A.confidence(t.violations(spark, d))


@query("filter_nonblank", "SELECT conv_id, turn FROM conversations WHERE trim(text) <> ''")
def filter_nonblank(spark, d):
    return t.load(spark, d, "conversations").where(F.trim("text") != "").select("conv_id", "turn")


@query(
    "derive_run_columns",
    """SELECT run_id, concat_ws('_', product_id, engine, 'v1') AS prompt_id, 'outputs/' || CAST(run_id AS VARCHAR) || '.txt' AS output_path, engine AS material, hour(scheduled) AS hour, dayname(scheduled) AS day_name, dayofweek(scheduled) IN (0, 6) AS is_weekend, CAST(scheduled AS DATE) AS date,
    CASE WHEN hour(scheduled) >= 8 AND hour(scheduled) < 12 THEN 'morning' WHEN hour(scheduled) >= 12 AND hour(scheduled) < 17 THEN 'afternoon' ELSE 'evening' END AS slot FROM runs""", "runs",
)
def derive_run_columns(spark, d):
    return L.derived(t.runs(spark, d).withColumn("material_type", F.concat("engine", F.lit(".j2"))))


@query("derive_delay", "SELECT event_id AS run_id, round(coalesce(value, 0), 2) AS duration_sec, coalesce(CASE WHEN event_type <> 'error' THEN 60.0 END, 0.0) AS delay_sec FROM events")
def derive_delay(spark, d):
    e = t.load(spark, d, "events")
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1e6).cast("long"))
    late = F.when(F.col("event_type") != "error", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) - 60_000_000).cast("string")).otherwise("not a time")
    x = L.delays(e.select(F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), end.alias("completed_at"), late.alias("scheduled")))
    return x.select("run_id", F.round("duration_sec", 2).alias("duration_sec"), "delay_sec")


@query("time_slot_band", "SELECT CASE WHEN hour(ts) >= 7 AND hour(ts) < 12 THEN 'morning' WHEN hour(ts) >= 12 AND hour(ts) < 17 THEN 'afternoon' WHEN hour(ts) >= 17 AND hour(ts) < 22 THEN 'evening' ELSE 'night' END AS slot, count(*) AS n FROM evals GROUP BY slot", "evals")
def time_slot_band(spark, d):
    bands = (("morning", 7, 12), ("afternoon", 12, 17), ("evening", 17, 22))
    return t.evals(spark, d).groupBy(T.time_slot(F.hour("ts"), bands, "night").alias("slot")).agg(F.count("*").alias("n"))


@query(
    "overlay_status",
    "SELECT run_id, coalesce(new_status, status) AS status, coalesce(new_owner, owner, 'nobody') AS owner FROM runs LEFT JOIN (SELECT user_id AS u, arg_max(event_type, ts) AS new_status, arg_max('e' || CAST(event_id AS VARCHAR), ts) AS new_owner FROM events GROUP BY user_id) ON u = run_id", "runs",
)
def overlay_status(spark, d):
    up = t.load(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("status"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("owner"), F.col("ts").alias("updated_at"))
    return L.overlay(t.runs(spark, d), up, {"status": None, "owner": "nobody"}).select("run_id", "status", "owner")


@query("append_new", "SELECT DISTINCT run_id, origin FROM (SELECT o_orderkey AS run_id, 'log' AS origin FROM orders UNION ALL SELECT event_id + 500, 'new' FROM events WHERE event_id + 500 NOT IN (SELECT o_orderkey FROM orders))")
def append_new(spark, d):
    old = t.runs(spark, d).select("run_id", F.lit("log").alias("origin"))
    return L.append_new(old, t.load(spark, d, "events").select((F.col("event_id") + 500).alias("run_id"), F.lit("new").alias("origin")))


@query("append_counts", "SELECT count(*) FILTER (o_orderkey IS NULL) AS added, count(*) FILTER (o_orderkey IS NOT NULL) AS skipped FROM (SELECT event_id * 3 AS k FROM events) LEFT JOIN orders ON k = o_orderkey")
def append_counts(spark, d):
    return L.append_counts(t.runs(spark, d), t.load(spark, d, "events").select((F.col("event_id") * 3).alias("run_id")))


@query("session_results", "SELECT event_id, ts, event_type FROM events WHERE user_id = 7")
def session_results(spark, d):
    return t.load(spark, d, "events").where("user_id = 7").orderBy("ts").select("event_id", "ts", "event_type")


@query("reset_subset", "SELECT run_id, CASE WHEN engine = '2-HIGH' THEN 'pending' ELSE status END AS status, CASE WHEN engine <> '2-HIGH' THEN tokens END AS tokens FROM runs", "runs")
def reset_subset(spark, d):
    return L.reset(t.runs(spark, d), "2-HIGH", ["tokens"]).select("run_id", "status", "tokens")


@query("shift_schedule", "SELECT run_id, CASE WHEN engine = '2-HIGH' THEN scheduled + INTERVAL 30 DAY ELSE scheduled END AS scheduled FROM runs", "runs")
def shift_schedule(spark, d):
    return L.shift(t.runs(spark, d), "2-HIGH", 30).select("run_id", "scheduled")


@query("status_counts", "SELECT s AS status, count(run_id) AS n FROM (VALUES ('pending'), ('claimed'), ('running'), ('completed'), ('failed')) v(s) LEFT JOIN runs ON status = s GROUP BY s UNION ALL SELECT 'total', count(*) FROM runs", "runs")
def status_counts(spark, d):
    return L.status_counts(t.runs(spark, d), ["pending", "claimed", "running", "completed", "failed"])


@query("assign_counts", "SELECT l_partkey AS key, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def assign_counts(spark, d):
    return L.shared_keys(t.load(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("owner")))


@query("dedup_first_per_run", "SELECT run_id, pos, claim FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS rn FROM violations) WHERE rn = 1", "violations")
def dedup_first_per_run(spark, d):
    return L.first_per_run(t.violations(spark, d), "run_id", "pos").select("run_id", "pos", "claim")


@query("resume_pending", "SELECT run_id FROM runs WHERE status = 'completed' AND run_id NOT IN (SELECT l_orderkey FROM lineitem)", "runs")
def resume_pending(spark, d):
    return L.resume(t.runs(spark, d), t.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"))).select("run_id")


# --- joins ------------------------------------------------------------------------------------


@query("join_eval_tokens", "SELECT e.run_id, e.hit_rate, r.tokens FROM evals e LEFT JOIN runs r USING (run_id)", "evals", "runs")
def join_eval_tokens(spark, d):
    return t.evals(spark, d).join(t.runs(spark, d).select("run_id", "tokens"), "run_id", "left").select("run_id", "hit_rate", "tokens")


@query("join_audit_day", "SELECT v.run_id, v.pos, v.claim, dayname(r.scheduled) AS day FROM violations v LEFT JOIN runs r USING (run_id)", "violations", "runs")
def join_audit_day(spark, d):
    return t.violations(spark, d).join(t.runs(spark, d).select("run_id", F.date_format("scheduled", "EEEE").alias("day")), "run_id", "left").select("run_id", "pos", "claim", "day")


@query("join_meta_keep", "SELECT e.run_id, m.tokens FROM evals e LEFT JOIN (SELECT run_id * 2 AS run_id, tokens FROM runs) m USING (run_id)", "evals", "runs")
def join_meta_keep(spark, d):
    m = t.runs(spark, d).select((F.col("run_id") * 2).alias("run_id"), "tokens")
    return t.evals(spark, d).join(m, "run_id", "left").select("run_id", "tokens")


@query("join_meta_drop", "SELECT e.run_id, m.tokens FROM evals e JOIN (SELECT run_id * 2 AS run_id, tokens FROM runs) m USING (run_id)", "evals", "runs")
def join_meta_drop(spark, d):
    m = t.runs(spark, d).select((F.col("run_id") * 2).alias("run_id"), "tokens")
    return t.evals(spark, d).join(m, "run_id").select("run_id", "tokens")


@query("violations_per_run", "SELECT run_id, count(v.pos) AS n_violations FROM runs LEFT JOIN violations v USING (run_id) GROUP BY run_id", "runs", "violations")
def violations_per_run(spark, d):
    return M.violations_per_run(t.runs(spark, d), t.violations(spark, d)).select("run_id", "n_violations")


@query("clean_runs", "SELECT run_id FROM runs WHERE run_id NOT IN (SELECT run_id FROM violations WHERE failed)", "runs", "violations")
def clean_runs(spark, d):
    return M.clean_runs(t.runs(spark, d), t.violations(spark, d).where("failed")).select("run_id")


def _sides(spark, d):
    l = t.load(spark, d, "labels").select(F.col("doc_id").alias("run_id"), "quality", "toxic")
    x = t.docs(spark, d)
    a = x.where("n_chars > 1000").select("run_id", (F.col("n_chars") > 4000).alias("detected"))
    b = l.where("quality = 1 or toxic = 1").select("run_id", (F.col("quality") == 1).alias("detected"))
    c = l.select("run_id", (F.col("toxic") == 1).alias("detected"))
    return a, b, c


SIDES = """a AS (SELECT doc_id AS run_id, n_chars > 4000 AS a FROM documents WHERE n_chars > 1000), b AS (SELECT doc_id AS run_id, quality = 1 AS b FROM labels WHERE quality = 1 OR toxic = 1), c AS (SELECT doc_id AS run_id, toxic = 1 AS c FROM labels)"""


@query("methods_full_outer", f"WITH {SIDES} SELECT run_id, coalesce(a, false) AS a, coalesce(b, false) AS b FROM a FULL JOIN b USING (run_id)")
def methods_full_outer(spark, d):
    a, b, _ = _sides(spark, d)
    return M.outer_methods("run_id", a=a, b=b)


@query(
    "methods_three_way",
    f"""WITH {SIDES}, w AS (SELECT run_id, coalesce(a, false) AS a, coalesce(b, false) AS b, coalesce(c, false) AS c FROM a FULL JOIN b USING (run_id) FULL JOIN c USING (run_id))
    SELECT run_id, a, b, c, CASE WHEN a AND b AND c THEN 'all_three' WHEN a AND NOT b AND NOT c THEN 'only_a' WHEN NOT a AND b AND c THEN 'both_b_c' WHEN NOT a AND b THEN 'only_b' WHEN NOT a AND c THEN 'only_c' WHEN NOT a THEN 'none' ELSE 'other' END AS class FROM w""",
)
def methods_three_way(spark, d):
    a, b, c = _sides(spark, d)
    return M.three_way_class(M.outer_methods("run_id", a=a, b=b, c=c), "a", "b", "c")


CATALOG = "k AS (SELECT o_orderkey AS run_id, 'e' || CAST(o_custkey AS VARCHAR) AS error, [lower(o_orderpriority[3:5]), 'economy', 'brand#1'] AS keywords FROM orders)"


def _catalog(spark, d):
    return t.load(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("e"), F.col("o_custkey").cast("string")).alias("error"), F.array(F.lower(F.substring("o_orderpriority", 3, 3)), F.lit("economy"), F.lit("brand#1")).alias("keywords"))


@query(
    "keyword_theta",
    f"""WITH {t.CTE['violations']}, {CATALOG}, h AS (SELECT k.run_id, k.error, w, pos, claim FROM (SELECT run_id, error, unnest(keywords) AS w FROM k) k JOIN violations v ON k.run_id = v.run_id AND contains(lower(claim), w)),
    g AS (SELECT run_id, error, array_to_string(list_sort(list_distinct(list(w))), ',') AS found, arg_min(claim, pos) AS first_claim FROM h GROUP BY ALL) SELECT run_id, error, found IS NOT NULL AS detected, coalesce(found, '') AS found, first_claim FROM k LEFT JOIN g USING (run_id, error)""",
)
def keyword_theta(spark, d):
    return M.keyword_matches(_catalog(spark, d), t.violations(spark, d)).withColumn("found", F.array_join("found", ","))


def _files(spark, d):
    n, c = t.load(spark, d, "nation"), t.load(spark, d, "customer")
    files = n.select(F.concat(F.lit("p"), (F.col("n_regionkey")).cast("string")).alias("product_id"), F.col("n_nationkey").alias("file_num")).distinct()
    catalog = c.select(F.concat(F.lit("p"), (F.col("c_nationkey") % 5).cast("string")).alias("product_id"), (F.col("c_custkey") % 30).alias("error_num"), F.lower("c_mktsegment").alias("type")).groupBy("product_id", "error_num").agg(F.min("type").alias("type"))
    found = t.load(spark, d, "supplier").select(F.concat(F.lit("p"), (F.col("s_nationkey") % 5).cast("string")).alias("product_id"), F.col("s_nationkey").alias("file_num"), (F.col("s_suppkey") % 30).alias("error_num"))
    return files, catalog, found


FILES = """f AS (SELECT DISTINCT 'p' || CAST(n_regionkey AS VARCHAR) AS product_id, n_nationkey AS file_num FROM nation), k AS (SELECT 'p' || CAST(c_nationkey % 5 AS VARCHAR) AS product_id, c_custkey % 30 AS error_num, min(lower(c_mktsegment)) AS type FROM customer GROUP BY 1, 2),
s AS (SELECT DISTINCT 'p' || CAST(s_nationkey % 5 AS VARCHAR) AS product_id, s_nationkey AS file_num, s_suppkey % 30 AS error_num FROM supplier)"""


@query("cumulative_errors_range", f"WITH {FILES} SELECT f.product_id, f.file_num, count(*) AS held, count(s.error_num) AS detected FROM f JOIN k ON f.product_id = k.product_id AND k.error_num <= f.file_num LEFT JOIN s ON s.product_id = f.product_id AND s.file_num = f.file_num AND s.error_num = k.error_num GROUP BY 1, 2")
def cumulative_errors_range(spark, d):
    return M.cumulative_errors(*_files(spark, d))


@query("missed_errors_tail", f"WITH {FILES}, c AS (SELECT product_id, file_num AS n, CAST(floor(file_num / 2) AS BIGINT) AS n_detected FROM f) SELECT product_id, type, count(*) AS missed FROM (SELECT product_id, unnest(generate_series(n_detected + 1, n)) AS error_num FROM c WHERE n_detected < n) JOIN k USING (product_id, error_num) GROUP BY ALL")
def missed_errors_tail(spark, d):
    f, k, _ = _files(spark, d)
    return M.missed_tail(f.select("product_id", F.col("file_num").cast("long").alias("n"), F.floor(F.col("file_num") / 2).alias("n_detected")), k)


# --- aggregates -------------------------------------------------------------------------------

EVAL_AGG = "count(*) AS n_runs, round(avg(hit_rate), 4) AS mean_hit_rate, round(avg(contradiction_rate), 4) AS mean_contradiction_rate, CAST(sum(n_errors) AS BIGINT) AS n_errors, round(avg(bias_score), 2) AS mean_bias, count(*) FILTER (decision = 'Supported') AS supported, count(*) FILTER (decision = 'Contradicted') AS contradicted, count(*) FILTER (decision = 'Unsupported') AS unsupported, count(*) FILTER (decision = 'Ambiguous') AS ambiguous"


@query("agg_engine_product_material", f"SELECT engine, product_id, material_type, {EVAL_AGG} FROM evals GROUP BY 1, 2, 3", "evals")
def agg_engine_product_material(spark, d):
    return A.evaluation_table(t.evals(spark, d), ["engine", "product_id", "material_type"])


@query("agg_engine_product", "SELECT engine, product_id, material_type, count(*) AS n_runs, round(avg(hit_rate), 4) AS mean_hit_rate, round(avg(bias_score), 2) AS mean_bias FROM evals GROUP BY GROUPING SETS ((engine, product_id, material_type), (engine, product_id))", "evals")
def agg_engine_product(spark, d):
    return A.evaluation_sets(t.evals(spark, d))


@query("agg_engine_comparison", "SELECT e.engine, count(*) AS n_runs, round(avg(hit_rate), 4) AS mean_hit_rate, CAST(sum(n_errors) AS BIGINT) AS n_errors, round(avg(tokens), 2) AS mean_tokens FROM evals e LEFT JOIN (SELECT run_id, tokens FROM runs) r USING (run_id) GROUP BY 1", "evals", "runs")
def agg_engine_comparison(spark, d):
    return A.engine_comparison(t.evals(spark, d), t.runs(spark, d).select("run_id", "tokens"))


@query("agg_drift", "SELECT engine, user_id, count(*) AS n, round(avg(hit_rate), 7) AS mean, round(stddev_pop(hit_rate), 7) AS std, round(CASE WHEN avg(hit_rate) > 0 THEN stddev_pop(hit_rate) / avg(hit_rate) ELSE 0 END, 7) AS cv FROM evals GROUP BY 1, 2 HAVING count(*) >= 2", "evals")
def agg_drift(spark, d):
    return _clear(A.drift(t.evals(spark, d), ["engine", "user_id"]))


@query("agg_temperature", f"SELECT engine, product_id, n_violations, {EVAL_AGG.replace('CAST(sum(n_errors)', 'CAST(sum(n_errors)')} FROM evals GROUP BY 1, 2, 3", "evals")
def agg_temperature(spark, d):
    return A.evaluation_table(t.evals(spark, d), ["engine", "product_id", "n_violations"])


@query("agg_product_material", f"SELECT engine, material_type, {EVAL_AGG} FROM evals GROUP BY 1, 2", "evals")
def agg_product_material(spark, d):
    return A.evaluation_table(t.evals(spark, d), ["engine", "material_type"])


FACTOR = "count(*) AS n_runs, count(*) FILTER (n_violations > 0) AS non_compliant, CAST(sum(n_violations) AS BIGINT) AS total, round(avg(n_violations), 4) AS mean, round(stddev_samp(n_violations), 4) AS std, round(100 * count(*) FILTER (n_violations > 0) / count(*), 4) AS non_compliant_pct FROM evals GROUP BY level"


@query("compliance_by_factor", f"SELECT 'engine' AS factor, engine AS level, {FACTOR} UNION ALL SELECT 'product_id', product_id AS level, {FACTOR} UNION ALL SELECT 'material_type', material_type AS level, {FACTOR}", "evals")
def compliance_by_factor(spark, d):
    return A.by_factor(t.evals(spark, d), ["engine", "product_id", "material_type"])


@query("compliance_by_day", "SELECT CAST(i AS INTEGER) AS ord, n AS day_name, count(run_id) AS n_runs, CAST(coalesce(sum(n_violations), 0) AS BIGINT) AS total FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')) v(i, n) LEFT JOIN evals e ON dayname(ts) = n GROUP BY 1, 2", "evals")
def compliance_by_day(spark, d):
    return A.by_ordered_level(t.evals(spark, d).withColumn("day_name", F.date_format("ts", "EEEE")), "day_name")


@query("compliance_overall", "SELECT count(*) AS n_runs, count(*) FILTER (n_violations = 0) AS compliant, count(*) FILTER (n_violations > 0) AS non_compliant, count(*) FILTER (n_violations IS NULL) AS unknown, CAST(sum(n_violations) AS BIGINT) AS violations, round(avg(n_violations), 4) AS mean_violations, round(100 * count(*) FILTER (n_violations = 0) / count(*), 4) AS compliant_pct FROM evals", "evals")
def compliance_overall(spark, d):
    return A.overall(t.evals(spark, d))


@query("severity_counts", "SELECT severity, count(*) AS n FROM violations WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') GROUP BY 1", "violations")
def severity_counts(spark, d):
    return A.level_counts(t.violations(spark, d), "severity", ["CRITICAL", "HIGH", "MEDIUM", "LOW"])


@query("top_rules", "SELECT rule, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM violations), 4) AS pct FROM violations GROUP BY rule ORDER BY n DESC, rule LIMIT 10", "violations")
def top_rules(spark, d):
    return A.top_shares(t.violations(spark, d), "rule")


@query("confidence_stats", "SELECT count(*) AS n, round(avg(confidence), 6) AS mean, min(confidence) AS least, max(confidence) AS most, count(*) FILTER (confidence > 0.98) AS n_high, round(100 * count(*) FILTER (confidence > 0.98) / count(*), 4) AS high_pct FROM violations WHERE failed", "violations")
def confidence_stats(spark, d):
    return A.confidence(t.violations(spark, d).where("failed"), 0.98)


@query("fp_patterns", "SELECT pattern, count(*) FILTER (regexp_matches(lower(claim), a) AND regexp_matches(lower(rule), b)) AS n, round(100 * count(*) FILTER (regexp_matches(lower(claim), a) AND regexp_matches(lower(rule), b)) / count(*), 4) AS pct FROM violations, (VALUES ('economy_ring', 'economy', 'ring'), ('brand1_red', 'brand#1', 'red')) p(pattern, a, b) GROUP BY pattern", "violations")
def fp_patterns(spark, d):
    return A.pattern_pairs(t.violations(spark, d), [("economy_ring", "economy", "ring"), ("brand1_red", "brand#1", "red")])


@query("label_quality", "SELECT label, n, round(100 * n / sum(n) OVER (), 4) AS pct, (label = 'neutral' AND 100 * n / sum(n) OVER () > 60) OR (label = 'contradiction' AND 100 * n / sum(n) OVER () < 10) AS imbalanced FROM (SELECT CASE decision WHEN 'Contradicted' THEN 'contradiction' WHEN 'Supported' THEN 'entailment' ELSE 'neutral' END AS label, count(*) AS n FROM evals GROUP BY 1)", "evals")
def label_quality(spark, d):
    return A.label_quality(t.evals(spark, d).withColumn("label", F.when(F.col("decision") == "Contradicted", "contradiction").when(F.col("decision") == "Supported", "entailment").otherwise("neutral")))


@query("extraction_quality", "SELECT count(*) AS claims, count(DISTINCT run_id) AS runs, count(DISTINCT rule) AS products, round(100 * count(*) FILTER (severity = 'LOW') / count(*), 4) AS exact_pct, round(100 * count(*) FILTER (severity = 'HIGH') / count(*), 4) AS partial_pct, round(100 * count(*) FILTER (severity = 'CRITICAL') / count(*), 4) AS none_pct, count(*) FILTER (failed) AS needs_review, round(avg(confidence) FILTER (severity = 'HIGH'), 6) AS partial_confidence FROM violations", "violations")
def extraction_quality(spark, d):
    v = t.violations(spark, d).select("run_id", F.col("rule").alias("product_id"), F.when(F.col("severity") == "LOW", "exact").when(F.col("severity") == "HIGH", "partial").otherwise("none").alias("match"), F.col("failed").alias("needs_review"), "confidence")
    return A.extraction_quality(v)


@query("token_diagnostics", "SELECT status, engine, count(*) AS n, min(tokens) AS least, max(tokens) AS most, round(avg(tokens), 4) AS mean, count(*) FILTER (tokens > 0.9 * 4500) AS near_limit FROM runs GROUP BY 1, 2", "runs")
def token_diagnostics(spark, d):
    return A.token_usage(t.runs(spark, d).withColumn("max_tokens", F.lit(4500)), ["status", "engine"])


@query("token_upper_median", "SELECT list_sort(list(tokens))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median FROM runs", "runs")
def token_upper_median(spark, d):
    return A.upper_median(t.runs(spark, d), "tokens")


@query("token_topn", "SELECT run_id, tokens, n_chars, round(n_chars / nullif(tokens, 0), 4) AS chars_per_token FROM (SELECT run_id, n_chars, len(regexp_split_to_array(text, '[ \\t\\n\\r]+')) AS tokens FROM docs) ORDER BY tokens DESC, run_id LIMIT 10", "docs")
def token_topn(spark, d):
    return A.token_topn(t.docs(spark, d).select("run_id", "n_chars", F.size(F.split("text", "[ \\t\\n\\r]+")).cast("long").alias("tokens")))


@query("token_cost", "SELECT engine, tokens, round(cost, 6) AS cost, round(cost / min(cost) OVER (), 4) AS ratio FROM (SELECT engine, CAST(sum(tokens) AS BIGINT) AS tokens, sum(tokens) * (length(engine) / 2.0) / 1e6 AS cost FROM runs GROUP BY engine)", "runs")
def token_cost(spark, d):
    r = t.runs(spark, d)
    return A.token_cost(r, r.select("engine").distinct().withColumn("per_million", F.length("engine") / 2.0))


@query("files_with_violations", "SELECT product_id, engine, count(*) AS n_runs, count(DISTINCT CASE WHEN n > 0 THEN run_id END) AS with_violations, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 4) AS mean FROM (SELECT r.run_id, any_value(product_id) AS product_id, any_value(engine) AS engine, count(v.pos) AS n FROM runs r LEFT JOIN violations v USING (run_id) GROUP BY r.run_id) GROUP BY 1, 2", "runs", "violations")
def files_with_violations(spark, d):
    n = M.violations_per_run(t.runs(spark, d), t.violations(spark, d))
    return n.groupBy("product_id", "engine").agg(F.count("*").alias("n_runs"), F.countDistinct(F.when(F.col("n_violations") > 0, F.col("run_id"))).alias("with_violations"), F.sum("n_violations").alias("total"), F.round(F.avg("n_violations"), 4).alias("mean"))


VAR = "SELECT engine, product_id, material_type, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(var_samp(value), 4) AS var, round(CASE WHEN avg(value) > 0 THEN stddev_samp(value) / avg(value) ELSE 0 END, 4) AS cv FROM evals GROUP BY 1, 2, 3"


@query("condition_variability", VAR, "evals")
def condition_variability(spark, d):
    return A.variability(t.evals(spark, d), ["engine", "product_id", "material_type"], "value")


@query("condition_variability_summary", f"SELECT round(avg(cv), 4) AS mean_cv, round(quantile_cont(cv, 0.5), 4) AS median_cv, max(cv) AS max_cv, count(*) FILTER (cv = 0) AS constant FROM ({VAR})", "evals")
def condition_variability_summary(spark, d):
    return A.variability_summary(A.variability(t.evals(spark, d), ["engine", "product_id", "material_type"], "value"))


@query("rep_cv", "SELECT count(*) AS repetitions, round(100 * stddev_pop(m) / avg(m), 4) AS cv_pct FROM (SELECT user_id, avg(value) AS m FROM evals GROUP BY 1)", "evals")
def rep_cv(spark, d):
    return A.repetition_cv(t.evals(spark, d), "user_id", "value")


@query("hourly_volume", "SELECT date_trunc('hour', ts) AS \"at\", count(*) AS n, dayname(date_trunc('hour', ts)) AS day_name, hour(date_trunc('hour', ts)) AS hour FROM evals GROUP BY 1, 3, 4", "evals")
def hourly_volume(spark, d):
    return A.hourly(t.evals(spark, d), "ts", "1 hour")


@query("hourly_factors", "SELECT h AS \"at\", round(sum(s) / sum(n), 7) AS mean, arg_min(engine, (-n, engine)) AS mode FROM (SELECT date_trunc('hour', ts) AS h, engine, count(*) AS n, sum(value) AS s FROM evals GROUP BY 1, 2) GROUP BY h", "evals")
def hourly_factors(spark, d):
    return _clear(A.hourly_factors(t.evals(spark, d), F.date_trunc("hour", "ts"), "value", "engine"))


@query("balance_by_level", "SELECT day_name, n, round(e, 4) AS expected, round(100 * (n - e) / e, 4) AS deviation_pct, abs(100 * (n - e) / e) <= 5 AS within FROM (SELECT dayname(ts) AS day_name, count(*) AS n, sum(count(*)) OVER () / 7 AS e FROM evals GROUP BY 1)", "evals")
def balance_by_level(spark, d):
    return A.balance(t.evals(spark, d).withColumn("day_name", F.date_format("ts", "EEEE")), ["day_name"], 7, 5.0)


@query("balance_exact", "SELECT engine, n, round(e, 4) AS expected, round(100 * (n - e) / e, 4) AS deviation_pct, n = e AS within FROM (SELECT engine, count(*) AS n, sum(count(*)) OVER () / 5 AS e FROM evals GROUP BY 1)", "evals")
def balance_exact(spark, d):
    return A.balance(t.evals(spark, d), ["engine"], 5, 0.0)


SLOT = "CASE WHEN hour(ts) >= 8 AND hour(ts) < 12 THEN 'morning' WHEN hour(ts) >= 12 AND hour(ts) < 17 THEN 'afternoon' ELSE 'evening' END"


@query("slot_bias", f"SELECT is_weekend, slot, n, round(100 * n / sum(n) OVER (PARTITION BY is_weekend), 4) AS pct FROM (SELECT dayofweek(ts) IN (0, 6) AS is_weekend, {SLOT} AS slot, count(*) AS n FROM evals GROUP BY 1, 2)", "evals")
def slot_bias(spark, d):
    return A.slot_bias(t.evals(spark, d).select(F.dayofweek("ts").isin(1, 7).alias("is_weekend"), T.time_slot(F.hour("ts")).alias("slot")))


@query("crosstab", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def crosstab(spark, d):
    return A.crosstab(t.load(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("level_string_summary", "SELECT product_id, string_agg(engine || ':' || CAST(n AS VARCHAR), ' | ' ORDER BY engine) AS levels FROM (SELECT product_id, engine, count(*) AS n FROM runs GROUP BY 1, 2) GROUP BY 1", "runs")
def level_string_summary(spark, d):
    return A.level_strings(t.runs(spark, d), "product_id", "engine")


@query("median_by_group", "SELECT engine, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(quantile_cont(value, 0.5), 4) AS median FROM evals GROUP BY 1", "evals")
def median_by_group(spark, d):
    return A.medians(t.evals(spark, d), "engine", "value")


@query("first_last_n", "(SELECT run_id, 'first' AS part FROM runs ORDER BY run_order LIMIT 20) UNION ALL (SELECT run_id, 'last' FROM runs ORDER BY run_order DESC LIMIT 20)", "runs")
def first_last_n(spark, d):
    return A.first_last(t.runs(spark, d).select("run_id", "run_order"), "run_order", 20).select("run_id", "part")


@query("union_sections", "SELECT 'engines' AS section, engine, NULL AS status, count(*) AS n FROM runs GROUP BY engine UNION ALL SELECT 'status', NULL, status, count(*) FROM runs GROUP BY status", "runs")
def union_sections(spark, d):
    r = t.runs(spark, d)
    return A.sections(engines=r.groupBy("engine").agg(F.count("*").alias("n")), status=r.groupBy("status").agg(F.count("*").alias("n")))


@query("seed_stability", f"SELECT slot, round(avg(n), 4) AS mean, round(stddev_samp(n), 4) AS std, min(n) AS least, max(n) AS most, count(DISTINCT n) = 1 AS all_equal FROM (SELECT user_id, {SLOT} AS slot, count(*) AS n FROM evals GROUP BY 1, 2) GROUP BY slot", "evals")
def seed_stability(spark, d):
    return A.seed_stability(t.evals(spark, d).select(F.col("user_id").alias("seed"), T.time_slot(F.hour("ts")).alias("slot")))


# --- audit ------------------------------------------------------------------------------------

PARTS = "pc AS (SELECT p_partkey AS claim_id, p_brand AS product_id, p_type AS category, p_name AS claim, p_size FROM part), pr AS (SELECT p_brand AS product_id, p_type AS category, CASE WHEN p_size % 2 = 0 THEN 'authorized' ELSE 'prohibited' END AS rule_type, CAST(p_partkey AS INTEGER) AS rule_idx, p_name AS rule_text FROM part WHERE p_size > 40)"


def _parts(spark, d):
    p = t.load(spark, d, "part")
    claims = p.select(F.col("p_partkey").alias("claim_id"), F.col("p_brand").alias("product_id"), F.col("p_type").alias("category"), F.col("p_name").alias("claim"))
    rules = p.where("p_size > 40").select(F.col("p_brand").alias("product_id"), F.col("p_type").alias("category"), F.when(F.col("p_size") % 2 == 0, "authorized").otherwise("prohibited").alias("rule_type"), F.col("p_partkey").cast("int").alias("rule_idx"), F.col("p_name").alias("rule_text"))
    return claims, rules


@query("audit_candidates", f"WITH {PARTS} SELECT claim_id, rule_idx, rule_type FROM pc JOIN pr USING (product_id, category)")
def audit_candidates(spark, d):
    return U.candidate_pairs(*_parts(spark, d)).select("claim_id", "rule_idx", "rule_type")


@query(
    "audit_numeric_rule",
    "SELECT c.p_partkey AS claim_id, min(r.p_partkey) AS rule_idx, 1.0::DOUBLE AS score FROM part c JOIN part r ON c.p_brand = r.p_brand AND r.p_size > 45 AND (c.p_type = r.p_type OR r.p_type = 'ECONOMY') WHERE c.p_size <> r.p_size GROUP BY 1",
)
def audit_numeric_rule(spark, d):
    p = t.load(spark, d, "part")
    kind = lambda c: F.when(F.col(c) == "ECONOMY", "general").otherwise(F.col(c))
    text = F.concat(F.col("p_size").cast("string"), F.lit(" GB"))
    c = p.select(F.col("p_partkey").alias("claim_id"), F.col("p_brand").alias("product_id"), kind("p_type").alias("category"), text.alias("claim"))
    s = p.where("p_size > 45").select(F.col("p_brand").alias("product_id"), kind("p_type").alias("category"), F.col("p_partkey").alias("rule_idx"), text.alias("rule_text"))
    return U.numeric_violations(c, s).select("claim_id", "rule_idx", "score")


@query("audit_score_pairs")
def audit_score_pairs(spark, d):
    """Scored by a model that is trained on pairs made from the rules."""
    claims, rules = _parts(spark, d)
    model = PS.fit(PS.labelled_from_rules(rules))
    return U.score_candidates(claims, rules, model).select("claim_id", "rule_idx", "rule_type", "contradiction", "entailment", "neutral")


def _scored(spark, d):
    l = t.load(spark, d, "lineitem")
    return l.select(F.col("l_orderkey").alias("claim_id"), F.when(F.col("l_returnflag") == "A", "prohibited").otherwise("authorized").alias("rule_type"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).cast("long").alias("rule_idx"), F.concat(F.lit("r"), F.col("l_partkey").cast("string")).alias("rule_text"), (1 - F.col("l_discount")).alias("entailment"), (1 - F.col("l_tax")).alias("contradiction"))


@query(
    "audit_reduce",
    """SELECT claim_id, round(score, 4) AS score, side, rule_text, score > 0.95 AS violation FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, side, rule_idx) AS rn FROM (SELECT l_orderkey AS claim_id, CASE l_returnflag WHEN 'A' THEN 1 - l_discount ELSE 1 - l_tax END AS score,
    CASE l_returnflag WHEN 'A' THEN 'prohibited' ELSE 'factual' END AS side, CAST(l_linenumber AS BIGINT) * 100000 + l_partkey AS rule_idx, 'r' || CAST(l_partkey AS VARCHAR) AS rule_text FROM lineitem)) WHERE rn = 1""",
)
def audit_reduce(spark, d):
    return U.reduce_scores(_scored(spark, d), 0.95).withColumn("score", F.round("score", 4))


@query("audit_run_status", "SELECT run_id, count(v.pos) AS n_violations, CASE WHEN run_id IN (SELECT user_id FROM events WHERE event_type = 'error') THEN 'ERROR' WHEN count(v.pos) > 0 THEN 'FAIL' ELSE 'PASS' END AS audit_status FROM runs LEFT JOIN (SELECT * FROM violations WHERE failed) v USING (run_id) GROUP BY run_id", "runs", "violations")
def audit_run_status(spark, d):
    e = t.load(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("run_id"))
    return U.run_status(t.runs(spark, d), t.violations(spark, d).where("failed"), e).select("run_id", "n_violations", "audit_status")


@query("audit_flatten", "SELECT run_id, CASE WHEN v.pos IS NULL THEN 'PASS' ELSE 'FAIL' END AS status, coalesce(v.rule, '') AS violated_rule, coalesce(v.claim, '') AS extracted_claim, CASE WHEN v.pos IS NULL THEN '' ELSE printf('%.4f', v.confidence) END AS confidence_score FROM runs LEFT JOIN (SELECT * FROM violations WHERE confidence > 0.95) v USING (run_id)", "runs", "violations")
def audit_flatten(spark, d):
    v = t.violations(spark, d).where("confidence > 0.95").groupBy("run_id").agg(F.collect_list(F.struct("rule", "claim", F.col("confidence").alias("score"))).alias("violations"))
    a = t.runs(spark, d).select("run_id").join(v, "run_id", "left").withColumn("status", F.when(F.col("violations").isNull(), "PASS").otherwise("FAIL"))
    return U.flattened(a)


@query("audit_summary", "SELECT coalesce(product_id, 'ALL') AS product_id, count(*) AS runs, count(*) FILTER (n = 0) AS passed, count(*) FILTER (n > 0) AS failed, 0::BIGINT AS errors, CAST(sum(n) AS BIGINT) AS violations FROM (SELECT r.run_id, any_value(product_id) AS product_id, count(v.pos) AS n FROM runs r LEFT JOIN (SELECT * FROM violations WHERE failed) v USING (run_id) GROUP BY 1) GROUP BY ROLLUP (product_id)", "runs", "violations")
def audit_summary(spark, d):
    return U.summary(U.run_status(t.runs(spark, d), t.violations(spark, d).where("failed")))


def _labelled(spark, d):
    claims, rules = _parts(spark, d)
    p = t.load(spark, d, "part")
    labels = p.select(F.col("p_partkey").alias("claim_id"), F.when(F.col("p_size") > 33, "contradiction").when(F.col("p_size") > 16, "entailment").otherwise("neutral").alias("label"))
    premises = rules.groupBy("product_id").agg(F.min("rule_text").alias("premise"))
    return U.labels_attached(claims.withColumn("claim_kind", F.when(F.col("category") == "PROMO", "disclaimer").otherwise("product_claim")), labels, premises, p.where("p_retailprice > 905").select(F.col("p_partkey").alias("claim_id")))


LABELLED = f"""WITH {PARTS}, pm AS (SELECT product_id, min(rule_text) AS premise FROM pr GROUP BY 1), x AS (SELECT claim_id, CASE WHEN premise IS NULL THEN 'no_product_id' WHEN trim(claim) = '' THEN 'no_sentence' WHEN category = 'PROMO' THEN 'disclaimer' END AS skipped,
CASE WHEN pc.p_size > 33 THEN 'contradiction' WHEN pc.p_size > 16 THEN 'entailment' ELSE 'neutral' END AS l, substring(sha256(premise), 1, 12) AS premise_hash, substring(sha256(claim), 1, 12) AS hypothesis_hash, p_retailprice > 905 AS policy_violation FROM pc LEFT JOIN pm USING (product_id) JOIN part ON p_partkey = claim_id),
y AS (SELECT claim_id, skipped, CASE WHEN skipped IS NULL THEN l END AS label, premise_hash, hypothesis_hash, policy_violation, CASE WHEN skipped IS NULL AND policy_violation THEN 'high' WHEN skipped IS NULL AND l = 'contradiction' THEN 'medium' END AS severity FROM x)"""


@query("claims_label_attach", f"{LABELLED} SELECT * FROM y")
def claims_label_attach(spark, d):
    return _labelled(spark, d)


@query("claims_label_summary", f"{LABELLED} SELECT count(*) AS total, count(*) FILTER (skipped IS NULL) AS verified, count(skipped) AS skipped, count(*) FILTER (label = 'contradiction') AS contradiction, count(*) FILTER (label = 'entailment') AS entailment, count(*) FILTER (label = 'neutral') AS neutral, count(*) FILTER (policy_violation) AS policy FROM y")
def claims_label_summary(spark, d):
    return U.label_summary(_labelled(spark, d))


def _vectors(spark, d):
    e = t.load(spark, d, "embeddings")
    claims = e.select(F.col("vec_id").alias("claim_id"), F.col("label").alias("product_id"), F.col("embedding").alias("vector"))
    rules = e.select(F.col("vec_id").alias("rule_idx"), F.col("label").alias("product_id"), F.col("embedding").alias("vector"))
    return claims, rules


@query(
    "semantic_topk",
    """SELECT claim_id, rule_idx, round(cosine, 4) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY cosine DESC, rule_idx) AS rank FROM (SELECT c.vec_id AS claim_id, r.vec_id AS rule_idx,
    list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS cosine FROM embeddings c JOIN embeddings r ON c.label = r.label)) WHERE rank <= 3 AND cosine >= 0.1""",
)
def semantic_topk(spark, d):
    return U.semantic_topk(*_vectors(spark, d), k=3, least=0.1).select("claim_id", "rule_idx", F.round("cosine", 4).alias("cosine"), F.col("rank").cast("long").alias("rank"))


LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda x: CAST(length(lower({0})) - length(replace(lower({0}), x, '')) AS DOUBLE))"
FILTERED = f"""{PARTS}, near AS (SELECT claim_id, rule_idx, product_id, list_cosine_similarity({LETTERS.format("claim")}, {LETTERS.format("rule_text")}) AS cosine FROM pc JOIN pr USING (product_id, category)),
kept AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY cosine DESC, rule_idx) AS rank FROM near WHERE cosine >= 0.83 QUALIFY rank <= 3)"""


def _filtered(spark, d):
    # vectors are made from letters, which costs more than a shuffle of names: by all cores
    claims, rules = (spread(x, i) for x, i in zip(_parts(spark, d), ("claim_id", "rule_idx"), strict=True))
    return U.filtered_pairs(claims.withColumn("vector", U.letters(F.col("claim"))), rules.withColumn("vector", U.letters(F.col("rule_text"))), k=3, least=0.83)


@query("audit_filtered_pairs", f"WITH {FILTERED} SELECT claim_id, rule_idx, round(cosine, 6) AS cosine FROM kept")
def audit_filtered_pairs(spark, d):
    return _filtered(spark, d).select("claim_id", "rule_idx", F.round("cosine", 6).alias("cosine"))


@query(
    "semantic_reduction",
    f"""WITH {FILTERED}, b AS (SELECT product_id, count(*) AS before FROM near GROUP BY 1), a AS (SELECT product_id, count(*) AS after FROM kept GROUP BY 1)
    SELECT product_id, before, coalesce(after, 0) AS after, round(100 * (1 - coalesce(after, 0) / before), 4) AS reduction_pct FROM b LEFT JOIN a USING (product_id)""",
)
def semantic_reduction(spark, d):
    return U.measured_reduction(*_parts(spark, d), _filtered(spark, d))


@query("nli_dataset_export", f"WITH {PARTS}, pm AS (SELECT product_id, min(rule_text) AS premise FROM pr GROUP BY 1) SELECT claim_id, product_id, premise, claim, '' AS label FROM pc JOIN pm USING (product_id) WHERE category <> 'PROMO'")
def nli_dataset_export(spark, d):
    claims, rules = _parts(spark, d)
    return claims.where("category <> 'PROMO'").join(rules.groupBy("product_id").agg(F.min("rule_text").alias("premise")), "product_id").select("claim_id", "product_id", "premise", "claim", F.lit("").alias("label"))


def _uniform_sql(key: str, seed: int = 42) -> str:
    """operators.design.uniform"""
    return f"(CAST('0x' || substring(md5(concat_ws(':', CAST({key} AS VARCHAR), '{seed}')), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE)"


@query("group_split", f"SELECT CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT owner) AS groups FROM (SELECT owner, {_uniform_sql('owner')} AS u FROM runs) GROUP BY 1", "runs")
def group_split(spark, d):
    return U.group_split(t.runs(spark, d), "owner").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("owner").alias("groups"))


def _nested(spark, d):
    v = t.violations(spark, d).groupBy("run_id").agg(F.collect_list(F.struct(F.col("claim").alias("claim_text"), "severity", F.col("rule").alias("rule_violated"))).alias("violations"))
    compliant = F.when(F.col("status") == "running", None).otherwise(F.col("violations").isNull())
    return t.runs(spark, d).select("run_id", "status").join(v, "run_id", "left").withColumn("compliant", compliant)


@query("compliance_flatten", "SELECT r.run_id, CASE WHEN status <> 'running' THEN v.pos IS NULL END AS compliant, coalesce(claim, '') AS claim_text, coalesce(severity, 'NONE') AS severity, coalesce(rule, '') AS rule_violated FROM runs r LEFT JOIN violations v USING (run_id)", "runs", "violations")
def compliance_flatten(spark, d):
    x = _nested(spark, d).select("run_id", "compliant", F.explode_outer("violations").alias("v"))
    return x.select("run_id", "compliant", F.coalesce("v.claim_text", F.lit("")).alias("claim_text"), F.coalesce("v.severity", F.lit("NONE")).alias("severity"), F.coalesce("v.rule_violated", F.lit("")).alias("rule_violated"))


@query("compliance_summary", "SELECT count(*) FILTER (c) AS compliant, count(*) FILTER (NOT c) AS non_compliant, count(*) FILTER (c IS NULL) AS errors, CAST(sum(n) AS BIGINT) AS violations, round(avg(n), 4) AS mean_violations FROM (SELECT r.run_id, CASE WHEN any_value(status) <> 'running' THEN count(v.pos) = 0 END AS c, count(v.pos) AS n FROM runs r LEFT JOIN violations v USING (run_id) GROUP BY 1)", "runs", "violations")
def compliance_summary(spark, d):
    n = F.coalesce(F.size("violations"), F.lit(0))
    x = _nested(spark, d).select("compliant", F.greatest(n, F.lit(0)).alias("n"))
    return x.agg(F.count_if("compliant").alias("compliant"), F.count_if(~F.col("compliant")).alias("non_compliant"), F.count_if(F.col("compliant").isNull()).alias("errors"), F.sum("n").alias("violations"), F.round(F.avg("n"), 4).alias("mean_violations"))


@query("verdict_summary", "SELECT engine, count(*) AS n, count(*) FILTER (v = 'violation') AS violation, count(*) FILTER (v = 'false_positive') AS false_positive, count(*) FILTER (v = 'grey_area') AS grey_area, round(100 * count(*) FILTER (v = 'violation') / count(*), 4) AS violation_pct, round(100 * count(*) FILTER (v = 'false_positive') / count(*), 4) AS false_positive_pct, round(100 * count(*) FILTER (v = 'grey_area') / count(*), 4) AS grey_area_pct, CAST(floor(count(*) FILTER (v = 'violation') * 10000 / count(*)) AS BIGINT) AS violation_projected, CAST(floor(count(*) FILTER (v = 'false_positive') * 10000 / count(*)) AS BIGINT) AS false_positive_projected, CAST(floor(count(*) FILTER (v = 'grey_area') * 10000 / count(*)) AS BIGINT) AS grey_area_projected FROM (SELECT engine, CASE decision WHEN 'Contradicted' THEN 'violation' WHEN 'Supported' THEN 'false_positive' ELSE 'grey_area' END AS v FROM evals) GROUP BY engine", "evals")
def verdict_summary(spark, d):
    v = t.evals(spark, d).withColumn("verdict", F.when(F.col("decision") == "Contradicted", "violation").when(F.col("decision") == "Supported", "false_positive").otherwise("grey_area"))
    return U.verdicts(v, "engine", 10000)


# --- detection --------------------------------------------------------------------------------


@query(
    "detect_keyword",
    """SELECT run_id, rank, term, confidence, substring(text, CAST(greatest(instr(lower(text), lower(term)) - 5, 1) AS BIGINT), 10 + length(term)) AS context, total FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY confidence DESC, pos, term) AS rank, count(*) OVER (PARTITION BY run_id) AS total FROM
    (SELECT v.run_id, pos, claim || ' ' || rule AS text, confidence, term FROM violations v, (VALUES ('ring'), ('economy'), ('Widget')) k(term) WHERE contains(lower(claim || ' ' || rule), lower(term)))) WHERE rank <= 3""", "violations",
)
def detect_keyword(spark, d):
    v = t.violations(spark, d).withColumn("text", F.concat_ws(" ", "claim", "rule"))
    terms = v.select("run_id").distinct().select("run_id", F.explode(F.array(F.lit("ring"), F.lit("economy"), F.lit("Widget"))).alias("term"))
    return M.top_matches(terms, v.select("run_id", "pos", "text", "confidence"), 3, 5).withColumn("rank", F.col("rank").cast("long"))


@query("detect_funnel", "SELECT outcome, n, round(100 * n / sum(n) OVER (), 4) AS pct FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM violations v WHERE v.run_id = o_orderkey AND failed AND contains(lower(claim), 'economy')) THEN 'validated' WHEN EXISTS (SELECT 1 FROM violations v WHERE v.run_id = o_orderkey AND NOT failed AND contains(lower(claim), 'economy')) THEN 'disclaimer_only' ELSE 'missed' END AS outcome, count(*) AS n FROM orders GROUP BY 1)", "violations")
def detect_funnel(spark, d):
    v = t.violations(spark, d)
    return M.funnel(t.runs(spark, d).select("run_id", F.lit("economy").alias("keyword")), v.where("failed").select("run_id", "claim"), v.where("not failed").select("run_id", "claim"))


@query("detect_first_k", "SELECT run_id, bool_or(contains(lower(claim), 'economy')) AS detected FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS rn FROM violations) WHERE rn <= 3 GROUP BY run_id", "violations")
def detect_first_k(spark, d):
    return R.first_k(t.violations(spark, d), "run_id", 3, "pos").groupBy("run_id").agg(F.bool_or(F.contains(F.lower("claim"), F.lit("economy"))).alias("detected"))


def _counts(spark, d):
    v = t.violations(spark, d).join(t.runs(spark, d).select("run_id", "product_id"), "run_id")
    n = lambda x: x.groupBy("product_id", "run_id").agg(F.count("*").alias("n"))
    return n(v), n(v.where("confidence > 0.95"))


@query("filter_impact", "SELECT coalesce(product_id, 'ALL') AS product_id, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after, round(100 * (sum(b) - sum(a)) / nullif(sum(b), 0), 4) AS reduction_pct, round(sum(a) / count(*), 4) AS per_run FROM (SELECT r.product_id, v.run_id, count(*) AS b, count(*) FILTER (confidence > 0.95) AS a FROM violations v JOIN runs r USING (run_id) GROUP BY 1, 2) GROUP BY ROLLUP (product_id)", "violations", "runs")
def filter_impact(spark, d):
    return M.filter_impact(*_counts(spark, d))


@query(
    "detect_rate",
    "SELECT 'overall' AS category, 'ALL' AS subcategory, count(*) AS total, count(*) FILTER (decision = 'Contradicted') AS detected, round(100 * count(*) FILTER (decision = 'Contradicted') / count(*), 1) AS rate FROM evals UNION ALL SELECT 'engine', engine, count(*), count(*) FILTER (decision = 'Contradicted'), round(100 * count(*) FILTER (decision = 'Contradicted') / count(*), 1) FROM evals GROUP BY engine UNION ALL SELECT 'product_id', product_id, count(*), count(*) FILTER (decision = 'Contradicted'), round(100 * count(*) FILTER (decision = 'Contradicted') / count(*), 1) FROM evals GROUP BY product_id", "evals",
)
def detect_rate(spark, d):
    return M.detection_rates(t.evals(spark, d).withColumn("detected", F.col("decision") == "Contradicted"), ["engine", "product_id"])


AGREE = f"WITH {SIDES}, w AS (SELECT run_id, coalesce(a, false) AS a, coalesce(b, false) AS b FROM a FULL JOIN b USING (run_id)), g AS (SELECT *, CASE WHEN a AND b THEN 'both_detected' WHEN NOT a AND NOT b THEN 'both_missed' WHEN a THEN 'a_only' ELSE 'b_only' END AS agreement FROM w)"


def _wide(spark, d):
    a, b, _ = _sides(spark, d)
    return M.outer_methods("run_id", a=a, b=b)


@query("method_agreement", f"{AGREE} SELECT run_id, a, b, agreement FROM g")
def method_agreement(spark, d):
    return M.agreement(_wide(spark, d), "a", "b")


@query("method_summary", f"{AGREE} SELECT count(*) AS n, count(*) FILTER (agreement = 'both_detected') AS both_detected, count(*) FILTER (agreement = 'both_missed') AS both_missed, count(*) FILTER (agreement = 'a_only') AS a_only, count(*) FILTER (agreement = 'b_only') AS b_only, round(100 * count(*) FILTER (a = b) / count(*), 4) AS agreement_pct FROM g")
def method_summary(spark, d):
    return M.agreement_summary(_wide(spark, d), "a", "b")


@query("method_2x2", f"{AGREE} SELECT CAST(a AS VARCHAR) AS a, count(*) FILTER (NOT b) AS \"false\", count(*) FILTER (b) AS \"true\" FROM g GROUP BY 1")
def method_2x2(spark, d):
    return A.crosstab(_wide(spark, d).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")), "a", "b", ["false", "true"])


@query("method_fp_rate", "SELECT CAST(sum(n_violations) AS BIGINT) AS flags, CAST(sum(least(n_violations, 1)) AS BIGINT) AS true_positives, CAST(sum(n_violations) - sum(least(n_violations, 1)) AS BIGINT) AS false_positives, round(100 * (sum(n_violations) - sum(least(n_violations, 1))) / sum(n_violations), 4) AS fp_pct FROM evals", "evals")
def method_fp_rate(spark, d):
    return M.false_positive_rate(t.evals(spark, d).select(F.col("n_violations").alias("flags"), F.least(F.col("n_violations"), F.lit(1)).alias("true_positives")))


@query("overlap_summary", f"{AGREE} SELECT v.agreement, count(g.run_id) AS n FROM (VALUES ('both_detected'), ('both_missed'), ('a_only'), ('b_only')) v(agreement) LEFT JOIN g USING (agreement) GROUP BY 1")
def overlap_summary(spark, d):
    return M.overlap_summary(M.agreement(_wide(spark, d), "a", "b"), ["both_detected", "both_missed", "a_only", "b_only"])


def _reruns(spark, d):
    v = t.violations(spark, d)
    g = lambda x: x.groupBy(F.col("run_id").alias("file")).agg((F.count("*") > 2).alias("detected"), F.collect_list("rule").alias("claims"))
    return g(v.where("confidence > 0.92")), g(v.where("confidence > 0.93"))


@query(
    "rerun_stability",
    """SELECT coalesce(x.file, y.file) AS file, CASE WHEN coalesce(d1, false) <> coalesce(d2, false) THEN 'different_detection' WHEN len(coalesce(c1, [])) <> len(coalesce(c2, [])) THEN 'different_count' WHEN coalesce(c1, []) = coalesce(c2, []) THEN 'identical' ELSE 'different_claims' END AS stability
    FROM (SELECT run_id AS file, count(*) > 2 AS d1, list_sort(list(rule)) AS c1 FROM violations WHERE confidence > 0.92 GROUP BY 1) x FULL JOIN (SELECT run_id AS file, count(*) > 2 AS d2, list_sort(list(rule)) AS c2 FROM violations WHERE confidence > 0.93 GROUP BY 1) y ON x.file = y.file""", "violations",
)
def rerun_stability(spark, d):
    return M.rerun_stability(*_reruns(spark, d))


@query("run_delta", "SELECT product_id, CAST(sum(b) AS BIGINT) AS first, CAST(sum(a) AS BIGINT) AS second, CAST(sum(a) - sum(b) AS BIGINT) AS delta, round(100 * (sum(a) - sum(b)) / sum(b), 4) AS delta_pct FROM (SELECT r.product_id, v.run_id, count(*) AS b, count(*) FILTER (confidence > 0.95) AS a FROM violations v JOIN runs r USING (run_id) GROUP BY 1, 2) GROUP BY 1", "violations", "runs")
def run_delta(spark, d):
    return M.run_delta(*_counts(spark, d), "product_id", "n")


@query("corruption_levels", "SELECT n_violations AS level, count(*) FILTER (product_id = 'p0' AND hit_rate > 0.2) AS p0, count(*) FILTER (product_id = 'p1' AND hit_rate > 0.2) AS p1, count(*) FILTER (product_id = 'p2' AND hit_rate > 0.2) AS p2 FROM evals GROUP BY 1", "evals")
def corruption_levels(spark, d):
    return M.corruption_levels(t.evals(spark, d).select(F.col("n_violations").alias("level"), "product_id", (F.col("hit_rate") > 0.2).alias("detected")), ["p0", "p1", "p2"])


@query("cumulative_detection", "SELECT run_id, n_violations AS induced, CASE WHEN hit_rate > 0.2 THEN n_violations ELSE 0 END AS detected FROM evals", "evals")
def cumulative_detection(spark, d):
    return t.evals(spark, d).select("run_id", F.col("n_violations").alias("induced"), F.when(F.col("hit_rate") > 0.2, F.col("n_violations")).otherwise(0).alias("detected"))


@query("review_topn", "SELECT run_id, rank, substring(claim, 1, 12) AS claim, confidence, greatest(n - 3, 0) AS remaining FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY confidence DESC, pos, claim) AS rank, count(*) OVER (PARTITION BY run_id) AS n FROM violations) WHERE rank <= 3", "violations")
def review_topn(spark, d):
    return M.review_topn(t.violations(spark, d), 3, 12).withColumn("rank", F.col("rank").cast("long"))


@query("incr_audit", "SELECT run_id FROM runs WHERE status = 'completed' AND run_id NOT IN (SELECT event_id FROM events)", "runs")
def incr_audit(spark, d):
    return incremental.new_runs(t.runs(spark, d), t.load(spark, d, "events").select(F.col("event_id").alias("run_id"))).select("run_id")


@query("incr_volume", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def incr_volume(spark, d):
    return incremental.volume(t.load(spark, d, "events")).withColumn("total", F.round("total", 2))


# --- samples and designs ----------------------------------------------------------------------


@query("sample_stratified", "SELECT run_id, engine, product_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY engine, product_id ORDER BY md5(CAST(run_id AS VARCHAR) || ':42'), run_id) AS rank FROM runs) WHERE rank <= 20", "runs")
def sample_stratified(spark, d):
    return D.stratified(t.runs(spark, d), ["engine", "product_id"], 20).select("run_id", "engine", "product_id", F.col("rank").cast("long").alias("rank"))


@query("sample_short_strata", "SELECT engine, product_id, count(*) AS size FROM runs GROUP BY 1, 2 HAVING count(*) < 600", "runs")
def sample_short_strata(spark, d):
    return D.short_strata(t.runs(spark, d), ["engine", "product_id"], 600)


@query("sample_n", "SELECT run_id FROM runs ORDER BY md5(CAST(run_id AS VARCHAR) || ':42'), run_id LIMIT 100", "runs")
def sample_n(spark, d):
    return D.sample_n(t.runs(spark, d), 100).select("run_id")


@query("sample_review", "(SELECT run_id, true AS compliant FROM runs WHERE status = 'completed' ORDER BY md5(CAST(run_id AS VARCHAR) || ':42'), run_id LIMIT 50) UNION ALL (SELECT run_id, false FROM runs WHERE status <> 'completed' ORDER BY md5(CAST(run_id AS VARCHAR) || ':42'), run_id LIMIT 50)", "runs")
def sample_review(spark, d):
    return D.review_sample(t.runs(spark, d).select("run_id", (F.col("status") == "completed").alias("compliant"), F.lit("LOW").alias("severity")), 100).select("run_id", "compliant")


@query("sample_head_per_group", "SELECT run_id, product_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY run_order) AS rn FROM runs) WHERE rn <= 10", "runs")
def sample_head_per_group(spark, d):
    return D.head_per_group(t.runs(spark, d), "product_id", 10, "run_order").select("run_id", "product_id")


@query("sample_one_per_material", "SELECT run_id, engine FROM (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY md5(CAST(run_id AS VARCHAR) || ':42'), run_id) AS rn FROM docs) WHERE rn = 1", "docs")
def sample_one_per_material(spark, d):
    return D.one_per_group(t.docs(spark, d), "engine").select("run_id", "engine")


def _levels(spark, d):
    """The runs of each combination of levels, counted in one pass: a handful of rows, written."""
    return written(t.runs(spark, d).groupBy("engine", "product_id", "status").agg(F.count("*").alias("n")), "levels")


def _conditions(levels):
    return levels.select("engine").distinct().crossJoin(F.broadcast(levels.select("product_id").distinct())).crossJoin(F.broadcast(levels.select("status").distinct()))  # a handful of levels each


@query("matrix_cartesian", "SELECT * FROM (SELECT DISTINCT engine FROM runs), (SELECT DISTINCT product_id FROM runs), (SELECT DISTINCT status FROM runs)", "runs")
def matrix_cartesian(spark, d):
    return _conditions(_levels(spark, d))


@query(
    "matrix_replicated",
    f"""SELECT *, CAST(dayofweek(date) IN (0, 6) AS BOOLEAN) AS is_weekend FROM (SELECT *, DATE '2026-01-05' + day AS date, CASE slot WHEN 'morning' THEN 8 WHEN 'afternoon' THEN 12 ELSE 17 END + CAST(floor({_uniform_sql("run_id", 44)} * 4) AS INTEGER) AS hour,
    CAST(floor({_uniform_sql("run_id", 45)} * 60) AS INTEGER) AS minute FROM (SELECT *, CAST(floor({_uniform_sql("run_id", 42)} * 7) AS INTEGER) AS day, ['morning', 'afternoon', 'evening'][CAST(floor({_uniform_sql("run_id", 43)} * 3) AS INTEGER) + 1] AS slot
    FROM (SELECT *, sha1(concat_ws('|', engine, product_id, status, CAST(repetition_id AS VARCHAR))) AS run_id FROM (SELECT DISTINCT engine FROM runs), (SELECT DISTINCT product_id FROM runs), (SELECT DISTINCT status FROM runs), (VALUES (1), (2), (3)) r(repetition_id))))""", "runs",
)
def matrix_replicated(spark, d):
    return D.replicated(_conditions(_levels(spark, d)), 3, "2026-01-05", 7)


@query("matrix_run_id", """SELECT sha1('{"engine":"' || engine || '","product_id":"' || product_id || '","run_order":' || CAST(run_order AS VARCHAR) || '}') AS run_id, run_order FROM runs""", "runs")
def matrix_run_id(spark, d):
    return D.run_ids(t.runs(spark, d).drop("run_id"), ["product_id", "engine", "run_order"]).select("run_id", "run_order")


@query("matrix_duplicates", "SELECT user_id AS run_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def matrix_duplicates(spark, d):
    return D.duplicates(t.load(spark, d, "events").select(F.col("user_id").alias("run_id")))


@query("matrix_shuffle", "SELECT run_id, row_number() OVER (ORDER BY md5(CAST(run_id AS VARCHAR) || ':42'), run_id) AS run_order FROM runs", "runs")
def matrix_shuffle(spark, d):
    return D.shuffled(t.runs(spark, d).drop("run_order")).select("run_id", F.col("run_order").cast("long").alias("run_order"))


@query("matrix_schedule", f"SELECT run_id, make_timestamp(epoch_us(TIMESTAMP '2026-01-05 08:00:00') + CAST(floor({_uniform_sql('run_id')} * 72.0::DOUBLE * 3600000000) AS BIGINT)) AS scheduled FROM runs", "runs")
def matrix_schedule(spark, d):
    return D.scheduled(t.runs(spark, d).select("run_id"), "2026-01-05 08:00:00", 72.0)


def _dealt_sql(rows: str, within: str, column: str, levels: list[str]) -> str:
    """operators.design.balanced"""
    at = f"row_number() OVER (PARTITION BY {within} ORDER BY md5(run_id || ':42'), run_id) - 1 + CAST(floor({_uniform_sql(within)} * {len(levels)}) AS BIGINT)"
    return f"(SELECT *, {levels}[CAST(({at}) % {len(levels)} AS BIGINT) + 1] AS {column} FROM {rows})"


SLOTS = ["morning", "afternoon", "evening"]
STRATIFIED = """(SELECT *, sha1(condition || '#' || CAST(repetition_id AS VARCHAR)) AS run_id FROM (SELECT engine, product_id, status, condition, unnest(range(1, quota + 1)) AS repetition_id FROM
    (SELECT *, (SELECT count(*) FROM runs) // count(*) OVER () + CAST(row_number() OVER (ORDER BY md5(condition || ':42'), condition) <= (SELECT count(*) FROM runs) % count(*) OVER () AS BIGINT) AS quota
    FROM (SELECT *, concat_ws('|', engine, product_id, status) AS condition FROM (SELECT DISTINCT engine FROM runs), (SELECT DISTINCT product_id FROM runs), (SELECT DISTINCT status FROM runs)))))"""


@query("matrix_stratified", f"SELECT * FROM {_dealt_sql(_dealt_sql(STRATIFIED, 'condition', 'day', list(A.DAYS)), 'day', 'slot', SLOTS)}", "runs")
def matrix_stratified(spark, d):
    levels = _levels(spark, d)
    total = levels.agg(F.sum("n")).first()[0] or 0
    return D.stratified_matrix(_conditions(levels), total, list(A.DAYS), SLOTS)


@query(
    "matrix_balance",
    """SELECT engine, slot, count(*) AS n FROM (SELECT engine, ['morning', 'afternoon', 'evening'][CAST((i + off) % 3 AS BIGINT) + 1] AS slot FROM (SELECT engine, row_number() OVER (PARTITION BY engine ORDER BY md5(CAST(run_id AS VARCHAR) || ':42'), run_id) - 1 AS i,
    CAST(floor(CAST('0x' || substring(md5(engine || ':42'), 1, 12) AS BIGINT) / 281474976710656.0 * 3) AS BIGINT) AS off FROM runs)) GROUP BY 1, 2""", "runs",
)
def matrix_balance(spark, d):
    return D.balanced(t.runs(spark, d), ["engine"], "slot", ["morning", "afternoon", "evening"]).groupBy("engine", "slot").agg(F.count("*").alias("n"))


@query("matrix_check", "SELECT 'status=' || s AS \"check\", CAST(e AS BIGINT) AS expected, count(run_id) AS actual, count(run_id) = e AS pass FROM (VALUES ('pending', 5000), ('completed', 5000), ('failed', 0)) v(s, e) LEFT JOIN runs ON status = s GROUP BY s, e", "runs")
def matrix_check(spark, d):
    return D.matrix_checks(t.runs(spark, d), {"status": {"pending": 5000, "completed": 5000, "failed": 0}})


@query(
    "matrix_fingerprint",
    "SELECT count(*) AS n, CAST(sum(CAST('0x' || substring(h, 1, 12) AS HUGEINT)) AS VARCHAR) AS sum1, CAST(sum(CAST('0x' || substring(h, 13, 12) AS HUGEINT)) AS VARCHAR) AS sum2 FROM (SELECT sha256(coalesce(engine, '~') || '|' || coalesce(product_id, '~') || '|' || CAST(run_id AS VARCHAR)) AS h FROM runs)", "runs",
)
def matrix_fingerprint(spark, d):
    return D.fingerprint(t.runs(spark, d), ["engine", "product_id", "run_id"])


# --- statistics -------------------------------------------------------------------------------


@query("ttest_one_sample", "SELECT count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, (avg(value) - 50) / (stddev_samp(value) / sqrt(count(value))) AS t FROM evals", "evals")
def ttest_one_sample(spark, d):
    return _rounded(S.one_sample(t.evals(spark, d), "value", 50.0))


def _rounded(df, places: int = 5):
    return df.select(*[F.round(c, places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _round_sql(body: str, doubles: list[str], rest: list[str]) -> str:
    return f"SELECT {', '.join([*rest, *[f'round({c}, 5) AS {c}' for c in doubles]])} FROM ({body})"


ORDER = "(SELECT value, engine = 'error' AS one FROM evals)"


@query("ttest_two_sample", _round_sql(f"SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t FROM (SELECT count(*) FILTER (one) AS n1, avg(value) FILTER (one) AS m1, var_samp(value) FILTER (one) AS v1, count(*) FILTER (NOT one) AS n2, avg(value) FILTER (NOT one) AS m2, var_samp(value) FILTER (NOT one) AS v2 FROM {ORDER})", ["m1", "v1", "m2", "v2", "t"], ["n1", "n2"]), "evals")
def ttest_two_sample(spark, d):
    return _rounded(S.two_sample(t.evals(spark, d), "value", F.col("engine") == "error"))


ANOVA = "SELECT k, n, round((b / (k - 1)) / (w / (n - k)), 5) AS f FROM (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum((n - 1) * v) AS w, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b FROM (SELECT {f} AS f, count(*) AS n, avg({v}) AS m, var_samp({v}) AS v FROM {t} GROUP BY 1))"


@query("anova_oneway", ANOVA.format(f="engine", v="value", t="evals"), "evals")
def anova_oneway(spark, d):
    return _rounded(S.anova(t.evals(spark, d), "engine", "value"))


@query("anova_twoway")
def anova_twoway(spark, d):
    return S.anova_twoway(t.evals(spark, d), "engine", "product_id", "value")


@query("tukey_hsd")
def tukey_hsd(spark, d):
    return S.tukey(t.evals(spark, d), "engine", "value")


@query("chi2_independence", "SELECT CAST((r - 1) * (c - 1) AS BIGINT) AS df, round(x, 5) AS chi2 FROM (SELECT count(DISTINCT engine) AS r, count(DISTINCT decision) AS c, sum((coalesce(n, 0) - e) * (coalesce(n, 0) - e) / e) AS x FROM (SELECT a.engine, b.decision, n, a.na * b.nb / (SELECT count(*) FROM evals) AS e FROM (SELECT engine, count(*) AS na FROM evals GROUP BY 1) a CROSS JOIN (SELECT decision, count(*) AS nb FROM evals GROUP BY 1) b LEFT JOIN (SELECT engine, decision, count(*) AS n FROM evals GROUP BY 1, 2) c ON c.engine = a.engine AND c.decision = b.decision))", "evals")
def chi2_independence(spark, d):
    return _rounded(S.chi2_table(t.evals(spark, d), "engine", "decision"))


@query("chi2_uniform", "SELECT count(*) - 1 AS df, round(sum(n * n) * count(*) / sum(n) - sum(n), 5) AS chi2 FROM (SELECT dayname(ts) AS day, count(*) AS n FROM evals GROUP BY 1)", "evals")
def chi2_uniform(spark, d):
    return _rounded(S.chi2_uniform(t.evals(spark, d).withColumn("day", F.date_format("ts", "EEEE")), "day"))


RANKS = "(SELECT engine, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS r, count(*) OVER (PARTITION BY value) AS ties FROM {})"


@query("kruskal_wallis", f"SELECT k, n, round(h, 4) AS h, round((h - k + 1) / (n - k), 6) AS eta2 FROM (SELECT k, n, (12.0 / (n * (n + 1.0)) * q - 3 * (n + 1)) / (1 - t / (n * 1.0 * n * n - n)) AS h FROM (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(r * r / n) AS q, (SELECT sum(ties * 1.0 * ties - 1) FROM {RANKS.format('evals')}) AS t FROM (SELECT engine, count(*) AS n, sum(r) AS r FROM {RANKS.format('evals')} GROUP BY 1)))", "evals")
def kruskal_wallis(spark, d):
    k = S.kruskal(t.evals(spark, d), "engine", "value")
    return k.select("k", "n", F.round("h", 4).alias("h"), F.round("eta2", 6).alias("eta2"))


TWO = "(SELECT * FROM evals WHERE engine IN ('click', 'view'))"


@query("mann_whitney", f"SELECT n1, n2, u, round(1 - 2 * u / (n1 * n2), 6) AS rank_biserial FROM (SELECT CAST(count(*) FILTER (engine = 'click') AS BIGINT) AS n1, CAST(count(*) FILTER (engine = 'view') AS BIGINT) AS n2, sum(r) FILTER (engine = 'click') - count(*) FILTER (engine = 'click') * (count(*) FILTER (engine = 'click') + 1) / 2 AS u FROM {RANKS.format(TWO)})", "evals")
def mann_whitney(spark, d):
    return S.mann_whitney(t.evals(spark, d), "engine", "value", "click", "view").select("n1", "n2", "u", F.round("rank_biserial", 6).alias("rank_biserial"))


@query("levene", ANOVA.format(f="engine", v="z", t="(SELECT e.engine, abs(e.value - m.m) AS z FROM evals e JOIN (SELECT engine, quantile_cont(value, 0.5) AS m FROM evals GROUP BY 1) m USING (engine))"), "evals")
def levene(spark, d):
    return _rounded(S.levene(t.evals(spark, d), "engine", "value"))


@query("normality_screen", "SELECT n, round(m3 / pow(m2, 1.5), 5) AS skewness, round(m4 / (m2 * m2) - 3, 5) AS kurtosis, round(n / 6 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 2) AS jb FROM (SELECT count(*) AS n, avg(pow(value - m, 2)) AS m2, avg(pow(value - m, 3)) AS m3, avg(pow(value - m, 4)) AS m4 FROM evals, (SELECT avg(value) AS m FROM evals))", "evals")
def normality_screen(spark, d):
    j = S.jarque_bera(t.evals(spark, d), "value")
    return j.select("n", F.round("skewness", 5).alias("skewness"), F.round("kurtosis", 5).alias("kurtosis"), F.round("jb", 2).alias("jb"))


def _poly(c, x):
    out = repr(c[0])
    for a in c[1:]:
        out = f"({out}) * {x} + ({a!r})"
    return f"({out})"


def _quantile_sql(p: str) -> str:
    """The normal quantile of a column."""
    q, x = f"sqrt(-2 * ln(least({p}, 1 - {p})))", f"({p} - 0.5)"
    low = f"{_poly(S.QUANTILE['c'], q)} / {_poly(S.QUANTILE['d'], q)}"
    return f"CASE WHEN least({p}, 1 - {p}) < {S.QUANTILE_TAIL} THEN CASE WHEN {p} < 0.5 THEN 1 ELSE -1 END * {low} ELSE {x} * {_poly(S.QUANTILE['a'], f'pow({x}, 2)')} / {_poly(S.QUANTILE['b'], f'pow({x}, 2)')} END"


def _outer_sql(m: str, c: tuple) -> str:
    return f"{m} / sqrt(mm) + " + " + ".join(f"({a!r}) * pow(n, {-(i + 1) / 2})" for i, a in enumerate(c))


@query(
    "shapiro_wilk",
    f"""WITH {t.CTE["evals"]}, o AS (SELECT value AS x, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n, avg(value) OVER () AS mean FROM evals WHERE value IS NOT NULL),
    s AS (SELECT *, {_quantile_sql("((i - 0.375) / (n + 0.25))::DOUBLE")} AS m FROM o),
    g AS (SELECT any_value(n)::DOUBLE AS n, sum(m * (x - mean)) AS mx, sum(m * m) AS mm, sum(pow(x - mean, 2)) AS xx, max(m) AS m1, max(m) FILTER (i = n - 1) AS m2, max(x) - min(x) AS w1, max(x) FILTER (i = n - 1) - max(x) FILTER (i = 2) AS w2 FROM s),
    a AS (SELECT *, {_outer_sql("m1", S.OUTER)} AS a1, {_outer_sql("m2", S.NEXT)} AS a2 FROM g)
    SELECT n::BIGINT AS n, round(pow((mx - m1 * w1 - m2 * w2) / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) + a1 * w1 + a2 * w2, 2) / xx, 6) AS w FROM a""",
)
def shapiro_wilk(spark, d):
    return S.shapiro_wilk(t.evals(spark, d), "value").select("n", F.round("w", 6).alias("w"))


@query("effect_size", "SELECT round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS size FROM (SELECT avg(value) / stddev_samp(value) AS d FROM evals)", "evals")
def effect_size(spark, d):
    return S.effect_size(t.evals(spark, d), "value").withColumn("d", F.round("d", 6))


@query("test_report")
def test_report(spark, d):
    return S.report(t.evals(spark, d), "value", ["engine", "product_id"])


# --- sources, where the driver's tables can stand for files ------------------------------------


@query("src_rules_fallback", "SELECT p_brand AS product_id, p_size > 25 AS truth, p_partkey AS rule_idx FROM part WHERE (p_size > 25) = (p_brand IN (SELECT p_brand FROM part WHERE p_size > 25))")
def src_rules_fallback(spark, d):
    p = t.load(spark, d, "part").select(F.col("p_brand").alias("product_id"), F.when(F.col("p_size") > 25, "ground_truth").otherwise("regular").alias("rule_set"), F.col("p_partkey").alias("rule_idx"))
    return io.preferred_rules(p).select("product_id", (F.col("rule_set") == "ground_truth").alias("truth"), "rule_idx")


@query("src_rules_unwrap", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS rule_text FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def src_rules_unwrap(spark, d):
    e = t.load(spark, d, "events").select("event_id", F.regexp_replace("props", '"k": (\\d+)', '"statement": "$1"').alias("item"))
    return io.unwrapped(e).select("event_id", "rule_text")


@query("src_filename_key", "SELECT page_id, nullif(regexp_extract(f, '^(?:errors_)?([a-z]+)_(\\d+)(?:\\.csv)?$', 1), '') AS product, TRY_CAST(nullif(regexp_extract(f, '^(?:errors_)?([a-z]+)_(\\d+)(?:\\.csv)?$', 2), '') AS INTEGER) AS n FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'errors_' ELSE '' END || regexp_extract(url, '//([a-z]*)', 1) || '_' || CAST(page_id AS VARCHAR) || '.csv' AS f FROM pages)")
def src_filename_key(spark, d):
    name = F.concat(F.when(F.col("page_id") % 2 == 0, "errors_").otherwise(""), F.regexp_extract("url", "//([a-z]*)", 1), F.lit("_"), F.col("page_id").cast("string"), F.lit(".csv"))
    return io.file_key(t.load(spark, d, "pages").select("page_id", name.alias("file"))).select("page_id", "product", "n")


@query("sink_claims_index", "SELECT run_id, count(*) AS n_claims, 'claims/' || CAST(run_id AS VARCHAR) || '.jsonl' AS path FROM violations GROUP BY run_id", "violations")
def sink_claims_index(spark, d):
    return io.claims_index(t.violations(spark, d), "claims")


@query("schema_add_columns", "SELECT run_id, tokens, 0 AS retries, 'none' AS note FROM runs", "runs")
def schema_add_columns(spark, d):
    return io.add_columns(t.runs(spark, d).select("run_id", "tokens"), {"tokens": -1, "retries": 0, "note": "none"})


@query("schema_canonicalize", "SELECT run_id, hit_rate, 0.0::DOUBLE AS unsupported_rate, engine, decision FROM evals", "evals")
def schema_canonicalize(spark, d):
    c = io.canonical(t.evals(spark, d))
    return c.select("run_id", "metrics.hit_rate", "metrics.unsupported_rate", "metadata.engine", "labels.decision")


@query("schema_validate", "SELECT run_id, 'missing owner' AS error FROM runs WHERE owner IS NULL UNION ALL SELECT run_id, 'missing seed' FROM runs", "runs")
def schema_validate(spark, d):
    return io.schema_errors(t.runs(spark, d), ["run_id", "owner", "seed"])


@query("catalog_validate", "SELECT product_id, 'short text: ' || rule_text AS error FROM pr WHERE length(rule_text) < 10 UNION ALL SELECT product_id, 'no unit: ' || rule_text FROM pr WHERE kind = 'spec' UNION ALL SELECT product_id, 'no section: ' || k FROM (SELECT DISTINCT product_id FROM pr), (VALUES ('authorized'), ('spec'), ('prohibited')) v(k) WHERE (product_id, k) NOT IN (SELECT product_id, kind FROM pr)".replace(" FROM pr", " FROM (SELECT p_brand AS product_id, CASE WHEN p_type = 'ECONOMY' THEN 'spec' ELSE 'authorized' END AS kind, p_name AS rule_text FROM part) pr"))
def catalog_validate(spark, d):
    p = t.load(spark, d, "part").select(F.col("p_brand").alias("product_id"), F.when(F.col("p_type") == "ECONOMY", "spec").otherwise("authorized").alias("rule_type"), F.col("p_name").alias("rule_text"))
    return io.catalog_errors(p)
