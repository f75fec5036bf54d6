"""The driver's tables in the shape of the operators, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import spread


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "documents"), "doc_id").select(F.col("doc_id").alias("run_id"), F.col("source").alias("engine"), F.col("lang").alias("product_id"), "text", "n_chars")


def runs(spark: SparkSession, d: str) -> DataFrame:
    o, c = load(spark, d, "orders"), load(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("product_id"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    owner = F.when(F.col("o_totalprice") < 250000, F.concat(F.lit("u"), (F.col("o_custkey") % 7).cast("string")))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("run_id"), "product_id", F.col("o_orderpriority").alias("engine"), status.alias("status"), F.col("o_orderdate").alias("scheduled"),
        (F.col("o_totalprice") > 400000).alias("trap_flag"), F.floor(F.col("o_totalprice") / 100).alias("tokens"), owner.alias("owner"), F.col("o_orderkey").alias("run_order"),
    )


def evals(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    decision = F.when(v >= 150, "Contradicted").when(v >= 80, "Supported").when(v >= 40, "Ambiguous").otherwise("Unsupported")
    return load(spark, d, "events").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("engine"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("product_id"), F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("material_type"),
        "ts", "user_id", "value", F.least(v / 500, F.lit(1.0)).alias("hit_rate"), F.when(v >= 150, 1.0).otherwise(0.0).alias("contradiction_rate"), F.floor(v / 50).alias("n_errors"), F.least(v, F.lit(100.0)).alias("bias_score"), decision.alias("decision"), F.floor(v / 60).alias("n_violations"),
    )


def violations(spark: SparkSession, d: str) -> DataFrame:
    l, p = load(spark, d, "lineitem"), load(spark, d, "part")
    severity = F.when(F.col("l_returnflag") == "A", "CRITICAL").when(F.col("l_returnflag") == "R", "HIGH").otherwise("LOW")
    pos = F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey") * 1000000 + F.col("l_suppkey")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("run_id"), pos.alias("pos"), F.col("p_name").alias("rule"), F.concat_ws(" ", "p_type", "p_brand").alias("claim"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), severity.alias("severity"), (F.col("l_linestatus") == "F").alias("failed")
    )


def rules(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("authorized"), F.lit("prohibited"), F.lit("spec"), F.lit("disclaimer")), (F.col("item_id") % 4 + 1).cast("int"))
    products = F.explode(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]))
    return load(spark, d, "benchmark").select(F.col("item_id").alias("rule_idx"), F.col("text").alias("rule_text"), kind.alias("rule_type"), products.alias("product_id"))


def methods(spark: SparkSession, d: str) -> DataFrame:
    l = load(spark, d, "labels").select(F.col("doc_id").alias("run_id"), (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return docs(spark, d).select("run_id", "engine", "product_id", (F.col("n_chars") > 2000).alias("c")).join(l, "run_id", "left")


CTE = {
    "docs": "docs AS (SELECT doc_id AS run_id, source AS engine, lang AS product_id, text, n_chars FROM documents)",
    "runs": """runs AS (SELECT o_orderkey AS run_id, c_mktsegment AS product_id, o_orderpriority AS engine,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status, o_orderdate AS scheduled, o_totalprice > 400000 AS trap_flag,
        CAST(floor(o_totalprice / 100) AS BIGINT) AS tokens, CASE WHEN o_totalprice < 250000 THEN 'u' || CAST(o_custkey % 7 AS VARCHAR) END AS owner, o_orderkey AS run_order
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey)""",
    "evals": """evals AS (SELECT event_id AS run_id, event_type AS engine, 'p' || CAST(user_id % 3 AS VARCHAR) AS product_id, 'm' || CAST(user_id % 5 AS VARCHAR) AS material_type, ts, user_id, value,
        least(value / 500, 1.0) AS hit_rate, CASE WHEN value >= 150 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS contradiction_rate, CAST(floor(value / 50) AS BIGINT) AS n_errors, least(value, 100.0) AS bias_score,
        CASE WHEN value >= 150 THEN 'Contradicted' WHEN value >= 80 THEN 'Supported' WHEN value >= 40 THEN 'Ambiguous' ELSE 'Unsupported' END AS decision, CAST(floor(value / 60) AS BIGINT) AS n_violations FROM events)""",
    "violations": """violations AS (SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey AS pos, p_name AS rule, p_type || ' ' || p_brand AS claim, round(1 - l_discount, 2) AS confidence,
        CASE l_returnflag WHEN 'A' THEN 'CRITICAL' WHEN 'R' THEN 'HIGH' ELSE 'LOW' END AS severity, l_linestatus = 'F' AS failed FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "rules": """rules AS (SELECT item_id AS rule_idx, text AS rule_text, CASE item_id % 4 WHEN 0 THEN 'authorized' WHEN 1 THEN 'prohibited' WHEN 2 THEN 'spec' ELSE 'disclaimer' END AS rule_type, product_id
        FROM benchmark, (VALUES ('de'), ('en'), ('es'), ('fr')) p(product_id))""",
    "methods": """methods AS (SELECT d.doc_id AS run_id, d.source AS engine, d.lang AS product_id, d.n_chars > 2000 AS c, l.quality = 1 AS a, l.toxic = 1 AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "sentences": r"""sentences AS (SELECT run_id, engine, product_id, CAST(pos - 1 AS INTEGER) AS pos, s AS sentence FROM (SELECT run_id, engine, product_id, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM
        (SELECT run_id, engine, product_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM docs)))""",
}


def sql(body: str, *names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n" + body if names else body
