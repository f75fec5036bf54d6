"""Readers and writers of run logs, texts, rules and results. Schemas are given, never inferred."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that a set of text files is dealt over.
FOLDERS = 256
#: Bytes of texts that a task reads into a batch.
BATCH_BYTES = 1 << 23
RULES = "product_id string, rule_set string, rule_type string, category_path string, rule_idx int, rule_text string"

# The keys of a product document and the rule type of each, newer names before older.
RULE_KEYS = {
    "authorized": ("authorized_claims",), "spec": ("specs", "technical_specs"), "prohibited": ("prohibited_or_unsupported_claims", "prohibited_claims"),
    "clarification": ("clarifications",), "disclaimer": ("mandatory_statements", "mandatory_disclaimers"),
}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, typed: blank fields are null, and a field that can't be cast is null."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    text = spark.read.option("header", True).schema(T.StructType([T.StructField(f.name, T.StringType()) for f in wanted])).csv(path)
    blank = lambda c: F.when(F.trim(c) == "", None).otherwise(F.col(f"`{c}`"))
    return text.select(*[blank(f.name).try_cast(f.dataType).alias(f.name) for f in wanted])


def read_texts(spark: SparkSession, path: str, key: str = r"([^/]*?)(?:\.[^./]*)?$") -> DataFrame:
    """One text a file: (run_id, text), the key being the file's name without its ending, or what the expression finds in its path.

    Files in folders of the path are read too; many folders, as by a pattern, are listed by tasks."""
    t = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("f"))
    return t.select(F.regexp_extract("f", key, 1).alias("run_id"), "text")


def write_texts(rows: DataFrame, path: str) -> int:
    """(run_id string, text) -> a file for each text in folders of the path, named by its key with the ending
    .txt; how many there were. Tasks write the files, whole and then renamed, so that a repeated task leaves the
    same; nothing is sorted or moved by the driver. Other characters of keys than a file name has are written as %xx.

    The path is one that pyarrow can open from the tasks: file, hdfs, s3 or gs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(path)
        made, attempt = set(), uuid.uuid4().hex
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                folder = f"{root}/{zlib.crc32(key.encode()) % FOLDERS:03d}"
                if folder not in made:
                    fs.create_dir(folder)
                    made.add(folder)
                with fs.open_output_stream(f"{folder}/_{attempt}") as out:
                    out.write(text.as_buffer())
                fs.move(f"{folder}/_{attempt}", f"{folder}/{quote(key, safe='')}.txt")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    n = rows.where("run_id is not null and text is not null").select(F.col("run_id").cast("string").alias("run_id"), "text").mapInArrow(run, "n long")
    return n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_written_texts(spark: SparkSession, path: str) -> DataFrame:
    """What write_texts() has left in the path: (run_id, text). A task lists and reads a folder, so that the driver
    holds neither names nor sizes of files, however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(path)
        rows = lambda keys, texts: pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["run_id", "text"])
        for b in batches:
            for folder in b.column(0).to_pylist():
                keys, texts, size = [], [], 0
                for f in fs.get_file_info(FileSelector(f"{root}/{folder:03d}", allow_not_found=True)):
                    if not f.base_name.endswith(".txt"):
                        continue  # of a task that broke off
                    with fs.open_input_stream(f.path) as s:
                        texts.append(s.read())
                    keys.append(unquote(f.base_name[: -len(".txt")]))
                    size += len(texts[-1])
                    if size >= BATCH_BYTES:
                        yield rows(keys, texts)
                        keys, texts, size = [], [], 0
                yield rows(keys, texts)

    return spark.range(0, FOLDERS, 1, FOLDERS).mapInArrow(run, "run_id string, text string")


def attach_texts(runs: DataFrame, texts: DataFrame) -> DataFrame:
    """Runs with their text; skipped marks those without one."""
    return runs.join(texts, "run_id", "left").withColumn("skipped", F.col("text").isNull())


def _flat(node, path: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(node, dict):
        text = node.get("statement") or node.get("text")
        if isinstance(text, str):
            yield path, text
        else:
            for k, v in node.items():
                yield from _flat(v, f"{path}.{k}" if path else str(k))
    elif isinstance(node, list):
        for v in node:
            yield from _flat(v, path)
    elif node is not None and str(node).strip():
        yield path, str(node)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Product documents in YAML -> rules, in list order. A file named *_GROUND_TRUTH is the ground-truth
    set of its product. Items may be strings or {statement: ...}; empty ones are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for b in batches:
            rows = []
            for name, content in zip(b["name"], b["content"], strict=True):
                doc = yaml.safe_load(content) or {}
                truth = "_GROUND_TRUTH" in name
                product = str(doc.get("product_id") or name.split("/")[-1].rsplit(".", 1)[0].replace("_GROUND_TRUTH", ""))
                for kind, keys in RULE_KEYS.items():
                    node = next((doc[k] for k in keys if doc.get(k)), None)
                    rows += [(product, "ground_truth" if truth else "regular", kind, p, i, t) for i, (p, t) in enumerate(_flat(node))]
            yield pd.DataFrame(rows, columns=["product_id", "rule_set", "rule_type", "category_path", "rule_idx", "rule_text"])

    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("name"), "content")
    return files.mapInPandas(run, RULES)


def preferred_rules(rules: DataFrame) -> DataFrame:
    """The ground-truth set of a product where there is one, else its regular set."""
    best = rules.groupBy("product_id").agg(F.max(F.col("rule_set") == "ground_truth").alias("truth"))
    return rules.join(best, "product_id").where((F.col("rule_set") == "ground_truth") == F.col("truth")).drop("truth")


def unwrapped(items: DataFrame, column: str = "item") -> DataFrame:
    """Items that are a text or a JSON object with statement or text -> rule_text; empty ones go."""
    is_object = F.startswith(F.trim(column), F.lit("{"))
    text = F.when(is_object, F.coalesce(F.get_json_object(column, "$.statement"), F.get_json_object(column, "$.text"))).otherwise(F.col(column))
    return items.withColumn("rule_text", text).where(F.trim("rule_text") != "")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def bad_lines(spark: SparkSession, path: str, schema: str) -> int:
    """How many lines read_jsonl drops."""
    row = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return spark.read.text(path).where("trim(value) <> ''").where(row["_corrupt"].isNotNull()).count()


def read_json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object or array a file, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def merge_csvs(spark: SparkSession, glob: str, schema: str, key: str = r"([^/]*?)(?:\.csv)?$") -> DataFrame:
    """Many CSVs of one form; run_id is the file's name, or what the expression finds in its path."""
    return spark.read.option("header", True).schema(schema).csv(glob).withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), key, 1))


def file_key(rows: DataFrame, column: str = "file") -> DataFrame:
    """product and n of names like product_3.csv or errors_product_3."""
    p = r"^(?:errors_)?([a-z]+)_(\d+)(?:\.csv)?$"
    return rows.withColumn("product", F.nullif(F.regexp_extract(column, p, 1), F.lit(""))).withColumn("n", F.regexp_extract(column, p, 2).try_cast("int"))


def write_csv(rows: DataFrame, path: str, columns: Sequence[str], decimals: Mapping[str, int] | None = None) -> None:
    rows.select(*[F.round(c, (decimals or {})[c]).alias(c) if c in (decimals or {}) else F.col(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_claims(claims: DataFrame, path: str) -> DataFrame:
    """Claims partitioned by product, and the index of claims by run that comes back."""
    claims.write.mode("overwrite").partitionBy("product_id").parquet(path)
    return claims_index(claims, path)


def claims_index(claims: DataFrame, path: str) -> DataFrame:
    return claims.groupBy("run_id").agg(F.count("*").alias("n_claims")).withColumn("path", F.concat(F.lit(f"{path}/"), F.col("run_id").cast("string"), F.lit(".jsonl")))


def append_checked(rows: DataFrame, path: str) -> None:
    """Appends to a table; refuses other columns or types than it has."""
    spark = rows.sparkSession
    try:
        have = spark.read.parquet(path).schema
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        have = None
    form = lambda s: [(f.name, f.dataType) for f in s]
    if have is not None and form(have) != form(rows.schema):
        raise ValueError(f"columns differ: {rows.schema.simpleString()} against {have.simpleString()}")
    rows.write.mode("append").parquet(path)


def add_columns(rows: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Missing columns with their defaults; those there stay."""
    return rows.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in rows.columns})


def canonical(records: DataFrame) -> DataFrame:
    """Flat per-run records in the nested form: metrics, metadata and labels with defaults; error lists become counts."""
    has = set(records.columns)
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in has else F.lit(0.0)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) if c in has else F.lit("unknown")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) if c in has else F.lit(0)
    rates = ("hit_rate", "contradiction_rate", "unsupported_rate", "ambiguous_rate", "overclaim_rate", "bias_score")
    metrics = F.struct(*[num(c).alias(c) for c in rates], size("numeric_errors").alias("numeric_errors"), size("unit_errors").alias("unit_errors"))
    return records.select("run_id", metrics.alias("metrics"), F.struct(*[text(c).alias(c) for c in ("engine", "product_id", "material_type")]).alias("metadata"), F.struct(text("decision").alias("decision")).alias("labels"))


def schema_errors(records: DataFrame, required: Sequence[str]) -> DataFrame:
    """A row for each required column that is null or missing in a record."""
    there = [F.when(F.col(c).isNull() if c in records.columns else F.lit(True), F.lit(f"missing {c}")) for c in required]
    return records.select("run_id", F.explode(F.array_compact(F.array(*there))).alias("error"))


# Units that a specification must name one of.
SPEC_UNITS = "mg|g|kg|ml|l|gb|mb|tb|hz|khz|mhz|ghz|mah|mp|inch|inches|mm|cm|w|v|%|ppm|tps|hours|hour|days|seconds|years"


def catalog_errors(rules: DataFrame, least: int = 10) -> DataFrame:
    """Products without a required section, texts that are too short, specs without a unit."""
    short = rules.where(F.length("rule_text") < least).select("product_id", F.concat(F.lit("short text: "), "rule_text").alias("error"))
    bare = rules.where((F.col("rule_type") == "spec") & ~F.col("rule_text").rlike(rf"(?i)\d\s*({SPEC_UNITS})(\W|$)")).select("product_id", F.concat(F.lit("no unit: "), "rule_text").alias("error"))
    kinds = rules.groupBy("product_id").agg(F.collect_set("rule_type").alias("k"))
    gaps = kinds.select("product_id", F.explode(F.array_except(F.array(*[F.lit(k) for k in ("authorized", "spec", "prohibited")]), "k")).alias("kind")).select("product_id", F.concat(F.lit("no section: "), "kind").alias("error"))
    return short.unionByName(bare).unionByName(gaps)
