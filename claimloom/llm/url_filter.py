"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import ascii_lower, table


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without a last dot and the usual ports, path (at least /) and query: what urls of one page
    that differ in scheme, case of the host, or fragment have in common. Null without `://`."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), ":(80|443)?$", ""), "\\.$", "")
    path, query = path_of(url), F.regexp_extract(url, "://[^?#]*(\\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), query))


def _listed(keys: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    """The rows whose string is listed: a Bloom filter lets possible hits through, a hash join on the strings keeps the true ones."""
    filled = bloom.build(listed.select(F.xxhash64(column).alias("h")), "h")

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(bloom.probe(filled, b.column("h").to_numpy(zero_copy_only=False).astype(np.int64))))

    probed = keys.withColumn("h", F.xxhash64(column))
    return probed.mapInArrow(may, probed.schema).drop("h").join(listed, column)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", listed: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, ...), rules (rule, action), listed (url, action) -> (page_id, host, path, rule, verdict).

    A rule is `host/path-prefix`. It fits its host and all subdomains if the url's path starts with
    the rule's path. The longest fitting rule wins (of equal ones given twice, the greater action). A
    url that no rule fits gets the verdict of the listed url of the same canonical form (see above;
    the greater action of several), else the default, and a null rule. Null urls and those without
    `://` have empty host and path. One row comes out for each row of pages, repeated ones too; urls
    of any length are read whole; other columns are not looked at; empty tables give an empty one.

    Each distinct host and path emits its prefixes of listed lengths under the parent domains of as
    many labels as listed ones have; the filter drops nearly all that aren't listed, and the hash
    join on the strings drops the rest.
    """
    r = rules.where("rule is not null and instr(rule, '/') > 0").groupBy("rule").agg(F.max("action").alias("action"))
    r = r.select(F.concat(ascii_lower(F.substring_index("rule", "/", 1)), F.expr("substring(rule, instr(rule, '/'))")).alias("prefix"), "rule", "action")
    sizes = r.select(F.length(F.substring_index("prefix", "/", 1)).alias("h"), F.size(F.split(F.substring_index("prefix", "/", 1), "\\.")).alias("labels"), (F.length("prefix") - F.length(F.substring_index("prefix", "/", 1))).alias("n"))
    lengths = sorted(x[0] for x in sizes.select("n").distinct().collect())  # bounded by the longest rule
    most = sizes.agg(F.max("labels")).first()[0] or 0
    seen = pages.select(F.col("page_id"), F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = seen.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    last = F.slice(labels, F.greatest(F.size(labels) - most, F.lit(0)) + 1, max(most, 1))  # no rule has more labels
    parents = F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.array_join(F.slice(last, i, most), "."))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")) if lengths else F.array().cast("array<int>")
    keys = urls.select("host", "path", F.explode(parents).alias("parent"), fits.alias("fits"))
    keys = keys.select("host", "path", "parent", F.explode("fits").alias("n")).select("host", "path", F.concat("parent", F.expr("substring(path, 1, n)")).alias("prefix"))
    best = _listed(keys, "prefix", r).groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("best"))
    out = seen.join(best, ["host", "path"], "left").select("page_id", "url", "host", "path", "best.rule", "best.action")
    verdict = F.col("action")
    if listed is not None:
        of = listed.select(canonical(F.col("url")).alias("page"), "action").where("page is not null").groupBy("page").agg(F.max("action").alias("listed"))
        open_ = out.where("rule is null").select("url", canonical(F.col("url")).alias("page")).where("page is not null").distinct()
        out = out.join(_listed(open_, "page", of).select("url", "listed"), "url", "left")
        verdict = F.coalesce(verdict, F.col("listed"))
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict, F.lit(default)).alias("verdict"))


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, action string"))


OP5_SQL = """
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule, action, h, p) AS (VALUES
  ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
  ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
best AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.action, length(r.rule)) AS action
  FROM (SELECT DISTINCT * FROM p) p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
  GROUP BY ALL)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.action, 'allow') AS verdict
FROM p LEFT JOIN best ON p.page_id IS NOT DISTINCT FROM best.page_id AND p.host = best.host AND p.path = best.path
"""
