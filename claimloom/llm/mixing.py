"""Mixing sources to target weights along a training curriculum."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Spool, table, words

#: The weight of each source changes over equal phases of the training: factors by weight class.
PHASES = ((1.0, 1.0, 1.0, 1.0), (0.5, 1.0, 1.0, 1.5), (1.5, 1.0, 1.0, 0.5))


def ranked(df: DataFrame, column: str, spool: Spool) -> DataFrame:
    """Adds the 0-based global rank by column, nulls last, without a global window: ranges are
    dealt out to partitions, and each adds the rows of the ranges before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(column)
    parts = spool.cut(df.withColumn("_last", key.isNull()).repartitionByRange(n, F.col("_last"), key).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))  # a row for each range
    at = F.row_number().over(Window.partitionBy("_part").orderBy("_last", key))
    return parts.join(F.broadcast(sizes), "_part").withColumn("rank", (F.col("_before") + at - 1).cast("long")).drop("_part", "_n", "_before", "_last")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, rank) -> adds weight and target.

    Water filling: sources share `share` of all words by weight; those above `cap` times their size
    are held there and the excess goes to the others by weight, until none is above. Each round is
    one aggregate over the sources and returns two numbers.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("_cap", F.col("source_size") * float(cap))
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, held = 0.0, -1
    while True:
        full = F.col("_cap") <= F.col("weight") * level
        r = s.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if r[2] == held or not r[1]:
            break
        level, held = (total - r[0]) / r[1], r[2]
    return s.withColumn("target", F.least("_cap", F.col("weight") * level)).drop("_cap")


def _inverse(share: Column, rank: Column, phases: Sequence[Sequence[float]]) -> Column:
    """When a source has met this share of its demand: the inverse of its integrated schedule."""
    out = None
    for k, rates in enumerate(phases):
        at, whole, t = 0.0, sum(rates), F.lit(1.0)
        spans = []
        for i, x in enumerate(rates):
            spans.append((at / whole, x / whole, i / len(rates)))
            at += x
        for start, area, begin in reversed([s for s in spans if s[1] > 0]):
            t = F.when(share < start + area, begin + F.greatest(share - start, F.lit(0.0)) / (area * len(rates))).otherwise(t)
        out = t if out is None else F.when(rank % len(phases) == k, t).otherwise(out)
    return out


def plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, phases: Sequence[Sequence[float]] = PHASES, seed: int = 7, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, source, ...) -> one row a document: doc_id, size, source_size, target, taken,
    times (position from 0 to 1 and words taken, for each time that it is taken), and the carried columns.

    The documents of a source stand in an order by hash; the mix takes the source's words from the
    start of that order, and again from its start as often as the target exceeds the source. So a
    source's taken words are its target rounded, and no document exceeds its size times the
    rounded-up ratio. The position is where the source's integrated weight schedule reaches the document.

    Null texts and those without words have size 0 and are not taken; null is a source of its own
    and ranks last; rows that repeat a doc_id are documents of their own; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    spool = Spool(spark, "mixing")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words(F.col("text").cast("string"))).cast("long").alias("size"), F.struct(F.lit(0).alias("_"), *carry).alias("carry"))
    d = d.withColumn("u", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1))
    if not carry:
        d = spool.cut(d)  # the sizes alone: the texts are read once
    by_source = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = spool.cut(targets(ranked(by_source, "source", spool), weights, share, cap))
    rows = sources.agg(F.sum("n")).first()[0] or 0
    bits = max(0, int(rows // 2048).bit_length())  # about 2048 documents a bucket at any size
    d = d.withColumn("bucket", F.shiftright("u", 63 - bits) if bits else F.lit(0).cast("long"))
    known = F.col("d.source").eqNullSafe(F.col("s.source"))
    buckets = d.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    buckets = buckets.withColumn("before", F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket")) - F.col("in_bucket")).drop("in_bucket")
    starts = spool.cut(buckets.alias("d").join(sources.alias("s"), known).select("d.source", "bucket", "before", "source_size", "rank", "target"))
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    d = d.withColumn("inside", inside)
    j = d.alias("d").join(starts.alias("s"), known & (F.col("d.bucket") == F.col("s.bucket")))
    goal, at, n, whole = F.round("target").cast("long"), F.col("before") + F.col("inside"), F.col("size"), F.col("source_size")
    zero = F.lit(0).cast("long")
    took = [F.greatest(zero, F.least(goal - k * whole - at, n)) for k in range(math.ceil(cap))]
    pos = lambda offset: _inverse(offset / F.greatest(goal, F.lit(1).cast("long")), F.col("rank"), phases)
    times = F.array(*[F.struct(pos(at + k * whole).alias("position"), x.alias("taken")) for k, x in enumerate(took)])
    taken = took[0]
    for x in took[1:]:
        taken = taken + x
    return j.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.filter(times, lambda x: x["taken"] > 0).alias("times"), *[F.col(f"carry.{c}").alias(c) for c in carry if c != "doc_id"])


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row for each time that the mix takes a document: the documents' columns, position and
    taken, range-sorted by position. The text of a document that the mix takes in part is its first
    `taken` words as they stand. Columns of the documents named position or taken are replaced; null
    and empty texts are not taken; repeated rows are documents of their own; an empty table gives an empty one."""
    names = docs.columns
    safe = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)], F.col("doc_id"), F.col("text"), F.col("source"))
    p = plan(safe, carry=[f"_c{i}" for i in range(len(names))], **how)
    rows = p.withColumn("time", F.explode("times"))
    text = F.col(f"_c{names.index('text')}")
    other, word = SPACE, SPACE.replace("[", "[^")
    cut = F.expr("regexp_extract(`_text`, `_pattern`, 0)")
    rows = rows.withColumn("_text", text).withColumn("_pattern", F.concat(F.lit(f"^(?:{other[:-1]}*+{word}+){{"), F.col("time.taken").cast("string"), F.lit("}+")))
    kept = F.when(F.col("time.taken") < F.col("size"), cut).otherwise(text)
    own = ("position", "taken")
    out = [(kept if c == "text" else F.col(f"_c{i}")).alias(c) for i, c in enumerate(names) if c not in own]
    out += [F.col(f"time.{c}").alias(c) for c in own]
    rows = rows.select(F.col("time.position").alias("_p"), F.col("doc_id").alias("_d"), *out)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "_p", "_d").sortWithinPartitions("_p", "_d").drop("_p", "_d")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    p = plan(table(spark, sf_dir, "documents"))
    p = p.withColumns({"first_position": F.get("times", F.lit(0))["position"], "second_position": F.get("times", F.lit(1))["position"]})
    return p.drop("times").orderBy("first_position", "doc_id")
