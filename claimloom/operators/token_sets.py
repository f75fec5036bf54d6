"""Join of texts with rules by token set ratio, a fuzzy likeness of their word sets.

The ratio is the best of three comparisons: what both share with each one's words, and the shared
words with each one's rest by longest common subsequence. The first two follow from lengths: they
are high only if enough of one side's letters is in shared words, so one of its longest words must
be shared, which is the key of the join. The third needs texts of about the same length, and has a
bound by length and letters. Only pairs that pass are compared, in one pass over Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of all alphabets.
SPACE = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def token_set(text: Column) -> Column:
    """The different words of a text in lower case, in order."""
    return F.array_sort(F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")))


def joined_length(words: Column) -> Column:
    """Characters of the words joined by spaces."""
    return F.greatest(F.aggregate(words, F.lit(-1), lambda s, w: s + F.char_length(w) + 1), F.lit(0))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel in the first text."""
    if not a or not b:
        return 0
    ones, where = (1 << len(a)) - 1, {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    s = ones
    for ch in b:
        u = s & where.get(ch, 0)
        s = (s + u | s - u) & ones
    return len(a) - s.bit_count()


def set_ratio(p: list[str], q: list[str], least: float = 0.0) -> float:
    """The token set ratio of two sorted word sets; the subsequence is only looked for if it can be the
    best comparison and reach `least`."""
    if not p or not q:
        return 0.0
    in_q, in_p = set(q), set(p)
    shared = [w for w in p if w in in_q]
    if shared and (len(shared) == len(p) or len(shared) == len(q)):
        return 100.0
    both, left, right = " ".join(shared), " ".join(w for w in p if w not in in_q), " ".join(w for w in q if w not in in_p)
    l, r = f"{both} {left}" if both else left, f"{both} {right}" if both else right
    best = max(200.0 * len(both) / (len(both) + len(l)), 200.0 * len(both) / (len(both) + len(r))) if both else 0.0
    same = len(both) + bool(both)  # the shared beginning is part of a longest subsequence
    total = len(l) + len(r)
    if 200.0 * (same + min(len(left), len(right))) / total <= max(best, least - 1e-9):
        return best
    letters = {c: left.count(c) for c in set(left)}
    if 200.0 * (same + sum(min(n, right.count(c)) for c, n in letters.items())) / total <= max(best, least - 1e-9):
        return best
    return max(best, 200.0 * (same + lcs(left, right)) / total)


def _longest(words: Column, needed: Column) -> Column:
    """The longest words, one of which at least is in any choice of words of the needed weight, which is
    the sum of their lengths and one for each."""
    ordered = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])

    def cut(o: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("spare"))
        step = lambda s, w: F.struct((s["sum"] + F.char_length(w) + 1).alias("sum"), (s["spare"] + (s["sum"] + F.char_length(w) + 1 < needed - 1e-6).cast("int")).alias("spare"))
        return F.slice(o, F.lit(1), F.size(o) - F.aggregate(F.reverse(o), start, step, lambda s: s["spare"]))

    return F.transform(F.array(ordered), cut)[0]


def candidates(texts: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs to compare, with both word sets and lengths; a pair may come up to three times.

    texts (*keys, words, size, ...), rules (*keys, rule_words, rule_size, least, ...).
    """
    f = F.col("least") / (200 - F.col("least"))  # of the longer part's length
    bound = rules.agg(F.max(F.col("rule_size") / f).alias("m"), F.min(f).alias("f")).first()  # two numbers
    most, f_least = (bound.m, bound.f) if bound.m is not None else (0.0, 0.5)  # no rules: nothing is met
    weight = F.aggregate(F.array_intersect("words", "rule_words"), F.lit(0.0), lambda s, w: s + F.char_length(w) + 1)
    # enough of the rule's letters in shared words: the rule is indexed by its longest words
    index = rules.withColumn("_w", F.explode(_longest(F.col("rule_words"), F.col("rule_size") * f + 1)))
    a = texts.withColumn("_w", F.explode("words")).join(index, [*keys, "_w"]).where(weight >= F.col("rule_size") * f + 1 - 1e-6)
    # enough of the text's: no text much longer than a rule is in one
    short = texts.where(F.col("size") <= most + 1e-6)
    some = short.withColumn("_w", F.explode(_longest(F.col("words"), F.col("size") * f_least + 1)))
    b = some.join(rules.withColumn("_w", F.explode("rule_words")), [*keys, "_w"]).where(weight >= F.col("size") * f + 1 - 1e-6)
    # about the same length: in one class of lengths or in neighbouring ones
    scale = -math.log(f_least) if f_least < 1 else 1.0
    part = lambda c: F.floor(F.ln(F.col(c)) / scale + 1e-9)
    near = rules.withColumn("_w", F.explode(F.array(*[part("rule_size") + k for k in (-1, 0, 1)])))
    c = short.where("size > 0").withColumn("_w", part("size")).join(near.where("rule_size > 0"), [*keys, "_w"])
    c = c.where(F.least("size", "rule_size") >= F.greatest("size", "rule_size") * f - 1e-6)
    return a.drop("_w").unionByName(b.drop("_w")).unionByName(c.drop("_w"))


def token_set_join(texts: DataFrame, rules: DataFrame, keys: list[str], id_: str, rule_id: list[str], text: str = "text", rule: str = "rule_text", least: float | str = 80.0) -> DataFrame:
    """(id, *rule_id, ratio): the pairs of equal keys with a token set ratio of at least `least`, a number
    or a column of the rules, over 0. Ids name their rows; keys are non-null. Null and empty texts match
    nothing. Each pair comes once; nothing is capped.
    """
    t = texts.select(F.col(id_).alias("_id"), *keys, token_set(F.col(text)).alias("words")).withColumn("size", joined_length(F.col("words")))
    limit = F.col(least) if isinstance(least, str) else F.lit(least)
    r = rules.select(F.struct(*rule_id).alias("_rule"), *keys, token_set(F.col(rule)).alias("rule_words"), limit.cast("double").alias("least")).withColumn("rule_size", joined_length(F.col("rule_words")))
    met = candidates(t, r, keys).select("_id", "_rule", "words", "rule_words", "least")
    out = StructType([met.schema["_id"], met.schema["_rule"], *StructType.fromDDL("ratio double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ratio = [set_ratio(p, q, x) for p, q, x in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            keep = pa.array([s >= x for s, x in zip(ratio, b.column(4).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ratio, pa.float64())], out.names).filter(keep)

    return met.mapInArrow(run, out).distinct().select(F.col("_id").alias(id_), "_rule.*", "ratio")
