"""Joins of texts with a table of rules by likeness or containment, without pairing all with all.

Rules are indexed by their rarest words or pieces, and a text meets a rule only under a key of the
rule that it holds itself. What meets is verified in the same stage; each pair meets once, so that
nothing is shuffled to remove repeats. The indexes are plain equi-joins: the planner broadcasts them
while they fit its threshold and shuffles otherwise, splitting hot keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import written

#: Characters of a piece of text in the containment index.
GRAM = 5


def _bucket(size: Column, threshold: float) -> Column:
    """Sizes of similar sets are in the same class or in neighbouring ones."""
    return F.floor(F.ln(size.cast("double")) / -math.log(threshold) + 1e-9) if threshold < 1 else size.cast("long")


def word_counts(sets: DataFrame, rules: DataFrame, words: str, rule_words: str) -> DataFrame:
    """(word, n): in how many texts each word of the rules occurs, over all texts; 0 where in none."""
    known = rules.select(F.explode(rule_words).alias("word")).distinct()
    seen = sets.select(F.explode(words).alias("word")).join(known, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    return known.join(seen, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def prefix_index(rules: DataFrame, keys: list[str], rule_words: str, counts: DataFrame, threshold: float) -> DataFrame:
    """rules (*keys, _rule, rule_words) -> a narrow row for each word of a rule's prefix: (*keys, _rule, _word, _place, _prefix, _size, _bucket).

    The prefix is the shortest list of a rule's rarest words of which one at least is in every set of
    enough likeness; _place is the word's place in it. A row goes to each size class that can be similar.
    """
    ranked = rules.select("_rule", rule_words).dropDuplicates(["_rule"]).select("_rule", F.explode(rule_words).alias("word")).join(counts, "word").groupBy("_rule").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("o"))
    size = F.size("o")
    some = (size - F.ceil(size * threshold - 1e-9) + 1).cast("int")
    prefixes = ranked.select("_rule", F.slice(F.transform("o", lambda x: x["word"]), F.lit(1), some).alias("_prefix"), size.alias("_size"), _bucket(size, threshold).alias("b"))
    placed = prefixes.select("_rule", "_prefix", "_size", F.posexplode("_prefix").alias("_place", "_word"), "b")
    near = placed.withColumn("_bucket", F.explode(F.array("b") if threshold >= 1 else F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1))).drop("b")
    return rules.select("_rule", *keys).distinct().join(near, "_rule")


def jaccard_candidates(sets: DataFrame, rules: DataFrame, keys: list[str], words: str, rule_words: str, threshold: float) -> DataFrame:
    """The pairs to verify: the columns of both, each pair once.

    A text meets a rule of its keys and of a similar size class under a word of the rule's prefix. Of
    several such words the first counts. From its place follows how many words can be shared at most;
    pairs for which that is too few go at once. Rules and their index are written first, so that the
    planner knows how small they are and texts, which stand here once a word, stay where they are read.
    """
    r = written(rules.where(F.size(rule_words) > 0).withColumn("_rule", F.sha2(F.to_json(F.array_sort(rule_words)), 256)), "rules")
    index = written(prefix_index(r, keys, rule_words, word_counts(sets, r, words, rule_words), threshold), "index")
    least, most = index.agg(F.min("_bucket"), F.max("_bucket")).first()  # no other size class meets a rule
    s = sets.where(F.size(words) > 0).withColumn("_bucket", _bucket(F.size(words), threshold)).where(F.col("_bucket").between(F.lit(least), F.lit(most)))
    met = s.withColumn("_word", F.explode(words)).join(index, [*keys, "_word", "_bucket"])
    first = ~F.arrays_overlap(F.slice("_prefix", F.lit(1), F.col("_place")), words)
    enough = F.col("_size") - F.col("_place") >= F.ceil((F.size(words) + F.col("_size")) * (threshold / (1 + threshold)) - 1e-9)
    return met.where(first & enough).drop("_word", "_bucket", "_place", "_prefix", "_size").join(r, [*keys, "_rule"]).drop("_rule")


def jaccard_join(sets: DataFrame, rules: DataFrame, keys: list[str], words: str = "words", rule_words: str = "rule_words", threshold: float = 0.4) -> DataFrame:
    """Pairs of a text's and a rule's word sets with a Jaccard similarity of the threshold or more.

    sets (*keys, words array of distinct words, ...) and rules (*keys, rule_words, ...) come back with
    all their columns and `similarity`. Null keys and null or empty sets match nothing; repeated rows
    match as often as they stand; the threshold is over 0. Nothing is capped.
    """
    return jaccard_candidates(sets, rules, keys, words, rule_words, threshold).withColumn("similarity", T.jaccard(F.col(words), F.col(rule_words))).where(F.col("similarity") >= threshold)


def grams(text: Column, n: int) -> Column:
    """The different pieces of n characters of a text, in linear time; none of a text that is shorter, the empty one for n = 0."""
    if n == 0:
        return F.when(text.isNotNull(), F.array(F.lit("")))
    each = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, F.lit(n)), ""))
    return F.when(F.char_length(text) >= n, F.array_distinct(F.transform(F.array(F.split(text, "")), each)[0]))


def key_size(text: Column) -> Column:
    return F.least(F.char_length(text), F.lit(GRAM))


def contained_candidates(texts: DataFrame, rules: DataFrame, keys: list[str], text: str, rule: str) -> tuple[DataFrame, DataFrame]:
    """The pairs to verify: rules that may be in texts, and texts that may be in rules.

    A rule's key is that of its pieces which fewest rules have; it can only be in texts that hold this
    piece. A text can only be in a rule if every piece of it is in some rule; its key is the piece that
    fewest rules have. The index holds all pieces of the rules, of up to GRAM characters, for texts that
    are shorter than a key.
    """
    of = lambda rows, c, name: rows.where(F.col(c).isNotNull()).withColumn(name, F.sha2(c, 256))
    texts, rules, none = of(texts, text, "_text"), of(rules, rule, "_rule"), F.array().cast("array<string>")
    once = rules.select("_rule", *keys, rule).dropDuplicates(["_rule", *keys])
    lists = F.array(*[F.struct(F.lit(n).alias("n"), F.coalesce(grams(F.col(rule), n), none).alias("g")) for n in range(GRAM + 1)])
    posts = once.select("_rule", *keys, key_size(F.col(rule)).alias("_size"), F.explode(lists).alias("x")).select("_rule", *keys, "_size", F.col("x.n").alias("_n"), F.explode("x.g").alias("_gram"))
    counts = posts.groupBy(*keys, "_gram").agg(F.count("*").alias("_rules"))
    rarest = F.min(F.struct("_rules", "_gram"))["_gram"].alias("_gram")
    own = posts.where("_n = _size").join(counts, [*keys, "_gram"]).groupBy("_rule", *keys).agg(rarest)
    anchored = rules.join(own, ["_rule", *keys]).drop("_rule")
    sizes = [r[0] for r in rules.select(key_size(F.col(rule))).distinct().collect()]  # at most GRAM + 1 numbers
    pieces = F.concat(none, *[F.coalesce(grams(F.col(text), n), none) for n in sizes])
    holding = texts.withColumn("_gram", F.explode(pieces)).join(anchored, [*keys, "_gram"]).drop("_gram")
    mine = F.concat(*[F.when(key_size(F.col(text)) == n, grams(F.col(text), n)).otherwise(none) for n in range(GRAM + 1)])
    known = texts.select("_text", *keys, F.explode(mine).alias("_gram")).join(counts, [*keys, "_gram"], "left")
    able = known.groupBy("_text", *keys).agg(F.count("*").alias("a"), F.count("_rules").alias("b"), rarest).where("a = b").drop("a", "b")
    met = able.join(posts.select(*keys, "_gram", "_rule"), [*keys, "_gram"]).drop("_gram")
    return holding, met.join(rules, ["_rule", *keys]).join(texts, ["_text", *keys])


def containment_join(texts: DataFrame, rules: DataFrame, keys: list[str], text: str, rule: str) -> DataFrame:
    """Pairs of equal keys of which the text holds the rule or the rule the text, each pair once, with
    all columns of both. Case counts. Null texts and keys match nothing; an empty text is in every
    other; repeated rows match as often as they stand; texts are read whole. Nothing is capped.
    """
    holding, within = contained_candidates(texts, rules, keys, text, rule)
    t, r = F.col(text), F.col(rule)
    columns = [*texts.columns, *[c for c in rules.columns if c not in keys]]
    return holding.where(F.contains(t, r)).select(columns).unionByName(within.where(F.contains(r, t) & ~F.contains(t, r)).select(columns))
