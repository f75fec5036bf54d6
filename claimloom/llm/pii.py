"""Personal data with DataFrame functions only: bootstrapped contextual extraction.

Regular expressions find the base entities, which seed the bootstrap together with words that look
like keys: the words before them are lexical patterns, identifier-like words and groups of numbers
elsewhere are instances, and pattern and instance scores are computed in turn over the graph of who
stands before whom, until they settle. Instances of high confidence are added with the kind of their
patterns: the four of the base, or secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Spool, ascii_lower, table
from .groups import sent_if_few

KINDS = ("email", "ip", "card", "phone")
#: Of added spans only.
MORE_KINDS = ("secret",)

# The expressions of the four kinds. Where they differ from the plain form, it is to find the same
# matches without trying a run of characters again from each of its places: runs are possessive,
# and a match starts a run or follows the match before (\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates: two or more groups of digits, with brackets or marks between; or one word of 6 to 256 characters with a digit.
_GROUP = r"\(?[0-9]{2,}\)?"
CANDIDATE = rf"(?<![A-Za-z0-9]){_GROUP}(?:[\x20./-]{_GROUP})++(?![A-Za-z0-9])|(?<![A-Za-z0-9._%@+/-])(?=[A-Za-z._%@+/-]{{0,255}}[0-9])[A-Za-z0-9._%@+/-]{{6,256}}(?![A-Za-z0-9._%@+/-])"
#: A candidate that looks like a key, and so seeds patterns of secrets: 20 characters or more, of them 5 digits and 5 letters.
KEY = r"^(?=(?:[^0-9]*[0-9]){5})(?=(?:[^A-Za-z]*[A-Za-z]){5})[A-Za-z0-9_+/-]{20,}$"
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Characters before an entity in which its two words of context are looked for.
REACH = 120


def matches(text: Column, pattern: str) -> Column:
    """The matches as structs of start, end (code points, end exclusive), value and the text before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(z: Column) -> Column:
        m, g = z["m"], z["g"]
        none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")

        def step(s: Column, i: Column) -> Column:
            start = s["at"] + F.length(g[i])
            end = start + F.length(m[i])
            before = F.right(F.concat(s["before"], g[i]), F.lit(REACH))
            one = F.struct(start.alias("start"), end.alias("end"), m[i].alias("value"), before.alias("before"))
            return F.struct(end.alias("at"), F.right(F.concat(before, m[i]), F.lit(REACH)).alias("before"), F.concat(s["out"], F.array(one)).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), F.struct(F.lit(0).alias("at"), F.lit("").alias("before"), none.alias("out")), step, lambda s: s["out"])

    both = F.transform(F.array(F.struct(found.alias("m"), gaps.alias("g"))), lambda z: F.when(F.size(z["m"]) > 0, placed(z)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")))
    return both[0]


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(s: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        return s + F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def base_spans(text: Column, kind: str) -> Column:
    only = lambda v: F.regexp_replace(v, "[^0-9]", "")
    found = matches(text, PATTERNS[kind])
    if kind == "ip":
        return F.filter(found, lambda x: x["value"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    if kind == "card":
        return F.filter(found, lambda x: F.length(only(x["value"])).between(12, 19) & luhn(only(x["value"])))
    if kind == "phone":
        return F.filter(found, lambda x: F.length(only(x["value"])).between(9, 15))
    return found


def contexts(before: Column) -> Column:
    """The patterns of what stands before an entity: its last word and its last two words, without quotes and brackets that open there."""
    w = F.filter(F.split(ascii_lower(F.regexp_replace(before, "[\"'`(\\[<{]+$", "")), SPACE), lambda x: x != "")
    n = F.size(w)
    return F.array_compact(F.array(F.when(n > 0, F.concat(F.lit("1 "), F.element_at(w, -1))), F.when(n > 1, F.concat_ws(" ", F.lit("2"), F.element_at(w, -2), F.element_at(w, -1)))))


def _occurrences(found: DataFrame) -> DataFrame:
    """(d, t, kind or null, start, end, value, context): a row for each entity or candidate and pattern."""
    def of(column: str, kind: str | None) -> Column:
        return F.transform(column, lambda x: x.withField("kind", F.lit(kind).cast("string")))

    seeds = found.select("d", "t", F.explode(F.concat(*[of(k, k) for k in KINDS])).alias("x"))
    others = found.select("d", "t", F.explode(of("candidates", None)).alias("x"))
    keys = others.where(F.col("x.value").rlike(KEY)).withColumn("x", F.col("x").withField("kind", F.lit(MORE_KINDS[0])))
    rows = seeds.union(others).union(keys).select("d", "t", "x.kind", "x.start", "x.end", ascii_lower(F.col("x.value")).alias("value"), F.col("x.before"))
    return rows.withColumn("context", F.explode(contexts(F.col("before")))).drop("before")


def discover(docs: DataFrame, found: DataFrame, support: float = 3.0, confidence: float = 0.5, most_rounds: int = 20) -> DataFrame:
    """(d, t, text), and the entities by document -> (d, t, start, end, kind) of the identifiers
    that the bootstrap adds.

    A pattern's score for a kind is the share of its occurrences, anywhere in the corpus, that
    stand before an instance of that kind, instances counting with their score; it needs the
    support of so many different instances. An instance's score is that of at least one of its
    patterns being right; seeds have 1 as they vouch for patterns, but are added by their patterns
    alone. Rounds end when the confident instances stay the same. All steps are grouped sums and
    joins on strings; occurrences are summed up before they are shuffled.
    """
    spool = Spool(docs.sparkSession, "pii")
    at = spool.cut(_occurrences(found))
    edges = spool.cut(at.groupBy("context", "kind", "value").agg(F.count("*").alias("n")))
    wide = spool.cut(edges.groupBy("context").agg(F.count_distinct("value").alias("k"), F.count("kind").alias("seeds")).where((F.col("k") >= support) & (F.col("seeds") > 0)).select("context"))
    if wide.isEmpty():
        return at.select("d", "t", "start", "end", "kind").limit(0)
    # how often the patterns occur at all: one pass over all words, kept only where a pattern asks
    w = F.filter(F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), SPACE), lambda x: x != "")
    words = docs.select(w.alias("w"))
    ones = words.select(F.explode("w").alias("c")).select(F.concat(F.lit("1 "), "c").alias("context"))
    pairs = words.where(F.size("w") > 1).select(F.explode(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", F.lit("2"), a, b))).alias("context"))
    asking = sent_if_few(wide)
    total = spool.cut(ones.union(pairs).join(asking, "context", "left_semi").groupBy("context").agg(F.count("*").alias("total")))
    met = edges.join(asking, "context", "left_semi")
    least = met.groupBy("context").agg(F.sum(F.when(F.col("kind").isNull() | F.col("kind").isin(*KINDS), F.col("n"))).alias("least"))  # keys count as candidates
    e = spool.cut(met.join(least, "context").join(total, "context", "left").select("context", "kind", "value", "n", F.greatest("least", F.coalesce("total", F.lit(0))).alias("total")))
    seeds = e.where("kind is not null").select("context", "kind", "value", "n", "total", F.lit(1.0).alias("s"))
    asked = e.where("kind is null").drop("kind")
    scored, instances, before = seeds, None, -1
    for _ in range(most_rounds):
        p = scored.groupBy("context", "kind").agg(F.sum("s").alias("support"), (F.sum(F.col("n") * F.col("s")) / F.max("total")).alias("p")).where(F.col("support") >= support)
        p = p.select("context", "kind", F.least("p", F.lit(0.99)).alias("p"))
        instances = spool.cut(asked.join(p, "context").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("p"))))).alias("s")))
        sure = instances.where(F.col("s") >= confidence).count()
        if sure == before:
            break
        before = sure
        more = asked.join(instances, "value").select("context", "kind", "value", "n", "total", "s")
        scored = seeds.union(more.join(seeds.select("context", "kind", "value"), ["context", "kind", "value"], "left_anti").select(seeds.columns))
    best = instances.where(F.col("s") >= confidence).groupBy("value").agg(F.max(F.struct("s", "kind")).alias("b")).select("value", F.col("b.kind").alias("kind"))
    # a value is added where one of the patterns that stand for it does, and elsewhere too: it is the same identifier
    return at.where("kind is null").drop("kind", "context").distinct().join(best, "value").select("d", "t", "start", "end", "kind")


def _digest(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, secrets last."""
    kinds = (*KINDS, *MORE_KINDS)
    rank = F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*[F.lit(i) for i in range(len(kinds))]))
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, text, ...) -> one row a document: doc_id, base and added, arrays of (kind, start, end).

    Null texts count as empty and have no spans; rows that repeat doc_id and text have the same
    spans each; null doc_ids are kept; an empty table gives an empty one. Added spans never overlap
    base ones. Texts of any length are read whole; the two words of context are looked for in the
    REACH characters before an entity, which may hold other entities. Other columns are not looked at.
    """
    spool = Spool(docs.sparkSession, "entities")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    # no kind and no candidate goes without a digit or @
    may = d.where(F.col("text").rlike("[0-9@]")).select("d", "t", *[base_spans(F.col("text"), k).alias(k) for k in KINDS], matches(F.col("text"), CANDIDATE).alias("candidates"))
    taken = F.concat(*[F.col(k) for k in KINDS])
    clear = lambda c: ~F.exists(taken, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    found = spool.cut(may.withColumn("candidates", F.filter("candidates", clear)).dropDuplicates(["d", "t"]))
    extra = discover(d, found, **how).groupBy("d", "t").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    short = lambda k: F.transform(k, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    same = F.col("d").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2"))
    spans = found.select("d", "t", F.concat(*[short(k) for k in KINDS]).alias("base"))
    key = lambda x: x.withColumnsRenamed({"d": "d2", "t": "t2"})
    spans = spans.join(key(extra), same, "left").select("d", "t", "base", "added")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return d.select("d", "t").join(key(spans), same, "left").select(F.col("d").alias("doc_id"), F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    p = personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return p.select("doc_id", *[count(k) for k in KINDS], F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
