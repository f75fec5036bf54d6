"""Token set ratios and hits against all pairs, and how few pairs are compared."""

import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import rules as R
from claimloom.operators import token_sets as TS
from claimloom.plans import QUERIES


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def plain_ratio(x, y):
    """By its definition: the best of three comparisons of sorted words."""
    p, q = set((x or "").lower().split()), set((y or "").lower().split())
    if not p or not q:
        return 0.0
    both, l, r = (" ".join(sorted(s)) for s in (p & q, p - q, q - p))
    if both and (not l or not r):
        return 100.0
    a, b = f"{both} {l}".strip(), f"{both} {r}".strip()
    same = lambda u, v: 200.0 * plain_lcs(u, v) / (len(u) + len(v)) if u and v else 0.0
    return max(same(a, b), same(both, a), same(both, b))


def text(rng, most):
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.choice((1, 2, 3, 7)))) if rng.random() < 0.5 else rng.choice(["the", "colour", "color", "colours", "of", "nothing", "Best"])
    return rng.choice([" ", "  ", " "]).join(word() for _ in range(rng.randrange(most)))


def test_ratio_against_its_definition():
    rng = random.Random(2)
    for _ in range(1500):
        x, y = text(rng, 9), text(rng, 9)
        p, q = (sorted(set(t.lower().split())) for t in (x, y))
        want = plain_ratio(x, y)
        assert TS.set_ratio(p, q) == pytest.approx(want)
        for least in (60.0, 85.0):  # what is cut off stays below the threshold
            got = TS.set_ratio(p, q, least)
            assert (got >= least) == (want >= least) and (want < least or got == pytest.approx(want))


@pytest.mark.parametrize("least", [40.0, 80.0, 100.0])
def test_join_against_all_pairs(spark, least):
    rng = random.Random(int(least))
    a = [(i, rng.choice("pq"), text(rng, 12)) for i in range(90)] + [(200, "p", None), (201, "p", ""), (202, "p", " ".join(text(rng, 9) for _ in range(200)))]
    b = [(j, rng.choice("pq"), rng.choice([text(rng, 6), text(rng, 14), a[j][2] + " more"]), 1) for j in range(50)] + [(99, "p", None, 1), (98, "p", "", 1)]
    x, y = spark.createDataFrame(a, "run_id long, product_id string, text string"), spark.createDataFrame(b, "rule_idx long, product_id string, rule_text string, size int")
    want = sorted((i, j, round(plain_ratio(s, r), 6)) for i, p, s in a for j, q, r, _ in b if p == q and plain_ratio(s, r) >= least)
    got = sorted((r.run_id, r.rule_idx, round(r.ratio, 6)) for r in TS.token_set_join(x, y, ["product_id"], "run_id", ["rule_idx"], least=least).collect())
    assert got == want and want
    assert TS.token_set_join(x.limit(0), y, ["product_id"], "run_id", ["rule_idx"]).count() == TS.token_set_join(x, y.limit(0), ["product_id"], "run_id", ["rule_idx"]).count() == 0


def test_few_pairs_are_compared(spark):
    """Long texts of frequent words against rules that share these, and one word that names the rule."""
    a = [(i, "p", " ".join(["the", "of", "and", "is", f"subject{i % 50:03d}x", *(f"w{i}_{k}" for k in range(60))])) for i in range(400)]
    b = [(j, "p", f"subject{j:03d}x is the and of") for j in range(100)]
    x, y = spark.createDataFrame(a, "run_id long, product_id string, text string"), spark.createDataFrame(b, "rule_idx long, product_id string, rule_text string")
    t = x.select("product_id", TS.token_set(F.col("text")).alias("words")).withColumn("size", TS.joined_length(F.col("words")))
    r = y.select("product_id", TS.token_set(F.col("rule_text")).alias("rule_words"), F.lit(80.0).alias("least")).withColumn("rule_size", TS.joined_length(F.col("rule_words")))
    assert TS.candidates(t, r, ["product_id"]).count() <= 2 * 400  # of 40,000
    assert TS.token_set_join(x, y, ["product_id"], "run_id", ["rule_idx"]).count() == 400


def brute_hit(doc, rule, least):
    return rule is not None and doc is not None and (rule.lower() in doc.lower() or plain_ratio(doc, rule) >= least)


def test_hits_and_rates(spark):
    rng = random.Random(9)
    limits = {"authorized": 85.0, "prohibited": 80.0}
    docs = [(i, rng.choice("pq"), ". ".join(text(rng, 8) for _ in range(rng.randrange(5)))) for i in range(70)] + [(100, "p", None), (101, "none", "x")]
    rules = [(rng.choice("pq"), rng.choice(["authorized", "prohibited", "spec"]), j, rng.choice([text(rng, 3), text(rng, 7), docs[j][2][3:20], ""])) for j in range(40)] + [("p", "prohibited", 90, None)]
    d, r = spark.createDataFrame(docs, "run_id long, product_id string, text string"), spark.createDataFrame(rules, "product_id string, rule_type string, rule_idx long, rule_text string")
    want = {(i, k, j) for i, p, t in docs for q, k, j, x in rules if p == q and k in limits and brute_hit(t, x, limits[k])}
    hits = R.rule_hits(d, r)
    assert {tuple(x) for x in hits.collect()} == want and len(want) > 30
    for x in R.hit_rates(d, r, hits).collect():
        product = next(p for i, p, _ in docs if i == x.run_id)
        for kind, rate in (("authorized", x.hit_rate), ("prohibited", x.contradiction_rate)):
            assert rate == pytest.approx(sum(h[0] == x.run_id and h[1] == kind for h in want) / sum(p == product and k == kind for p, k, *_ in rules))
    assert R.hit_rates(d, r, hits).count() == 71


def test_query_of_alike_rules(spark, tmp_path):
    rng = random.Random(4)
    items = [(i, text(rng, 9)) for i in range(40)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(i, j, round(plain_ratio(a, b), 4)) for i, a in items for j, b in items if i < j and plain_ratio(a, b) >= 60}
    assert {tuple(r) for r in QUERIES["fuzzy_token_set"](spark, str(tmp_path)).collect()} == want and want
