"""Similarity and containment joins against all pairs, and how few pairs they look at."""

import random

from claimloom.operators import similarity as S

WORDS = [f"w{i}" for i in range(60)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def word_sets(rng, n):
    # some words are in nearly every set, as in prose
    return [(i, rng.choice(["p", "q", None]), sorted({rng.choice(WORDS[:6]) for _ in range(rng.randrange(4))} | {rng.choice(WORDS) for _ in range(rng.randrange(9))}), rng.randrange(9)) for i in range(n)]


def test_jaccard_join_against_all_pairs(spark):
    rng = random.Random(2)
    a, b = word_sets(rng, 150), word_sets(rng, 60)
    b += [(1000 + i, k, w, n) for i, k, w, n in b[:5]] + [(2000, "p", [], 0), (2001, "p", None, 0)]
    a += a[:3] + [(500, "p", [], 0), (501, "p", None, 0)]
    x = frame(spark, a, "id long, product_id string, words array<string>, size int")
    y = frame(spark, b, "rule_idx long, product_id string, rule_words array<string>, _n int")
    for t in (0.2, 0.4, 0.5, 0.8, 1.0):
        want = sorted((i, j, round(len({*p} & {*q}) / len({*p} | {*q}), 9)) for i, k, p, _ in a for j, m, q, _ in b if p and q and k and k == m and len({*p} & {*q}) / len({*p} | {*q}) >= t)
        got = S.jaccard_join(x, y, ["product_id"], threshold=t)
        assert set(got.columns) == {*x.columns, *y.columns, "similarity"}
        assert sorted((r.id, r.rule_idx, round(r.similarity, 9)) for r in got.collect()) == want
    assert S.jaccard_join(x.limit(0), y, ["product_id"]).count() == S.jaccard_join(x, y.limit(0), ["product_id"]).count() == 0


def test_jaccard_candidates_are_few(spark):
    """All sentences share frequent words with all rules; those that meet are about those that match."""
    rng = random.Random(3)
    common = WORDS[:4]
    rules = [(j, "p", sorted({*common, *(f"r{j}_{k}" for k in range(6))})) for j in range(100)]
    texts = [(i, "p", sorted({*common, *(f"r{i % 100}_{k}" for k in range(6)), f"own{i}"}) if i < 300 else sorted({*common, *(f"x{rng.randrange(999)}" for _ in range(6))})) for i in range(1500)]
    x, y = frame(spark, texts, "id long, product_id string, words array<string>"), frame(spark, rules, "rule_idx long, product_id string, rule_words array<string>")
    assert S.jaccard_candidates(x, y, ["product_id"], "words", "rule_words", 0.5).count() == 300  # of 150,000
    assert S.jaccard_join(x, y, ["product_id"], threshold=0.5).count() == 300


def test_containment_join_against_all_pairs(spark):
    rng = random.Random(4)
    letters = "abé😀"
    word = lambda lo, hi: "".join(rng.choice(letters) for _ in range(rng.randrange(lo, hi)))
    a = [(i, rng.choice(["p", "q", None]), rng.choice([word(0, 4), word(3, 9), word(8, 30)])) for i in range(150)]
    b = [(j, rng.choice(["p", "q"]), rng.choice([word(0, 4), word(3, 9), word(8, 30), a[j][2] + word(0, 6)]), j) for j in range(60)] + [(99, "p", None, 1)]
    a += a[:4] + [(500, "p", None)]
    x, y = frame(spark, a, "claim_id long, product_id string, low string"), frame(spark, b, "rule_idx long, product_id string, rule string, _size int")
    want = sorted((i, j) for i, k, p in a for j, m, q, _ in b if p is not None and q is not None and k == m and (p in q or q in p))
    got = S.containment_join(x, y, ["product_id"], "low", "rule")
    assert got.columns == ["claim_id", "product_id", "low", "rule_idx", "rule", "_size"]
    assert sorted((r.claim_id, r.rule_idx) for r in got.collect()) == want and len(want) > 200
    assert S.containment_join(x.limit(0), y, ["product_id"], "low", "rule").count() == S.containment_join(x, y.limit(0), ["product_id"], "low", "rule").count() == 0


def test_containment_candidates_are_few(spark):
    """Rules and texts of one frame share most of their pieces; a rule is looked for by its rarest one."""
    texts = [(i, "p", f"the product is said to hold {i % 500:04d} units of it") for i in range(2000)]
    rules = [(j, "p", f"said to hold {j:04d} units") for j in range(200)] + [(900, "p", "in short, the product is said to hold 0007 units of it, which nobody doubts")]
    x, y = frame(spark, texts, "claim_id long, product_id string, low string"), frame(spark, rules, "rule_idx long, product_id string, rule string")
    holding, within = S.contained_candidates(x, y, ["product_id"], "low", "rule")
    assert S.containment_join(x, y, ["product_id"], "low", "rule").count() == 4 * 201
    assert holding.count() <= 2 * 4 * 201 and within.count() <= 4 * 2000  # of 402,000


def test_pieces_take_linear_steps(spark):
    got = frame(spark, [("ab" * 100_000,), ("aé😀b",), ("ab",), (None,)], "t string").select(S.grams(S.F.col("t"), 3).alias("g")).collect()
    assert [r.g for r in got] == [["aba", "bab"], ["aé😀", "é😀b"], None, None]


def test_texts_stay_where_they_are_read(spark):
    """The word index is small and known to be: sets, which stand in the join once a word, are not shuffled to it."""
    x = frame(spark, [(i, "p", ["a", "b", f"c{i}"]) for i in range(50)], "id long, product_id string, words array<string>")
    y = frame(spark, [(1, "p", ["a", "b", "c7"]), (2, "q", ["a"])], "rule_idx long, product_id string, rule_words array<string>")
    met = S.jaccard_candidates(x, y, ["product_id"], "words", "rule_words", 0.5)
    assert "hashpartitioning" not in met._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in met.where("id = 7").collect()] == [7]
