"""Nearest rules by the vector index against brute force: exact rows, recall, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.operators import audit as U
from claimloom.operators import vectors as V

C, R = "claim_id long, product_id string, vector array<float>, id int, cell int", "rule_idx long, product_id string, vector array<float>, key string, small int"


def clustered(rng, n, d=16, groups=12, noise=0.5):
    centre = np.random.default_rng(1).normal(size=(groups, d))
    return (centre[rng.integers(groups, size=n)] + noise * rng.normal(size=(n, d))).astype(np.float32)


def brute(claims, rules, k, least):
    out = []
    for i, p, x, *_ in claims:
        if i is None or p is None or x is None or None in x or not any(x):
            continue
        near = []
        for j, q, y, *_ in rules:
            if j is not None and p == q and y is not None and None not in y and any(y):
                a, b = np.array(x, np.float64), np.array(y, np.float64)
                near.append((-((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), j))
        out += [(i, j, round(-s, 6), n + 1) for n, (s, j) in enumerate(sorted(x for x in near if -x[0] >= least)[:k])]
    return sorted(out)


def rows(df):
    return sorted((r.claim_id, r.rule_idx, round(r.cosine, 6), r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    claims = [(i, "pq"[i % 7 == 0], v.tolist(), 1, 1) for i, v in enumerate(clustered(rng, 150))]
    rules = [(j, "pq"[j % 5 == 0], v.tolist(), "x", 1) for j, v in enumerate(clustered(rng, 600))]
    rules += [(1000 + j, p, v, "x", 1) for j, (_, p, v, *_) in enumerate(rules[:20])]  # equal vectors: the smaller rule_idx first
    rules += [(2000, "p", None, "x", 1), (2001, "p", [0.0] * 16, "x", 1), (2002, None, [1.0] * 16, "x", 1), (None, "p", [1.0] * 16, "x", 1), (2003, "only", [1.0] * 16, "x", 1), (2004, "p", [None] + [1.0] * 15, "x", 1)]
    claims += [(900, "p", None, 1, 1), (901, "p", [0.0] * 16, 1, 1), (902, None, [1.0] * 16, 1, 1), (None, "p", [1.0] * 16, 1, 1), (903, "no rules", [1.0] * 16, 1, 1), (904, "p", [-1.0] * 16, 1, 1)]
    return claims, rules, spark.createDataFrame(claims, C).repartition(3), spark.createDataFrame(rules, R).repartition(5)


@pytest.mark.parametrize("how", [{"small": 0}, {"small": 0, "probes": 1, "cells": 7}, {"small": 200}, {}])
def test_exact_rows(tables, how):
    """With an index for all products, for the larger one, for none: the rows of brute force."""
    claims, rules, c, r = tables
    assert rows(U.semantic_topk(c, r, 3, 0.3, **how)) == brute(claims, rules, 3, 0.3)


def test_recall_without_the_exact_pass(tables):
    claims, rules, c, r = tables
    want = {x[:2] for x in brute(claims, rules, 5, 0.3)}
    got = {x[:2] for x in rows(U.semantic_topk(c, r, 5, 0.3, small=0, probes=4, exact=False))}
    assert len(want) > 300 and len(got & want) >= 0.9 * len(want)
    all_rules = sum(1 for _ in rules)
    assert V.fit_cells(r.where("vector is not null and not exists(vector, v -> v is null)"), 1024).shape == (int(np.ceil(np.sqrt(all_rules - 2))), 16)


def test_cells_bound_the_comparisons(tables, spark):
    """An index of tight groups leaves few pairs of blocks to compare: the bound rules the other cells out."""
    rng = np.random.default_rng(8)
    c = spark.createDataFrame([(i, "p", v.tolist(), 1, 1) for i, v in enumerate(clustered(rng, 60, noise=0.02))], C)
    r = spark.createDataFrame([(i, "p", v.tolist(), "x", 1) for i, v in enumerate(clustered(rng, 900, noise=0.02))], R)
    exact, fast = (rows(U.semantic_topk(c, r, 5, 0.3, small=0, probes=5, exact=e)) for e in (True, False))
    assert exact == fast and len(exact) == 300


def test_empty_tables_and_doubles(tables, spark):
    _, _, c, r = tables
    assert U.semantic_topk(c.limit(0), r).count() == U.semantic_topk(c, r.limit(0)).count() == U.semantic_topk(c, r.limit(0), small=0).count() == 0
    wide = r.withColumn("vector", F.col("vector").cast("array<double>"))
    assert rows(U.semantic_topk(c, wide, 3, small=0)) == rows(U.semantic_topk(c, r, 3))


def test_filter_inside_the_audit(spark):
    """Candidates keep their texts, those that the filter drops are not scored, and the reduction is what was dropped."""
    claims = spark.createDataFrame([(1, "p", "material", "pure merino wool"), (2, "p", "general", "pure merino wool"), (3, "q", "material", "pure merino wool"), (4, "p", "safety", "zzz")], "claim_id long, product_id string, category string, claim string")
    rules = spark.createDataFrame([(1, "p", "material", "authorized", "pure merino wool"), (2, "p", "material", "prohibited", "merino wool, pure"), (3, "p", "material", "authorized", "xyz"), (4, "p", "safety", "authorized", "abc")], "rule_idx long, product_id string, category string, rule_type string, rule_text string")
    v = lambda df, x: df.withColumn("vector", U.letters(F.col(x)))
    kept = U.filtered_pairs(v(claims, "claim"), v(rules, "rule_text"), k=2, least=0.5)
    assert {(r.claim_id, r.rule_idx, r.claim, r.rule_text, r.rule_type) for r in kept.collect()} == {(1, 1, "pure merino wool", "pure merino wool", "authorized"), (1, 2, "pure merino wool", "merino wool, pure", "prohibited")}
    assert U.score_pairs(kept).count() == 2
    assert [tuple(r) for r in U.measured_reduction(claims, rules, kept).collect()] == [("p", 4, 2, 50.0)]


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    """Claims and rules that repeat meet as one, however many ids they have; every id has its own rows."""
    sizes, scored = [], V.scored
    count = lambda b: b.select(F.sum(F.size("ids"))).first()[0]
    monkeypatch.setattr(V, "scored", lambda c, r, *how: (sizes.append((count(c), count(r))), scored(c, r, *how))[1])
    vectors = [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]]
    claims = [(i, "p", vectors[i % 3], 1, 1) for i in range(90)]
    rules = [(j, "p", vectors[j % 2], "x", 1) for j in range(80)]
    c, r = spark.createDataFrame(claims, C), spark.createDataFrame(rules, R)
    assert rows(U.semantic_topk(c, r, 3, 0.3)) == brute(claims, rules, 3, 0.3)
    assert sizes == [(3, 6)]


def test_cells_follow_the_rules_of_a_key(tables, monkeypatch):
    """Vectors go to each cell they search, so there are only as many cells as hold CELL rules each; with several, the rows are those of brute force."""
    claims, rules, c, r = tables
    asked, fit = [], V.fit_cells
    monkeypatch.setattr(V, "fit_cells", lambda rows_, cells: (asked.append(cells), fit(rows_, cells))[1])
    monkeypatch.setattr(V, "CELL", 40)
    assert rows(U.semantic_topk(c, r, 3, 0.3, small=0, probes=2)) == brute(claims, rules, 3, 0.3)
    assert len(asked) == 1 and 8 <= asked[0] <= 15
