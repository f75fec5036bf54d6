"""Periodic runs against a brute-force version and on edge cases."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from claimloom.llm import runs

DOCS = "doc_id long, text string, runs int, n int, w int, h int, collapsed int"


def brute(w, least=12):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, 2 * q) and not any(w[i + p : i + n] == w[i : i + n - p] for p in range(1, q)):
                out.add((i, n, q))
            i = max(j, i + 1)
    return sorted(out)


def periodic(rng, n):
    w = [f"w{rng.randrange(rng.choice((1, 2, 3, 5, 20, 400)))}" for _ in range(n)]
    if rng.random() < 0.6 and n > 5:
        a, p = rng.randrange(n), rng.randrange(1, 12)
        for i in range(a, n):
            w[i] = w[a + (i - a) % p]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(n)] = "once"
    return w


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        w = periodic(rng, rng.randrange(70))
        assert runs.runs_of(w) == brute(w)
    for least in (1, 2, 5, 30):
        w = periodic(rng, 60)
        assert runs.runs_of(w, least) == brute(w, least)


def test_long_texts_take_n_log_n_steps():
    assert runs.runs_of(["a"] * 100_000) == [(0, 100_000, 1)]
    assert runs.runs_of([f"w{x}" for i in range(50_000) for x in (i, i - 2)]) == []  # single words at the ends alone, again and again
    period = [f"p{i}" for i in range(9_000)]
    assert runs.runs_of(["x", *period, *period, *period[:5], "y"]) == [(1, 18_005, 9_000)]


def test_collapse():
    w = "a b a b a b a b a b a b a x c c".split()
    assert runs.collapse(w, runs.runs_of(w)) == "a b x c c".split()


EDGE = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "ab " * 40_000), (6, "x y " * 6), (7, "x y " * 6), (7, "x y " * 6), (None, "z " * 12), (8, "été à b c " * 6), (9, "u v " * 5)]


def test_rows(spark):
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in EDGE], DOCS)
    rows = runs.periodic_runs(docs).collect()
    assert len(rows) == len(EDGE)
    for (i, t), r in zip(EDGE, rows, strict=True):
        w = (t or "").encode().split()
        want = [(0, len(w), 1)] if i in (5, None) else brute(w)
        assert (r.doc_id, r.n_words, [tuple(x) for x in r.runs]) == (i, len(w), want)
        assert r.collapsed == b" ".join(runs.collapse(w, want)).decode()
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    """The query's rows recomputed from the contract."""
    rng = random.Random(9)
    texts = EDGE[:4] + EDGE[5:] + [(i, " ".join(periodic(rng, rng.randrange(90)))) for i in range(100, 180)]
    spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in texts], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in texts:
        w = (t or "").split(" ") if i != 3 else []
        w = [x for x in w if x]
        if i is not None and w and (h := zlib.crc32(str(i).encode())) % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        found = brute(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        kept = " ".join(runs.collapse(w, found))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(found), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(kept)))
    got = runs.op11_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert got.where(F.col("n_runs") > 0).count() > 20
