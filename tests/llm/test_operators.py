"""The operators against brute-force versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from claimloom.llm import bloom, common, decontaminate, groups, line_dedup, lm, minhash, mixing, pii, quality, simhash, toxicity, url_filter
from claimloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def documents(spark, texts, sources=None, extra=True):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, "en", (sources or {}).get(i, "s"), len(t or "")) for i, t in texts]
    d = spark.createDataFrame(rows, DOCS)
    return d.withColumns({c: F.lit(7) for c in ("fp", "d", "t", "y", "x", "score", "rank", "size", "row", "key", "position_", "h")}) if extra else d


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "la", "mu"]) + str(rng.randrange(40)) for _ in range(n))


EDGE = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three"), (6, LONG), (7, "same text here"), (8, "same text here"), (8, "same text here"), (None, "no id at all here"), (9, "Größe ÄÖ été x é")]


# --- shared -----------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(3)
    for n, m in ((1, 0), (40, 30), (60, 25), (300, 299)):
        edges = [(i, i + 1) for i in range(n)] if m == 299 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        rng.shuffle(edges)
        up = list(range(n + 1))

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    f = bloom.build(keys, "h")
    import numpy as np

    have = np.array([r.h for r in keys.collect()])
    other = np.array([r.h for r in spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h")).collect()])
    assert bloom.probe(f, have).all() and bloom.probe(f, other).mean() < 0.05
    assert not bloom.probe(bloom.build(keys.limit(0), "h"), have).any()


# --- 3: SimHash -------------------------------------------------------------------------------


def brute_fp(text, width=3):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    grams = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash_against_all_pairs(spark):
    rng = random.Random(1)
    base = [words(rng, 60) for _ in range(12)]
    texts = [(i, b) for i, b in enumerate(base)] + EDGE[:9]
    for i in range(60):
        w = base[i % 12].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append((100 + i, " ".join(w)))
    texts = [(k, t) for k, t in texts]
    got = simhash.near_duplicates(documents(spark, texts)).collect()
    assert len(got) == len(texts)
    fps = [(k, brute_fp(t)) for k, t in texts]
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == Counter(fps)
    root = {f: f for _, f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    vals = sorted(root)
    for i, a in enumerate(vals):
        for b in vals[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for k, f in fps:
        least[find(f)] = min(least[find(f)], k)
    assert {(r.doc_id, r.component_id) for r in got} == {(k, least[find(f)]) for k, f in fps}


def test_simhash_edges(spark):
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, EDGE)).collect()}
    assert got[1].component_id == got[2].component_id == got[3].component_id == 1 and got[1].fp == 0
    assert got[7].component_id == got[8].component_id == 7 and got[None].component_id is None
    kept = simhash.keep_one(documents(spark, EDGE))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 4, 5, 6, 7, 9] and "fp" in kept.columns
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_labelled_and_fingerprint_queries(spark, tmp_path):
    """The query columns of op3, op4, op8 and op10 on a small table with edge cases."""
    docs, labels = labelled(spark)
    docs.unionByName(documents(spark, [(10_000 + (i or 0), t) for i, t in EDGE])).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    n = docs.count() + len(EDGE)
    for q, modulus, rest, cut in ((toxicity.op4_toxicity, 3, 1, 0.7), (quality.op10_quality, 5, 0, 0.3)):
        got = q(spark, str(tmp_path)).collect()
        assert len(got) == n and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) and r.predicted == (r.score >= cut) and 0 <= r.score <= 1 for r in got)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    for r in simhash.op3_simhash(spark, str(tmp_path)).collect():
        assert r.fingerprint == f"{brute_fp(texts[r.doc_id]):016x}" and r.component_id <= r.doc_id
    got = minhash.op8_minhash(spark, str(tmp_path))
    assert got.count() == n and {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"} <= set(got.columns)


def test_simhash_spans_blocks():
    assert simhash._fingerprint(LONG.encode(), 3, 42, block=64) == simhash._fingerprint(LONG.encode(), 3, 42)


# --- 10: quality ------------------------------------------------------------------------------


def labelled(spark, n=400):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        texts.append((i, words(rng, 50) if good else " ".join(w + "***" for w in words(rng, 50).split())))
        labels.append((i, int(good), int(i % 3 == 0)))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_learns_and_filters(spark):
    docs, labels = labelled(spark)
    forest = quality.fit_quality(docs, labels, 300)
    s = {r.doc_id: r.score for r in quality.score_quality(docs, forest).collect()}
    held = [i for i in s if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40 and all((s[i] >= 0.3) == (i % 4 != 0) for i in held)
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in s if i % 4}
    blind = quality.fit_quality(docs.withColumn("source", F.lit("z")).withColumn("lang", F.lit("q")), labels, 300)
    assert (blind.cut == forest.cut).all()


def test_quality_edges(spark):
    docs, labels = documents(spark, EDGE), labelled(spark)[1]
    for lab in (labels.limit(0), labels):
        got = quality.score_quality(docs, quality.fit_quality(docs, lab)).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert quality.keep_quality(documents(spark, []), labels).count() == 0


def test_forest_scores_like_a_walk():
    import numpy as np

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(500, 22)), rng.random(500) < 0.5
    y = (x[:, 3] + 0.3 * rng.normal(size=500) > 0).astype(float)
    f = quality.fit_forest(x, y, trees=10, depth=3)
    total = np.full(500, f.base)
    for i in range(500):
        for k in range(10):
            at = 0
            while at < 7:
                at = 2 * at + 1 + (x[i, f.feature[k, at]] > f.cut[k, at])
            total[i] += f.leaf[k, at - 7]
    assert np.allclose(f.score(x), 1 / (1 + np.exp(-total))) and ((f.score(x) > 0.5) == y).mean() > 0.9


# --- 4: toxicity ------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(600):
        w = words(rng, 80).split()
        if i % 5 == 0:
            for _ in range(3):
                w[rng.randrange(80)] = rng.choice(["nastyword", "vileword", "awfulword"])
        texts.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    docs, lab = documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    net = toxicity.fit_toxicity(docs, lab, 300)
    s = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, net).collect()}
    held = [i for i in s if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((s[i] >= 0.7) == (i % 5 == 0) for i in held) / len(held) > 0.97
    edge = toxicity.score_toxicity(documents(spark, EDGE), net).collect()
    assert len(edge) == len(EDGE) and all(0 <= r.score <= 1 for r in edge)
    none = toxicity.fit_toxicity(docs, lab.limit(0), 10)
    assert {round(r.score, 6) for r in toxicity.score_toxicity(docs, none).collect()} and toxicity.score_toxicity(documents(spark, []), net).count() == 0


def test_toxicity_blocks_do_not_change_scores():
    import numpy as np

    net = toxicity.fit_net([b"good fine text"] * 10 + [b"vile text"] * 10, np.array([0.0] * 10 + [1.0] * 10), epochs=2)
    r = toxicity.Reader()
    t = [r.read(LONG.encode()), r.read(b""), r.read(b"vile text"), r.read(b"x")]
    ids = np.array(r.ids)
    assert np.allclose(net.logits(t, ids, block=50), net.logits(t, ids), atol=1e-5)
    assert np.allclose(net.logits(t[2:3], ids), net.logits(t, ids)[2], atol=1e-5)


# --- 5: URLs ----------------------------------------------------------------------------------


def brute_url(url, rules, default="allow"):
    rest = (url or "").partition("://")[2]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest)[0])
    path = re.split("[?#]", rest[len(host) :])[0]
    best = None
    for rule, action in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, action)
    return host, path, best and best[0], best[1] if best else default


def test_urls(spark):
    urls = ["http://A.Example.ORG/en/12?x#y", "https://example.org/es/1", "http://x.com", "http://x.com/de/", "http://com/fr/a", "ftp://notorg/x", None, "", "no scheme", "http://a.org?x=http://b.com/de/", "://org/", "http://sub.com/de/x#://y", "http://org:80/", "http://.org/", "http://x.org/"]
    rng = random.Random(2)
    urls += [f"http://{rng.choice(['a.', '', 'b.c.'])}{rng.choice(['example.org', 'com', 'x.net', 'org'])}/{rng.choice(['en/1', 'es/', 'fr/2', 'de/', ''])}" for _ in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("h", F.lit(1))
    got = url_filter.judge(pages, spark.createDataFrame(url_filter.RULES, "rule string, action string")).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((i, *brute_url(u, url_filter.RULES)) for i, u in [*enumerate(urls), (0, urls[0])])
    assert url_filter.judge(pages.limit(0), spark.createDataFrame([], "rule string, action string")).count() == 0


def test_long_hosts_and_listed_urls(spark):
    urls = ["http://" + "a." * 50_000 + "example.org/en/1", "HTTPS://Bad.net:443/x?y#z", "http://bad.net/x?y", "http://bad.net/x", "http://bad.net./", "http://a.org/listed", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("http://bad.net/x?y", "block"), ("http://bad.net", "block"), ("http://a.org/listed", "block"), (None, "block"), ("junk", "block")], "url string, action string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, spark.createDataFrame(url_filter.RULES, "rule string, action string"), listed=listed).collect()}
    assert got == {0: ("example.org/en/1", "block"), 1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "block"), 5: ("org/", "allow"), 6: (None, "allow")}


# --- 2: mixing --------------------------------------------------------------------------------


def brute_targets(sizes, weights, share, cap):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, live, out = share * sum(sizes.values()), set(sizes), {}
    while live:
        level = left / sum(w[s] for s in live)
        full = {s for s in live if w[s] * level > cap * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in live}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        live -= full
    return out


def test_mixing(spark):
    rng = random.Random(4)
    texts = [(i, words(rng, rng.randrange(0, 60))) for i in range(300)] + [(500, None), (501, ""), (7, words(rng, 30)), (None, words(rng, 9)), (502, LONG)]
    src = {i: rng.choice(["a", "a", "a", "b", "c", "é", None]) for i, _ in texts}
    docs = documents(spark, texts, src)
    got = mixing.plan(docs).collect()
    assert len(got) == len(texts)
    size = Counter()
    for i, t in texts:
        size[src[i]] += len((t or "").split())
    want = brute_targets(size, (3, 1, 2), 1.5, 2.0)
    taken = Counter()
    for r in got:
        s = src[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(taken[s] == round(want[s]) or abs(taken[s] - want[s]) <= 1 for s in size)
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(docs.repartition(7)).collect()))
    m = mixing.mix(docs)
    out = m.collect()
    assert [r.position for r in out] == sorted(r.position for r in out) and sum(r.taken for r in out) == sum(taken.values())
    assert all(len(r.text.split()) == r.taken for r in out) and set(docs.columns) <= set(m.columns)
    assert mixing.plan(documents(spark, [])).count() == 0 and mixing.mix(documents(spark, [(1, None)])).count() == 0


def test_mixing_with_any_cap_and_clashing_columns(spark):
    docs = documents(spark, [(i, words(random.Random(i), 20)) for i in range(10)], {i: "ab"[i % 2] for i in range(10)}).withColumn("position", F.lit("theirs")).withColumn("taken", F.lit(None).cast("string"))
    p = mixing.plan(docs, weights=(1, 0), share=2.0, cap=4.5).collect()
    assert sum(r.taken for r in p) == 400 and all(r.target == 400.0 for r in p if r.taken) and {r.taken for r in p} == {80, 0}
    m = mixing.mix(docs, weights=(1, 0), share=2.0, cap=4.5)
    assert m.columns.count("position") == m.columns.count("taken") == 1 and m.count() == 20 and dict(m.dtypes)["position"] == "double"


def test_curriculum_inverts_the_integral(spark):
    d = spark.range(1001).select((F.col("id") / 1001).alias("q"), (F.col("id") % 3).alias("rank"))
    for q, rank, t in d.select("q", "rank", mixing._inverse(F.col("q"), F.col("rank"), mixing.PHASES)).collect():
        rates = mixing.PHASES[rank]
        whole = sum(min(max(t * 4 - k, 0), 1) * x for k, x in enumerate(rates)) / sum(rates)
        assert whole == pytest.approx(q, abs=1e-9)


# --- 6: decontamination -----------------------------------------------------------------------

ITEMS = [(1, "If Tom has 12 apples and gives 5 apples to Anna every 3 days then how many apples does Tom have after 9 days"), (2, "short item of five words"), (3, "The quick brown fox jumps over the lazy dog near the river bank while nobody looks at it."), (4, None)]


def test_leaks(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(3))
    re_set = "If Bob has 40 apples and gives 7 apples to Mary every 2 days then how many apples does Bob have after 8 days"
    torn = "If Bob has 40 apples and gives 7 apples to Mary every 2 days then how many apples does Carl have after 8 days"
    docs = documents(spark, [(10, f"some words before. {ITEMS[0][1]} and after"), (11, f"x y z. {re_set} so there"), (12, words(random.Random(1), 400)), (13, ITEMS[2][1].upper() + " " + ITEMS[2][1]), (14, "a short item of five words b"), (15, None), (16, ""), (17, torn), (10, ITEMS[2][1]), (18, " ".join(w + "***" for w in ITEMS[2][1].split()))])
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {(10, 1), (10, 3), (11, 1), (13, 3), (14, 2), (18, 3)}  # not 17, where one name stands for two
    assert got[10, 1].n_changed == 0 and got[11, 1].n_changed > 0
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()} >= {12, 15, 16}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(documents(spark, []), bench).count() == 0
    assert decontaminate.drop_leaks(documents(spark, EDGE), bench).count() == len(EDGE)


def test_every_item_can_be_found(spark):
    """Items of numbers or names alone, copies in lower case, names at the beginning, words put in."""
    items = [(1, "Tom has 12 apples and gives 5 apples to Anna. How many apples are left for Tom when 3 days are over"), (2, "12 + 30 - 7 = 35 ; 8 * 9 = 72"), (3, "17 * 23"), (4, "Anna Berta Carl Dora Emil Fritz Gustav Hans Ida"), (5, None), (6, "***")]
    other = "Bob has 40 apples and gives 7 apples to Mary. How many apples are left for Bob when 2 days are over"
    docs = [(1, items[0][1].lower()), (2, f"x y {items[1][1]} z"), (3, "so 17 * 23 is?"), (4, other), (5, other.replace("for Bob", "for Carl")), (6, items[3][1].lower()), (7, "17 23"), (8, items[0][1].replace("apples and", "really tasty apples and")), (None, items[2][1])]
    got = decontaminate.leaks(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 1), (6, 4), (8, 1), (None, 3)}


def test_names_and_numbers_of_several_words(spark):
    items = [
        (1, "A train leaves Boston at noon and goes to Denver with five pounds of mail and 12 bags before it returns to Boston"),
        (2, "Then New York sold 25 tons of wheat, and Chicago bought them for two hundred dollars a ton in the end"),
        (3, "In San Francisco Anna, Berta and Carl share twenty-five cookies that were baked by Dora yesterday evening at home"),
    ]
    docs = [
        (1, items[0][1].replace("Boston", "New York").replace("Denver", "San Francisco")),
        (2, items[0][1].replace("five", "17").replace("12", "forty two")),
        (3, items[0][1].replace("goes to Denver", "goes to Salt Lake City").replace("Boston", "Rome").lower()),  # a name that no item has, in lower case: words
        (4, items[0][1].replace("Boston", "New York", 1)),  # one name for two
        (5, items[1][1].replace("New York", "Rome").replace("two hundred", "90").replace("25", "three")),
        (6, items[1][1].replace("Chicago", "New York", 1).replace("New York", "Chicago", 1).lower()),  # the names of items in lower case, exchanged
        (7, items[2][1].replace("San Francisco", "Rome").replace("Carl", "Mary Ann").replace("twenty-five", "3 million")),
        (8, items[2][1].replace("Anna, Berta", "Anna Berta")),  # two names have become one
        (9, "One train leaves at noon and goes on with five pounds of mail and some bags before it returns"),
        (10, f"Word. {items[0][1]} {items[1][1]}"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_changed for r in decontaminate.leaks(documents(spark, docs), bench).collect()}
    assert {(1, 1), (2, 1), (5, 2), (6, 2), (7, 3), (10, 1), (10, 2)} <= set(got) and not {4, 9} & {d for d, _ in got}
    assert got[10, 1] == got[10, 2] == 0 and got[1, 1] > 0 and got[2, 1] > 0


def brute_leaks(docs, items, coverage=0.5):
    """Leaks by comparing every window of every item with every window of every document as lists of tokens."""
    g = decontaminate
    names = Counter()
    for _, t in items:
        for w, k in brute_words(t):
            names[w, k == g._KNOWN] += k in (g._KNOWN, g._LITERAL)
    names = {w for (w, capital), n in names.items() if capital and n and not names[w, False]}

    def sequences(t):
        w = [(a, b if b in (g._NUM, g._UNIT) or a not in names else g._KNOWN) for a, b in brute_words(t)]
        return [[(a, (g._KNOWN if as_name else g._LITERAL) if b == g._CAP else b) for a, b in w] for as_name in (False, True)]

    def windows(t):
        out = set()
        for s in sequences(t):
            for p in range(len(s) - g.WINDOW + 1):
                x = s[p : p + g.WINDOW]
                if sum(b == g._LITERAL for _, b in x) >= g.LITERALS:
                    out.add((p, tuple(a if b == g._LITERAL else g._TAG[b] for a, b in x), tuple(a for a, b in x if b != g._LITERAL)))
        return out

    leaks = set()
    for d, t in docs:
        of = defaultdict(list)
        for p, template, slots in windows(t):
            of[template].append((p, slots))
        for i, u in items:
            mine = windows(u)
            met = [(q - p, p, a, b) for p, template, a in mine for q, b in of.get(template, ())]
            for lo, wide in [(s, 1) for s in {m[0] for m in met}] + [(k * g.DRIFT // 2, g.DRIFT) for k in {m[0] // (g.DRIFT // 2) - e for m in met for e in (0, 1)}]:
                one = [m for m in met if lo <= m[0] < lo + wide]
                pairs = {(a, b) for m in one for a, b in zip(m[2], m[3], strict=True)}
                if len({p for _, p, _, _ in one}) >= coverage * len({m[0] for m in mine}) > 0 and len({a for a, _ in pairs}) == len(pairs):
                    leaks.add((d, i))
    return leaks


def brute_words(t):
    """(lower-cased core, kind) of the words of a text of ASCII words with single spaces."""
    g, out, opens = decontaminate, [], True
    for w in t.split():
        core = re.sub(r"^[\W_]+|[\W_]+$", "", w)
        k = g._NUM if core.isdigit() or core.lower() in g.NUMBERS else g._UNIT if core.lower() in g.UNITS else g._CAP if re.fullmatch("[A-Z][a-z]+", core) else g._LITERAL
        out.append((core.lower(), g._KNOWN if k == g._CAP and not opens else k))
        opens = w[-1] in ".!?:"
    return out


def test_leaks_against_brute_force(spark):
    """Whole leaks of generated questions: copies, other numbers and names, torn ones, words put in, halves, other texts.
    Names stand alone and numbers aren't spelled in a row, so that every word is a token."""
    rng = random.Random(61)
    plain = ["the", "gives", "apples", "to", "and", "then", "buys", "more", "for", "every", "river", "takes", "how", "many", "left"]
    people = ["Tom", "Anna", "Carl", "Dora", "Emil", "Nina"]

    def question(n):
        out = []
        while len(out) < n:
            out += [rng.choice(plain) for _ in range(rng.randrange(2, 4))] + [rng.choice([rng.choice(people), str(rng.randrange(2, 90)), "seven", "kg", "days"])]
        return ("So " + " ".join(out) + ".").replace("  ", " ")

    items = [(k, question(rng.randrange(14, 40))) for k in range(25)]
    docs = []
    for k, (_, t) in enumerate(items):
        swap = dict(zip(people, rng.sample(["Bob", "Mary", "Otto", "Ida", "Hugo", "Rita"], 6)))
        other = " ".join(swap.get(w.strip("."), w) for w in t.split())
        numbers = {}
        changed = re.sub(r"\d+", lambda m: numbers.setdefault(m[0], str(rng.randrange(100, 999))), other)
        torn = re.sub(r"\d+", lambda m: str(rng.randrange(100, 999)), t)
        w = t.split()
        put_in = " ".join([*w[: len(w) // 2], "really", "very", *w[len(w) // 2 :]])
        docs += [(10 * k, question(30) + " " + t), (10 * k + 1, changed), (10 * k + 2, torn), (10 * k + 3, put_in), (10 * k + 4, " ".join(w[: len(w) * 2 // 3])), (10 * k + 5, t.lower()), (10 * k + 6, question(60))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(docs, items)
    assert got == want and len(want) > 80 and {(10 * k, k) for k in range(25)} <= want


def test_templates_against_expressions():
    """What words are, by arrays over bytes, against regular expressions word by word."""
    number, name, edge = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*[%°]?[a-z]{0,3}"), re.compile(r"[^\W\d_][^\W\d_A-ZÀ-Þ]+"), re.compile(r"^[\W_]+|[\W_]+$")
    rng = random.Random(31)
    some = ["Tom", "tom", "12", "3.5kg", "12abcd", "1/2", "x9", "9x9", "(Anna)", "Été", "été", "über", "Über", "USA", "A", "I", "...", "end.", "why?!", "--", "«Nina»", "“Otto”", "hours", "Hours,", "5%", "$40", "a-b", "a1", "10:30", "naïve", "Zürich", "日本"]
    texts = [rng.choice(["", " ", "\n"]).join("") + "".join(rng.choice(some) + rng.choice([" ", " ", "\n", "  "]) for _ in range(rng.randrange(30))) for _ in range(200)] + ["", " "]
    for at_once in (64, 1 << 20):
        read = decontaminate.Templates(at_once=at_once)
        buf, (start, end, c0, c1, kind, h), owner = read.read([t.encode() for t in texts])
        want = []
        for k, t in enumerate(texts):
            opens = True
            for line in t.split("\n"):
                opens = True
                for w in line.split():
                    core = edge.sub("", w)
                    low = core.lower()
                    g = decontaminate
                    one = g._SKIP if not core else g._NUM if number.fullmatch(low) else g._UNIT if low in g.UNITS else g._CAP if core[0].isupper() and name.fullmatch(core) else g._LITERAL
                    want.append((k, low, g._KNOWN if one == g._CAP and not opens else one))
                    opens = bool(re.search(r"[.!?:]\W*$", w))
        got = [(int(o), buf[a:b].decode() if k != decontaminate._SKIP else "", int(k)) for o, a, b, k in zip(owner, c0, c1, kind)]
        assert got == want
        words = {}
        assert all(words.setdefault(w, x) == x for (_, w, k), x in zip(got, h.tolist()) if k != decontaminate._SKIP) and len(set(words.values())) == len(words)


def test_slots_must_agree(spark):
    bench = spark.createDataFrame([(1, "there 11 are 12 many 13 words 14 here 15 and 11 more 12 of 13 them 14 again 15 said")], "item_id long, text string")
    ok, bad = "there 21 are 22 many 23 words 24 here 25 and 21 more 22 of 23 them 24 again 25 said", "there 21 are 22 many 23 words 24 here 25 and 31 more 32 of 33 them 34 again 35 said"
    got = [r.doc_id for r in decontaminate.leaks(documents(spark, [(1, ok), (2, bad)]), bench).collect()]
    assert got == [1]


# --- 7: lines ---------------------------------------------------------------------------------


def test_lines(spark):
    rng = random.Random(6)
    long = [words(rng, 90) for _ in range(6)]
    near = long[0].replace(long[0].split()[5], "other", 1)
    texts = [(1, f"{long[0]}\n{long[1]}\n\nEnd."), (2, f"{near}\n{long[2]}\nend"), (3, f"{long[3]}\n{long[1].upper()}"), (4, None), (5, ""), (6, "***\n---"), (7, "***"), (8, long[4]), (8, long[4]), (None, long[5]), (9, long[5])]
    docs = documents(spark, texts)
    out = line_dedup.dedup_lines(docs)
    got = {r.doc_id: r.text for r in out.collect() if r.doc_id not in (8,)}
    assert out.columns == docs.columns and out.count() == len(texts)
    assert got[1] == texts[0][1] and got[2] == long[2] and got[3] == long[3]
    assert got[4] is None and got[5] == "" and got[6] == "***\n---" and got[7] == "***"
    assert got[None] == long[5] and got[9] == ""
    assert sorted(r.text for r in out.collect() if r.doc_id == 8) == ["", long[4]]
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def char_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def removed(spark, lines):
    got = line_dedup.dedup_lines(documents(spark, list(enumerate(lines)))).collect()
    return {r.doc_id for r in got if not r.text}


def test_lines_against_all_pairs(spark):
    """Chains of near copies: groups, and so the lines kept, agree with comparing all pairs by edits."""
    rng = random.Random(9)
    lines = []
    for _ in range(8):
        w = words(rng, 70).split()
        for _ in range(8):
            lines.append(" ".join(w))
            w = [*w]
            w[rng.randrange(len(w))] = f"edit{rng.randrange(999)}"
    rng.shuffle(lines)
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for j in range(i):
            if a.split()[60:] != lines[j].split()[60:] and len(set(a.split()) & set(lines[j].split())) < 40:
                continue  # of another chain
            if char_edits(a, lines[j]) <= 0.2 * max(len(a), len(lines[j])):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    gone = removed(spark, lines)
    assert {i for i in range(len(lines)) if i not in gone} == {i for i in range(len(lines)) if find(i) == i}


def test_recall_of_similar_lines(spark):
    """Against brute force: lines with some words changed, of similarity 0.8 and more by edits of characters."""
    rng = random.Random(41)
    lines, ok = [], []
    for n, changed in ((10, 1), (20, 1), (20, 2), (20, 3), (30, 1), (30, 3), (30, 5)):
        for _ in range(60):
            a = words(rng, n).split()
            b = [*a]
            for at in rng.sample(range(n), changed):
                b[at] = rng.choice(["lorem", "ipsum", "dolor", "amet"]) + str(rng.randrange(99))
            a, b = " ".join(a), " ".join(b)
            lines += [a, b]
            if char_edits(a, b) <= 0.2 * max(len(a), len(b)):
                ok.append(len(lines) - 1)
    gone = removed(spark, lines)
    assert len(ok) > 380 and len(gone & set(ok)) >= 0.93 * len(ok) and len(gone - set(ok)) <= 3


def test_recall_by_kind_of_edit(spark):
    """Against brute force, for each kind: typos in every second to fifth word, joined words, replaced words."""
    rng = random.Random(43)
    letter = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(letter() for _ in range(rng.randrange(3, 10)))

    def typos(w, each):
        return [x[:k] + letter() + x[k + 1 :] if i % each == 0 and (k := rng.randrange(len(x))) >= 0 else x for i, x in enumerate(w)]

    def replaced(w, k):
        at = set(rng.sample(range(len(w)), k))
        return [word() if i in at else x for i, x in enumerate(w)]

    joined = lambda w: "".join(x + ("" if i % 3 == 2 else " ") for i, x in enumerate(w)).split()
    kinds = [(10, lambda w: typos(w, 3), 0.9), (20, lambda w: typos(w, 3), 0.9), (40, lambda w: typos(w, 3), 0.9), (40, lambda w: typos(w, 5), 0.95), (5, lambda w: replaced(w, 1), 0.85), (10, lambda w: replaced(w, 2), 0.85), (20, lambda w: replaced(w, 4), 0.85), (40, lambda w: replaced(w, 8), 0.9), (20, joined, 0.9), (10, lambda w: typos(w, 2), 0.75)]
    lines, of = [], {}
    for k, (n, change, _) in enumerate(kinds):
        while sum(x == k for x in of.values()) < 60:
            w = [word() for _ in range(n)]
            a, b = " ".join(w), " ".join(change(w))
            if char_edits(a, b) <= 0.2 * max(len(a), len(b)):
                of[len(lines) + 1] = k
                lines += [a, b]
    gone = removed(spark, lines)
    assert gone <= set(of)
    for k, (_, _, least) in enumerate(kinds):
        assert sum(i in gone for i, x in of.items() if x == k) >= least * 60, k


def test_lines_by_edits_alone(spark):
    """One to eight words of 40 changed; unlike lines stay."""
    rng = random.Random(21)
    base = [words(rng, 40) for _ in range(12)]
    lines = list(base)
    for k, b in enumerate(base):
        w = b.split()
        for at in rng.sample(range(40), 1 + k % 8):
            w[at] = w[at][:-2] + f"q{rng.randrange(9)}"
        lines.append(" ".join(w))
    for i, a in enumerate(lines):
        for j in range(i):
            assert (char_edits(a, lines[j]) <= 0.2 * max(len(a), len(lines[j]))) == (j == i - 12)
    assert removed(spark, lines) == set(range(12, 24))


def test_line_query(spark, tmp_path):
    rng = random.Random(22)
    a = words(rng, 40).split()
    b = [x[:-1] + "z" if i % 5 == 0 else x for i, x in enumerate(a)]
    spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in line_dedup.op7_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}


def test_short_lines_by_characters(spark):
    lines = ["Subscribe to our newsletter", "call us 0800 1234", "see more photos", "Subscribe to our newsleter", "call us 0800 1235", "see more photo", "seemore photos", "open daily", "closed now"]
    assert removed(spark, lines) == {3, 4, 5, 6}


def test_crowded_buckets_lose_no_pairs(spark):
    """More lines than a bucket compares pair by pair share most words; each has one near copy far off in the order."""
    rng = random.Random(23)
    shared = words(rng, 30)
    lines = [f"{shared} {' '.join(f'{rng.randrange(1 << 40):x}' for _ in range(9))}" for _ in range(120)]
    lines += [x[:-3] + "zzz" for x in lines]
    far = [char_edits(lines[0], x) / max(len(lines[0]), len(x)) for x in lines[1:40]]
    assert min(far) > 0.2 and removed(spark, lines) == set(range(120, 240))


def test_long_texts_and_long_lines(spark):
    """A text of 5,000 lines, of which the first and each seventh stand elsewhere before; lines of 200,000 characters."""
    rng = random.Random(24)
    lines = [f"{words(rng, 6)} {i}x{rng.randrange(1 << 60):x}" for i in range(5000)]
    far = ["x" * 200_000, "ab " * 70_000, "ab " * 70_000]
    before = "\n".join(lines[::7])
    got = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, [(1, before), (2, "\n".join(lines)), (3, "\n".join(far))]), report=True).collect()}
    assert got[1].n_removed == 0 and got[2].text == "\n".join(x for i, x in enumerate(lines) if i % 7) and got[2].n_removed == len(lines[::7])
    assert got[3].text == "\n".join(far[:2]) and got[3].n_lines == 3


# --- 8: fingerprints --------------------------------------------------------------------------


def test_minhash(spark):
    rng = random.Random(12)
    texts = [(i * 3, words(rng, rng.choice([3, 8, 40, 200, 500]))) for i in range(120)] + [(2, None), (4, ""), (7, "same text here now ok yes"), (8, "same text here now ok yes"), (1000, LONG), (5, "été ÄÖ")]
    texts.sort(key=lambda x: x[0])
    got = {r.doc_id: r for r in minhash.fingerprint_neighbours(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    grams = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").encode().lower().split()] for i in range(max(1, len(w) - 4)) if w}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    off = []
    for k, (i, t) in enumerate(texts):
        t, nxt = t or "", texts[(k + 1) % len(texts)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + nxt[:n]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and len(r.fingerprint) == 512
        off += [abs(r.near_edited - like(grams(t), grams(edited))), abs(r.near_next - like(grams(t), grams(nxt)))]
    assert sum(off) / len(off) < 0.03 and max(off) < 0.2
    assert got[7].fingerprint == got[8].fingerprint and got[7].near_next == 1.0
    assert minhash.fingerprint_neighbours(documents(spark, [])).count() == 0
    one = minhash.fingerprint_neighbours(documents(spark, [(1, "alone in the table it is")])).first()
    assert one.near_next == 1.0


def test_neighbours_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "IN_BUCKET", 4)
    ids = random.Random(1).sample(range(-500, 500), 60) + [7, 7, 7]
    d = spark.createDataFrame([(i, f"t{i}-{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = minhash.with_next(d, ["text"]).collect()
    assert len(got) == len(ids)
    nxt = {r.text: r.next_text for r in got}
    at, seen = next(iter(nxt)), []
    while at not in seen:
        seen.append(at)
        at = nxt[at]
    assert len(seen) == len(ids)  # one ring over all rows
    order = [int(s[1:].rsplit("-", 1)[0]) for s in seen]
    low = order.index(min(order))
    assert order[low:] + order[:low] == sorted(order)


# --- 9: personal data -------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            odd = sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and (not 12 <= len(d) <= 19 or odd) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def test_pii_base(spark):
    rng = random.Random(13)
    bits = ["a@b.cd", "x@y", "@", "a@b@c.d", "x@y.zz_k@w.com", "1.2.3.4.5", "256.1.1.1", "0010.001.1.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+12", "é", " ", ".", "-", "12 34", "9" * 25, "+1+2 345 678 901", "\n", "a.b-c%d+e_f@g-h.i.j."]
    texts = [(i, "".join(rng.choice(bits) + rng.choice(["", " ", "x", "é"]) for _ in range(rng.randrange(12)))) for i in range(300)] + EDGE + [(400, "a" * 50_000 + "1" * 50_000), (401, "1 " * 30_000), (402, "+1" + "(" * 5000)]
    got = pii.personal_data(documents(spark, texts)).collect()
    assert len(got) == len(texts)
    want = Counter((i, tuple(brute_spans(t))) for i, t in texts)
    rank = {k: i for i, k in enumerate(pii.KINDS)}
    assert Counter((r.doc_id, tuple(sorted(((s.kind, s.start, s.end) for s in r.base), key=lambda s: (s[1], rank[s[0]], s[2])))) for r in got) == want
    assert pii.personal_data(documents(spark, [])).count() == 0


def test_pii_bootstrap_finds_what_the_base_misses(spark):
    rng = random.Random(14)
    texts = [(i, f"{words(rng, 12)} please call +1 (212) 555-{1000 + i} or so {words(rng, 5)}") for i in range(20)]
    texts += [(100 + i, f"{words(rng, 8)} please call 0212/555{1000 + i} {words(rng, 6)}") for i in range(4)] + [(200, f"the number 0212/5559999 {words(rng, 9)}")]
    got = {r.doc_id: r for r in pii.personal_data(documents(spark, texts)).collect()}
    for i in range(4):
        t = texts[20 + i][1]
        s = t.index("0212/")
        assert [(x.kind, x.start, x.end) for x in got[100 + i].added] == [("phone", s, s + 12)]
    assert not got[200].added and not any(got[i].added for i in range(20))


def test_pii_secrets_and_groups_with_precision(spark):
    """Planted forms that the base misses, among look-alikes: every added span is planted, and nearly all are found."""
    rng = random.Random(33)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts, want = [], set()
    for i in range(60):
        v, quoted = (key(40) if i % 3 else f"k{key(9)}7"), i % 2
        start = f"{words(rng, 9)} token = " + '"' * quoted
        texts.append((i, f"{start}{v}" + '"' * quoted + f" {words(rng, 5)}"))
        want.add((i, "secret", len(start), len(start) + len(v)))
    for i in range(60, 80):
        texts.append((i, f"{words(rng, 6)} ring us at +1 (212) 555-{1000 + i} {words(rng, 4)}"))
        start = f"{words(rng, 6)} ring us at "
        texts.append((100 + i, f"{start}(030) {rng.randrange(100, 999)} {rng.randrange(1000, 9999)} {words(rng, 4)}"))
        want.add((100 + i, "phone", len(start), len(start) + 14))
    texts += [(300 + i, f"{words(rng, 5)} build {key(40)} was fine {words(rng, 5)} about 2020 and 12 34 {words(rng, 3)}") for i in range(2)]
    got = {(r.doc_id, s.kind, s.start, s.end) for r in pii.personal_data(documents(spark, texts)).collect() for s in r.added}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(got)


def test_pii_query(spark, tmp_path):
    texts = [(1000 + i, f"x a{i}@b.cd from 10.0.0.{i} or 4111 1111 1111 1111") for i in range(3)] + EDGE
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op9_pii(spark, str(tmp_path)).collect():
        spans = ",".join(f"{k}:{s}:{e}" for k, s, e in brute_spans(next(t for i, t in texts if i == r.doc_id)))
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest() and r.spans == spans and r.n_added == 0
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len([x for x in spans.split(",") if x])


# --- 1: language model ------------------------------------------------------------------------


def test_lm(spark):
    rng = random.Random(15)
    texts = [(i, words(rng, 60)) for i in range(300)] + EDGE + [(700, "Unseen gibberish zzqx")]
    docs = documents(spark, texts)
    got = lm.score_texts(docs, start_docs=200, hot_words=50).collect()
    assert len(got) == len(texts)
    tok = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in texts if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 4)) for i, t in texts)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    own = [r for r in got if r.held_out and 10 <= r.doc_id < 300]
    # words drawn evenly have no context to learn from, and the word counts are the best there can be; the model comes near
    assert own and sum(r.score for r in own) > 1.02 * sum(r.base_score for r in own) and all(r.score < 0 for r in got)
    hot = lm.score_texts(docs, start_docs=200, hot_words=1 << 16).collect()  # where the counts come from changes nothing
    pairs = zip(sorted(got, key=str), sorted(hot, key=str), strict=True)
    assert all(x.doc_id == y.doc_id and abs(x.score - y.score) < 0.02 + 1e-4 * abs(y.score) for x, y in pairs)
    assert lm.score_texts(documents(spark, [])).count() == 0


def test_lm_scores_do_not_follow_partitions(spark, monkeypatch):
    """Shards are dealt by hash: one file or many, the rows in another order, and repeated rows in one
    partition or apart give the same parameters and scores."""
    monkeypatch.setattr(lm, "TRAIN_EVERY", 1)
    rng = random.Random(35)
    texts = [(i, words(rng, 80)) for i in range(120)] + [(7, "the same row " * 30)] * 9 + EDGE
    rng.shuffle(texts)
    docs = documents(spark, texts)
    key = lambda r: (str(r.doc_id), r.n_tokens, r.score)
    one = sorted(lm.score_texts(docs.coalesce(1), start_docs=20).collect(), key=key)
    many = sorted(lm.score_texts(docs.repartition(7), start_docs=20).collect(), key=key)
    assert len(one) == len(texts)
    for a, b in zip(one, many, strict=True):
        assert a.doc_id == b.doc_id and abs(a.score - b.score) <= 1e-5 * abs(a.score)


def test_lm_shards_train_on_all_blocks(spark):
    """Every block is trained on once, in a shard of bounded size, whatever the partitions; a block that
    occurs n times weighs as n."""
    np = __import__("numpy")
    texts = [words(random.Random(k), 60).encode().split() for k in range(150)]
    sub = lm.Subwords(lm.read_vocabulary(lm.VOCABULARY), {})
    _, sizes, pieces = sub.read(texts)
    m = lm.start_model(pieces, lm._subword_counts(sizes, texts), sub.opens, steps=5)
    inp, tgt, prev = m.blocks(pieces, lm._subword_counts(sizes, texts))
    rows = [(k, np.concatenate([inp[k], inp[prev[k]], tgt[k]]).astype("<i2").tobytes(), 1) for k in range(len(prev))]
    blocks = spark.createDataFrame(rows, "mix long, block binary, n long")
    out = [lm.train_shards(blocks.repartition(p), m.state(), per_shard=200).groupBy("k").agg({"v": "sum"}).collect() for p in (1, 5)]
    a, b = ({r[0]: r[1] for r in x} for x in out)
    shards = -(-len(rows) // 200)
    assert len(rows) / lm.BATCH <= a[-1] <= len(rows) / lm.BATCH + shards and a[-1] == b[-1]
    assert max(abs(a[k] - b[k]) for k in a) < 1e-6 * a[-1]
    before = m.state()["p"]["e"].ravel()
    trained = lm.Model(**{**m.state(), "p": {k: v.copy() for k, v in m.p.items()}})
    lm.finish(trained, a)
    assert len(before) and any((trained.p[k] != m.p[k]).any() for k in m.p)
    once, thrice = (lm.Model(**{**m.state(), "p": {k: v.copy() for k, v in m.p.items()}}) for _ in range(2))
    some = np.array([0, 1, 1, 1])
    lm.Trainer(once).step(inp[some], inp[prev[some]], tgt[some], 0.01)
    lm.Trainer(thrice).step(inp[:2], inp[prev[:2]], tgt[:2], 0.01, np.array([1, 3], np.float32))
    assert all(np.allclose(once.p[k], thrice.p[k], atol=1e-4) for k in m.p)


def test_lm_passages_against_brute_force(spark, monkeypatch):
    """What a passage gains: the difference to a run in which no context is looked up."""
    rng = random.Random(25)
    texts = [(i, words(rng, 200)) for i in range(40)]
    texts += [(100 + i, texts[i][1]) for i in range(8)] + [(200 + i, " ".join(texts[10 + i][1].split()[:100]) + " " + words(rng, 100)) for i in range(8)]
    docs = documents(spark, texts, extra=False)
    got = {r.doc_id: r for r in lm.score_texts(docs, start_docs=20).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    seen, by_doc = Counter(), {}
    for i, t in texts:
        keys = __import__("numpy").array([xxhash.xxh64_intdigest(w, 42) for w in t.encode().lower().split()], "uint64")
        at, context, passage = lm.passages(keys, __import__("numpy").array([len(keys)]))
        assert all(b - a >= lm.PASSAGE for a, b in zip(at, at[1:]))
        by_doc[i] = list(zip(context.tolist(), passage.tolist()))
        if not held[i]:
            seen.update(by_doc[i])
    matched = {i: sum(seen[x] - (not held[i]) > 0 for x in by_doc[i]) for i, _ in texts}
    assert sum(matched.values()) > 20
    monkeypatch.setattr(lm, "CONTEXT", 100_000)
    plain = {r.doc_id: r.score for r in lm.score_texts(docs, start_docs=20).collect()}
    for i, _ in texts:
        gain = got[i].score - plain[i]
        assert abs(gain) < 1e-3 if not by_doc[i] or not any(seen[x] - (not held[i]) > 0 or sum(n for (c, _), n in seen.items() if c == x[0]) > (not held[i]) for x in by_doc[i]) else gain > 20 * matched[i] - len(by_doc[i])


def test_lm_attention_lowers_the_loss():
    """Texts that repeat a word after a distance that no pair of neighbours shows."""
    import numpy as np

    rng = random.Random(4)
    few = [f"{a}{b}" for a in ("red", "blue", "green", "gold") for b in ("cat", "dog", "fish")]
    texts = []
    for _ in range(300):
        w = rng.choice(few)
        texts.append(" ".join(f"the {w} of" for _ in range(12)).encode().split())
    sub = lm.Subwords(lm.read_vocabulary(lm.VOCABULARY), {})
    n = np.array([len(t) for t in texts])
    _, sizes, pieces = sub.read(texts)
    counts = lm._subword_counts(sizes, texts)
    m = lm.start_model(pieces, counts, sub.opens, steps=300)
    with_it = m.logs(pieces, counts)[0].mean()
    m.p["o"] = m.p["o"] * 0
    assert with_it > m.logs(pieces, counts)[0].mean() + 0.1 and len(n)


def test_lm_probabilities_sum_to_one_and_windows_agree():
    import numpy as np

    sub = lm.Subwords(lm.read_vocabulary(lm.VOCABULARY), {})
    texts = [b"alpha beta gamma".split() * 20, [], b"delta".split()]
    _, sizes, pieces = sub.read(texts)
    counts = lm._subword_counts(sizes, texts)
    m = lm.start_model(pieces, counts, sub.opens, steps=3)
    assert np.allclose(np.concatenate(m.logs(pieces, counts, at_once=1)), np.concatenate(m.logs(pieces, counts)), atol=1e-4)
    inside = [np.exp(m.tail[m.id == g]).sum() for g in np.unique(m.id)]
    assert np.allclose(inside, 1)
    one = {int(c): int(np.flatnonzero(m.id == c)[0]) for c in np.unique(m.id)}  # a subword of each class
    second = [np.exp(m.logs(np.array([pieces[0], k], np.int32), np.array([2]))[0][1] - m.tail[k]) for k in one.values()]
    end = np.exp(m.logs(pieces[:1], np.array([1]))[0][1])
    missing = (lm.OUT - 1 - len(one)) * (lm.EVEN / lm.OUT + 3e-3)  # classes without subwords have a little
    assert 1 - missing - 1e-3 <= sum(second) + end <= 1 + 1e-3
    parts = [m.units(*(lambda g: (g[1], np.array([len(t)]), g[2]))(sub.read([t])))[0].sum() for t in texts]
    log, _, text = m.units(sizes, np.array([len(t) for t in texts]), pieces)
    assert np.allclose(np.bincount(text, log), parts, atol=1e-3)


def test_lm_models_travel_as_arrays():
    """What tasks are sent holds no class of this package, which they need not have."""
    import numpy as np

    m = lm.start_model(np.zeros(0, np.int32), np.zeros(0, np.int64), np.ones(300, bool))
    assert {type(x) for x in m.state().values()} <= {np.ndarray, dict, float}
    assert all(np.allclose(a, b) for a, b in zip(m.logs(np.zeros(0, np.int32), np.array([0])), lm.Model(**m.state()).logs(np.zeros(0, np.int32), np.array([0]))))


def test_lm_words_survive_encoding():
    sub = lm.Subwords(lm.read_vocabulary(lm.VOCABULARY), {})
    ws = [w for t in ("it's a b  c d ", "é" * 400, "x" * 1000, "日本語", "...", "'s") for w in t.encode().split()]
    _, sizes, pieces = sub.read([ws])
    assert [sub.key[k] for k in sub.read([ws])[0]] == [xxhash.xxh64_intdigest(w, 42) for w in ws]
    at = 0
    for w, n in zip(ws, sizes, strict=True):
        assert sub.encoding.decode_bytes(pieces[at : at + n].tolist()) == b" " + w
        at += n


def test_held_out_is_crc32(spark):
    got = spark.range(50).select("id", common.held_out(F.col("id"), 7, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 7 == 2) for r in got)


def test_every_pair_of_a_crowded_bucket_is_compared(spark):
    """60 rows of a bucket whose finer buckets hold one row each: links that are no neighbours are found."""
    sent = spark.range(60).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("o"), F.lit(0).cast("long").alias("z"), (F.col("id") + 100).alias("id"))
    alone = lambda crowds, level: crowds.withColumn("key", F.col("id") * 10 + level)
    found = groups.linked(sent, lambda o, z, o2, z2: F.lit(True), alone, lambda links: links.where("(b - a) % 20 = 0 and a % 20 > 2"), common.Spool(spark, "crowd"), 3)
    assert {r.id: r.root for r in found.collect()} == {100 + i: 100 + i % 20 for i in range(60) if i % 20 > 2}


def test_lm_learns_from_every_block_of_every_training_row(spark):
    """As many blocks come to training as the rows have, one for every BLOCK subwords and the end."""
    texts = [words(random.Random(k), 40 + k) for k in range(60)]
    tokens, ranks = [t.encode().split() for t in texts], lm.read_vocabulary(lm.VOCABULARY)
    sub = lm.Subwords(ranks, {})
    _, sizes, pieces = sub.read(tokens)
    counts = lm._subword_counts(sizes, tokens)
    m = lm.start_model(pieces, counts, sub.opens, steps=5)
    train = spark.createDataFrame([(k, bytearray(t.encode())) for k, t in enumerate(texts)], "key long, text binary").repartition(3)
    assert lm.learn(train, ranks, m.state()).where("block is not null").count() == sum(-(-(int(c) + 1) // lm.BLOCK) for c in counts)


def test_lines_apart_by_their_beginnings(spark):
    """Pairs near the limit: what a beginning rules out isn't similar by all edits, and unlike lines go by it."""
    rng = random.Random(51)
    pairs = []
    for k in range(300):
        a = words(rng, rng.randrange(8, 40))
        n = len(a) * rng.randrange(5, 40) // 100
        at = sorted(rng.sample(range(len(a)), n)) if k % 3 else list(range(n)) if k % 2 else list(range(len(a) - n, len(a)))
        b = list(a)
        for i in at:
            b[i] = rng.choice(["", "q", b[i] + "x"])
        pairs.append((k, 1000 + k, a, "".join(b) if k % 10 else words(rng, len(a.split()))))
    rows = spark.createDataFrame([x for a, b, s, t in pairs for x in ((a, s), (b, t))], "id long, norm string")
    links = spark.createDataFrame([(a, b) for a, b, _, _ in pairs], "a long, b long")
    got = {r.a for r in line_dedup.verified(links, rows, 0.8, common.Spool(spark, "begin")).collect()}
    assert got == {a for a, _, s, t in pairs if char_edits(s, t) <= int(0.2 * max(len(s), len(t)) + 1e-9)} and 80 < len(got) < 250


def test_neighbours_are_written_without_their_sketches(spark, monkeypatch):
    """The tables of buckets hold a row's own sketch and its neighbour's id, nothing twice."""
    columns, cut = [], common.Spool.cut
    monkeypatch.setattr(common.Spool, "cut", lambda self, df: columns.append(df.columns) or cut(self, df))
    sent = spark.range(60).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("o"), F.lit(0).cast("long").alias("z"), (F.col("id") + 100).alias("id"))
    finer = lambda crowds, level: crowds.withColumn("key", F.col("id") % 7)
    found = groups.linked(sent, lambda o, z, o2, z2: F.lit(True), finer, lambda links: links.where("(b - a) % 20 = 0"), common.Spool(spark, "beside"), 3)
    assert {r.id: r.root for r in found.collect()} == {100 + i: 100 + i % 20 for i in range(60)}
    assert columns and not any(set(c) & {"o2", "z2", "root2"} for c in columns)


def test_lm_rows_of_blocks(spark):
    """Up to TOGETHER blocks of a text travel in one row of a byte a subword, and are the same blocks."""
    np = __import__("numpy")
    texts = [words(random.Random(k), k * 9).encode().split() for k in range(90)]
    ranks = lm.read_vocabulary(lm.VOCABULARY)
    sub = lm.Subwords(ranks, {})
    _, sizes, pieces = sub.read(texts)
    counts = lm._subword_counts(sizes, texts)
    m = lm.start_model(pieces, counts, sub.opens, steps=2)
    inp, tgt, prev = m.blocks(pieces, counts)
    want = Counter(np.concatenate([inp[k], inp[prev[k]], tgt[k]]).astype(int).tobytes() for k in range(len(prev)))
    train = spark.createDataFrame([(k, bytearray(b" ".join(t))) for k, t in enumerate(texts)], "key long, text binary").repartition(3)
    rows = lm.learn(train, ranks, m.state(), lm.TOGETHER).where("block is not null").select("mix", "block").collect()
    own, before, t, n = lm._unpacked(np.array([r.mix for r in rows]), [bytes(r.block) for r in rows], np.arange(len(rows)))
    assert Counter(np.concatenate(x).astype(int).tobytes() for x in zip(own, before, t)) == want and len(n) == len(prev)
    assert len(rows) < len(prev) / 10 and sum(len(r.block) for r in rows) < 20 * len(prev)


def test_long_lines_by_characters(spark):
    """Lines of over 1,000 characters with a typo in every third word: likeness is by characters there too, and unlike lines stay."""
    rng = random.Random(57)
    letter = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz")
    lines = []
    for n in (220, 300, 400):
        w = ["".join(letter() for _ in range(rng.randrange(3, 10))) for _ in range(n)]
        b = [x[:k] + letter() + x[k + 1 :] if i % 3 == 0 and (k := rng.randrange(len(x))) >= 0 else x for i, x in enumerate(w)]
        lines += [" ".join(w), " ".join(b), " ".join("".join(letter() for _ in x) if i % 3 == 0 else x for i, x in enumerate(w))]
    assert min(map(len, lines)) > 1000 and removed(spark, lines) == {1, 4, 7}


def test_long_lines_by_words_and_bands(spark):
    """Pairs of long lines on both sides of the limit, each against all edits of characters."""
    rng = random.Random(58)
    pairs = []
    for k in range(24):
        a = words(rng, 190)
        b = list(a)
        for i in rng.sample(range(len(a)), len(a) * (1 + k) // 60):
            b[i] = rng.choice(["", "q", b[i] + "x", "zz"])
        w = a.split()
        c = " ".join(x for i, x in enumerate(w) if i % (k + 2))  # words taken out
        pairs += [(2 * k, a, "".join(b)), (2 * k + 1, a, c)]
    rows = spark.createDataFrame([x for i, s, t in pairs for x in ((i, s), (1000 + i, t))], "id long, norm string")
    links = spark.createDataFrame([(i, 1000 + i) for i, _, _ in pairs], "a long, b long")
    got = {r.a for r in line_dedup.verified(links, rows, 0.8, common.Spool(spark, "long")).collect()}
    want = {i for i, s, t in pairs if char_edits(s, t) <= int(0.2 * max(len(s), len(t)) + 1e-9)}
    assert got == want and 10 < len(want) < 46


def test_unlike_lines_go_by_their_sketches(spark, monkeypatch):
    """Lines of few endings and beginnings of words, none like another: hardly a pair gets to its texts, and crowded buckets are not split."""
    rng, asked, cut = random.Random(59), [], common.Spool.cut
    parts = ["tion", "ing", "ment", "able", "ness", "ous", "ly", "er", "con", "pre", "st", "un", "re", "dis", "ab", "ent", "ive", "al", "ist", "form", "mit", "port"]
    lines = [" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(170)) for _ in range(500)]
    seen = line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda links, *rest: asked.append(links.count()) or seen(links, *rest))
    assert removed(spark, lines) == set() and sum(asked) < 5_000


def test_lm_passages_cover_texts():
    """All words after the first context are in a passage, whatever the texts' sizes, and a part that two texts share is cut alike."""
    np = __import__("numpy")
    rng = np.random.default_rng(61)
    sizes = np.array([0, 5, lm.CONTEXT + lm.PASSAGE - 1, lm.CONTEXT + lm.PASSAGE, 60, 1000, 3, 400, 0])
    keys = rng.integers(0, 1 << 62, sizes.sum()).astype(np.uint64)
    keys[-300:] = keys[200:500]  # the last text ends as the 1,000 words have it in their midst
    at, context, passage = lm.passages(keys, sizes)
    long, ends = lm.passage_sizes(at, sizes), np.cumsum(sizes)
    covered = np.zeros(len(keys), int)
    for x, k in zip(at, long):
        covered[x : x + k] += 1
        assert lm.PASSAGE <= k < 2 * lm.PASSAGE
    for end, k in zip(ends, sizes):
        want = [0] * min(k, lm.CONTEXT) + [1] * (k - lm.CONTEXT) if k >= lm.CONTEXT + lm.PASSAGE else [0] * k
        assert covered[end - k : end].tolist() == want
    of = {(c, p) for x, c, p in zip(at, context, passage) if 200 <= x < 500}
    assert sum((c, p) in of for x, c, p in zip(at, context, passage) if x >= len(keys) - 300) >= 8
