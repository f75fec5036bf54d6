"""The prefix trie against a brute-force version and on edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

from claimloom.llm import trie

ROWS = "conv_id long, turn long, role string, text string, place int, node_a int, depth int, c0 int"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(convs):
    """{id: [(role, text), ...]} -> the rows of the contract, as tuples."""
    members, stops = defaultdict(list), defaultdict(list)
    for c, t in convs.items():
        stops[tuple(t)].append(c)
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    saved, leaves = defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] += not children[p]
        if p:
            saved[p[:-1]] += saved[p]
            leaves[p[:-1]] += leaves[p]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(str((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(stops[p]))) for p, m in members.items())


def original(rows):
    convs = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs[c].append((role or "", text or ""))
    return convs


def shared(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def sample(rng, ids):
    rows = []
    for c in ids:
        n = rng.choice((1, 2, 3, 5, 8, 9, 16, 17, 30, 70))
        same = rng.randrange(3)
        start = rng.choice((0, 0, -2, 1000))
        for k in range(n):
            text = rng.choice(("a", "é", "", None)) if k > n - 2 else f"turn {k} of {same}"
            rows.append((c, None if k == 0 and start == 0 else start + k * rng.choice((1, 1, 700)) if k == 0 else start + k * 700, rng.choice(("user", None)) if k == n - 1 else "user", text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], ROWS)


def test_trie_of_conversations_as_they_are(spark):
    rng = random.Random(4)
    rows = sample(rng, range(40))
    rng.shuffle(rows)
    got = trie.prefix_trie(trie.turns(frame(spark, rows))).select(*FIELDS)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(original(rows))


def test_query(spark, tmp_path):
    """Rebuilt conversations: absent bases, turnless ones, null turns, roles, texts and ids, long ones, many alike."""
    rng = random.Random(6)
    rows = sample(rng, [i for i in range(90) if i % 5 or i % 3]) + [(c, k, "user", f"same {k}") for c in range(5_000, 5_060) for k in range(4)] + [(None, 1, "user", "x"), (9_000_000_001, None, None, None)]
    rng.shuffle(rows)
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    made = shared(original(rows))
    assert any(not t for t in made.values()) and max(map(len, made.values())) > 60
    got = trie.op12_prefix_trie(spark, str(tmp_path))
    assert got.columns == FIELDS
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(made)


def test_repeated_rows_and_empty_table(spark):
    """Rows that repeat a turn are turns of their own; no conversations give no nodes."""
    rows = [(1, 1, "u", "b"), (1, 1, "u", "b"), (2, 1, "u", "b"), (1, None, "s", "")]
    got = trie.prefix_trie(trie.turns(frame(spark, rows))).select(*FIELDS)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(original(rows))
    assert trie.prefix_trie(trie.rebuilt(trie.turns(frame(spark, rows).limit(0)))).count() == 0
    tied = [(1, 1, "u", "b"), (1, 1, "u", "a"), (2, 1, "u", "a"), (2, 1, "u", "b")]
    assert trie.prefix_trie(trie.turns(frame(spark, tied))).count() == 3  # tied turns have one order everywhere
