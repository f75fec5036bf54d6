"""The in-row parsers: against their SQL on texts full of headers, plans without shuffles, edge cases."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from claimloom.operators import claims as C
from claimloom.operators import parsing as P
from claimloom.plans import ORACLE_SQL, QUERIES

LINES = [
    "Headline: Buy it", "AD HEADLINE", "Primary Text:", " primary: all of it", "Description - short", "**Q1: Is it?**", "Q: What is it?", "A: It is 128 GB. It cures Everything!\tSure.", "**A:** no", "A1: yes", "question| x", "answer", "# Title", "## Heading",
    "#nothing", "Disclaimers:", "**disclaimer**", "---", "--- ", "Terms. Disclaimer applies", "Why this works: because", "Analysis", "compliance notes", "", "  ", "\t", "It is guaranteed to help. Better than Others! ok", "one.two. Three.\rFour", "été. É? À la. Ab\x0b Cd", "== x", "===",
    "Plain words with 5 mg in them.  Two  spaces.   End", "no end", "Only. A. B. C. d. E", "...", "\U0001f600 smile. Best \U0001f600!", "q", "apples are the best", "rationale", "Primary", "headline:", "description:",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, d = random.Random(12), str(tmp_path_factory.mktemp("marked"))
    text = lambda n: "\n".join(rng.choice(LINES) for _ in range(n))
    docs = [(i, text(rng.randrange(14)), "en", "s", 1) for i in range(400)] + [(500, "", "en", "s", 0), (501, None, "en", "s", 0), (502, "\n\n", "en", "s", 2), (503, "word. " * 3000, "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    turns = [(c, k, ("user", "assistant", "system")[rng.randrange(7) % 3 if rng.random() < 0.1 else k % 2], rng.choice(LINES).replace("\x0b", " ")) for c in range(80) for k in range(rng.randrange(1, 9))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    pages = [(i, rng.choice(["http://a.de/x", "no host"]), text(rng.randrange(9))) for i in range(150)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.mark.parametrize("name", ["split_sentences_offsets", "parse_blocks", "block_sentences", "claim_records", "claim_offsets_check", "claim_excerpt", "faq_pairs", "ad_format_check"])
def test_rows_are_those_of_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert len(got) > 50 and sorted(map(str, got)) == sorted(map(str, want))


def test_no_shuffle(spark):
    d = spark.createDataFrame([(1, "Headline: x\nIt has 5 GB.")], "run_id long, text string")
    for df in (C.blocks(d), C.block_sentences(d), C.claim_records(d), C.own_offsets_check(d), C.claim_excerpt(d), C.faq_pairs(d), C.ad_format(d), C.text_sentences(d)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_offsets_hold_and_blocks_part_the_text():
    rng = random.Random(3)
    for _ in range(300):
        text = "\n".join(rng.choice(LINES) for _ in range(rng.randrange(12)))
        at = 0
        for _, _, start, end, body in P.blocks(text):
            assert at <= start and text[start:end] == body
            at = end
        for _, _, _, start, end, s, _ in P.block_sentences(text):
            assert text[start:end] == s == s.strip() and s


def test_meta_is_left_out_or_counted(spark):
    d = spark.createDataFrame([(1, "Headline:\nIt has 5 GB.\nRationale:\nThis cures insomnia.\nHeadline:\nBest offer.")], "run_id long, text string")
    ids = lambda df: [(r.claim_id, r.claim_kind) for r in df.orderBy("sent_index").collect()]
    assert ids(C.claim_records(d)) == [("1::sent000", "product_claim"), ("1::sent001", "product_claim")]
    assert ids(C.claim_records(d, include_meta=True)) == [("1::sent000", "product_claim"), ("1::sent001", "meta"), ("1::sent002", "product_claim")]


def test_wrong_offsets_are_counted(spark):
    d = spark.createDataFrame([(1, "abc def")], "run_id long, text string")
    c = spark.createDataFrame([(1, 0, 3, "abc"), (1, 4, 7, "xyz"), (1, 6, 9, "fgh"), (1, -1, 2, "ab")], "run_id long, start long, end long, sentence string")
    assert C.offsets_check(c, d).first()[1:] == (1, 3, 2)
    assert P.held("abc def", [r.asDict() for r in c.collect()]) == (1, 3, 2)


def test_long_texts_take_linear_time(spark):
    began = time.time()
    for text in ("A: yes.\n" * 100_000, "Word one. " * 100_000, "x" * 1_000_000, "\n" * 300_000, "Headline: x\n" * 100_000):
        for p in (P.blocks, P.block_sentences, P.faq_pairs, P.ad_sections):
            for _ in p(text):
                pass
    assert time.time() - began < 60


def test_nulls_repeats_and_empty_tables(spark):
    d = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "It has 5 GB.", 1), (3, "It has 5 GB.", 1), (None, "It has 5 GB.", 1)], "run_id long, text string, block int")
    assert sorted(((r.run_id or 0, r.kind, r.start, r.end, r.text) for r in C.blocks(d).collect()), key=str) == sorted([(1, "unknown", 0, None, None), (2, "unknown", 0, 0, "")] + [(i, "unknown", 0, 12, "It has 5 GB.") for i in (0, 3, 3)], key=str)
    assert C.claim_records(d).count() == 3 and C.own_offsets_check(d).count() == 3
    assert C.ad_format(d).where("not format_valid").count() == 5 and C.faq_pairs(d).count() == 0
    none = d.limit(0)
    assert [f(none).count() for f in (C.blocks, C.block_sentences, C.claim_records, C.own_offsets_check, C.claim_excerpt, C.faq_pairs, C.ad_format)] == [0] * 7
    assert C.text_sentences(d).where(~F.col("exact")).count() == 0
