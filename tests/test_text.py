from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators import claims as C
from claimloom.operators import rules as R
from claimloom.plans import QUERIES


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_sentences_and_offsets(spark):
    assert one(spark, T.sentences(F.col("t")), t="One. Two!  Three?? ") == ["One", "Two", "Three"]
    text = "First one. Second one!\nthird. Fourth"
    got = one(spark, T.sentences_with_offsets(F.col("t")), t=text)
    assert [g.piece for g in got] == ["First one.", "Second one!", "third.", "Fourth"]
    assert all(text[g.start : g.end] == g.piece for g in got)


def test_triggers_need_an_anchor_for_verbs(spark):
    d = spark.createDataFrame([("It has 128 GB of storage",), ("It is nice",), ("Guaranteed to cure insomnia",), ("Better than the rest",)], "s string")
    got = [r.t for r in d.select(T.triggers(F.col("s")).alias("t")).collect()]
    assert got == [["numeric", "claim_verb"], [], ["guarantee", "medical"], ["comparative"]]


def test_bias_counts_patterns_not_matches(spark):
    d = spark.createDataFrame([(1, "The best, the best and certainly amazing. Always better than others."), (2, "Plain."), (3, None)], "run_id int, text string")
    got = {r.run_id: (r.high, r.medium, r.low, r.bias_score) for r in C.bias_report(d).collect()}
    assert got == {1: (2, 2, 1, 64), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0)}


def test_overclaims_whole_phrases(spark):
    assert one(spark, T.found(F.lower("t"), [r"\bbest\b", r"\bguaranteed?\b"]), t="Best best GUARANTEE guaranteed") == ["best", "guarantee", "guaranteed"]


def test_categories_and_kinds(spark):
    assert one(spark, T.claim_category(F.col("t")), t="6.5 inch OLED") == "display"
    assert one(spark, T.claim_category(F.col("t")), t="nothing here") == "general"
    assert one(spark, T.violation_type(F.col("r"), F.col("c")), r="cannot be both", c="x") == "Feature hallucination"
    assert one(spark, T.text_kind(F.col("t")), t="Discover ... hard rules: none") == "prompt"
    assert one(spark, T.short_hash(F.col("t")), t="a") == "ca978112ca1b"


def test_numbers(spark):
    assert [(n.value, n.unit) for n in one(spark, T.numbers(F.col("t")), t="3,5 mg and 6.1 inch")] == [(35.0, "mg"), (6.1, "inch")]
    assert one(spark, T.bare_numbers(F.col("t")), t="5 mg, 7, 8%") == ["7"]
    claim, spec = T.unit_numbers(F.col("a")), T.unit_numbers(F.col("b"))
    assert one(spark, T.number_contradicts(claim, spec), a="RAM of 16 GB", b="8 GB or 12 GB LPDDR5X") is True
    assert one(spark, T.number_contradicts(claim, spec), a="RAM of 12 GB", b="8 GB or 12 GB LPDDR5X") is False
    assert one(spark, T.number_contradicts(claim, spec), a="5.0 GB", b="5 GB") is True  # as written


AD = "Headline: Fast\nPrimary Text:\nIt is the best.\nDescription: Buy\nDisclaimers:\nTerms apply. Always."


def test_blocks_of_an_advertisement(spark):
    d = spark.createDataFrame([(1, AD), (2, "no marks"), (3, "")], "run_id int, text string")
    got = C.blocks(d).orderBy("run_id", "block").collect()
    assert [(r.run_id, r.kind, r.text) for r in got] == [(1, "ad_primary", "It is the best."), (1, "ad_disclaimers", "Terms apply. Always."), (2, "unknown", "no marks"), (3, "unknown", "")]
    assert all(AD[r.start : r.end] == r.text for r in got if r.run_id == 1)


def test_claims_keep_spans(spark):
    d = spark.createDataFrame([(1, AD)], "run_id int, text string")
    c = C.claim_records(d)
    rows = c.orderBy("sent_index").collect()
    assert [(r.claim_id, r.claim_kind) for r in rows] == [("1::sent000", "product_claim"), ("1::sent002", "disclaimer")]
    assert C.offsets_check(c, d).first()[1:] == (2, 0, 0)


def test_faq_pairs(spark):
    text = "Q: One?\nA: Yes.\nMore.\n\n---\n**What is two?**\nA1: It is.\nDisclaimer: none\nQ: Never?\nA: no"
    got = C.faq_pairs(spark.createDataFrame([(1, text)], "run_id int, text string")).orderBy("pair").collect()
    assert [(r.question, r.answer) for r in got] == [("One?", "Yes. More."), ("What is two?", "It is.")]


def test_ad_format(spark):
    got = C.ad_format(spark.createDataFrame([(1, AD), (2, "x"), (3, "Headline: " + "h" * 41)], "run_id int, text string")).orderBy("run_id").collect()
    assert (got[0].headline, got[0].primary, got[0].description, got[0].format_valid, got[0].any_limit_exceeded) == ("Fast", "It is the best.", "Buy", True, False)
    assert not got[1].format_valid and got[2].headline_exceeds


def brute_ad(text):
    """The sections of one text, line by line."""
    out, section = {"headline": "", "primary": "", "description": ""}, None
    for line in text.split("\n"):
        x = line.strip(" \t\r\v\f")
        head = next((k for h, k in (("headline:", "headline"), ("primary text:", "primary"), ("primary:", "primary"), ("description:", "description")) if x.lower().startswith(h)), None)
        if head:
            section, out[head] = head, x.split(":", 1)[1].strip(" ")
        elif x and section and not out[section]:
            out[section] = x
    return out


def test_ad_query_reads_whole_pages(spark, tmp_path):
    pages = [(1, "http://a.de/x", "<p>" + "long " * 500 + "</p>\nmore"), (2, "http://b.de/", "\n \n" + "y" * 201), (3, "http://c.de/z", "short"), (4, "http://d.de/", "z" * 300 + "\nHeadline: new\n" + "t" * 300)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.run_id: r for r in QUERIES["ad_format_check"](spark, str(tmp_path)).collect()}
    for i, url, html in pages:
        want = brute_ad(f"Headline: {url}\nPrimary text:\n{html}\nDescription: {url.split('/')[2]}")
        assert {k: got[i][k] for k in want} == want and got[i].primary_length == len(want["primary"])


def test_screening_order(spark):
    s = spark.createDataFrame([(1, "p", 0, "this one is long enough to count as claim"), (1, "p", 1, "red blue"), (1, "p", 2, "another one that is long enough to count"), (2, "p", 0, "red green")], "run_id int, product_id string, pos int, sentence string")
    r = spark.createDataFrame([("p", "authorized", 0, "red blue"), ("p", "prohibited", 1, "red green")], "product_id string, rule_type string, rule_idx int, rule_text string")
    got = {(x.run_id, x.pos, x.decision) for x in R.screen(s, r, 0.6).collect()}
    assert got == {(1, 0, "Unsupported"), (1, 1, "Supported"), (2, 0, "Contradicted")}


def test_match_kinds(spark):
    c = spark.createDataFrame([(1, "p", "Red ring!"), (2, "p", "the red rings"), (3, "p", "blue")], "claim_id int, product_id string, claim string")
    r = spark.createDataFrame([("p", 0, "red ring"), ("p", 1, "ring")], "product_id string, rule_idx int, rule_text string")
    assert {x.claim_id: x.match for x in R.best_match(c, r).collect()} == {1: "exact", 2: "partial", 3: "none"}


def test_token_set_ratio(spark):
    d = spark.createDataFrame([("a b c", "c b"), ("abc", "abd"), ("", "x")], "a string, b string")
    assert [round(r.x, 2) for r in d.select(R.token_set_ratio("a", "b").alias("x")).collect()] == [100.0, 66.67, 0.0]


def test_number_validation(spark):
    p = spark.createDataFrame([(1000.0, "mg", 1.0, "g"), (2.0, "g", 1.0, "g"), (1.0, "cm", 1.0, "g"), (1.0, "zz", 1.0, "ZZ"), (1.0, "g", 0.0, "g")], "claim_value double, claim_unit string, spec_value double, spec_unit string")
    got = R.validate_numbers(p, R.units_table(spark)).collect()
    assert {(r.claim_value, r.claim_unit, r.spec_value): r.valid for r in got} == {(1000.0, "mg", 1.0): True, (2.0, "g", 1.0): False, (1.0, "cm", 1.0): False, (1.0, "zz", 1.0): True, (1.0, "g", 0.0): False}


def test_premise(spark):
    r = spark.createDataFrame([("p", "authorized", "", 0, "A"), ("p", "spec", "display", 0, "6 in"), ("p", "spec", "display", 1, "7 in")], "product_id string, rule_type string, category_path string, rule_idx int, rule_text string")
    assert R.premise(r).first().premise == "AUTHORIZED:\n- A\n\nPROHIBITED:\n(none)\n\nSPECS:\n- display: 6 in\n- display: 7 in\n\nDISCLAIMERS:\n(none)"


def test_equal_claims_meet_rules_once(spark, monkeypatch):
    met, join = [], R.containment_join
    monkeypatch.setattr(R, "containment_join", lambda a, b, *how: (met.append((a.count(), b.count())), join(a, b, *how))[1])
    c = spark.createDataFrame([(i, "p", "Large ring." if i % 2 else "old PLATE") for i in range(40)], "claim_id long, product_id string, claim string")
    r = spark.createDataFrame([(j, "p", "large ring") for j in range(30, 0, -1)], "rule_idx long, product_id string, rule_text string")
    assert {(x.claim_id % 2, x.match, x.rule_idx) for x in R.best_match(c, r).collect()} == {(1, "exact", 1), (0, "none", None)}
    assert met == [(2, 1)]
