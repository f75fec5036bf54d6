"""Queries over texts: splitting, lexicons, categories, matching, numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from ..operators import claims as C
from ..operators import parsing as P
from ..operators import rules as R
from ..operators import similarity as S
from ..operators import token_sets as TS
from ..sources.scratch import spread
from . import tables as t
from .registry import query


def _any(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{x.replace(chr(39), chr(39) * 2)}')" for x in terms) + ")"


def _case(column: str, table: list[tuple[str, list[str]]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(column, terms)} THEN '{name}'" for name, terms in table) + f" ELSE '{otherwise}' END"


def _wide(p: str) -> str:
    """A pattern whose word ends hold for all alphabets, as Java's do, with the phrase as group 1."""
    head, tail = (r"(?:^|[^\pL\pN_])" if p[2].isalnum() else r"\b"), (r"(?:$|[^\pL\pN_])" if p[-3] != "%" else r"\b")
    return f"{head}({p[2:-2]}){tail}"


def _found(patterns: list[str]) -> str:
    return "list_distinct(flatten([" + ", ".join(f"regexp_extract_all(lower(text), '{_wide(p)}', 1, 'i')" for p in patterns) + "]))"


BIAS_SQL = "[" + ", ".join(f"{{'s': '{s}', 'n': len(regexp_extract_all(lower(text), '{_wide(p.lower() if 'FDIC' in p else p)}', 0))}}" for s, _, ps in lexicon.BIAS for p in ps) + "]"
TRIGGERS_SQL = f"""[CASE WHEN regexp_matches(lower(sentence), '{lexicon.NUMERIC[4:]}', 'i') THEN 'numeric' END, CASE WHEN {_any('lower(sentence)', lexicon.GUARANTEE)} THEN 'guarantee' END,
    CASE WHEN {_any('lower(sentence)', lexicon.MEDICAL)} THEN 'medical' END, CASE WHEN {_any('lower(sentence)', lexicon.FINANCIAL)} THEN 'financial' END, CASE WHEN regexp_matches(lower(sentence), '(?:^|[^\\pL\\pN_])(?:better|faster|more|less|superior|best|number one|leading|top)(?:$|[^\\pL\\pN_])') THEN 'comparative' END]"""
VERBS_SQL = "[" + ", ".join(f"'{v}'" for v in lexicon.CLAIM_VERBS) + "]"


@query("split_sentences_simple", "SELECT run_id, pos, sentence FROM sentences", "docs", "sentences")
def split_sentences_simple(spark, d):
    return C.sentences(t.docs(spark, d))


BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
HEADS = " ".join(f"WHEN regexp_matches({'line' if k.startswith('blog') else 'low'}, '{p}') THEN '{k}'" for k, p in P.HEADERS)
LINES = f"""lines AS (SELECT *, trim(line, {BLANK}) AS trimmed, lower(trim(line, {BLANK})) AS low, lead(line) OVER w AS nxt, coalesce(sum(length(line) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
    FROM (SELECT run_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM docs) WINDOW w AS (PARTITION BY run_id ORDER BY no))"""
BLOCKS = f"""{LINES},
heads AS (SELECT *, CASE {HEADS} WHEN trimmed = '---' AND contains(lower(nxt), 'disclaimer') THEN 'blog_disclaimers' END AS head FROM lines),
named AS (SELECT *, CASE WHEN head <> 'disclaimers' THEN head WHEN head IS NOT NULL THEN CASE WHEN family IN ('ad', 'faq') THEN family || '_disclaimers' ELSE 'blog_disclaimers' END END AS kind
    FROM (SELECT *, last_value(CASE WHEN head <> 'disclaimers' THEN split_part(head, '_', 1) END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY no) AS family FROM heads)),
counted AS (SELECT *, count(kind) OVER (PARTITION BY run_id ORDER BY no) AS block FROM named),
bodies AS (SELECT run_id, block, min(off) AS start, string_agg(line, chr(10) ORDER BY no) AS text FROM counted WHERE kind IS NULL GROUP BY ALL HAVING trim(string_agg(line, chr(10) ORDER BY no), {BLANK}) <> ''),
blocks AS (
    SELECT b.run_id, b.block, coalesce(c.kind, 'unknown') AS kind, CAST(b.start AS BIGINT) AS start, CAST(b.start + length(b.text) AS BIGINT) AS "end", b.text FROM bodies b LEFT JOIN counted c ON b.run_id = c.run_id AND b.block = c.block AND c.kind IS NOT NULL
    UNION ALL SELECT run_id, 0, 'unknown', 0, length(text), text FROM docs ANTI JOIN bodies USING (run_id))"""
#: A mark after the punctuation that ends a sentence; white space stays with the pieces, which are trimmed.
CUT = r"string_split(regexp_replace(regexp_replace({0}, '([.!?])(\s+[A-Z])', '\1' || chr(1) || '\2', 'g'), '([.!?])(\n)', '\1' || chr(1) || '\2', 'g'), chr(1))"


def _pieces(source: str, key: str, text: str, at: str = "0") -> str:
    """Sentences of the rows of a table with their offsets, numbered by the rows' key."""
    return f"""SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY no) - 1 AS INTEGER) AS sent, CAST(first + length(piece) - length(ltrim(piece, {BLANK})) AS BIGINT) AS start,
    CAST(first + length(piece) - length(ltrim(piece, {BLANK})) + length(trim(piece, {BLANK})) AS BIGINT) AS "end", trim(piece, {BLANK}) AS sentence
    FROM (SELECT *, off + coalesce(sum(length(piece)) OVER (PARTITION BY {key} ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
    FROM (SELECT {key}, {at} AS off, unnest({CUT.format(text)}) AS piece, generate_subscripts({CUT.format(text)}, 1) AS no FROM {source})) WHERE trim(piece, {BLANK}) <> ''"""


SENTENCES = f"""{BLOCKS}, cut AS ({_pieces("blocks", "run_id, block, kind", "text", "start")})"""
RECORDS = f"""{SENTENCES}, told AS (SELECT *, list_filter({TRIGGERS_SQL}, lambda x: x IS NOT NULL) AS a, row_number() OVER (PARTITION BY run_id ORDER BY block, sent) - 1 AS sent_index FROM cut WHERE kind <> 'meta'),
records AS (SELECT *, CASE WHEN list_has_any(regexp_extract_all(lower(sentence), '\\w+', 0), {VERBS_SQL}) THEN list_append(a, 'claim_verb') ELSE a END AS trigger_types FROM told WHERE len(a) > 0)"""


@query("split_sentences_offsets", f"""WITH {t.CTE["docs"]}, s AS ({_pieces("docs", "run_id", "text")}) SELECT run_id, sent AS pos, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", sentence, true AS exact FROM s""")
def split_sentences_offsets(spark, d):
    s = C.text_sentences(t.docs(spark, d))
    return s.select("run_id", "pos", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "sentence", "exact")


@query("parse_blocks", f"WITH {t.CTE['docs']}, {BLOCKS} SELECT * FROM blocks")
def parse_blocks(spark, d):
    return C.blocks(t.docs(spark, d))


@query("block_sentences", f"WITH {t.CTE['docs']}, {SENTENCES} SELECT * FROM cut")
def block_sentences(spark, d):
    return C.block_sentences(t.docs(spark, d))


@query(
    "claim_triggers",
    f"""SELECT run_id, pos, array_to_string(CASE WHEN len(a) > 0 AND list_has_any(regexp_extract_all(lower(sentence), '\\w+', 0), {VERBS_SQL}) THEN list_append(a, 'claim_verb') ELSE a END, ',') AS tags
    FROM (SELECT run_id, pos, sentence, list_filter({TRIGGERS_SQL}, lambda x: x IS NOT NULL) AS a FROM sentences) WHERE len(a) > 0""",
    "docs", "sentences",
)
def claim_triggers(spark, d):
    s = C.sentences(t.docs(spark, d)).withColumn("tags", T.triggers(F.col("sentence"))).where(F.size("tags") > 0)
    return s.select("run_id", "pos", F.array_join("tags", ",").alias("tags"))


@query(
    "claim_records",
    f"""WITH {t.CTE['docs']}, {RECORDS} SELECT run_id, run_id || '::sent' || lpad(sent_index::VARCHAR, CAST(greatest(3, length(sent_index::VARCHAR)) AS INTEGER), '0') AS claim_id, sentence, CAST(sent_index AS INTEGER) AS sent_index, start, "end", array_to_string(trigger_types, ',') AS trigger_types, kind AS block_kind,
    CASE WHEN contains(kind, 'disclaimer') THEN 'disclaimer' ELSE 'product_claim' END AS claim_kind FROM records""",
)
def claim_records(spark, d):
    return C.claim_records(t.docs(spark, d)).withColumn("trigger_types", F.array_join("trigger_types", ","))


@query(
    "claim_offsets_check",
    f"""WITH {t.CTE['docs']}, {RECORDS} SELECT run_id, count(*) FILTER (held) AS n_right, count(*) FILTER (NOT held) AS n_wrong, count(*) FILTER (NOT inside) AS n_outside
    FROM (SELECT run_id, start >= 0 AND "end" <= length(text) AS inside, substring(text, start + 1, length(sentence)) = sentence AS held FROM records JOIN docs USING (run_id)) GROUP BY run_id""",
)
def claim_offsets_check(spark, d):
    return C.own_offsets_check(t.docs(spark, d))


@query(
    "claim_excerpt",
    f"""WITH {t.CTE['docs']}, {RECORDS}, span AS (SELECT run_id, greatest(min(start) - 200, 0) AS a, max("end") + 200 AS b FROM records GROUP BY run_id)
    SELECT run_id, CASE WHEN least(b, length(text)) - a <= 1500 THEN substring(text, a + 1, least(b, length(text)) - a) ELSE left(text, 750) || chr(10) || '...' || chr(10) || right(text, 750) END AS excerpt FROM span JOIN docs USING (run_id)""",
)
def claim_excerpt(spark, d):
    return C.claim_excerpt(t.docs(spark, d))


def _faq(spark, d):
    """Conversations as question and answer texts."""
    turns = t.load(spark, d, "conversations").where("role <> 'system'")
    line = F.concat(F.when(F.col("role") == "user", "Q: ").otherwise("A: "), F.regexp_replace("text", r"\s+", " "))
    g = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return g.select(F.col("conv_id").alias("run_id"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


FAQ_LINES = f"""docs AS (SELECT conv_id AS run_id, string_agg(CASE role WHEN 'user' THEN 'Q: ' ELSE 'A: ' END || regexp_replace(text, '\\s+', ' ', 'g'), chr(10) ORDER BY turn) AS text FROM conversations WHERE role <> 'system' GROUP BY conv_id),
{LINES}, told AS (SELECT run_id, no, trimmed AS line, regexp_matches(trimmed, '{P.QUESTION}') AS is_q FROM lines WHERE trimmed <> '' AND NOT starts_with(trimmed, '===') AND NOT starts_with(trimmed, '---')),
upto AS (SELECT *, max(CAST(regexp_matches(line, 'Disclaimer|DISCLAIMER') AS INTEGER)) OVER (PARTITION BY run_id ORDER BY no) AS over FROM told),
paired AS (SELECT *, sum(CAST(is_q AS INTEGER)) OVER (PARTITION BY run_id ORDER BY no) AS pair FROM upto WHERE over = 0),
said AS (SELECT *, trim(CASE WHEN is_q THEN regexp_replace(replace(line, '**', ''), 'Q[1-5]?:', '', 'g') WHEN regexp_matches(line, '{P.ANSWER}') THEN regexp_replace(replace(line, '**', ''), 'A[1-5]?:', '', 'g') WHEN NOT starts_with(line, '#') THEN line END, {BLANK}) AS part FROM paired WHERE pair > 0)"""


@query("faq_pairs", f"WITH {FAQ_LINES} SELECT run_id, CAST(pair AS INTEGER) AS pair, max(part) FILTER (is_q) AS question, string_agg(part, ' ' ORDER BY no) FILTER (NOT is_q) AS answer FROM said WHERE part IS NOT NULL GROUP BY run_id, pair HAVING max(part) FILTER (is_q) <> '' AND count(*) FILTER (NOT is_q) > 0")
def faq_pairs(spark, d):
    return C.faq_pairs(_faq(spark, d))


AD_LINES = f"""docs AS (SELECT page_id AS run_id, 'Headline: ' || url || chr(10) || 'Primary text:' || chr(10) || html || chr(10) || 'Description: ' || regexp_extract(url, '//([^/]*)', 1) AS text FROM pages),
{LINES}, told AS (SELECT run_id, no, trimmed, CASE WHEN starts_with(low, 'headline:') THEN 'headline' WHEN starts_with(low, 'primary text:') OR starts_with(low, 'primary:') THEN 'primary' WHEN starts_with(low, 'description:') THEN 'description' END AS head FROM lines WHERE trimmed <> ''),
turns AS (SELECT *, count(head) OVER w AS turn, last_value(head IGNORE NULLS) OVER w AS section FROM told WINDOW w AS (PARTITION BY run_id ORDER BY no)),
own AS (SELECT run_id, section, turn, no, CASE WHEN head IS NOT NULL THEN trim(regexp_replace(trimmed, '^[^:]*:', '')) ELSE trimmed END AS own FROM turns WHERE turn > 0),
parts AS (SELECT run_id, section, turn, arg_min(own, no) AS own FROM own WHERE own <> '' GROUP BY ALL),
wide AS (SELECT run_id, coalesce(arg_max(own, turn) FILTER (section = 'headline'), '') AS headline, coalesce(arg_max(own, turn) FILTER (section = 'primary'), '') AS primary_, coalesce(arg_max(own, turn) FILTER (section = 'description'), '') AS description FROM docs LEFT JOIN parts USING (run_id) GROUP BY run_id)"""


@query(
    "ad_format_check",
    f"""WITH {AD_LINES} SELECT run_id, headline, primary_ AS primary, description, length(headline) AS headline_length, length(primary_) AS primary_length, length(description) AS description_length, length(headline) > 40 AS headline_exceeds, length(primary_) > 125 AS primary_exceeds,
    length(description) > 30 AS description_exceeds, headline <> '' AND primary_ <> '' AND description <> '' AS format_valid, length(headline) > 40 OR length(primary_) > 125 OR length(description) > 30 AS any_limit_exceeded FROM wide""",
)
def ad_format_check(spark, d):
    p = t.load(spark, d, "pages")
    text = F.concat(F.lit("Headline: "), F.col("url"), F.lit("\nPrimary text:\n"), F.col("html"), F.lit("\nDescription: "), F.regexp_extract("url", "//([^/]*)", 1))
    return C.ad_format(p.select(F.col("page_id").alias("run_id"), text.alias("text")))


@query(
    "response_parse",
    r"""SELECT conv_id, turn, len(e) > 0 AS errors_found, len(e) AS error_count, array_to_string(e, '|') AS errors FROM (SELECT conv_id, turn, CASE WHEN contains(upper(text), 'NO ERRORS FOUND') THEN [] ELSE
    list_filter(string_split(text, chr(10)), lambda x: contains(x, '- ') OR contains(x, '1.') OR contains(x, '2.') OR contains(x, '3.') OR contains(x, '* ') OR contains(x, 'Error:') OR contains(x, 'Incorrect:')) END AS e FROM conversations)""",
)
def response_parse(spark, d):
    e = T.reviewer_errors(F.col("text"))
    return t.load(spark, d, "conversations").select("conv_id", "turn", (F.size(e) > 0).alias("errors_found"), F.size(e).cast("long").alias("error_count"), F.array_join(e, "|").alias("errors"))


@query("concat_group_texts", "SELECT conv_id, count(*) AS n_texts, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM (SELECT DISTINCT conv_id, turn, text FROM conversations) GROUP BY conv_id")
def concat_group_texts(spark, d):
    x = t.load(spark, d, "conversations").select("conv_id", F.col("turn").alias("run_id"), "text").distinct()
    return C.joined_texts(x, "conv_id").select("conv_id", F.col("n_texts").cast("long").alias("n_texts"), "text")


@query("bias_detect", f"SELECT run_id, len(list_filter(b, lambda x: x.n > 0)) AS n_patterns FROM (SELECT run_id, {BIAS_SQL} AS b FROM docs)", "docs")
def bias_detect(spark, d):
    return C.bias_report(t.docs(spark, d)).select("run_id", F.col("n_patterns").cast("long").alias("n_patterns"))


@query(
    "bias_score",
    f"""SELECT run_id, h AS high, m AS medium, l AS low, least((10 * h + 5 * m + 2 * l) * 2, 100) AS bias_score FROM (SELECT run_id, len(list_filter(b, lambda x: x.n > 0 AND x.s = 'High')) AS h,
    len(list_filter(b, lambda x: x.n > 0 AND x.s = 'Medium')) AS m, len(list_filter(b, lambda x: x.n > 0 AND x.s = 'Low')) AS l FROM (SELECT run_id, {BIAS_SQL} AS b FROM docs))""",
    "docs",
)
def bias_score(spark, d):
    b = C.bias_report(t.docs(spark, d))
    return b.select("run_id", *[F.col(c).cast("long").alias(c) for c in ("high", "medium", "low", "bias_score")])


@query("overclaim_detect", f"SELECT run_id, array_to_string(list_sort({_found(lexicon.OVERCLAIMS)}), ',') AS phrases FROM docs", "docs")
def overclaim_detect(spark, d):
    return t.docs(spark, d).select("run_id", F.array_join(F.array_sort(T.found(F.lower("text"), lexicon.OVERCLAIMS)), ",").alias("phrases"))


WORDS = "list_distinct(regexp_extract_all(lower({}), '\\w+', 0))"
RULE_WORDS = f"rw AS (SELECT *, {WORDS.format('rule_text')} AS rule_words FROM rules WHERE rule_type IN ('authorized', 'prohibited')), sw AS (SELECT *, {WORDS.format('sentence')} AS words FROM sentences)"
JACCARD = "len(list_intersect(words, rule_words)) / len(list_distinct(list_concat(words, rule_words)))"


@query(
    "jaccard_match",
    f"WITH {t.CTE['docs']}, {t.CTE['sentences']}, {t.CTE['rules']}, {RULE_WORDS} SELECT run_id, pos, rule_idx, round({JACCARD}, 6) AS similarity FROM sw JOIN rw USING (product_id) WHERE {JACCARD} >= 0.3",
)
def jaccard_match(spark, d):
    s = C.sentences(t.docs(spark, d), "product_id").select("run_id", "product_id", "pos", T.word_set(F.col("sentence")).alias("words"))
    r = t.rules(spark, d).where("rule_type in ('authorized', 'prohibited')").withColumn("rule_words", T.word_set(F.col("rule_text")))
    return S.jaccard_join(s, r, ["product_id"], threshold=0.3).select("run_id", "pos", "rule_idx", F.round("similarity", 6).alias("similarity"))


@query(
    "screen_claims",
    f"""WITH {t.CTE['docs']}, {t.CTE['sentences']}, {t.CTE['rules']}, {RULE_WORDS},
    firsts AS (SELECT run_id, pos, rule_type, arg_min(rule_text, rule_idx) AS matched FROM sw JOIN rw USING (product_id) WHERE {JACCARD} >= 0.3 GROUP BY run_id, pos, rule_type),
    fm AS (SELECT run_id, min(pos) AS first_match FROM firsts GROUP BY run_id),
    lone AS (SELECT run_id, min(pos) AS p, arg_min(sentence, pos) AS s FROM sentences WHERE len(list_filter(string_split_regex(sentence, '\\s+'), lambda x: x <> '')) > 5 GROUP BY run_id)
    SELECT run_id, pos, CASE rule_type WHEN 'prohibited' THEN 'Contradicted' ELSE 'Supported' END AS decision, matched FROM firsts
    UNION ALL SELECT run_id, p, 'Unsupported', s FROM lone LEFT JOIN fm USING (run_id) WHERE first_match IS NULL OR p < first_match""",
)
def screen_claims(spark, d):
    s = C.sentences(t.docs(spark, d), "product_id")
    return R.screen(s, t.rules(spark, d), 0.3)


@query("fuzzy_token_set")
def fuzzy_token_set(spark, d):
    """The rules that are alike: every pair with a token set ratio of 60 or more."""
    r = t.load(spark, d, "benchmark").select(F.col("item_id").alias("x"), F.lit(0).alias("one"), "text")
    p = TS.token_set_join(r, r.select(F.col("x").alias("y"), "one", F.col("text").alias("rule_text")), ["one"], "x", ["y"], least=60.0)
    return p.where("x < y").select("x", "y", F.round("ratio", 4).alias("ratio"))


@query("rule_hit_rate")
def rule_hit_rate(spark, d):
    """Every document against the rules of its language."""
    docs, rules = t.docs(spark, d), t.rules(spark, d)
    return R.hit_rates(docs, rules, R.rule_hits(docs, rules))


FORM = r"regexp_replace(regexp_replace(regexp_replace(lower({}), '^\s+|\s+$', '', 'g'), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')"
KIND = "CASE WHEN f = rf THEN 'exact' WHEN (contains(rf, f) OR contains(f, rf)) AND least(length(f), length(rf)) / nullif(greatest(length(f), length(rf)), 0) > 0.6 THEN 'partial' ELSE 'none' END"
PART_CLAIMS = "pc AS (SELECT p_partkey AS claim_id, p_brand AS product_id, p_name AS claim FROM part), pr AS (SELECT row_number() OVER (ORDER BY p_brand, p_name) AS rule_idx, p_brand AS product_id, rule_text FROM (SELECT DISTINCT p_brand, p_name, {} AS rule_text FROM part WHERE p_size > 25))"


def _part_claims(spark, d):
    return t.load(spark, d, "part").select(F.col("p_partkey").alias("claim_id"), F.col("p_brand").alias("product_id"), F.col("p_name").alias("claim"))


def _part_rules(spark, d, text):
    """The names of large parts of a brand as its rules, numbered inside the brand."""
    from pyspark.sql import Window

    r = t.load(spark, d, "part").where("p_size > 25").select(F.col("p_brand").alias("product_id"), "p_name", text.alias("rule_text")).distinct()
    return r.select("product_id", "rule_text", F.row_number().over(Window.partitionBy("product_id").orderBy("p_name")).alias("rule_idx"))


def _match_sql(rule: str) -> str:
    r = f"SELECT product_id, rule_text, row_number() OVER (PARTITION BY product_id ORDER BY p_name) AS rule_idx FROM (SELECT DISTINCT p_brand AS product_id, p_name, {rule} AS rule_text FROM part WHERE p_size > 25)"
    m = f"SELECT claim_id, min(rule_idx) AS rule_idx, arg_min(kind, rule_idx) AS match FROM (SELECT claim_id, rule_idx, {KIND} AS kind FROM (SELECT c.p_partkey AS claim_id, r.rule_idx, {FORM.format('c.p_name')} AS f, {FORM.format('r.rule_text')} AS rf FROM part c JOIN ({r}) r ON c.p_brand = r.product_id)) WHERE kind <> 'none' GROUP BY claim_id"
    return f"SELECT p_partkey AS claim_id, coalesce(m.match, 'none') AS match, m.rule_idx FROM part LEFT JOIN ({m}) m ON p_partkey = m.claim_id"


@query("match_type", _match_sql("'The ' || p_name || '.'"))
def match_type(spark, d):
    return R.best_match(_part_claims(spark, d), _part_rules(spark, d, F.concat(F.lit("The "), "p_name", F.lit("."))))


@query(
    "match_uplift",
    f"""WITH o AS ({_match_sql("'The very fine ' || p_name || '.'")}), n AS ({_match_sql("p_name")})
    SELECT count(*) AS n, count(*) FILTER (o.match = 'exact') AS old_exact, count(*) FILTER (o.match = 'partial') AS old_partial, count(*) FILTER (o.match = 'none') AS old_none,
    count(*) FILTER (n.match = 'exact') AS new_exact, count(*) FILTER (n.match = 'partial') AS new_partial, count(*) FILTER (n.match = 'none') AS new_none, count(*) FILTER (o.match <> 'none') / count(*) AS old_rate, count(*) FILTER (n.match <> 'none') / count(*) AS new_rate,
    count(*) FILTER ((CASE n.match WHEN 'exact' THEN 3 WHEN 'partial' THEN 2 ELSE 1 END) > (CASE o.match WHEN 'exact' THEN 3 WHEN 'partial' THEN 2 ELSE 1 END)) AS improved FROM o JOIN n USING (claim_id)""",
)
def match_uplift(spark, d):
    c = _part_claims(spark, d)
    return R.match_uplift(R.best_match(c, _part_rules(spark, d, F.concat(F.lit("The very fine "), "p_name", F.lit(".")))), R.best_match(c, _part_rules(spark, d, F.col("p_name"))))


@query("policy_substring", "SELECT p_partkey AS claim_id, p_name AS claim FROM part WHERE EXISTS (SELECT 1 FROM part r WHERE r.p_brand = part.p_brand AND r.p_size > 25 AND (contains(lower(part.p_name), lower(r.p_name)) OR contains(lower(r.p_name), lower(part.p_name))))")
def policy_substring(spark, d):
    return R.policy_hits(_part_claims(spark, d), _part_rules(spark, d, F.col("p_name")).withColumn("rule_type", F.lit("prohibited"))).select("claim_id", "claim")


NUMBERS = r"(\d+(?:[.,]\d+)?)\s*([A-Za-z]+)(?:$|[^\pL\pN_])"


@query(
    "numeric_extract",
    rf"SELECT run_id, TRY_CAST(replace(v, ',', '') AS DOUBLE) AS value, lower(u) AS unit FROM (SELECT run_id, unnest(regexp_extract_all(text, '{NUMBERS}', 1)) AS v, unnest(regexp_extract_all(text, '{NUMBERS}', 2)) AS u FROM docs)", "docs",
)
def numeric_extract(spark, d):
    return R.exploded_numbers(t.docs(spark, d), "run_id").select("run_id", "value", "unit")


def _measures(spark, d):
    """Quantities in mg or g against sizes in g."""
    l, p = t.load(spark, d, "lineitem"), t.load(spark, d, "part")
    unit = F.when(F.col("l_returnflag") == "A", "mg").when(F.col("l_returnflag") == "N", "g").otherwise("cm")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("run_id"), F.col("l_quantity").alias("claim_value"), unit.alias("claim_unit"), F.col("p_size").cast("double").alias("spec_value"), F.lit("g").alias("spec_unit"))


@query(
    "numeric_validate",
    """SELECT run_id, claim_value, claim_unit, spec_value, round(CASE claim_unit WHEN 'mg' THEN abs(claim_value / 1000 - spec_value) / spec_value WHEN 'g' THEN abs(claim_value - spec_value) / spec_value END, 6) AS relative_error,
    coalesce(CASE claim_unit WHEN 'mg' THEN abs(claim_value / 1000 - spec_value) / spec_value WHEN 'g' THEN abs(claim_value - spec_value) / spec_value END <= 0.05, false) AS valid
    FROM (SELECT l_orderkey AS run_id, l_quantity AS claim_value, CASE l_returnflag WHEN 'A' THEN 'mg' WHEN 'N' THEN 'g' ELSE 'cm' END AS claim_unit, CAST(p_size AS DOUBLE) AS spec_value FROM lineitem JOIN part ON l_partkey = p_partkey)""",
)
def numeric_validate(spark, d):
    v = R.validate_numbers(_measures(spark, d), R.units_table(spark))
    return v.select("run_id", "claim_value", "claim_unit", "spec_value", F.round("relative_error", 6).alias("relative_error"), "valid")


def _numbers(spark, d):
    l = t.load(spark, d, "lineitem")
    # few bytes of numbers make many rows: every core gets its share of them
    return spread(l, "l_orderkey").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("p"), (F.col("l_suppkey") % 20).cast("string")).alias("product_id"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("value"), F.lower("l_returnflag").alias("unit"))


def _specs(spark, d):
    s = t.load(spark, d, "supplier")
    unit = F.when(F.col("s_nationkey") % 3 == 0, "a").when(F.col("s_nationkey") % 3 == 1, "n").otherwise("r")
    return s.select(F.concat(F.lit("p"), (F.col("s_suppkey") % 20).cast("string")).alias("product_id"), F.floor(F.col("s_acctbal") / 200).cast("double").alias("value"), unit.alias("unit"), F.col("s_suppkey").alias("rule_idx"), F.lit(0).alias("ord"))


NS = """n AS (SELECT l_orderkey AS run_id, 'p' || CAST(l_suppkey % 20 AS VARCHAR) AS product_id, l_linenumber AS ord, l_quantity AS value, lower(l_returnflag) AS unit FROM lineitem),
s AS (SELECT 'p' || CAST(s_suppkey % 20 AS VARCHAR) AS product_id, floor(s_acctbal / 200) AS spec_value, CASE s_nationkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'n' ELSE 'r' END AS spec_unit, s_suppkey AS rule_idx FROM supplier)"""


@query("numeric_vs_spec", f"WITH {NS} SELECT run_id, ord, value, unit, spec_value FROM n JOIN s ON n.product_id = s.product_id AND unit = spec_unit WHERE coalesce(abs(value - spec_value) / nullif(spec_value, 0) > 0.05, true)")
def numeric_vs_spec(spark, d):
    return R.number_errors(_numbers(spark, d), _specs(spark, d)).select("run_id", "ord", "value", "unit", "spec_value")


@query("unit_vs_spec", f"WITH {NS} SELECT run_id, ord, value, unit, spec_value, spec_unit FROM n JOIN s ON n.product_id = s.product_id AND unit <> spec_unit AND abs(value - spec_value) < 10")
def unit_vs_spec(spark, d):
    return R.unit_errors(_numbers(spark, d), _specs(spark, d)).select("run_id", "ord", "value", "unit", "spec_value", "spec_unit")


@query(
    "numeric_last_spec",
    f"""WITH {NS}, l AS (SELECT product_id, spec_unit, arg_max(spec_value, rule_idx) AS expected FROM s GROUP BY ALL)
    SELECT run_id, ord, value, unit, expected, round(CASE WHEN expected <> 0 THEN abs(value - expected) / expected * 100 ELSE 0 END, 4) AS error_pct FROM n JOIN l ON n.product_id = l.product_id AND unit = spec_unit WHERE abs(value - expected) > 0.01""",
)
def numeric_last_spec(spark, d):
    return R.last_spec_errors(_numbers(spark, d), _specs(spark, d)).select("run_id", "ord", "value", "unit", "expected", F.round("error_pct", 4).alias("error_pct"))


NUMBER_AND_NEXT = r"\b(\d+)(\.\d+)?\b([\s\x0B]*[a-zA-Z%])?"  # a whole part remains of a fraction before a unit


@query(
    "missing_units",
    f"""SELECT run_id, CAST(len(l) AS INTEGER) AS n, l[1:3] AS examples FROM (SELECT run_id, list_filter(list_transform(regexp_extract_all(text, '{NUMBER_AND_NEXT}'), lambda x: CASE WHEN NOT regexp_matches(x, '[a-zA-Z%]$') THEN x
    WHEN contains(x, '.') THEN regexp_extract(x, '^[0-9]+') END), lambda x: x IS NOT NULL) AS l FROM docs)""", "docs",
)
def missing_units(spark, d):
    n = T.bare_numbers(F.col("text"))
    return t.docs(spark, d).select("run_id", F.size(n).alias("n"), F.slice(n, 1, 3).alias("examples"))


@query("numbers_with_units", rf"SELECT run_id, regexp_extract(p_name, '[a-z]+') AS w, len(regexp_extract_all(x, '{lexicon.NUMBER_WITH_UNIT[4:]}', 1, 'i')) AS n FROM (SELECT p_partkey AS run_id, p_name, p_name || ' ' || p_size || ' GB and ' || p_size || 'MP' AS x FROM part)")
def numbers_with_units(spark, d):
    p = t.load(spark, d, "part")
    x = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.lit("GB and"), F.concat(F.col("p_size").cast("string"), F.lit("MP")))
    return p.select(F.col("p_partkey").alias("run_id"), F.regexp_extract("p_name", "[a-z]+", 0).alias("w"), F.size(T.unit_numbers(x)).cast("long").alias("n"))


@query(
    "numeric_contradiction",
    "SELECT l_orderkey AS run_id, l_linenumber AS pos, l_quantity AS q, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) NOT IN (CAST(p_size AS VARCHAR), '12') GROUP BY ALL",
)
def numeric_contradiction(spark, d):
    l, p = t.load(spark, d, "lineitem"), t.load(spark, d, "part")
    claim = F.concat(F.lit("it has "), F.col("l_quantity").cast("long").cast("string"), F.lit(" GB"))
    spec = F.concat(F.col("p_size").cast("string"), F.lit(" GB or 12 GB"))
    j = l.join(p, F.col("l_partkey") == F.col("p_partkey")).where(T.number_contradicts(T.unit_numbers(claim), T.unit_numbers(spec)))
    return j.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("q")).agg(F.count("*").alias("n"))


@query("claim_category", f"SELECT category, count(*) AS n FROM (SELECT {_case('lower(sentence)', lexicon.CATEGORIES, 'general')} AS category FROM sentences) GROUP BY category", "docs", "sentences")
def claim_category(spark, d):
    return C.sentences(t.docs(spark, d)).groupBy(T.claim_category(F.col("sentence")).alias("category")).agg(F.count("*").alias("n"))


@query("violation_type", f"SELECT type, count(*) AS n FROM (SELECT {_case('lower(sentence)', lexicon.VIOLATION_TYPES, 'Factual')} AS type FROM (SELECT product_id || ' ' || sentence AS sentence FROM sentences)) GROUP BY type", "docs", "sentences")
def violation_type(spark, d):
    s = C.sentences(t.docs(spark, d)).join(t.docs(spark, d).select("run_id", "product_id"), "run_id")
    return s.groupBy(T.violation_type(F.col("product_id"), F.col("sentence")).alias("type")).agg(F.count("*").alias("n"))


@query("text_kind", f"SELECT run_id, CASE WHEN {_any('lower(substring(text, 1, 500))', lexicon.PROMPT_MARKERS)} THEN 'prompt' WHEN {_any('lower(substring(text, 1, 500))', lexicon.OUTPUT_MARKERS)} THEN 'output' ELSE 'unknown' END AS kind FROM docs", "docs")
def text_kind(spark, d):
    return t.docs(spark, d).select("run_id", T.text_kind(F.col("text")).alias("kind"))


@query("text_hash", "SELECT run_id, substring(sha256(text), 1, 12) AS h12, substring(sha256(text), 1, 16) AS h16, sha1(text) AS s1, md5(text) AS m5 FROM docs", "docs")
def text_hash(spark, d):
    x = F.col("text")
    return t.docs(spark, d).select("run_id", T.short_hash(x).alias("h12"), T.short_hash(x, 16).alias("h16"), F.sha1(x).alias("s1"), F.md5(x).alias("m5"))


@query(
    "premise_build",
    """SELECT product_id, 'AUTHORIZED:' || chr(10) || coalesce(string_agg('- ' || rule_text, chr(10) ORDER BY rule_idx) FILTER (rule_type = 'authorized'), '(none)') || chr(10) || chr(10) || 'PROHIBITED:' || chr(10) || coalesce(string_agg('- ' || rule_text, chr(10) ORDER BY rule_idx) FILTER (rule_type = 'prohibited'), '(none)')
    || chr(10) || chr(10) || 'SPECS:' || chr(10) || coalesce(string_agg('- ' || rule_text, chr(10) ORDER BY rule_idx) FILTER (rule_type = 'spec'), '(none)') || chr(10) || chr(10) || 'DISCLAIMERS:' || chr(10) || coalesce(string_agg('- ' || rule_text, chr(10) ORDER BY rule_idx) FILTER (rule_type = 'disclaimer'), '(none)') AS premise FROM rules GROUP BY product_id""",
    "rules",
)
def premise_build(spark, d):
    return R.premise(t.rules(spark, d).withColumn("category_path", F.lit("")))


@query(
    "run_metrics",
    """SELECT run_id, hit_rate, unsupported_rate, contradiction_rate FROM (SELECT o_orderkey AS run_id, coalesce(avg(CASE l_returnflag WHEN 'A' THEN 1.0 ELSE 0.0 END) FILTER (l_orderkey IS NOT NULL), 0.0) AS hit_rate,
    coalesce(avg(CASE l_returnflag WHEN 'N' THEN 1.0 ELSE 0.0 END) FILTER (l_orderkey IS NOT NULL), 0.0) AS unsupported_rate, coalesce(avg(CASE l_returnflag WHEN 'R' THEN 1.0 ELSE 0.0 END) FILTER (l_orderkey IS NOT NULL), 0.0) AS contradiction_rate FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)""",
)
def run_metrics(spark, d):
    dec = t.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") == "A", "Supported").when(F.col("l_returnflag") == "N", "Unsupported").otherwise("Contradicted").alias("decision"))
    return R.run_metrics(t.runs(spark, d), dec).select("run_id", "hit_rate", "unsupported_rate", "contradiction_rate")


@query(
    "run_decision",
    "SELECT run_id, CASE WHEN contradiction_rate > 0 OR n_errors > 5 THEN 'Contradicted' WHEN n_violations > 3 THEN 'Unsupported' WHEN hit_rate >= 0.7 THEN 'Supported' WHEN hit_rate >= 0.3 THEN 'Ambiguous' ELSE 'Unsupported' END AS decision FROM evals",
    "evals",
)
def run_decision(spark, d):
    e = t.evals(spark, d).select("run_id", "contradiction_rate", F.greatest(F.col("n_errors") - 5, F.lit(0)).alias("numeric_errors"), F.col("n_violations").alias("n_overclaims"), "hit_rate")
    return R.run_decision(e).select("run_id", "decision")


@query(
    "flagship",
    f"""WITH {t.CTE['docs']}, {t.CTE['sentences']}, b AS (SELECT run_id, engine, product_id, least((10 * len(list_filter(b, lambda x: x.n > 0 AND x.s = 'High')) + 5 * len(list_filter(b, lambda x: x.n > 0 AND x.s = 'Medium')) + 2 * len(list_filter(b, lambda x: x.n > 0 AND x.s = 'Low'))) * 2, 100) AS bias,
    len({_found(lexicon.OVERCLAIMS)}) AS over FROM (SELECT *, {BIAS_SQL} AS b FROM docs)),
    c AS (SELECT run_id, count(*) AS n_sentences, count(*) FILTER (len(list_filter({TRIGGERS_SQL}, lambda x: x IS NOT NULL)) > 0) AS n_claims FROM sentences GROUP BY run_id)
    SELECT engine, product_id, count(*) AS n_runs, CAST(sum(coalesce(n_sentences, 0)) AS BIGINT) AS n_sentences, CAST(sum(coalesce(n_claims, 0)) AS BIGINT) AS n_claims, round(avg(bias), 4) AS mean_bias, CAST(sum(over) AS BIGINT) AS n_overclaims FROM b LEFT JOIN c USING (run_id) GROUP BY engine, product_id""",
)
def flagship(spark, d):
    """Which engine and product over-claims most: claims, bias and over-claims of every text, without a
    shuffle before the small roll-up. Sentences are looked at one by one only in texts that have a claim at all."""
    x = t.docs(spark, d).select("engine", "product_id", "text", T.sentences(F.col("text")).alias("s"))
    claims = F.when(T.anchored(F.col("text")), F.size(F.filter("s", T.anchored))).otherwise(0)
    x = x.select("engine", "product_id", F.size("s").alias("n_sentences"), claims.alias("n_claims"), T.bias(F.col("text")).alias("bias"), F.size(T.found(F.lower("text"), lexicon.OVERCLAIMS)).alias("over"))
    h, m, low = (T.severity_count(F.col("bias"), k) for k in ("High", "Medium", "Low"))
    return x.groupBy("engine", "product_id").agg(F.count("*").alias("n_runs"), F.sum("n_sentences").alias("n_sentences"), F.sum("n_claims").alias("n_claims"), F.round(F.avg(T.bias_score(h, m, low)), 4).alias("mean_bias"), F.sum("over").alias("n_overclaims"))
