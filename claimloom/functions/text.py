"""Column functions over text. All are built-in expressions: they stay in the JVM and need no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon


#: What \\s stands for.
BLANKS = " \t\n\x0b\f\r"


def sentences(text: Column) -> Column:
    """Split at runs of . ! ?, trimmed, empty ones dropped; a null text has none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), lambda s: F.btrim(s, F.lit(BLANKS))), lambda s: s != "")


def pieces(text: Column, separator: str) -> Column:
    """array<struct<start, end, piece>>: the text between separators, with exact offsets, blank pieces dropped and pieces trimmed."""
    none = F.array().cast("array<struct<start:int,end:int,piece:string>>")

    def walk(z: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            g = z["g"][i]
            core = F.regexp_replace(g, r"^\s+|\s+$", "")
            start = s["at"] + F.length(g) - F.length(F.regexp_replace(g, r"^\s+", ""))
            one = F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("piece"))
            after = s["at"] + F.length(g) + F.coalesce(F.length(F.get(z["s"], i)), F.lit(0))
            return F.struct(after.alias("at"), F.when(core == "", s["out"]).otherwise(F.concat(s["out"], F.array(one))).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(z["g"]) - 1), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])

    both = F.struct(F.split(text, separator, -1).alias("g"), F.regexp_extract_all(text, F.lit(separator), F.lit(0)).alias("s"))
    return F.transform(F.array(both), walk)[0]


#: Between sentences: white space after . ! ? before a capital, or line ends after . ! ?
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?])\n+"


def sentences_with_offsets(text: Column) -> Column:
    return pieces(F.coalesce(text, F.lit("")), SENTENCE_GAP)


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether the text holds a term; terms that hold another one need no look of their own."""
    out = F.lit(False)
    for t in terms:
        if not any(o in t and o != t for o in terms):
            out = out | F.contains(text, F.lit(t))
    return out


def any_of(patterns: Sequence[str]) -> str:
    """One expression for patterns that begin with \\b: it is tried at the beginnings of words alone, by their first letter."""
    by: dict[str, list[str]] = {}
    for p in patterns:
        by.setdefault(p[2], []).append(p[3:])
    return r"\b(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")"


def found(text: Column, patterns: Sequence[str]) -> Column:
    """Distinct matched phrases over all patterns, in pattern order, of a text in lower case; one expression screens the text first."""
    each = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns])
    return F.when(text.rlike(any_of(patterns)), F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def bias(text: Column, whitelist: Sequence[str] = ()) -> Column:
    """array<struct<severity, category, pattern, matches>>: a detection for each pattern with a match
    outside the whitelist. One expression screens the text, then one for each category."""
    text = F.lower(F.coalesce(text, F.lit("")))
    allowed = F.array(*[F.lit(w.lower()) for w in whitelist]).cast("array<string>")
    none = F.array().cast("array<struct<severity:string,category:string,pattern:string,matches:array<string>>>")
    low = lambda p: p.lower() if "FDIC" in p else p
    groups = []
    for severity, category, patterns in lexicon.BIAS:
        one = []
        for p in patterns:
            hits = F.filter(F.regexp_extract_all(text, F.lit(low(p)), F.lit(0)), lambda m: ~F.array_contains(allowed, m))
            one.append(F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(p).alias("pattern"), hits.alias("matches")))
        groups.append(F.when(text.rlike(any_of([low(p) for p in patterns])), F.filter(F.array(*one), lambda d: F.size(d["matches"]) > 0)).otherwise(none))
    return F.when(text.rlike(any_of([low(p) for _, _, ps in lexicon.BIAS for p in ps])), F.concat(*groups)).otherwise(none)


def severity_count(detections: Column, severity: str) -> Column:
    return F.size(F.filter(detections, lambda d: d["severity"] == severity))


def bias_score(high: Column, medium: Column, low: Column) -> Column:
    return F.least((10 * high + 5 * medium + 2 * low) * 2, F.lit(100))


def triggers(sentence: Column) -> Column:
    """The trigger tags of a claim; a claim verb counts beside another trigger only."""
    s = F.lower(sentence)
    anchors = F.array_compact(
        F.array(
            F.when(s.rlike(lexicon.NUMERIC), "numeric"), F.when(contains_any(s, lexicon.GUARANTEE), "guarantee"), F.when(contains_any(s, lexicon.MEDICAL), "medical"),
            F.when(contains_any(s, lexicon.FINANCIAL), "financial"), F.when(s.rlike(lexicon.COMPARATIVE), "comparative"),
        )
    )
    verb = s.rlike(r"(?<!\w)(?:" + "|".join(v for v in lexicon.CLAIM_VERBS if v.isalpha()) + r")(?!\w)")  # one word, as written
    return F.when((F.size(anchors) > 0) & verb, F.array_append(anchors, "claim_verb")).otherwise(anchors)


def anchored(text: Column) -> Column:
    """Whether triggers() finds any tag in a sentence; a text has one if one of its sentences does."""
    s = F.lower(text)
    return contains_any(s, [*lexicon.GUARANTEE, *lexicon.MEDICAL, *lexicon.FINANCIAL]) | s.rlike(lexicon.NUMERIC) | s.rlike(lexicon.COMPARATIVE)


def first_of(text: Column, table: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    """The first name with a term in the text."""
    out = None
    for name, terms in table:
        cond = contains_any(text, terms)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(otherwise)


def claim_category(claim: Column) -> Column:
    return first_of(F.lower(claim), lexicon.CATEGORIES, "general")


def violation_type(rule: Column, claim: Column) -> Column:
    return first_of(F.lower(F.concat_ws(" ", rule, claim)), lexicon.VIOLATION_TYPES, "Factual")


def text_kind(text: Column) -> Column:
    """prompt, output or unknown, by the markers in the first 500 characters; prompt markers win."""
    head = F.lower(F.substring(text, 1, 500))
    return F.when(contains_any(head, lexicon.PROMPT_MARKERS), "prompt").when(contains_any(head, lexicon.OUTPUT_MARKERS), "output").otherwise("unknown")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; 0 when b is empty."""
    return F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def match_form(text: Column) -> Column:
    """Lower case, punctuation out, one space between words."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), r"[^\w\s]", ""), r"\s+", " ")


def match_kind(claim: Column, rule: Column) -> Column:
    """exact, partial (one holds the other and is over 0.6 of its length) or none, of two match_form texts."""
    short, long = F.least(F.length(claim), F.length(rule)), F.greatest(F.length(claim), F.length(rule))
    inside = F.contains(rule, claim) | F.contains(claim, rule)
    return F.when(claim == rule, "exact").when(inside & (F.try_divide(short, long) > 0.6), "partial").otherwise("none")


def numbers(text: Column) -> Column:
    """array<struct<value, unit>> of all numbers followed by letters; a comma in a number is dropped."""
    p = F.lit(r"(\d+(?:[.,]\d+)?)\s*([A-Za-z]+)\b")
    values, units = F.regexp_extract_all(text, p, F.lit(1)), F.regexp_extract_all(text, p, F.lit(2))
    return F.zip_with(values, units, lambda v, u: F.struct(F.regexp_replace(v, ",", "").try_cast("double").alias("value"), u.alias("unit")))


def bare_numbers(text: Column) -> Column:
    """Numbers that no unit follows."""
    return F.regexp_extract_all(text, F.lit(r"\b\d+(?:\.\d+)?\b(?!\s*[a-zA-Z%])"), F.lit(0))


def unit_numbers(text: Column) -> Column:
    """array<struct<value string, unit>> over the closed list of units, in one spelling each."""
    p = F.lit(lexicon.NUMBER_WITH_UNIT)
    name = lambda u: F.when(u.isin("gram", "grams"), "grams").when(u.isin("c", "°c", "℃"), "°c").otherwise(u)
    return F.zip_with(F.regexp_extract_all(text, p, F.lit(1)), F.transform(F.regexp_extract_all(text, p, F.lit(2)), lambda u: name(F.lower(u))), lambda v, u: F.struct(v.alias("value"), u.alias("unit")))


def number_contradicts(claim: Column, spec: Column) -> Column:
    """A number of the claim has a unit of the spec but none of its values, compared as written. Both: unit_numbers."""
    return F.exists(claim, lambda n: F.exists(spec, lambda s: s["unit"] == n["unit"]) & ~F.exists(spec, lambda s: (s["unit"] == n["unit"]) & (s["value"] == n["value"])))


def reviewer_errors(text: Column) -> Column:
    """The lines of a review that list an error, by their markers; none if it finds no errors."""
    marks = ["- ", "1.", "2.", "3.", "* ", "Error:", "Incorrect:"]
    lines = F.filter(F.split(text, "\n"), lambda x: contains_any(x, marks))
    return F.when(F.contains(F.upper(text), F.lit("NO ERRORS FOUND")), F.array().cast("array<string>")).otherwise(lines)


def short_hash(text: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def time_slot(hour: Column, bands: Sequence[tuple[str, int, int]] = (("morning", 8, 12), ("afternoon", 12, 17)), otherwise: str = "evening") -> Column:
    out = None
    for name, start, end in bands:
        cond = (hour >= start) & (hour < end)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(otherwise)
