"""From texts to claims: blocks, sentences, question-answer pairs, advertisement sections."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from . import parsing
from .parsing import parsed

def sentences(docs: DataFrame, *keep: str, key: str = "run_id") -> DataFrame:
    """(key, text) -> (key, columns to keep, pos, sentence)."""
    return docs.select(key, *keep, F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def text_sentences(docs: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, text) -> (key, pos, start, end, sentence, exact): sentences of whole texts, blocks or not, with
    exact offsets; `exact` says that the text holds the sentence there. Linear in the text."""
    each = lambda text: ((n, a, b, s, text[a:b] == s) for n, (a, b, s) in enumerate(parsing.sentences(text)))
    return parsed(docs, key, each, "pos int, start long, end long, sentence string, exact boolean")


def blocks(docs: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, text) -> (key, block, kind, start, end, text) of the marked-up blocks of each text.

    A header line opens a block and is not part of it; disclaimers belong to the family of the block
    before; `---` before a line about disclaimers opens blog disclaimers. Blank blocks are dropped,
    and a text without any is one block of kind unknown; of a null text, with a null end. The end is the
    start plus the length. Rows are parsed one by one in the scan's stage, whole, in linear time.
    """
    return parsed(docs, key, parsing.blocks, "block long, kind string, start long, end long, text string")


SENTENCE = "block long, kind string, sent int, start long, end long, sentence string, sent_index int"


def block_sentences(docs: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, text) -> the sentences of each block with offsets in the whole text."""
    return parsed(docs, key, parsing.block_sentences, SENTENCE).drop("sent_index")


def claim_records(docs: DataFrame, include_meta: bool = False, key: str = "run_id") -> DataFrame:
    """Candidate claims: sentences with a trigger. The index counts all sentences outside meta blocks,
    or with include_meta all."""
    s = parsed(docs, key, _numbered if include_meta else parsing.block_sentences, SENTENCE).where("sent_index is not null")
    s = s.withColumn("trigger_types", T.triggers(F.col("sentence"))).where(F.size("trigger_types") > 0)
    kind = F.when(F.contains("kind", F.lit("disclaimer")), "disclaimer").when(F.col("kind") == "meta", "meta").otherwise("product_claim")
    return s.select(key, F.format_string("%s::sent%03d", F.col(key).cast("string"), F.col("sent_index")).alias("claim_id"), "sentence", "sent_index", "start", "end", "trigger_types", F.col("kind").alias("block_kind"), kind.alias("claim_kind"))


def _numbered(text: str | None) -> Iterator[tuple]:
    return ((*s[:-1], n) for n, s in enumerate(parsing.block_sentences(text)))


def _with_claims(docs: DataFrame, key: str) -> DataFrame:
    """(key, text, claims array) of the texts that have claims."""
    p = parsed(docs, key, parsing.block_sentences, SENTENCE, keep=True)
    claims = F.filter("found", lambda s: s["sent_index"].isNotNull() & T.anchored(s["sentence"]))
    return p.withColumn("claims", claims).where(F.size("claims") > 0).drop("found")


def offsets_check(claims: DataFrame, docs: DataFrame, key: str = "run_id") -> DataFrame:
    """For each text: claims (of any table) whose span holds their sentence, and those whose doesn't, or lies outside."""
    j = claims.join(docs.select(key, "text"), key)
    inside = (F.col("start") >= 0) & (F.col("end") <= F.length("text"))
    right = inside & (F.substring("text", F.col("start").cast("int") + 1, F.length("sentence")) == F.col("sentence"))
    return j.groupBy(key).agg(F.count_if(right).alias("n_right"), F.count_if(~right).alias("n_wrong"), F.count_if(~inside).alias("n_outside"))


def own_offsets_check(docs: DataFrame, key: str = "run_id") -> DataFrame:
    """The same of the claims that claim_records() finds in each text, in the scan's stage; texts without claims have no row."""
    x = _with_claims(docs, key).select(key, "text", F.transform("claims", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["sentence"].alias("sentence"))).alias("claims"))
    out = StructType([x.schema[key], *StructType.fromDDL("n_right long, n_wrong long, n_outside long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [parsing.held(t.as_py(), c.as_py()) for t, c in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in n], pa.int64()) for k in range(3))], out.names)

    return x.mapInArrow(run, out)


def claim_excerpt(docs: DataFrame, margin: int = 200, most: int = 1500, key: str = "run_id") -> DataFrame:
    """The window from `margin` before the first claim to `margin` after the last if it fits `most`, else head and tail of the text."""
    j = _with_claims(docs, key).select(key, "text", F.array_min(F.transform("claims", lambda c: c["start"])).alias("a"), F.array_max(F.transform("claims", lambda c: c["end"])).alias("b"))
    a, b = F.greatest(F.col("a") - margin, F.lit(0)), F.least(F.col("b") + margin, F.length("text"))
    window = F.substring("text", a.cast("int") + 1, (b - a).cast("int"))
    ends = F.concat(F.substring("text", 1, most // 2), F.lit("\n...\n"), F.right("text", F.lit(most // 2)))
    return j.select(key, F.when(b - a <= most, window).otherwise(ends).alias("excerpt"))


def faq_pairs(docs: DataFrame, key: str = "run_id") -> DataFrame:
    """Question and answer pairs by lines; a line about disclaimers ends the text, other lines continue the answer."""
    return parsed(docs, key, parsing.faq_pairs, "pair int, question string, answer string")


def ad_format(docs: DataFrame, limits: dict[str, int] | None = None, key: str = "run_id") -> DataFrame:
    """Headline, primary text and description of an advertisement, their lengths and limits. The next
    non-blank line fills a section whose header line is bare; of repeated headers the last with content counts."""
    limits = limits or {"headline": 40, "primary": 125, "description": 30}
    wide = parsed(docs, key, parsing.ad_sections, ", ".join(f"{s} string" for s in parsing.SECTIONS))
    out = wide.withColumns({f"{s}_length": F.length(s) for s in limits} | {f"{s}_exceeds": F.length(s) > n for s, n in limits.items()})
    return out.withColumn("format_valid", (F.col("headline") != "") & (F.col("primary") != "") & (F.col("description") != "")).withColumn("any_limit_exceeded", F.col("headline_exceeds") | F.col("primary_exceeds") | F.col("description_exceeds"))


def joined_texts(docs: DataFrame, group: str, order: str = "run_id") -> DataFrame:
    """One document for each group, its texts in order. The groups are documents themselves and must
    fit a row; use it on filtered sets."""
    g = docs.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("ts"))
    return g.select(group, F.size("ts").alias("n_texts"), F.array_join(F.transform("ts", lambda x: x["text"]), "\n\n").alias("text"))


def bias_report(docs: DataFrame, key: Column | str = "run_id") -> DataFrame:
    d = docs.select(key, T.bias(F.col("text")).alias("found"))
    h, m, low = (T.severity_count(F.col("found"), s) for s in ("High", "Medium", "Low"))
    return d.select(key, F.size("found").alias("n_patterns"), h.alias("high"), m.alias("medium"), low.alias("low"), T.bias_score(h, m, low).alias("bias_score"))
