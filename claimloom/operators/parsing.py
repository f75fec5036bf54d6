"""Marked-up texts parsed where they are scanned: every row is cut by one walk over its lines.

The parsers are generators over one text; `parsed` runs them in Arrow batches, so that no line of a
text leaves the stage of its scan and nothing is shuffled to bring lines together again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T

# Patterns that open a block, by lower-cased trimmed line (the headings: by the line), in order.
HEADERS = [
    ("ad_headline", r"^(ad\s+)?headline\s*[:|-]?"), ("ad_primary", r"^primary(\s+text)?\s*[:|-]?"), ("ad_description", r"^description\s*[:|-]?"),
    ("faq_question", r"^(\*\*)?q\d*\s*[:.-]?(\*\*)?|^question\s*[:|-]?"), ("faq_answer", r"^(\*\*)?a\d*\s*[:.-]?(\*\*)?|^answer\s*[:|-]?"),
    ("blog_title", r"^#\s+"), ("blog_heading", r"^##\s+"), ("disclaimers", r"^(\*\*)?disclaimers?\s*[:|-]?(\*\*)?"),
    ("meta", r"^(why\s+this\s+works|rationale|compliance\s+(rationale|notes)|analysis)\s*[:|-]?"),
]
# Openers of a question and of an answer in the pair parser.
QUESTION = r"^(Q:|\*\*Q:|Q1:|\*\*Q1:|\*\*What|\*\*How|\*\*Is|\*\*Are|\*\*Does|\*\*Can)"
ANSWER = r"^(A:|\*\*A:|A1:|\*\*A1:)"
#: Sections of an advertisement and what their lines begin with, in lower case.
SECTIONS = {"headline": ("headline:",), "primary": ("primary text:", "primary:"), "description": ("description:",)}

_GAP = re.compile(T.SENTENCE_GAP, re.ASCII)
_QUESTION, _ANSWER, _OVER = re.compile(QUESTION), re.compile(ANSWER), re.compile("Disclaimer|DISCLAIMER")

Parser = Callable[[str | None], Iterator[tuple]]


def parsed(docs: DataFrame, key: str, parse: Parser, schema: str, column: str = "text", keep: bool = False) -> DataFrame:
    """(key, text, ...) -> (key, fields of schema): what parse() yields for each text; without a shuffle.

    With keep, one row a text instead: (key, text, found array of the fields)."""
    rows = docs.select(key, F.col(column).cast("string").alias(column))
    fields = StructType.fromDDL(schema)
    out = StructType.fromDDL(f"found array<struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in fields)}>>") if keep else fields
    types, names = to_arrow_schema(fields), fields.names
    result = StructType([*rows.schema.fields[: 2 if keep else 1], *out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                found, ends = [], [0]
                for x in b.column(1):
                    found += parse(x.as_py())
                    ends.append(len(found))
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [()] * len(names), types.types, strict=True)]
                if keep:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(types)))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], result.names)
                else:
                    at_ = pa.array([i for i in range(len(b)) for _ in range(ends[i + 1] - ends[i])], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at_), *columns], result.names)

    return rows.mapInArrow(run, result)


_HEADS = [(kind, re.compile(p, re.ASCII), kind.startswith("blog")) for kind, p in HEADERS]


def _head(line: str, after: str) -> str | None:
    trimmed = line.strip(T.BLANKS)
    low = trimmed.lower()
    for kind, p, as_is in _HEADS:
        if p.match(line if as_is else low):
            return kind
    return "blog_disclaimers" if trimmed == "---" and "disclaimer" in after.lower() else None


def blocks(text: str | None) -> Iterator[tuple[int, str, int, int | None, str | None]]:
    """(block, kind, start, end, text) of the blocks of a text; see claims.blocks."""
    lines = text.split("\n") if text is not None else []
    any_, number, kind, family, start, at = False, 0, "unknown", "", 0, 0
    for i in range(len(lines) + 1):
        head = _head(lines[i], lines[i + 1] if i + 1 < len(lines) else "") if i < len(lines) else "end"
        if head:
            body = text[start : max(at - 1, start)] if text is not None else ""
            if body.strip(T.BLANKS):
                any_ = True
                yield number, kind, start, start + len(body), body
            if i < len(lines):
                number, start = number + 1, at + len(lines[i]) + 1
                kind = head if head != "disclaimers" else f"{family}_disclaimers" if family in ("ad", "faq") else "blog_disclaimers"
                family = family if head == "disclaimers" else head.split("_")[0]
        at += len(lines[i]) + 1 if i < len(lines) else 0
    if not any_:
        yield 0, "unknown", 0, None if text is None else len(text), text


def sentences(text: str | None) -> Iterator[tuple[int, int, str]]:
    """(start, end, sentence): trimmed, blank ones left out."""
    at = 0
    for gap in [*((m.start(), m.end()) for m in _GAP.finditer(text or "")), (len(text or ""), 0)]:
        piece = (text or "")[at : gap[0]]
        core = piece.strip(T.BLANKS)
        if core:
            start = at + len(piece) - len(piece.lstrip(T.BLANKS))
            yield start, start + len(core), core
        at = gap[1]


def block_sentences(text: str | None) -> Iterator[tuple[int, str, int, int, int, str, int | None]]:
    """(block, kind, sent, start, end, sentence, sent_index): the index counts those outside meta blocks."""
    n = 0
    for block, kind, at, _, body in blocks(text):
        for sent, (start, end, s) in enumerate(sentences(body)):
            yield block, kind, sent, at + start, at + end, s, None if kind == "meta" else n
            n += kind != "meta"


def faq_pairs(text: str | None) -> Iterator[tuple[int, str, str]]:
    """(pair, question, answer); see claims.faq_pairs."""
    pair, question, answers = 0, "", []
    for raw in [*(text or "").split("\n"), None]:
        line = raw.strip(T.BLANKS) if raw is not None else None
        if line is not None and (not line or line.startswith(("===", "---"))):
            continue
        over = line is None or _OVER.search(line)
        asked = not over and _QUESTION.match(line)
        if (over or asked) and question and answers:
            yield pair, question, " ".join(answers)
        if over:
            return
        clean = lambda x, line=line: re.sub(rf"{x}[1-5]?:", "", line.replace("**", "")).strip(T.BLANKS)
        if asked:
            pair, question, answers = pair + 1, clean("Q"), []
        elif pair and _ANSWER.match(line):
            answers.append(clean("A"))
        elif pair and not line.startswith("#"):
            answers.append(line)


def ad_sections(text: str | None) -> Iterator[tuple[str, ...]]:
    """One row: the content of each section; see claims.ad_format."""
    out, now, filled = dict.fromkeys(SECTIONS, ""), None, True
    for raw in (text or "").split("\n"):
        line = raw.strip(T.BLANKS)
        head = next((s for s, starts in SECTIONS.items() if line.lower().startswith(starts)), None)
        if head:
            now, filled, line = head, False, line.partition(":")[2].strip(" ")
        if line and not filled:
            out[now], filled = line, True
    yield tuple(out.values())


def held(text: str | None, spans: list[dict[str, Any]]) -> tuple[int, int, int]:
    """How many of the spans (start, end, sentence) hold their sentence, don't, or lie outside."""
    size = len(text or "")
    inside = [0 <= s["start"] and s["end"] <= size for s in spans]
    right = sum(i and text[s["start"] : s["start"] + len(s["sentence"])] == s["sentence"] for i, s in zip(inside, spans, strict=True))
    return right, len(spans) - right, len(spans) - sum(inside)
