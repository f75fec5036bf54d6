"""Periodic runs of words in documents, by recursive frequency splitting and a scan of lags.

A run of period q repeats every one of its words. So a word that occurs once in a segment of the
text is in none of the segment's runs and parts it; the parts are split again, as words that were
frequent in the whole may be single in a part. Prose falls to pieces shorter than a run. What
survives is scanned at each lag at a few anchors, one of which every run must hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CRC, table, words

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def segments(w: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """The ranges of word numbers in which every word occurs twice at least, of `least` words or more.

    A range is searched from both ends in growing steps, up to the first words to split at, so that
    the work follows the smaller part and stays within n log n for any text.
    """
    n = len(w)
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    before, after = np.full(n, -1), np.full(n, n)
    before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        step, left, right, cuts = 64, lo, hi, []
        while left < right and not cuts:
            to = min(left + step, right)
            back = max(right - step, to)
            for x, y in ((left, to), (back, right)):
                cuts += (x + np.flatnonzero((before[x:y] < lo) & (after[x:y] >= hi))).tolist()
            left, right, step = to, back, step * 2
        if cuts:
            todo += zip([lo, *[c + 1 for c in cuts]], [*cuts, hi], strict=True)
        else:
            yield lo, hi


class _Spans:
    """Names of all spans of 1, 2, 4, ... words: equal names, equal words."""

    def __init__(self, w: np.ndarray):
        self.names = [w.astype(np.int64)]

    def level(self, k: int) -> np.ndarray | None:
        """Names of spans of 2^k words; None where the text is shorter."""
        while len(self.names) <= k:
            last, half = self.names[-1], 1 << len(self.names) - 1
            if len(last) <= half:
                return None
            self.names.append(np.unique(last[:-half] * (int(last.max()) + 1) + last[half:], return_inverse=True)[1])
        return self.names[k]

    def reach(self, i: int, q: int) -> tuple[int, int]:
        """The widest [s, r) around i whose words all equal those q further on."""
        r, k, m = i, 0, len(self.names[0])
        while (g := self.level(k)) is not None and r + q + (1 << k) <= m and g[r] == g[r + q]:
            r, k = r + (1 << k), k + 1
        for k in range(k, -1, -1):
            if k < len(self.names) and r + q + (1 << k) <= m and self.names[k][r] == self.names[k][r + q]:
                r += 1 << k
        s, k = i, 0
        while (g := self.level(k)) is not None and s >= 1 << k and g[s - (1 << k)] == g[s - (1 << k) + q]:
            s, k = s - (1 << k), k + 1
        for k in range(k, -1, -1):
            if k < len(self.names) and s >= 1 << k and self.names[k][s - (1 << k)] == self.names[k][s - (1 << k) + q]:
                s -= 1 << k
        return s, r


def scan(w: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment.

    At lag q a run is a stretch of at least max(least - q, q) words that equal those q further on.
    Spans of half a stretch are compared at steps that no stretch can evade. A stretch whose extent
    a smaller period has already is no run of q.
    """
    m, spans, seen = len(w), _Spans(w), set()
    for q in range(1, m // 2 + 1):
        need = max(least - q, q)
        if need + q > m:
            continue
        k = max(0, need.bit_length() - 2)
        size, done = 1 << k, 0
        step, g = need - size + 1, spans.level(k)
        for i in (np.flatnonzero(g[: m - q - size + 1 : step] == g[q :: step]) * step).tolist():
            if i >= done:
                s, done = spans.reach(i, q)
                if done - s >= need and (s, done + q) not in seen:
                    seen.add((s, done + q))
                    yield s, done + q - s, q


def runs_of(w: list, least: int = 12) -> list[tuple[int, int, int]]:
    """The runs of a list of words, by start and period."""
    names: dict = {}
    ids = np.fromiter((names.setdefault(x, len(names)) for x in w), np.int64, len(w))
    if len(names) == len(w):
        return []
    return sorted((lo + s, n, q) for lo, hi in segments(ids, least) for s, n, q in scan(ids[lo:hi], least))


def collapse(w: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run repeats: of each run the first period stays."""
    if not runs:
        return w
    change = np.zeros(len(w) + 1, np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    return [x for x, gone in zip(w, np.cumsum(change[:-1]).tolist(), strict=True) if not gone]


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_words, runs, collapsed): every row's runs of at least `least`
    words and two periods, by start and period, and its words without repeats, joined by one space.

    A run is a stretch with a smallest period that no neighbouring word extends. Words part at ASCII
    white space and count byte by byte. Null and empty texts and those without words have no run and
    collapse to an empty text. Rows are judged one by one: repeated rows and null ids come back as
    often as they come in, other columns are ignored, an empty table gives an empty one. Texts of any
    length are read whole, in n log n steps; runs overlap and are all listed. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                sizes, found, ends, texts = [], [], [0], []
                for x in part.column(1):
                    w = x.as_buffer().to_pybytes().split() if x.is_valid else []
                    runs = runs_of(w, least)
                    sizes.append(len(w))
                    found += runs
                    ends.append(len(found))
                    texts.append(b" ".join(collapse(w, runs)))
                fields = np.array(found, np.int64).reshape(-1, 3)
                structs = pa.StructArray.from_arrays([pa.array(fields[:, k]) for k in range(3)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs), pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    found = rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in each tenth document, by hash of its id, all words from a place on repeat a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).alias("g"))
    d = d.withColumn("w", F.when(F.col("chosen"), words(F.col("text")))).withColumn("n", F.size("w"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    d = d.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    made = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), tail)
    return d.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("p"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), lines.alias("lines"), "collapsed")
    return out.select(
        "doc_id", "n_runs", F.col("b.s").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.p").alias("period"), F.floor(-1000 * F.col("b.l") / F.col("b.p")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


OP11_SQL = f"""
WITH ids AS (SELECT DISTINCT doc_id, {CRC.format("doc_id")} AS h FROM documents),
split AS (
    SELECT d.doc_id, h, h // 10 AS g, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents d JOIN ids USING (doc_id)),
parts AS (
    SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS chosen, CASE WHEN len(w) > 0 THEN g % len(w) END AS a,
        CASE WHEN len(w) > 0 THEN 1 + (len(w) - g % len(w)) // (3 + g % 8) END AS p FROM split),
numbered AS (
    SELECT doc_id, i, CASE WHEN chosen AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
    FROM (SELECT *, unnest(range(n)) AS i FROM parts)),
grams AS (
    SELECT doc_id, i, CASE WHEN lead(i, 5) OVER d IS NOT NULL THEN
        concat_ws(' ', word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d, lead(word, 4) OVER d, lead(word, 5) OVER d) END AS gram
    FROM numbered WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i),
stretches AS (
    SELECT doc_id, q, min(i) AS s, count(*) + 5 AS same
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, s AS start, same + q AS length, min(q) AS period FROM stretches WHERE same >= greatest(12 - q, q) GROUP BY doc_id, s, same + q),
digests AS (
    SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, p := period), struct_pack(l := -length, s := start, p := period)) AS b,
        string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM numbered ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.p::BIGINT AS period, (1000 * b.l // b.p)::BIGINT AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents LEFT JOIN digests USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
