"""Benchmark decontamination by templates: re-parameterised questions count as leaks too.

Numbers, names and units of documents and benchmark items become typed placeholders. Windows of
template tokens are hash-joined; a Bloom filter of the benchmark's windows keeps the documents'
other windows out of the shuffle. What the slots hold is then compared: within one alignment of
document and item every value of the item must stand for one value of the document. Items without
a window that says enough are looked for as they stand.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import Spool, table

WINDOW = 8
#: Literal words that a window needs, so that placeholders alone don't match; shorter items need all but two.
LITERALS = 4
#: Within an alignment the place of a window, document against item, moves by fewer tokens than this.
DRIFT = 16

#: Units and currencies that count as a typed placeholder; add to them for other fields.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds ounce ounces ml l liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years percent degrees dollar dollars cent cents euro euros yen rupees "
    "mph kmh watt watts volt volts gb mb kb byte bytes".split()
)
_ONES = "one two three four five six seven eight nine".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: Words that are numbers. One that follows a number is part of it ("two hundred", "3 million").
NUMBERS = frozenset(
    ["zero", *_ONES, *_TENS, *(f"{t}-{o}" for t in _TENS for o in _ONES)]
    + "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion".split()
)
#: What a word is. A capital may open a sentence; a known name is one wherever it stands and however it is written.
_LITERAL, _NUM, _UNIT, _KNOWN, _CAP, _SKIP = range(6)
_TAG = ["", "<num>", "<unit>", "<name>", "<name>"]
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)

_BYTE = np.arange(256)
_SPACE = np.isin(_BYTE, [32, *range(9, 14)])
_DIGIT = (_BYTE >= 48) & (_BYTE < 58)
_INNER = _DIGIT | np.isin(_BYTE, list(b".,:/"))  # what a number may hold
_LETTER = ((_BYTE >= 65) & (_BYTE < 91)) | ((_BYTE >= 97) & (_BYTE < 123)) | (_BYTE >= 128)
_CLOSER = np.isin(_BYTE, list(b".!?:"))
_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Hashes of spans from differences of sums of powers, so that any span costs the same."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(values)
        if len(self.up) <= n:
            step = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, b, np.uint64)]))
            self.up, self.down = step(_BASE), step(pow(_BASE, -1, 1 << 64))
        c = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=c[1:])
        x = (c[end] - c[start]) * self.down[start]
        x ^= x >> np.uint64(32)
        x *= _MIX
        x ^= x >> np.uint64(29)
        return x


class _Set:
    """64-bit hashes and a table of their first 16 bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.may = np.unique(hashes), np.zeros(1 << 16, bool)
        self.may[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.may[(h >> np.uint64(48)).astype(np.int64)])
        return at[np.isin(h[at], self.hashes)] if len(at) else at


class Templates:
    """Words of whole texts to template tokens, by array operations over their bytes. names: known names in lower case."""

    def __init__(self, names: Collection[str] = (), at_once: int = 1 << 20):
        self.powers, self.at_once = Powers(), at_once
        self.numbers, self.units, self.names = (_Set(np.array([self._hash(x.encode()) for x in s], np.uint64)) for s in (NUMBERS, UNITS, names))
        self.tags = np.array([self._hash(t.encode() + b"\x00") for t in _TAG], np.uint64)

    def _hash(self, word: bytes) -> int:
        v = _VALUE[np.frombuffer(word, np.uint8)]
        return int(self.powers.spans(v, np.zeros(1, np.int64), np.full(1, len(v)))[0])

    def _words(self, low: bytes, raw: bytes, opens: bool) -> tuple[list[np.ndarray], bool]:
        """Of one piece of text, lower-cased and as it is: the words' starts and ends, those of their
        cores without marks at either end, kinds and hashes; and whether a capital after the piece
        may be no name, as `opens` says of its first."""
        b, o = np.frombuffer(low, np.uint8), np.frombuffer(raw, np.uint8)

        def count(m: np.ndarray) -> np.ndarray:
            c = np.zeros(len(m) + 1, np.int32)
            np.cumsum(m, dtype=np.int32, out=c[1:])
            return c

        edge = np.diff(np.concatenate([[True], _SPACE[b], [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
        letter = _LETTER[b]
        if not low.isascii():  # quotes, dashes and signs of more than one byte
            for lead, second in ((0xE2, 0x80), (0xC2, None), (0xE3, 0x80)):
                at = np.flatnonzero(b[:-1] == lead)
                at = at if second is None else at[b[at + 1] == second]
                for k in range(2 if second is None else 3):
                    letter[np.minimum(at + k, len(b) - 1)] = False
        digit = _DIGIT[b]
        core = letter | digit
        places, before = np.flatnonzero(core), count(core)
        has = before[end] > before[start]
        places = np.append(places, 0)
        c0 = np.where(has, places[np.minimum(before[start], len(places) - 1)], start)
        c1 = np.where(has, places[np.maximum(before[end] - 1, 0)] + 1, end)
        h = self.powers.spans(_VALUE[b], c0, c1)
        kind = np.where(has, _LITERAL, _SKIP).astype(np.int8)
        digits, letters = count(digit), count(letter)
        num = np.flatnonzero(has & digit[np.minimum(c0, len(b) - 1)]) if len(b) else np.zeros(0, np.int64)
        if len(num):
            last = np.append(np.flatnonzero(digit), 0)[digits[c1[num]] - 1] + 1  # after its last digit
            inner = count(_INNER[b])
            fits = (inner[last] - inner[c0[num]] == last - c0[num]) & (c1[num] - last <= 3) & (letters[c1[num]] - letters[last] == c1[num] - last)
            kind[num[fits]] = _NUM
        changed = b != o
        caps = count(changed)
        cap = np.flatnonzero(has & changed[np.minimum(c0, len(b) - 1)] | (has & (caps[c1] > caps[c0]) & (b[np.minimum(c0, len(b) - 1)] >= 128))) if len(b) else np.zeros(0, np.int64)
        if len(cap):
            size, one = c1[cap] - c0[cap], np.where(b[c0[cap]] < 128, 1, 2)
            only = (caps[c1[cap]] - caps[np.minimum(c0[cap] + one, c1[cap])] == 0) & (size > one) & (digits[c1[cap]] == digits[c0[cap]])
            kind[cap[only]] = _CAP
        closer = count(_CLOSER[b])
        closes = np.where(has, closer[end] > closer[c1], closer[end] > closer[start])
        first, line = np.full(len(start), opens), count(b == 10)
        if len(start):
            first[0] |= line[start[0]] > 0
            first[1:] = closes[:-1] | (line[start[1:]] > line[end[:-1]])
        opens = bool(closes[-1] or line[-1] > line[end[-1]]) if len(start) else bool(opens or line[-1])
        for kinds, known in ((_NUM, self.numbers), (_UNIT, self.units), (_KNOWN, self.names)):
            at = known(h)
            at = at[(kind[at] == _LITERAL) | (kind[at] == _CAP)]
            kind[at] = kinds
        kind[(kind == _CAP) & ~first] = _KNOWN
        return [start, end, c0, c1, kind, h], opens

    def read(self, texts: list[bytes]) -> tuple[bytes, list[np.ndarray], np.ndarray]:
        """-> all texts in lower case, the words' starts, ends, starts and ends of cores, kinds and hashes, and each word's text."""
        low = []
        for t in texts:
            x = t.lower() if t.isascii() else t.decode("utf-8", "replace").lower().encode()
            low.append(x if len(x) == len(t) else t.lower())
        all_low, all_raw, ends = b"\n".join(low) + b"\n", b"\n".join(texts) + b"\n", np.cumsum([len(t) + 1 for t in texts])
        got, at, opens = [], 0, True
        while at < len(all_low):
            to = len(all_low) if len(all_low) - at <= self.at_once else max(all_low.rfind(b" ", at, at + self.at_once), all_low.rfind(b"\n", at, at + self.at_once)) + 1
            if to <= at:  # a word longer than a piece
                to = min([p + 1 for p in (all_low.find(b" ", at), all_low.find(b"\n", at)) if p >= 0])
            piece, opens = self._words(all_low[at:to], all_raw[at:to], opens)
            got.append([x + at if k < 4 else x for k, x in enumerate(piece)])
            at = to
        words = [np.concatenate(x) for x in zip(*got, strict=True)]
        cuts = np.searchsorted(words[0], ends)
        return all_low, words, np.repeat(np.arange(len(texts)), np.diff(cuts, prepend=0))

    def windows(self, h: np.ndarray, size: int) -> np.ndarray:
        """The 64-bit hashes of all windows."""
        at = np.arange(max(0, len(h) - size + 1))
        return self.powers.spans(h, at, at + size) if len(at) else np.zeros(0, np.uint64)

    def found(self, texts: list[bytes], sizes: Collection[int] | None, filled: np.ndarray | None, whole: dict[int, np.ndarray] | None = None) -> Iterator[tuple]:
        """(text, place, place when joined, hash, template, slots, tokens of the text) of windows of the
        sizes (None: of one text, WINDOW or all its tokens), where the filter lets them through; then of
        the windows as they stand, by their sizes, with place -1.

        A text is read twice: word by word, and with names or numbers of several words joined to one
        token each. A window has a place in the readings it belongs to; a text with nothing to join has
        the first only. Joined places count with capitals that open sentences as words."""
        buf, (start, end, c0, c1, kinds, raw), owner = self.read(texts)
        use = np.flatnonzero(kinds != _SKIP)
        kind, h, text = kinds[use], raw[use], owner[use]
        b = np.frombuffer(buf, np.uint8)
        line = np.concatenate([[0], np.cumsum(b == 10, dtype=np.int32)])
        word = lambda i: buf[c0[i] : c1[i]].decode("utf-8", "replace")
        opening, spelled = kind == _CAP, (kind == _NUM) & ~_DIGIT[b[c0[use]]]
        # words with nothing but spaces between them may be one name or number
        i, j = use[:-1], use[1:]
        glued = np.append(False, (j - i == 1) & (owner[i] == owner[j]) & (end[i] == c1[i]) & (start[j] == c0[j]) & (line[start[j]] == line[end[i]])) if len(use) else np.zeros(0, bool)

        def inner(k: np.ndarray) -> np.ndarray:
            before = np.append(_SKIP, k[:-1]) if len(k) else k
            return glued & ((k == _KNOWN) & (before == _KNOWN) | spelled & (before == _NUM))

        sums = lambda m: np.concatenate([[0], np.cumsum(m, dtype=np.int32)])
        begins = np.searchsorted(text, text)
        single, widest = np.arange(len(use)) - begins, inner(np.where(opening, _KNOWN, kind))
        joined = np.cumsum(~inner(np.where(opening, _LITERAL, kind))) - 1
        joined -= joined[begins] if len(use) else 0
        two = np.bincount(text, widest, len(texts)) > 0  # texts with something to join
        o = sums(opening)
        for as_name in (False, True) if opening.any() else (False,):  # an opening capital as a literal, then as a name
            k = np.where(opening, _KNOWN if as_name else _LITERAL, kind)
            within = inner(k)
            n = sums(within)
            for join in (False, True) if within.any() else (False,):
                head = np.flatnonzero(~within) if join else np.arange(len(k))
                after, k_, text_ = np.append(head[1:], len(k)), k[head], text[head]
                counts = np.bincount(text_, minlength=len(texts))
                values = np.where(k_ == _LITERAL, h[head], self.tags[k_])
                c = sums(k_ == _LITERAL)
                for size in (min(WINDOW, len(head)),) if sizes is None else sizes:
                    x = self.windows(values, size) if size else values[:0]
                    if not len(x):
                        continue
                    ok = (c[size:] - c[:-size] >= (LITERALS if size == WINDOW else max(1, size - 2))) & (text_[: len(x)] == text_[size - 1 :])
                    first, last = head[: len(x)], after[size - 1 :]
                    if as_name:
                        ok &= o[last] > o[first]
                    if join:
                        ok &= n[last] > n[first]
                    at = np.flatnonzero(ok)
                    if filled is not None:
                        at = at[bloom.hits(filled, x[at])]
                    for p, v in zip(at.tolist(), x[at].view(np.int64).tolist(), strict=True):
                        f, e, t = int(first[p]), int(last[p]), int(text_[p])
                        w = [" ".join(word(i) for i in use[head[q] : after[q]].tolist()) for q in range(p, p + size)]
                        tags = k_[p : p + size].tolist()
                        whole_tokens = join or n[min(e + 1, len(k))] == n[f]
                        yield t, None if join else int(single[f]), int(joined[f]) if two[t] and whole_tokens else None, v, " ".join(_TAG[g] or s for s, g in zip(w, tags, strict=True)), [s for s, g in zip(w, tags, strict=True) if g], int(counts[t])
        for n, keys in (whole or {}).items():
            x = self.windows(raw, n)
            at = np.flatnonzero(owner[: len(x)] == owner[n - 1 :]) if len(x) else np.zeros(0, np.int64)
            at = at[bloom.hits(keys, x[at])]
            for p, v, t in zip(at.tolist(), x[at].view(np.int64).tolist(), owner[at].tolist(), strict=True):
                yield t, -1, None, v, " ".join(word(i) for i in range(p, p + n)), [], n


_ROWS = "{} long, pos int, joined int, h long, template string, slots array<string>, n_tokens int"
_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int32())


def _texts(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def _batch(rows: list[tuple], key: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _TYPES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], [key, "pos", "joined", "h", "template", "slots", "n_tokens"])


def item_rows(benchmark: DataFrame, names: Collection[str]) -> DataFrame:
    """(item_id, text, ...) -> all windows of each item; of one without any, the item as it stands (pos -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Templates(names)
        for b in batches:
            rows = []
            for who, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = text.as_buffer().to_pybytes()
                got = [(who, *r[1:]) for r in read.found([raw], None, None)]
                n = 0 if got else len(read.read([raw])[1][4])
                if n:
                    every = np.full((64, 8), -1, np.int64).view(np.uint64)
                    got = [(who, *r[1:]) for r in read.found([raw], (), None, {n: every})]
                rows += got
            yield _batch(rows, "item_id")

    return _texts(benchmark, "item_id").mapInArrow(run, _ROWS.format("item_id"))


def name_rows(benchmark: DataFrame) -> DataFrame:
    """(word) written with a capital inside a sentence of an item; capital: whether it always is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read, words, capital = Templates(), [], []
            for text in b.column(1):
                buf, (_, _, c0, c1, kinds, _), _ = read.read([text.as_buffer().to_pybytes()])
                for p, q, k in zip(c0.tolist(), c1.tolist(), kinds.tolist(), strict=True):
                    if k in (_KNOWN, _LITERAL):
                        words.append(buf[p:q].decode("utf-8", "replace"))
                        capital.append(k == _KNOWN)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(capital, pa.bool_())], ["word", "capital"])

    return _texts(benchmark, "item_id").mapInArrow(run, "word string, capital boolean")


#: Names that are sent to every task; a benchmark with more goes by capitals for the rest.
MOST_NAMES = 1 << 16


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5) -> DataFrame:
    """docs (doc_id, text, ...), benchmark (item_id, text, ...) -> one row for each document and
    item of which at least `coverage` of the windows stand in the document in one alignment whose
    slots are consistent: doc_id, item_id, n_matched, n_windows, coverage, n_slots, n_changed.

    An alignment holds windows that moved by the same number of tokens, or by numbers less than
    DRIFT apart, so that a copy with a few words more or less is still one. In it every number, unit
    and name of the item stands for one of the document, without exception. n_changed counts slot
    values that the document replaces; 0 is a verbatim leak.

    A word that items write with a capital inside sentences, and never without, is a name however a
    document writes it; other capitals are names inside sentences, and either at their beginning.
    Texts are read word by word, and once more with names in a row as one name and number words as one
    number with the number before them, so that a name or number may stand for one of more or fewer
    words. An alignment keeps to one reading of the document and one of the item.
    Items of fewer tokens than a window are one window. An item with no window of enough literal
    words (sums, lists of names) leaks where all its words, marks and numbers stand in a row as they
    are, but for case and punctuation at words' ends. Null and empty texts have no windows; rows
    that repeat an id count as one text, as do null ids; texts of any length are read whole; empty
    tables give an empty table; other columns of either table are not looked at.
    """
    spool = Spool(docs.sparkSession, "leaks")
    named = name_rows(benchmark).groupBy("word").agg(F.bool_and("capital").alias("c"), F.count("*").alias("n")).where("c")
    names = [r.word for r in named.orderBy(F.desc("n"), "word").limit(MOST_NAMES).select("word").collect()]
    items = spool.cut(item_rows(benchmark, names))
    filled = bloom.build(items.where("coalesce(pos, joined) >= 0").select("h").distinct(), "h")
    sizes = sorted(r[0] for r in items.where("coalesce(pos, joined) >= 0").select(F.least("n_tokens", F.lit(WINDOW))).distinct().collect())  # at most WINDOW
    whole = {r[0]: None for r in items.where("pos < 0").select("n_tokens").distinct().collect()}  # sizes of items without literals
    keys = bloom.build(items.where("pos < 0").select("h").distinct(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Templates(names)
        for b in batches:
            at, raw, ids, rows = 0, b.column(1), b.column(0).to_pylist(), []
            while at < len(b):  # what the caches hold
                texts, size, first = [], 0, at
                while at < len(b) and size < 1 << 16:
                    texts.append(raw[at].as_buffer().to_pybytes())
                    size, at = size + len(texts[-1]), at + 1
                rows += [(ids[first + r[0]], *r[1:]) for r in read.found(texts, sizes, filled, dict.fromkeys(whole, keys))]
            yield _batch(rows, "doc_id")

    found = spool.cut(_texts(docs, "doc_id").mapInArrow(run, _ROWS.format("doc_id")).drop("n_tokens"))
    # each reading of a text by itself: (reading, place)
    readings = F.expr("filter(array(struct(0 as reading, pos), struct(1 as reading, joined as pos)), x -> x.pos is not null)")
    read_ = lambda t: t.withColumn("r", F.explode(readings)).drop("pos", "joined")
    i = read_(items).select("item_id", F.col("r.reading").alias("item_reading"), F.col("r.pos").alias("item_pos"), "h", "template", F.col("slots").alias("item_slots")).distinct()
    count = i.groupBy(F.col("item_id").alias("i"), F.col("item_reading").alias("ir")).agg(F.count_distinct("item_pos").alias("n_windows"))
    i = i.join(count, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_reading") == F.col("ir"))).drop("i", "ir")
    found = read_(found).select("doc_id", F.col("r.reading").alias("reading"), F.col("r.pos").alias("pos"), "h", "template", "slots")
    shift = F.col("pos") - F.col("item_pos")
    place = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"))
    aligned = F.array(place("same", shift), place("near", F.floor(shift / DRIFT)), place("next", F.floor((shift + DRIFT // 2) / DRIFT)))
    met = found.join(i, ["h", "template"]).withColumn("align", F.explode(aligned)).select("doc_id", "item_id", "reading", "item_reading", "align.kind", "align.at", "item_pos", "n_windows", "item_slots", "slots")
    key = ["doc_id", "item_id", "reading", "item_reading", "kind", "at"]
    places = met.groupBy(*key).agg(F.count_distinct("item_pos").alias("n_matched"), F.max("n_windows").alias("n_windows"))
    value = met.select(*key, F.explode(F.arrays_zip("item_slots", "slots")).alias("z")).groupBy(*key, F.col("z.item_slots").alias("v")).agg(F.min("z.slots").alias("lo"), F.max("z.slots").alias("hi"))
    slots = value.groupBy(*key).agg(F.count("*").alias("n_slots"), F.count_if(F.col("lo") != F.col("hi")).alias("torn"), F.count_if((F.col("lo") != F.col("v")) | (F.col("hi") != F.col("v"))).alias("n_changed"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]
    one = places.alias("p").join(slots.alias("s"), reduce(and_, same), "left").where("coalesce(torn, 0) = 0")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    # joined readings speak where that word by word is no leak
    ratio = F.col("n_matched") / F.col("n_windows")
    best = F.max(F.struct((ratio >= coverage).alias("leak"), (-F.col("reading") - F.col("item_reading")).alias("plain"), ratio.alias("coverage"), "n_matched", (-zero("n_changed")).alias("c"), zero("n_slots").alias("s"), "n_windows"))
    out = one.select("p.doc_id", "p.item_id", "p.reading", "p.item_reading", "n_matched", "n_changed", "n_slots", "n_windows").groupBy("doc_id", "item_id").agg(best.alias("b"))
    out = out.select("doc_id", "item_id", "b.n_matched", "b.n_windows", "b.coverage", F.col("b.s").alias("n_slots"), (-F.col("b.c")).alias("n_changed"))
    return out.where(F.col("coverage") >= coverage)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5) -> DataFrame:
    """The documents without those that hold an item; a row without doc_id can't be named and stays.
    Null and empty texts stay; all rows of a doc_id go together; all columns come through."""
    return docs.join(leaks(docs, benchmark, coverage).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
