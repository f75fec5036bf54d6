"""Document fingerprints with DataFrame functions only: one-permutation MinHash.

The shingle hashes of a text are dealt to 256 bins by their top byte and each bin keeps its least.
An empty bin borrows from a bin that its own hash sequence picks (optimal densification). The low
byte of each bin's value is stored; likeness is corrected for bytes that agree by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, table

BINS, WIDTH, TRIES = 256, 5, 8
_LOW56 = (1 << 56) - 1
#: Buckets of consecutive documents at most, and the documents of one.
MAX_BUCKETS, IN_BUCKET = 1 << 14, 1500


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def shingles(text: Column, width: int = WIDTH) -> Column:
    """The hashes of a text's word shingles; a text of fewer words is one shingle, of none has none."""
    hashed = F.transform(F.filter(F.split(ascii_lower(text), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))

    def gram(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return F.when(n >= width, runs).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return _let(hashed, gram)


def packed(text: Column) -> Column:
    """The fingerprint as array<long>: 256 bytes, eight to a long. Without shingles all are zero."""
    bottom = F.array(*[_long((((b + 128) & 255) << 56) | _LOW56) for b in range(BINS)])  # one above all values of each bin
    of_bin = lambda x: F.shiftright(x, 56)  # noqa: E731  -128 to 127, in sorted order
    empty = lambda x: x.bitwiseAND(_long(_LOW56)) == _long(_LOW56)
    low = lambda x: x.bitwiseAND(F.lit(255).cast("long"))

    def least(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (of_bin(x) != of_bin(F.get(s, i - 1))))

    def dense(first: Column) -> Column:
        def fill(live: Column) -> Column:
            def value(x: Column, i: Column) -> Column:
                out = F.when(~empty(x), low(x))
                for t in range(TRIES):
                    donor = F.get(first, F.shiftrightunsigned(F.xxhash64(i, F.lit(t)), 56).cast("int"))
                    out = out.when(~empty(donor), low(donor))
                # the bins of a short text are nearly all empty: the first of its few in the sequence's further order
                far = F.array_min(F.transform(live, lambda d: F.xxhash64(i, of_bin(d)).bitwiseAND(F.lit(-256).cast("long")).bitwiseOR(low(d))))
                return out.otherwise(F.coalesce(low(far), F.lit(0).cast("long")))

            return F.transform(first, value)

        return _let(F.filter(first, lambda x: ~empty(x)), fill)

    def pack(v: Column) -> Column:
        def eight(k: Column) -> Column:
            out = F.lit(0).cast("long")
            for j in range(8):
                out = out.bitwiseOR(F.shiftleft(F.get(v, k * 8 + j), 8 * (7 - j)))
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), eight)

    return _let(_let(_let(F.sort_array(F.concat(shingles(text), bottom)), least), dense), pack)


def as_hex(p: Column) -> Column:
    return F.array_join(F.transform(p, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1."""

    def equal(x: Column) -> Column:  # zero bytes of a XOR; the top byte on its own, for the sum to stay positive
        seven, sevens = _long(0x007F7F7F7F7F7F7F), _long(0x0080808080808080)
        low = x.bitwiseAND(_long(_LOW56))
        nonzero = (low.bitwiseAND(seven) + seven).bitwiseOR(low).bitwiseAND(sevens)
        return 7 - F.bit_count(nonzero) + (F.shiftrightunsigned(x, 56) == 0).cast("int")

    same = F.aggregate(F.zip_with(a, b, lambda x, y: equal(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / 256
    return F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, ...) -> adds next_<column> of the following row by doc_id; the first follows the last.

    Buckets of consecutive ids are sorted each on its own; the first row of each is sent to the
    bucket before as a guest, so that no window spans them all. Null ids come first; rows of one id
    in the order of their columns' hash.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    n = docs.count()
    want = max(1, min(MAX_BUCKETS, n // IN_BUCKET))
    steps = (want - 1).bit_length()
    cuts = docs.select(F.percentile_approx(key, [k / want for k in range(1, want)], 10 * want + 1000)).first()[0] if want > 1 else []
    cuts = sorted(set(cuts or []))
    cuts += [(1 << 63) - 1] * ((1 << steps) - 1 - len(cuts))
    ladder = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else None
    # binary search: how many cuts are at or below the id
    bucket = F.lit(0)

    def step(lo: Column, half: Column) -> Column:
        return F.when(F.get(ladder, lo + half - 1) <= key, lo + half).otherwise(lo)

    if steps:
        bucket = F.aggregate(F.array(*[F.lit(1 << s) for s in reversed(range(steps))]), bucket, step)
    d = docs.withColumn("_b", bucket)
    firsts = sorted((r[0], r[1]) for r in d.groupBy("_b").agg(F.min(key)).collect())  # a row a bucket
    guests = [(first, firsts[i - 1][0], int(i == 0)) for i, (_, first) in enumerate(firsts)]
    g = spark.createDataFrame(guests, "_first long, _to int, _wrap int")
    d = d.join(F.broadcast(g), key == F.col("_first"), "left")  # at most MAX_BUCKETS rows
    homes = F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("guest")), F.struct(F.col("_to").alias("b"), (F.col("_wrap") + 1).alias("guest")))
    d = d.withColumn("_home", F.explode(F.filter(homes, lambda h: h.b.isNotNull()))).select(*docs.columns, F.col("_home.b").alias("_b"), F.col("_home.guest").alias("_guest"))
    order = Window.partitionBy("_b").orderBy("_guest", F.col("doc_id").asc_nulls_first(), F.xxhash64(*columns))
    return d.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("_guest = 0").drop("_b", "_guest")


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> the fingerprint of each whole text, of the text whose last quarter is
    replaced by the next document's beginning, and the likeness to it and to the next document."""
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = with_next(d.withColumn("fp", packed(F.col("text"))), ["text", "fp"])
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    d = d.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k)))
    d = d.withColumn("edited_fp", packed(F.col("edited")))
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(table(spark, sf_dir, "documents"))
