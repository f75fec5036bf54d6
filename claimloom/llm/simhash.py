"""SimHash near-duplicates of documents by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Spool, table
from .components import components


def _fingerprint(text: bytes, width: int, seed: int, block: int = 1 << 14) -> int:
    """The 64-bit fingerprint of one whole text; the bit counts of long texts add up by block."""
    w = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    n = max(1, len(w) - width + 1)
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, block):
        parts = w[at : min(at + block, n) + width - 1]
        grams = map(b" ".join, zip(*(parts[k:] for k in range(width)), strict=False)) if n > 1 or len(w) == width else [b" ".join(w)]
        h = np.fromiter((digest(g, seed) for g in grams), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp long): the SimHash of each whole text's word shingles.

    Words part at ASCII white space, A-Z are lower-cased, shingles count with repeats; a text of
    fewer words is one shingle, and one without words (also null) has fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", width, seed) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def near_links(fps: DataFrame) -> DataFrame:
    """(fp long) distinct values -> (a, b): edges that connect all values 2 or fewer bits apart.

    Every value is sent to itself and to its 64 one-bit variants. Two values meet at a variant if
    and only if they differ in at most 2 bits, and all that meet at one variant do so pairwise;
    so the chain of neighbours in each variant's sorted list connects what its pairs would,
    without emitting pairs. A variant receives at most 65 distinct values. Each edge is verified.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    sent = fps.select("fp").distinct().select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("ball"), "fp")
    chain = sent.withColumn("b", F.lag("fp").over(Window.partitionBy("ball").orderBy("fp")))
    return chain.where(F.col("b").isNotNull() & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= 2)).select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fp, component_id): the smallest doc_id that a chain of links reaches.

    Ties: equal fingerprints are one node. Rows whose doc_id is null have no link and no component;
    repeated doc_ids are rows of their own that share the component of their smallest fingerprint's class.
    Empty and null texts have fingerprint 0 and link to each other. An empty table gives an empty one.
    """
    spool = Spool(docs.sparkSession, "simhash")
    fps = spool.cut(fingerprints(docs, width))
    first = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    classes = spool.cut(first)
    roots = components(near_links(classes))
    # the class of each fingerprint, then the smallest id of each class: one row a fingerprint
    of = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = of.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """The documents with one row for each group of near-duplicates: that of the smallest doc_id.

    Rows without doc_id stay; of rows that repeat a doc_id all stay, as they can't be told apart.
    """
    gone = near_duplicates(docs, width).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
