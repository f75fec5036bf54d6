"""Nearest rules of a claim by cosine: blocks of vectors scored by matrix products under a coarse index.

The index assigns every rule's vector to the nearest of a bounded number of centroids, which are fitted
on a bounded sample. A claim is compared with the rules of its nearest cells. What these can't settle
is looked up exactly: a cell's rules lie within an angle of its centroid, so a cell can only hold a
better rule if its bound is above the worst rule found. Vectors travel in blocks of Arrow batches, one
for each key and cell that a task sees; no group is collected, and no pair of rows is ever formed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Vectors in a block at most, and vectors that a task holds until it writes its blocks.
BLOCK, HELD = 256, 1 << 15
#: Centroids at most, vectors of the sample that they are fitted on, rounds.
CELLS, SAMPLE, ROUNDS = 1024, 20_000, 10
#: Rules of the largest key in a cell, about; with fewer cells than that makes, cells are larger.
CELL = 4096
#: Keys of fewer rules have one cell: all of their rules are compared.
SMALL = 1024

_BLOCKS = "key string, cell int, ids array<long>, low array<double>, data binary"


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def fit_cells(rules: DataFrame, cells: int = CELLS, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Centroids (cells x dimensions) by spherical k-means on at most `sample` vectors, picked by hash:
    the square root of the number of rules, at most `cells`."""
    n = rules.count()
    picked = rules.select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(sample).toPandas()["vector"]
    if not len(picked):
        return np.zeros((0, 0))
    x = _unit(np.array([*map(np.asarray, picked)], np.float64))
    k = min(cells, len(x), int(np.ceil(np.sqrt(n))))
    centre = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:k])]
    for _ in range(rounds):
        own = np.argmax(x @ centre.T, axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        centre = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centre)
    return centre


def _usable(rows: DataFrame, keys: list[str], id_: str) -> DataFrame:
    key = F.to_json(F.struct(*keys))
    some = F.exists("vector", lambda v: v != 0) & ~F.exists("vector", lambda v: v.isNull())
    return rows.where(some).dropna(subset=[*keys, id_]).select(key.alias("key"), F.col(id_).cast("long").alias("id"), "vector")


def blocks(rows: DataFrame, cells_of, extra: bool = False) -> DataFrame:
    """(key, id, vector, small[, low]) -> blocks by key and cell. cells_of(unit vectors, low) gives an array
    of rows and their cells; keys that are small have cell -1 alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = defaultdict(list), 0
        schema = pa.schema([("key", pa.string()), ("cell", pa.int32()), ("ids", pa.list_(pa.int64())), ("low", pa.list_(pa.float64())), ("data", pa.binary())])

        def out() -> pa.RecordBatch:
            rows_ = [
                {"key": k, "cell": c, "ids": [i for i, _, _ in v[at : at + BLOCK]], "low": [t for _, t, _ in v[at : at + BLOCK]], "data": np.array([x for _, _, x in v[at : at + BLOCK]]).tobytes()}
                for (k, c), v in held.items() for at in range(0, len(v), BLOCK)
            ]
            return pa.RecordBatch.from_pylist(rows_, schema)

        for b in batches:
            x, keys, ids, small = _matrix(b.column(2)), b.column(0).to_pylist(), b.column(1).to_pylist(), np.asarray(b.column(3).to_pylist(), bool)
            low = b.column(4).to_numpy(zero_copy_only=False) if extra else np.full(len(x), -2.0)
            at, cell = cells_of(_unit(x.astype(np.float64)), low)
            large = ~small[at]
            for i, c in [*zip(at[large].tolist(), cell[large].tolist(), strict=True), *((i, -1) for i in np.flatnonzero(small).tolist() if not extra)]:
                held[keys[i], c].append((ids[i], low[i], x[i]))
                n += 1
                if n >= HELD:
                    yield out()
                    held.clear()
                    n = 0
        if held:
            yield out()

    return rows.mapInArrow(run, _BLOCKS)


def scored(claims: DataFrame, rules: DataFrame, k: int, least: float, wide: bool) -> DataFrame:
    """Blocks of claims against the blocks of rules of their key and cell -> (claim_id, rule_idx, cosine): of each
    pair of blocks, each claim's k best of at least `least` and its own lower bound."""
    kind = np.float64 if wide else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, r, s = [], [], []
            for cid, low, cx, rid, rx in zip(*(b.column(i) for i in range(5)), strict=True):
                cid, low, rid = (np.asarray(v.values) for v in (cid, low, rid))
                x = np.frombuffer(cx.as_buffer(), kind).reshape(len(cid), -1).astype(np.float64)
                y = np.frombuffer(rx.as_buffer(), kind).reshape(len(rid), -1).astype(np.float64)
                near = _unit(x) @ _unit(y).T
                bar = np.maximum(low, least)[:, None] - 1e-9
                if near.shape[1] > k:  # ties with the k-th stay: the last ranking decides
                    bar = np.maximum(bar, np.partition(near, -k, axis=1)[:, [-k]] - 1e-9)
                i, j = np.nonzero(near >= bar)
                # one by one, so that equal vectors have equal cosines wherever they stand
                p, q = x[i], y[j]
                cos = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
                keep = cos >= least
                c.append(cid[i][keep]), r.append(rid[j][keep]), s.append(cos[keep])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (c, r, s)], ["claim_id", "rule_idx", "cosine"])

    met = claims.join(rules.select("key", "cell", F.col("ids").alias("rule_ids"), F.col("data").alias("rule_data")), ["key", "cell"])
    return met.select("ids", "low", "data", "rule_ids", "rule_data").mapInArrow(run, "claim_id long, rule_idx long, cosine double")


def best(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("cosine"), "rule_idx"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_rules(claims: DataFrame, rules: DataFrame, keys: list[str], k: int = 5, least: float = 0.3, probes: int = 8, exact: bool = True, small: int = SMALL, cells: int = CELLS) -> DataFrame:
    """claims (claim_id, *keys, vector), rules (rule_idx, *keys, vector) -> (claim_id, rule_idx, cosine, rank): each
    claim's k nearest rules of its keys of at least `least`; of equal ones the smallest rule_idx.

    Without `exact` only the `probes` nearest cells of keys of more than `small` rules are searched. Null ids,
    keys and vectors, vectors with null elements and zero vectors match nothing; equal claim_ids are one claim;
    all vectors have one length. An empty table gives no rows.
    """
    spark = rules.sparkSession
    wide = "double" in claims.schema["vector"].dataType.simpleString() + rules.schema["vector"].dataType.simpleString()
    if wide:
        claims, rules = (x.withColumn("vector", F.col("vector").cast("array<double>")) for x in (claims, rules))
    rows, r = _usable(claims, keys, "claim_id"), _usable(rules, keys, "rule_idx")
    # equal vectors of a key are one: it is searched once, and only the k first rules of one can be among the nearest
    same = F.row_number().over(Window.partitionBy("key", "vector").orderBy("id"))
    r = r.withColumn("_n", same).where(F.col("_n") <= k).drop("_n")
    c = written(rows.select("key", "vector").distinct().withColumn("id", F.monotonically_increasing_id()), "vectors")
    owners = rows.join(c.withColumnRenamed("id", "vid"), ["key", "vector"]).select(F.col("id").alias("_owner"), "vid")
    back = lambda found: best(owners.join(found.select(F.col("claim_id").alias("vid"), "rule_idx", "cosine"), "vid").select(F.col("_owner").alias("claim_id"), "rule_idx", "cosine"), k)
    sizes = r.groupBy("key").agg((F.count("*") <= small).alias("small"))
    c, r = (x.join(sizes, "key").select("key", "id", "vector", "small") for x in (c, r))
    if sizes.where("not small").isEmpty():  # no index is needed
        none = lambda x, low: (np.zeros(0, int), np.zeros(0, int))
        return back(best(scored(blocks(c, none), blocks(r, none), k, least, wide), k))
    # vectors go to each cell they search: cells hold as many rules of a key as make that worth it
    large = r.where("not small").groupBy("key").count().agg(F.max("count")).first()[0]
    centre = fit_cells(r.where("not small"), min(cells, max(1, large // CELL)))
    ruled = written(blocks(r, lambda x, low: (np.arange(len(x)), np.argmax(x @ centre.T, axis=1))), "cells")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.float64 if wide else np.float32
        for b in batches:
            for cell, ids, data in zip(*(b.column(i) for i in range(3)), strict=True):
                x = np.frombuffer(data.as_buffer(), kind).reshape(len(ids), -1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([cell.as_py()], pa.int32()), pa.array([float((_unit(x) @ centre[cell.as_py()]).min())])], ["cell", "least"])

    # the widest angle in each cell: at most as many rows as centroids
    found = {x.cell: x.least for x in ruled.where("cell >= 0").select("cell", "ids", "data").mapInArrow(reach, "cell int, least double").groupBy("cell").agg(F.min("least").alias("least")).collect()}
    angle = np.array([np.arccos(np.clip(found.get(i, 1.0), -1, 1)) for i in range(len(centre))])
    used = np.array([i in found for i in range(len(centre))])

    def nearest(x: np.ndarray) -> np.ndarray:
        near = np.where(used, x @ centre.T, -np.inf)
        n = min(probes, int(used.sum()))
        return np.argsort(-near, axis=1, kind="stable")[:, :n]

    def probed(x: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x)
        return np.repeat(np.arange(len(x)), cell.shape[1]), cell.ravel()

    def left(x: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells that were not searched and whose bound isn't below the k-th rule found."""
        bound = np.cos(np.maximum(np.arccos(np.clip(x @ centre.T, -1, 1)) - angle, 0))
        may = used & (bound >= low[:, None] - 1e-7)
        np.put_along_axis(may, nearest(x), False, axis=1)
        return np.nonzero(may)

    first = written(best(scored(blocks(c, probed), ruled, k, least, wide), k), "nearest")
    if not exact:
        return back(first)
    worst = first.groupBy("claim_id").agg(F.count("*").alias("n"), F.min("cosine").alias("worst"))
    low = F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(least))
    open_ = c.where("not small").join(worst, F.col("id") == F.col("claim_id"), "left").select("key", "id", "vector", "small", F.coalesce(low, F.lit(least)).alias("low"))
    rest = scored(blocks(open_, left, extra=True), ruled, k, least, wide)
    return back(best(first.drop("rank").unionByName(rest), k))
