"""Toxicity: a convolutional text classifier trained in numpy, with thresholds by language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, table

#: Labelled documents used for the fit at most, by label: the first by hash of their id.
FIT_ROWS = 2_000
#: The longest text that is used for the fit, which bounds what the driver holds; all texts are scored.
FIT_BYTES = 100_000
WIDTHS, FILTERS, DIM, BUCKETS = (1, 2, 3), 12, 12, 1 << 16
PREFIXES = (5, 6, 7, 8, 9)
#: Of predicted 1.
CUT = 0.7

#: Groups of texts with a threshold of their own, found by what their commonest words are: languages, in a corpus of several.
LANGUAGES = 6
#: Words whose shares tell the groups apart.
COMMON = 256
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def _features(word: bytes) -> list[int]:
    """Hash buckets of a word and its beginnings; a beginning as long as the word counts once more as the word."""
    return [crc32(word) % BUCKETS] + [crc32(word[:n], n) % BUCKETS if len(word) > n else crc32(word, 99) % BUCKETS for n in PREFIXES]


class Reader:
    """Texts to word numbers; features of each distinct word are hashed once, for up to `most` words at a time."""

    def __init__(self, most: int = 150_000):
        self.most = most
        self.clear()

    def clear(self):
        self.of: dict[bytes, int] = {b"": 0}  # number 0 is the gap between texts
        self.ids: list[list[int]] = [[0] * (1 + len(PREFIXES))]

    def read(self, text: bytes) -> np.ndarray:
        of, found = self.of, _WORD.findall(text.lower())
        for w in found:
            if w not in of:
                of[w] = len(of)
                self.ids.append(_features(w))
        return np.fromiter(map(of.__getitem__, found), np.int32, len(found))


class Languages:
    """Groups of like texts, learned without labels: k-means over the shares of the commonest words."""

    def __init__(self, words: list[bytes], centres: np.ndarray):
        self.words, self.centres = words, centres

    def state(self) -> dict:
        return {"words": self.words, "centres": self.centres}

    def shares(self, texts: list[np.ndarray], of: dict[bytes, int]) -> np.ndarray:
        """Square roots of shares, so that a few words don't decide alone; all 0 for a text without common words."""
        place = np.full(len(of) + 1, -1)
        for k, w in enumerate(self.words):
            if w in of:
                place[of[w]] = k
        out = np.zeros((len(texts), len(self.words)))
        for i, t in enumerate(texts):
            at = place[t]
            out[i] = np.bincount(at[at >= 0], minlength=len(self.words))
        return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1))

    def __call__(self, texts: list[np.ndarray], of: dict[bytes, int]) -> np.ndarray:
        x = self.shares(texts, of)
        return (x @ self.centres.T - 0.5 * (self.centres**2).sum(1)).argmax(1)

    @staticmethod
    def learn(texts: list[np.ndarray], of: dict[bytes, int], rng: np.random.Generator, rounds: int = 20) -> Languages:
        name = {n: w for w, n in of.items()}
        seen = np.zeros(len(of) + 1)
        for t in texts:
            seen[np.unique(t)] += 1
        seen[0] = 0
        out = Languages([name[k] for k in np.argsort(-seen, kind="stable")[:COMMON] if seen[k] > 0], np.zeros((1, 1)))
        x = out.shares(texts, of)
        if not x.size:
            out.centres = np.zeros((1, len(out.words)))
            return out
        centres = x[:1].copy()  # each next one is the text farthest from those before
        while len(centres) < min(LANGUAGES, len(x)):
            far = ((x[:, None] - centres[None]) ** 2).sum(2).min(1)
            centres = np.vstack([centres, x[far.argmax()]])
        for _ in range(rounds):
            g = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
            for k in range(len(centres)):
                if (g == k).any():
                    centres[k] = x[g == k].mean(0)
        out.centres = centres
        return out


class Net:
    """e: BUCKETS x DIM; w: DIM x (FILTERS for each width and place in it); u: widths * FILTERS;
    shift: by language, logit of its threshold. state() and Net.of(state) make plain arrays of it and back."""

    def __init__(self, e: np.ndarray, w: np.ndarray, u: np.ndarray, b: float, shift: np.ndarray, language: Languages):
        self.e, self.w, self.u, self.b, self.shift, self.language = e, w, u, b, shift, language

    def state(self) -> dict:
        return {"e": self.e, "w": self.w, "u": self.u, "b": self.b, "shift": self.shift, "language": self.language.state()}

    @staticmethod
    def of(state: dict) -> Net:
        return Net(**{**state, "language": Languages(**state["language"])})

    def hidden(self, emb: np.ndarray) -> list[np.ndarray]:
        """For each width its filters at every start; the words past the end count as gaps."""
        h, out, at = emb @ self.w, [], 0
        for width in WIDTHS:
            x = h[:, at : at + FILTERS].copy()
            for k in range(1, width):
                at += FILTERS
                x[:-k] += h[k:, at : at + FILTERS]
            at += FILTERS
            out.append(x)
        return out

    def logits(self, texts: list[np.ndarray], ids: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """Of whole texts: blocks of the joined texts are pooled and the maxima of a text merged."""
        emb = self.e[ids].sum(1)
        emb[0] = 0
        gap = max(WIDTHS) - 1
        flat = np.concatenate([np.concatenate([t, np.zeros(max(gap, 1), np.int32)]) for t in texts] + [np.zeros(gap, np.int32)])
        ends = np.cumsum([len(t) + max(gap, 1) for t in texts])
        owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        pooled = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)  # relu: no text is below zero
        for at in range(0, len(owner), block):
            x = np.concatenate(self.hidden(emb[flat[at : at + block + gap]]), axis=1)[: min(block, len(owner) - at)]
            own = owner[at : at + block]
            x[flat[at : at + len(own)] == 0] = 0  # a window that starts in a gap would reach into the next text
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            top = np.maximum.reduceat(x, starts, axis=0)
            pooled[own[starts]] = np.maximum(pooled[own[starts]], top)
        return pooled @ self.u + self.b

    def scores(self, texts: list[np.ndarray], ids: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """The logit is moved so that each language's threshold comes to lie at CUT."""
        z = self.logits(texts, ids).astype(float) - self.shift[langs] + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_net(texts: list[bytes], y: np.ndarray, weight0: float = 1.0, epochs: int = 12, batch: int = 32, seed: int = 5) -> Net:
    """weight0: how many documents of label 0 each of the sample stands for, against one of label 1.

    Embeddings start from the shrunken log odds of their bucket's presence, so that the filters
    have something to select from the first step on. A quarter of the sample is left out of the
    training and sets the thresholds.
    """
    rng = np.random.default_rng(seed)
    reader = Reader(most=1 << 60)
    docs = [reader.read(t) for t in texts]
    language = Languages.learn(docs, reader.of, rng)
    langs = language(docs, reader.of) if docs else np.zeros(0, int)
    ids = np.array(reader.ids)
    nf = len(WIDTHS) * FILTERS
    w = rng.normal(0, 0.25, (DIM, FILTERS * sum(WIDTHS))).astype(np.float32)
    at = 0
    for width in WIDTHS:  # the first half of a width's filters begins with the log odds
        w[0, at : at + FILTERS // 2] = 1
        for k in range(1, width):
            w[0, at + k * FILTERS : at + k * FILTERS + FILTERS // 2] = 0.5
        at += width * FILTERS
    net = Net(rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32), w, rng.normal(0, 0.05, nf).astype(np.float32), 0.0, np.zeros(len(language.centres)), language)
    if len(y) < 8 or y.min() == y.max():  # nothing to learn: the rate of label 1
        rate = (y.sum() + 1) / (len(y) * (1 + (weight0 - 1) * (1 - (y.mean() if len(y) else 0))) + 2)
        net.e[:], net.u[:], net.b = 0, 0, float(np.log(rate / (1 - rate)))
        return net
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 4], order[len(y) // 4 :]
    seen = np.zeros((2, BUCKETS))
    for i in train:
        if len(docs[i]):
            seen[int(y[i])][np.unique(ids[np.unique(docs[i])])] += 1
    n1, n0 = (y[train] == 1).sum(), (y[train] == 0).sum()
    rate = (seen.sum(0) + 1) / (n1 + n0 + 2)
    odds = np.log((seen[1] + 4 * rate) / (n1 + 4)) - np.log((seen[0] + 4 * rate) / (n0 + 4))
    net.e[:, 0] += np.clip(odds, -1, 4) / (1 + len(PREFIXES))
    net.u[:] = np.where(np.arange(nf) % FILTERS < FILTERS // 2, 0.4, net.u)
    net.b = -0.8
    ge, gw, gu, gb = np.full(BUCKETS, 1e-3), np.full_like(net.w, 1e-3), np.full_like(net.u, 1e-3), 1e-3
    gap = np.zeros(max(WIDTHS) - 1, np.int32)
    for epoch in range(epochs):
        rate_now = 0.05 / (1 + 0.2 * epoch)
        for part in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
            dw, du, db, toks, grads = np.zeros_like(net.w), np.zeros_like(net.u), 0.0, [], []
            for i in part:
                flat = np.concatenate([docs[i], gap, gap[:1]])
                emb = net.e[ids[flat]].sum(1)
                emb[len(docs[i]) :] = 0
                hs = net.hidden(emb)
                tops = [h.argmax(0) for h in hs]
                pooled = np.concatenate([np.maximum(h[t, np.arange(FILTERS)], 0) for h, t in zip(hs, tops, strict=True)])
                g = 1 / (1 + np.exp(-(pooled @ net.u + net.b))) - y[i]
                du += g * pooled
                db += g
                dp = g * net.u * (pooled > 0)
                at = 0
                for k, width in enumerate(WIDTHS):
                    d, t = dp[k * FILTERS : (k + 1) * FILTERS], tops[k]
                    for j in range(width):
                        cols = slice(at + j * FILTERS, at + (j + 1) * FILTERS)
                        place = np.minimum(t + j, len(flat) - 1)
                        dw[:, cols] += emb[place].T * d
                        live = (place < len(docs[i])) & (d != 0)
                        if live.any():
                            toks.append(flat[place[live]])
                            grads.append(d[live, None] * net.w[:, cols].T[live])
                    at += width * FILTERS
            n = len(part)
            for p, g, s in ((net.w, dw / n + 1e-4 * net.w, gw), (net.u, du / n + 1e-4 * net.u, gu)):
                s += g * g
                p -= rate_now * g / np.sqrt(s)
            gb += (db / n) ** 2
            net.b -= rate_now * db / n / np.sqrt(gb)
            if toks:
                feats = ids[np.concatenate(toks)]
                g = np.repeat(np.concatenate(grads) / n, feats.shape[1], axis=0)
                f = feats.ravel()
                np.add.at(ge, f, (g * g).mean(1))
                np.subtract.at(net.e, f, (rate_now * g / np.sqrt(ge[f])[:, None]).astype(np.float32))
    z = net.logits([docs[i] for i in held], ids).astype(float)
    weight = np.where(y[held] == 1, 1.0, weight0)
    whole = _threshold(z, y[held], weight, 0.0, 0)
    for k in range(len(language.centres)):
        m = langs[held] == k
        net.shift[k] = _threshold(z[m], y[held][m], weight[m], whole, 12)
    return net


def _threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float, pull: float) -> float:
    """The logit with the best F1, drawn to the prior as if that had been found on `pull` rows of label 1."""
    n1 = (y == 1).sum()
    if not n1 or n1 == len(y):
        return prior
    order = np.argsort(-z, kind="stable")
    tp, fp = np.cumsum((y == 1)[order]), np.cumsum(((y == 0) * weight)[order])
    f1 = 2 * tp / (tp + fp + n1)
    best = int(f1.argmax())
    below = z[order[best + 1]] if best + 1 < len(z) else z[order[best]]
    return float(((z[order[best]] + below) / 2 * n1 + prior * pull) / (n1 + pull))


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Net:
    """Fitted on the driver on the whole texts of at most `rows` documents of each label outside the
    held-out fold, those of at most FIT_BYTES bytes. Labels without doc_id are not used; a doc_id
    with several labels counts as toxic if one does; without labels of both kinds every text gets one score."""
    free = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"), 3, 1))
    one = free.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    n = {r.y: r.n for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = one.where("y = 1").orderBy(*order).limit(rows).union(one.where("y = 0").orderBy(*order).limit(rows))
    some = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).where(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(picked), "doc_id")  # at most 2 * rows ids
    got = sorted(some.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).collect(), key=lambda r: r.doc_id)
    weight0 = max(1.0, n.get(0, 0) / rows) / max(1.0, n.get(1, 0) / rows)
    return fit_net([bytes(r.text) for r in got], np.array([r.y for r in got], float), weight0)


def score_toxicity(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, score) of each whole text, whatever its length.

    Null and empty texts get the score of a text without words; null and repeated doc_ids are rows
    like others; an empty table gives an empty one; other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net.state())  # arrays of a fixed size, about 3 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, model = Reader(), Net.of(sent.value)
        for b in batches:
            out = []
            for at in range(0, len(b), 256):
                if len(reader.ids) > reader.most:
                    reader.clear()
                texts = [reader.read(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1).slice(at, 256)]
                langs = model.language(texts, reader.of)
                used, flat = np.unique(np.concatenate([np.zeros(1, np.int32), *texts]), return_inverse=True)
                cuts = np.cumsum([len(t) for t in texts])[:-1]
                out.append(model.scores(np.split(flat[1:].astype(np.int32), cuts), np.array([reader.ids[i] for i in used]), langs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", F.coalesce(held_out(F.col("doc_id"), 3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
