"""Groups of similar rows from buckets of candidates, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Spool
from .components import components

#: Ids that are sent to every task (some 24 bytes each); more are joined by shuffle.
SENT_IDS = 1_000_000
#: Members of a bucket that are compared pair by pair; a larger one whose members are still apart is split by further keys.
CROWD = 24
#: Pairs of a crowded bucket that one task compares in the end, and over how many tasks one is dealt at most.
DEALT, MOST_DEALT = 10_000_000, 256
#: Parts in which pairs are verified at most, and pairs of a part if fewer parts do.
PARTS, PART = 8, 50_000


def linked(sent: DataFrame, alike: Callable[[Column, Column, Column, Column], Column], more: Callable[[DataFrame, int], DataFrame], verify: Callable[[DataFrame], DataFrame], spool: Spool, levels: int, crowd: int = 0) -> DataFrame:
    """sent: (key, o, z, id), a row for each bucket of each id -> (id, root) of those that are linked to another.

    o and z are a small sketch: alike(o, z, o2, z2) says cheaply whether two may be similar,
    verify((a, b)) returns the pairs that are. A bucket's ids are first linked to their neighbours in
    the order of the sketch, so that a crowd of near copies is connected without its pairs. Then
    every pair of a bucket that these links have left apart is compared, all ids and not one of each
    group. Buckets too crowded for that (more than `crowd`, or CROWD) are split, more((key, o, z, id, root), level) giving rows for
    finer buckets; what is still crowded after `levels` splits is compared in full. In the end the
    pairs of crowded buckets that are apart still are compared too, whether a finer bucket held both or
    not, so that each pair of a bucket has been compared or is connected. The rows of a bucket pass
    through tasks sorted and spilling; none is dropped.
    """
    crowd = crowd or CROWD
    order, whole = Window.partitionBy("key").orderBy("o", "id"), Window.partitionBy("key")
    met = sent.withColumns({f"{c}2": F.lag(c).over(order) for c in ("o", "z", "id")} | {"next": F.lead("id").over(order)})
    met = met.where("id2 is not null or next is not null")
    met = spool.cut(met.select("key", "o", "z", "id", _beside(F.col("id2") != F.col("id"), alike)))  # the neighbour alone is written, not its sketch
    del sent
    spool.tidy()
    passing: list[DataFrame] = []  # tables on the way, which go at the end

    def checked(rows: DataFrame) -> DataFrame:
        # texts are moved for a part of the pairs at a time, and their files go before the next
        rows = spool.cut(rows.distinct())
        spool.tidy()
        parts = min(PARTS, -(-rows.count() // PART)) or 1
        out = []
        for part in range(parts):
            out.append(spool.cut(verify(rows.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == part))))
            spool.let_go()
            spool.tidy()
        spool.drop(rows)
        return _union(out)

    found = [checked(_ordered(met.where("beside is not null"), "beside"))]
    roots = _roots(found)
    now = met.join(roots, "id", "left").select("key", "o", "z", "id", F.coalesce("root", "id").alias("root"))
    waiting, crowded = [], None
    for level in range(levels + 1):
        seen = now.withColumns({"n": F.count("*").over(whole), "lo": F.min("root").over(whole), "hi": F.max("root").over(whole)})
        if level:
            seen = seen.withColumns({f"{c}2": F.lag(c).over(order) for c in ("o", "z", "id", "root")}).withColumn("beside", _beside((F.col("n") > 2) & (F.col("root") != F.col("root2")), alike))
        members = ["key", "o", "z", "id", "root", "n"]
        apart = spool.cut(seen.where("lo <> hi" if level else "lo <> hi and n > 2").select(*members, *["beside"] * (level > 0)))  # of two, the one pair has been compared
        passing.append(apart)
        if not level:
            spool.drop(met)
        spool.tidy()
        if level:
            waiting.append(_ordered(apart.where("beside is not null"), "beside"))
        waiting.append(_all_pairs(apart.where(F.col("n") <= crowd), alike))
        crowds = apart.where(F.col("n") > crowd).select("key", "o", "z", "id", "root")
        if crowds.isEmpty():
            break
        if level < levels:
            crowded = crowds if crowded is None else crowded
            now = more(crowds, level)
            continue
        found.append(checked(_union(waiting)))
        roots = _roots(found)
        now = crowds.drop("root").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        waiting = [_all_pairs(now, alike)]
    found.append(checked(_union(waiting)))
    out = _roots(found)
    if crowded is not None:
        while len(passing) > 1:
            spool.drop(passing.pop())  # the finer buckets have been compared
        now = spool.cut(crowded.drop("root").join(out, "id", "left").withColumn("root", F.coalesce("root", "id")))
        passing.append(now)
        found.append(checked(_rest(now, alike)))
        out = _roots(found)
    for old in passing:
        spool.drop(old)
    spool.tidy()
    return out


def _pairs(rows: DataFrame, alike: Callable[..., Column]) -> DataFrame:
    return _ordered(rows.where(alike(F.col("o"), F.col("z"), F.col("o2"), F.col("z2"))), "id2")


def _ordered(rows: DataFrame, other: str) -> DataFrame:
    return rows.select(F.least("id", other).alias("a"), F.greatest("id", other).alias("b"))


def _beside(where: Column, alike: Callable[..., Column]) -> Column:
    """The neighbour id2 if the two are to be compared."""
    return F.when(where & alike(F.col("o"), F.col("z"), F.col("o2"), F.col("z2")), F.col("id2")).alias("beside")


def _all_pairs(rows: DataFrame, alike: Callable[..., Column]) -> DataFrame:
    """Of each bucket, those of different groups."""
    rows = rows.select("key", "o", "z", "id", "root")
    both = rows.join(rows.select("key", *[F.col(c).alias(f"{c}2") for c in ("o", "z", "id", "root")]), "key")
    return _pairs(both.where((F.col("id") < F.col("id2")) & (F.col("root") != F.col("root2"))), alike)


def _rest(rows: DataFrame, alike: Callable[..., Column]) -> DataFrame:
    """Of each bucket, those of different groups; of such two, one at least is outside the bucket's largest
    group, so that this meets what is outside with all. A large bucket is dealt over tasks."""
    groups = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    most = F.max_by("root", F.struct("n", "root")).alias("top")
    sizes = groups.groupBy("key").agg(most, F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("out")).where("out > 0")
    parts = F.least(F.lit(MOST_DEALT), 1 + F.floor(F.col("n") * F.col("out") / DEALT)).cast("int")
    rows = rows.join(sizes.select("key", "top", parts.alias("parts")), "key")
    out = rows.where(F.col("root") != F.col("top")).select("key", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "o", "z", "id", "root", "top")
    every = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"{c}2") for c in ("o", "z", "id", "root")])
    both = out.join(every, ["key", "part"]).where((F.col("root") != F.col("root2")) & ((F.col("root2") == F.col("top")) | (F.col("id") < F.col("id2"))))
    return _pairs(both, alike)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _roots(found: list[DataFrame]) -> DataFrame:
    return components(_union(found)).select(F.col("node").alias("id"), "root")


def sent_if_few(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if it has no more than SENT_IDS rows."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def with_texts(links: DataFrame, rows: DataFrame, spool: Spool, more: dict[str, Column] | None = None) -> DataFrame:
    """links (a, b), rows (id, s), repeated or not -> (a, b, a_s, b_s), and likewise what `more` makes
    of each s. The texts of linked ids alone are moved. spool.let_go() removes the tables this is
    read from, once it has been used."""
    links = spool.cut(links)
    ids = spool.cut(links.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = spool.cut(rows.select("id", "s").join(sent_if_few(ids), "id", "left_semi").groupBy("id").agg(F.first("s").alias("s")).withColumns(more or {}))
    names = ["s", *(more or {})]
    spool.passing += [links, ids, texts]
    left, right = (texts.select(F.col("id").alias(c), *[F.col(n).alias(f"{c}_{n}") for n in names]) for c in ("a", "b"))
    return links.join(left, "a").join(right, "b").select("a", "b", *[f"{c}_{n}" for n in names for c in ("a", "b")])
