"""Trie of conversation prefixes by ROLLUP over columns of turn ids.

A conversation is a row of turn ids in positional columns; ROLLUP over them aggregates every prefix
at once. Longer conversations go on in further rows, one a block of columns, whose groups are keyed
by the node that the blocks before them led to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC, Spool, table

#: Turns in a block of columns.
BLOCK = 8
#: Turns that are numbered together, and ids of conversations that are listed together.
RANGE, IDS = 1024, 4096

NODES = "node_a long, node_b long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, place, id struct<a, b, bytes>): turns numbered from 0.

    A turn's id is two 64-bit hashes of role and text and the UTF-8 bytes of the text; texts go no
    further. Numbers are counted in ranges of turns, and the sizes of the ranges before are added, so
    that one very long conversation is no single task. Null turns come first; rows of one turn number
    are in the order of their ids. Rows without conv_id are in no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    id_ = F.struct(F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), F.octet_length(text).cast("long").alias("bytes"))
    turn = F.col("turn").cast("long")
    part = F.coalesce(F.floor(turn / RANGE), F.lit(-(1 << 62)))
    t = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), part.alias("part"), turn.alias("turn"), id_.alias("id"))
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.groupBy("conv_id", "part").agg(F.count("*").alias("size")).select("conv_id", "part", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("before"))
    row = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "id"))
    return t.withColumn("row", row - 1).join(sizes, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("row")).alias("place"), "id")


def rebuilt(t: DataFrame) -> DataFrame:
    """(conv_id, place, id) -> the same of conversations that share beginnings, and (conv_id, null, null)
    for those that end without turns: the first h turns come from the conversation at the last multiple
    of five, h being the remainder by nine of the id's CRC-32; a conversation's own turns follow after its first h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    convs = t.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    of = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(of, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    own = t.join(convs.where("n > h").select("conv_id", "h", "taken"), "conv_id").where("place >= h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("place"), "id")
    first = t.where("place < 8").select(F.col("conv_id").alias("base"), "place", "id")
    lent = convs.where("taken > 0").select("conv_id", "base", "taken").join(first, "base").where("place < taken").select("conv_id", "place", "id")
    none = convs.where("n <= h and taken = 0").select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast(t.schema["id"].dataType).alias("id"))
    return own.unionByName(lent).unionByName(none)


def _mark(place: Column, id_: Column) -> list[Column]:
    """Two hashes of a turn at its place. A node is the bitwise sum of those on its path; the root is 0."""
    return [F.when(id_["a"].isNotNull(), F.xxhash64(F.lit(k), place, id_["a"], id_["b"])).otherwise(F.lit(0)) for k in (2, 3)]


def blocks(t: DataFrame) -> DataFrame:
    """(conv_id, place, id) -> (conv_id, block, key_a, key_b, c0, c1, ...): a row for each block of a
    conversation, with the turns' ids and the node at which the block begins."""
    a, b = _mark(F.col("place"), F.col("id"))
    block = F.coalesce(F.floor(F.col("place") / BLOCK), F.lit(0))
    columns = [F.max(F.when(F.col("place") % BLOCK == k, F.col("id"))).alias(f"c{k}") for k in range(BLOCK)]
    rows = t.groupBy("conv_id", block.alias("block")).agg(F.bit_xor(a).alias("a"), F.bit_xor(b).alias("b"), *columns)
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({f"key_{x}": F.coalesce(F.bit_xor(x).over(ahead), F.lit(0)) for x in "ab"})


def rolled_up(rows: DataFrame, *sums: str) -> DataFrame:
    """Every prefix of the blocks' rows: (node_a, node_b, up_a, up_b, depth, bytes, and the sums).

    Groups that end in a column without a turn repeat shorter prefixes, and a later block's beginning is
    the node at the end of the block before; both are left out.
    """
    names = [f"c{k}" for k in range(BLOCK)]
    grouped = rows.sparkSession.sql(
        f"SELECT block, key_a, key_b, {', '.join(names)}, {BLOCK} - cast(bit_count(grouping_id()) AS int) AS level, {', '.join(sums)} FROM {{rows}} GROUP BY block, key_a, key_b, ROLLUP({', '.join(names)})", rows=rows
    )
    marks = [_mark(F.col("block") * BLOCK + k, F.col(f"c{k}")) for k in range(BLOCK)]

    def path(side: int, to: Column) -> Column:
        return reduce(lambda x, k: x.bitwiseXOR(F.when(to > k, marks[k][side]).otherwise(F.lit(0))), range(BLOCK), F.col(f"key_{'ab'[side]}"))

    level, last = F.col("level"), F.coalesce(*[F.when(F.col("level") == k + 1, F.col(f"c{k}")) for k in range(BLOCK)])
    kept = grouped.withColumn("last", last).where("last is not null or level = 0 and block = 0")
    return kept.select(
        *[path(k, level).alias(f"node_{x}") for k, x in enumerate("ab")], *[path(k, level - 1).alias(f"up_{x}") for k, x in enumerate("ab")],
        (F.col("block") * BLOCK + level).alias("depth"), F.coalesce("last.bytes", F.lit(0)).alias("bytes"), *[s.split(" AS ")[1] for s in sums],
    )


def ends(t: DataFrame) -> DataFrame:
    """(node_a, node_b, ends_sha256): the hash of the ids of the conversations that end at a node.

    Ids come in lists of a range of ids each, sorted, and the lists of one node are hashed one after the
    other as they stream by, so that a node at which many conversations end is never held whole.
    """
    a, b = _mark(F.col("place"), F.col("id"))
    at = t.groupBy("conv_id").agg(F.bit_xor(a).alias("node_a"), F.bit_xor(b).alias("node_b"))
    part = F.floor(F.col("conv_id") / IDS).alias("part")
    listed = at.groupBy("node_a", "node_b", part).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, node, digest = ["node_a", "node_b", "ends_sha256"], None, None
        for batch in batches:
            done = []
            for x, y, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (x, y) == node:
                    digest.update(b"," + ids.encode())
                else:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (x, y), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], pa.schema([("node_a", pa.int64()), ("node_b", pa.int64()), ("ends_sha256", pa.string())]))
        if node:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*node, digest.hexdigest()), strict=True))])

    return listed.repartition("node_a", "node_b").sortWithinPartitions("node_a", "node_b", "part").mapInArrow(run, "node_a long, node_b long, ends_sha256 string")


def prefix_trie(t: DataFrame) -> DataFrame:
    """(conv_id, place, id) as of turns() or rebuilt() -> NODES: a row for each distinct prefix.

    A node's conv_id is the smallest of its members, so the nodes of one conv_id are the lower part of
    that conversation's path. A subtree's sum is therefore that of its members' own nodes, which a second
    ROLLUP over these conversations adds up, less what its own conversation has above it. Conversations
    without turns (place null) are members of the root and end there. No conversations give no nodes.
    """
    spool = Spool(t.sparkSession, "trie")
    t = spool.cut(t)
    rows = spool.cut(blocks(t))
    nodes = spool.cut(rolled_up(rows, "count(1) AS n_convs", "min(conv_id) AS conv_id"))
    key, own = ["node_a", "node_b"], F.col("bytes") * (F.col("n_convs") - 1)
    children = nodes.where("depth > 0").groupBy(F.col("up_a").alias("node_a"), F.col("up_b").alias("node_b")).agg(F.count("*").alias("n_children"))
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    known = spool.cut(nodes.join(children, key, "left").select("*", F.coalesce("n_children", F.lit(0)).alias("children"), F.coalesce(F.sum(own).over(above), F.lit(0)).alias("above")))
    firsts = known.groupBy("conv_id").agg(F.sum(own).alias("saved"), F.sum((F.col("children") == 0).cast("long")).alias("leaves"))
    below = rolled_up(rows.join(firsts, "conv_id"), "sum(saved) AS saved", "sum(leaves) AS leaves").select(*key, "saved", "leaves")
    parents = known.where("children > 0").select(F.col("node_a").alias("up_a"), F.col("node_b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    # only a conversation's topmost node has another conversation above it
    top = F.row_number().over(Window.partitionBy("conv_id").orderBy("depth")) == 1
    placed = known.withColumn("top", top)
    tops = placed.where("top and depth > 0").join(parents, ["up_a", "up_b"]).select(*known.columns, "parent_conv_id")
    rest = placed.where("not (top and depth > 0)").select(*known.columns, F.when(F.col("depth") > 0, F.col("conv_id")).alias("parent_conv_id"))
    out = tops.unionByName(rest).join(below, key).join(ends(t), key, "left")
    return out.select(
        *key, "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    numbered = Spool(spark, "turns").cut(turns(table(spark, sf_dir, "conversations")))
    return prefix_trie(rebuilt(numbered)).drop("node_a", "node_b")


OP12_SQL = f"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base, {CRC.format("conv_id")} % 9 AS h FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
made AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM convs c LEFT JOIN convs b ON c.base = b.conv_id),
rows_ AS (
    SELECT conv_id, taken + place - h AS place, role, text FROM t JOIN made USING (conv_id) WHERE place >= h
    UNION ALL SELECT m.conv_id, t.place, role, text FROM made m JOIN t ON m.base = t.conv_id WHERE t.place < taken),
paths AS (
    SELECT conv_id, place + 1 AS depth, strlen(text) AS bytes, string_agg(md5(role || chr(1) || text), '') OVER (PARTITION BY conv_id ORDER BY place) AS node FROM rows_
    UNION ALL SELECT conv_id, 0, 0, '' FROM made),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, left(node, 32 * (depth - 1)::BIGINT) AS up FROM paths GROUP BY node, depth),
children AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
under AS (SELECT DISTINCT a.node, b.node AS below FROM paths a JOIN paths b USING (conv_id) WHERE b.depth >= a.depth),
sums AS (
    SELECT u.node, sum((n.n_convs - 1) * n.bytes) AS saved_tokens, count(*) FILTER (WHERE c.node IS NULL) AS n_leaves
    FROM under u JOIN nodes n ON u.below = n.node LEFT JOIN children c ON c.node = n.node GROUP BY u.node),
stops AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(node, depth) AS node FROM paths GROUP BY conv_id) GROUP BY node)
SELECT n.conv_id, n.depth::BIGINT AS depth, CASE WHEN n.depth > 0 THEN p.conv_id END AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves::BIGINT AS n_leaves,
    saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.up LEFT JOIN children c ON c.node = n.node JOIN sums s ON s.node = n.node LEFT JOIN stops e ON e.node = n.node
"""
