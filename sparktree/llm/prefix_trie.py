"""The trie of conversations' beginnings, by prefix-doubling names.

Every different turn gets a dense number as its name. Two neighbouring blocks of 2**k
turns make one of 2**(k+1), named by the pair of their names; only blocks that begin at
a multiple of their size are needed, so all levels together have twice as many blocks
as there are turns. A beginning of d turns is composed of blocks as d is of powers of
two: that of d without its lowest bit, already named, and one block. So from the highest
level down each round names the beginnings with one more lowest bit, and after
logarithmically many joins every beginning of every conversation has the number of its
node. Sums over a node's subtree double in the same way: after k rounds a node holds
what lies less than 2**k turns below it, and hands that to the node 2**k turns above.

Names are exact: numbers of distinct keys, counted in a written table, never hashes.
Keys are made distinct before they are shuffled, joins on names are plain joins that
Spark splits where a key is common, and each round is written to the shared folder. No
conversation, node or group is gathered in a task: turns are numbered by ranges where a
conversation is long, and the members that end at a node are digested as a stream, in
order, from pieces that were joined to text by ranges.

Defined results: rows without a conversation id take no part; a null role or text is
empty; turns of equal number stand in the order of role, then text, and repeated rows
are turns of their own; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import running
from .common import materialize, shuffle_partitions, table, tidied

WORD_GAPS = r"[\x20\x09-\x0D]+"
#: Bytes of joined ids in one row.
PIECE_BYTES = 1 << 16


def dense_names(keys: DataFrame, base: int = 0) -> tuple[DataFrame, int]:
    """The distinct rows of ``keys`` with ``name``, numbers from ``base`` on without gaps,
    and the number after the last."""
    spark = keys.sparkSession
    counted = materialize(keys.distinct().withColumn("_at", F.monotonically_increasing_id()), "names")
    part = F.shiftright("_at", 33)
    sizes = sorted(map(tuple, counted.groupBy(part.alias("part")).count().collect()))  # a row for each partition
    before, starts = base, []
    for number, n in sizes:
        starts.append((number, before))
        before += n
    offsets = spark.createDataFrame(starts, "_part long, _before long")
    named = counted.join(F.broadcast(offsets), part == F.col("_part")).withColumn("name", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
    return named.drop("_at", "_part", "_before"), before


def numbered(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) -> conv_id, pos (from 1), role, text."""
    plain = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n, largest = plain.groupBy("conv_id").count().agg(F.sum("count"), F.max("count")).first()
    order = ["turn", "role", "text"]
    return running(plain, ["conv_id"], order, F.lit(1).cast("long"), n or 0, largest or 0).select("conv_id", F.col("upto").alias("pos"), "role", "text")


def named_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos, name (of the turn's role and text), words (of its text)."""
    own = materialize(numbered(turns), "turns")
    names, _ = dense_names(own.select("role", "text"))
    words = F.size(F.filter(F.split("text", WORD_GAPS), lambda w: w != "")).cast("long")
    names = names.withColumn("words", words)
    return materialize(own.join(names, ["role", "text"]).select("conv_id", "pos", "name", "words"), "turns")


def prefix_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, d, node for each d from 0 to the number of turns of each conversation.

    ``turns``: conv_id, pos (1, 2, ... in each), name; ``convs``: all conversations.
    Equal beginnings have equal nodes, from 0, the root; written.
    """
    levels = [turns.select("conv_id", (F.col("pos") - 1).alias("at"), "name")]
    longest = turns.agg(F.max("pos")).first()[0] or 0
    while 2 << (len(levels) - 1) <= longest:
        half = F.col("at") % 2
        pairs = levels[-1].groupBy("conv_id", F.floor(F.col("at") / 2).alias("at")).agg(F.max(F.when(half == 0, F.col("name"))).alias("left"), F.max(F.when(half == 1, F.col("name"))).alias("right"))
        pairs = materialize(pairs.where("right IS NOT NULL"), "pairs")
        names, _ = dense_names(pairs.select("left", "right"))
        levels.append(materialize(pairs.join(names, ["left", "right"]).select("conv_id", "at", "name"), "blocks"))
    out = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("node"))
    base, done = 1, None
    for k in range(len(levels) - 1, -1, -1):
        blocks = levels[k].where(F.col("at") % 2 == 0).select("conv_id", (F.col("at") * (1 << k)).alias("d"), F.col("name").alias("block"))
        known = out if done is None else done
        steps = materialize(blocks.join(known, ["conv_id", "d"]).select("conv_id", (F.col("d") + (1 << k)).alias("d"), F.col("node").alias("above"), "block"), "steps")
        names, base = dense_names(steps.select("above", "block"), base)
        new = materialize(steps.join(names, ["above", "block"]).select("conv_id", "d", F.col("name").alias("node")), "beginnings")
        done = known.unionByName(new)
    return out if done is None else done


def digested(ends: DataFrame) -> DataFrame:
    """(node, conv_id) -> node, ends_sha256: of each node's conversation ids in ascending
    order, in decimal digits, joined by commas."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (node, conv_id) -> node, first, ids: runs of one node, up to PIECE_BYTES."""
        for batch in batches:
            node, conv = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows: list[tuple] = []
            cuts = np.append(np.flatnonzero(np.append(True, node[1:] != node[:-1])), len(node)) if len(node) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                for lo in range(a, b, PIECE_BYTES // 21):
                    own = conv[lo : min(b, lo + PIECE_BYTES // 21)]
                    rows.append((int(node[a]), int(own[0]), ",".join(map(str, own.tolist()))))
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces sorted by (node, first) -> a row for each node; holds one digest's state."""
        node, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if own == node:
                    state.update(b"," + ids.encode())
                else:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = own, hashlib.sha256(ids.encode())
            yield pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.record_batch([pa.array([node], pa.int64()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    ranged = ends.select("node", "conv_id").repartitionByRange(shuffle_partitions(ends.sparkSession), "node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = ranged.mapInArrow(tidied(joined), "node long, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(tidied(hashed), "node long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of some conversations.

    ``turns``: conv_id, pos, name, words; ``convs``: the conv_id of all, also of those
    without a turn. Columns: node, conv_id (the smallest member), depth, parent (null for the
    root), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    beginnings = prefix_nodes(turns, convs)
    worded = beginnings.join(turns.select("conv_id", F.col("pos").alias("d"), "words"), ["conv_id", "d"], "left")
    nodes = materialize(worded.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("d").alias("depth"), F.count("*").alias("n_convs"), F.coalesce(F.max("words"), F.lit(0)).alias("words")), "nodes")

    def above(rows: DataFrame, steps: Column | int, name: str) -> DataFrame:
        """``rows`` with the node that lies so many turns above, as deep as there is one."""
        up = beginnings.select(F.col("conv_id").alias("_conv"), F.col("d").alias("_d"), F.col("node").alias(name))
        return rows.join(up, (F.col("conv_id") == F.col("_conv")) & (F.col("depth") - steps == F.col("_d"))).drop("_conv", "_d")

    parents = materialize(above(nodes.select("node", "conv_id", "depth"), 1, "parent").select("node", "parent"), "parents")
    children = parents.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    sums = ["n_leaves", "saved_tokens"]
    state = nodes.select("node", "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    step = 1
    while step <= deepest:
        handed = above(state.where(F.col("depth") >= step), step, "to").groupBy(F.col("to").alias("node")).agg(*(F.sum(c).alias(c) for c in sums))
        handed = handed.select("node", F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("depth"), *sums)
        state = materialize(state.unionByName(handed).groupBy("node").agg(F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *(F.sum(c).alias(c) for c in sums)), "subtrees")
        step *= 2
    last = beginnings.groupBy("conv_id").agg(F.max_by("node", "d").alias("node"))
    ends = materialize(digested(last), "ends")
    named = parents.join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    out = nodes.drop("words").join(state.select("node", *sums), "node").join(ends, "node", "left").join(named, "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("node", "conv_id", "depth", "parent", "parent_conv_id", "n_convs", "n_children", *sums, F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of a table of conversations (conv_id, turn, role, text)."""
    turns = named_turns(conversations)
    return trie(turns, turns.select("conv_id").distinct())


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: conversation c begins with the first h turns of
    c - c % 20 (all if fewer, none if absent), with h = crc32(c as text) % 4, and goes on with its own
    turns after its first h. Returns turns (conv_id, pos, name, words) and conv_ids."""
    h = F.crc32(F.col("conv_id").cast("string")) % 4
    convs = materialize(turns.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 20), "convs")
    # three turns of each base at most
    bases = turns.where("pos <= 3 AND conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "pos", "name", "words")
    borrowed = convs.join(bases, "base").where("pos <= h").select("conv_id", "pos", "name", "words")
    taken = borrowed.groupBy("conv_id").agg(F.count("*").alias("taken"))
    shift = convs.join(taken, "conv_id", "left").select("conv_id", "h", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    rest = turns.where("pos > 0").join(shift, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "name", "words")
    return materialize(borrowed.unionByName(rest), "rebuilt"), convs.select("conv_id")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations, a row for each node."""
    found = trie(*rebuilt(named_turns(table(spark, sf_dir, "conversations"))))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE_SQL = r"""
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT conv_id, list(t ORDER BY pos) AS ts FROM o GROUP BY conv_id
), h AS (
  SELECT n.conv_id, n.ts, coalesce(b.ts, []) AS bs, n.conv_id AS c
  FROM n LEFT JOIN n AS b ON b.conv_id = n.conv_id - n.conv_id % 20
), bytes AS (
  SELECT range AS v, list_reduce(list_prepend(range, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS e FROM range(256)
), tab AS (
  SELECT list(e ORDER BY v) AS es FROM bytes
), k AS (
  SELECT conv_id, ts, bs, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda x, b: xor(x >> 8, es[(xor(x, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM h, tab
), r AS (
  SELECT conv_id, list_concat(bs[1:h], ts[h + 1:]) AS ts FROM k
), p AS (
  SELECT conv_id, d, ts[1:d] AS key, len(ts) AS n, CASE WHEN d = 0 THEN 0 ELSE len(list_filter(string_split_regex(ts[d].text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) END AS words
  FROM r, LATERAL (SELECT unnest(range(0, len(ts) + 1)) AS d) q
), g AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM p GROUP BY key, d
), u AS (
  SELECT g.*, pg.conv_id AS parent_conv_id FROM g LEFT JOIN g AS pg ON g.d > 0 AND pg.d = g.d - 1 AND pg.key = g.key[1:g.d - 1]
), w AS (
  SELECT u.*, (SELECT count(*) FROM u AS ch WHERE ch.d = u.d + 1 AND ch.key[1:u.d] = u.key) AS n_children FROM u
), a AS (
  SELECT up.key, up.d, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved
  FROM w JOIN p AS up ON up.conv_id = w.conv_id AND up.d <= w.d GROUP BY up.key, up.d
)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, w.parent_conv_id, CAST(w.n_convs AS BIGINT) AS n_convs, CAST(w.n_children AS BIGINT) AS n_children,
  CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN a ON a.key = w.key AND a.d = w.d
"""
