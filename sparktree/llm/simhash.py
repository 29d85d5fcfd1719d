"""SimHash near-duplicates by sharded BK-trees.

Texts become fingerprints in one pass. Equal fingerprints are one node. A pair of
fingerprints that differ in at most r of 64 bits agrees on at least m of r + m blocks
of bits, so each node goes to one shard for each choice of m blocks; m grows with the
number of nodes so that an even shard stays small. Each task builds the BK-tree of its
shard and searches it for every member. A broadcast of the trees would pass all
fingerprints through the driver and grow with the corpus, so the trees travel by
shuffle, by shard key.

Shards with more nodes than ``SHARD`` are compared in two rounds. First each is dealt
into blocks that share a few leaders (``LEADERS`` at most), and each block is solved.
What that connects mostly becomes one group; only the nodes outside a shard's largest
group then meet the blocks of the others. So a shard of n nodes that are alike costs
about n rows; only nodes that are alike in their keys and yet unlike cost more.

A task reports, of the links that it finds, as many as connect what they connect;
components therefore lose nothing, and a group of n copies costs n rows, not n*n.

The pipeline's near duplicates (``near_duplicate_components``) take what the trees link
as candidates, and compare candidates exactly, in the same shards and rounds. At a
similarity of 0.8, fingerprints of 64 bits differ in some ten bits, beyond what keys of
equal blocks find, so least hashes of shingle sets give further candidates.

Defined results: a null or wordless text has fingerprint zero, which links like any
other, and an empty shingle set, which equals other empty ones only; a null id takes part but is never a component's id unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bk_tree import Forest
from .common import Words, binary, drawn_seed, materialize, mix, ranges, slices, table, tidied
from .components import connected_components, joined

#: Nodes of one block of a shard, and nodes that all blocks of a large shard share.
SHARD, LEADERS = 512, 64
#: Mean nodes of a shard beyond which another block is matched.
MEAN_SHARD = 48
#: Rows of whole shards that a task handles at a time.
BATCH = 1 << 16


def majority(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes the 64-bit word of bits that are set in over half."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts > 0)
    step = 1 << 18
    sums = np.zeros((len(counts), 64), np.int64)
    for lo in range(0, len(hashes), step):
        block = hashes[lo : lo + step]
        bits = np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        a, b = np.maximum(starts[full], lo), np.minimum(starts[full] + counts[full], lo + len(block))
        here = full[a < b]
        if len(here):
            sums[here] += np.add.reduceat(bits, (np.maximum(starts[here], lo) - lo), axis=0, dtype=np.int32)
    set_bits = sums * 2 > counts[:, None]
    out[:] = np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def shingle_fingerprints(texts: list[bytes | None], size: int) -> np.ndarray:
    """Fingerprints of the XXH64 (seed 42) of all lower-cased shingles of ``size`` words."""
    hashes, counts = [], []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = (text or b"").lower().split()
        n = len(words) - size + 1
        if not words:
            counts.append(0)
        elif n <= 1:
            hashes.append(np.array([digest(b" ".join(words), 42)], np.uint64))
            counts.append(1)
        else:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate([[0], ends[: n - 1]]).tolist()
            hashes.append(np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())), np.uint64, n))
            counts.append(n)
    counts = np.array(counts, np.int64)
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return majority(flat, np.cumsum(counts) - counts, counts)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of shingles of ``size`` words (shorter rows: of the words there are), one
    row's hashes after another's, and the number of each row."""
    n = np.diff(words.first)
    row = words.row()
    hashes, whole = words.windows(size), words.whole(size)
    short = np.flatnonzero((n > 0) & (n < size))
    at = ranges(words.first[short], n[short])
    hashes = np.concatenate([hashes[whole], words.hash[at]])
    row = np.concatenate([row[: len(whole)][whole], row[at]])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    return hashes[new], np.bincount(row[new], minlength=len(n))


def band_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BANDS keys for each run of hashes, each of the run's least hash in BAND_ROWS orders."""
    keys = np.zeros((len(counts), BANDS), np.uint64)
    full = np.flatnonzero(counts > 0)
    starts = (np.cumsum(counts) - counts)[full]
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    for band in range(BANDS):
        for i in range(BAND_ROWS if len(full) else 0):
            seed = mix(np.array([band * BAND_ROWS + i + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
            order = (low ^ np.uint32(seed & np.uint64(0xFFFFFFFF))) * np.uint32((seed >> np.uint64(32)) | np.uint64(1))
            keys[full, band] = mix(keys[full, band] + np.uint64(band + 1) + np.minimum.reduceat(order, starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return keys


def similar_groups(hashes: np.ndarray, counts: np.ndarray, side: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For sets one after another: the smallest set that each connects to over pairs of a
    Jaccard similarity of SIMILAR; with sides 1 and 2, only pairs between the sides and of
    different groups."""
    _, rank = np.unique(hashes, return_inverse=True)
    starts, mark = np.cumsum(counts) - counts, np.zeros(len(rank), bool)

    def near(i: int, among: np.ndarray) -> np.ndarray:
        among = among[(SIMILAR[1] * counts[among] >= SIMILAR[0] * counts[i]) & (SIMILAR[0] * counts[among] <= SIMILAR[1] * counts[i])]
        own = rank[starts[i] : starts[i] + counts[i]]
        mark[own] = True
        shared = np.bincount(np.repeat(np.arange(len(among)), counts[among]), mark[rank[ranges(starts[among], counts[among])]], minlength=len(among))
        mark[own] = False
        return among[SIMILAR[1] * shared >= SIMILAR[0] * (counts[i] + counts[among] - shared)]

    first = np.arange(len(counts))
    if not side.any():
        left = first.copy()
        while len(left):
            seed, left, todo = left[0], left[1:], [left[0]]
            while todo and len(left):
                hits = near(todo.pop(), left)
                first[hits] = seed
                todo += hits.tolist()
                left = left[~np.isin(left, hits, assume_unique=True)]
        return first
    _, group = np.unique(group, return_inverse=True)
    known = np.arange(len(group)), np.searchsorted(np.sort(group), group)
    known = np.argsort(group, kind="stable")[known[1]]  # a set of each group, as it is known so far
    first = joined(first, [(np.arange(len(first)), known)])
    one = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 2):
        hits = near(i, one[first[one] != first[i]])
        if len(hits):
            first = joined(first, [(np.full(len(hits), i), hits)])
    return first


def block_keys(code: Column, radius: int, matched: int) -> Column:
    """An array of shard keys: for each choice of ``matched`` blocks of bits, those bits."""
    n = radius + matched
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    keys = []
    for i, chosen in enumerate(combinations(masks, matched)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(i), code.bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def matched_blocks(nodes: int, radius: int) -> int:
    """The fewest blocks to match with which an even shard has at most MEAN_SHARD nodes."""
    for m in range(1, 4):
        if nodes <= MEAN_SHARD * 2 ** (64 * m / (radius + m)):
            return m
    return 4


def shard_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, side, node, group, code) sorted by shard -> spanning links (a, b)."""
    held: list[pa.Table] = []
    rows = 0

    def solve(t: pa.Table) -> pa.RecordBatch:
        shard = t.column("shard").to_numpy()
        side = t.column("side").to_numpy()
        code = t.column("code").to_numpy().view(np.uint64)
        _, number = np.unique(shard, return_inverse=True)
        order = np.lexsort((side, number))
        number, side, code = number[order], side[order], code[order]
        forest = Forest(code, number)

        def pairs():
            """Links within a shard, or between its two sides."""
            for a, b in forest.search(code, number, radius):
                keep = (a > b) & ((side[a] != side[b]) | (side[a] == 0))
                yield a[keep], b[keep]

        last = joined(np.arange(len(code)), pairs())
        a = np.flatnonzero(last != np.arange(len(code)))
        b = last[a]
        a, b = (t.column("node").to_numpy()[order][x] for x in (a, b))
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= BATCH:
            t = pa.concat_tables(held)
            shard = t.column("shard").to_numpy()
            cut = int(np.searchsorted(shard, shard[-1]))
            if cut:
                yield solve(t.slice(0, cut))
            held, rows = [t.slice(cut)], t.num_rows - cut
    if rows:
        yield solve(pa.concat_tables(held))


def in_rounds(members: DataFrame, compare) -> DataFrame:
    """Links (a, b) that connect what all pairs within each shard of ``members`` (shard,
    node; written, not to be computed again) connect.

    ``compare`` takes (shard, side, node, group), of a bounded number of rows a shard, to
    links: of side 0 between all, else between sides 1 and 2 if their groups differ.
    """
    plain = members.select("shard", F.lit(0).alias("side"), "node", F.col("node").alias("group"))
    large = materialize(members.groupBy("shard").count().where(F.col("count") > SHARD).select("shard", F.ceil(F.col("count") / SHARD).cast("int").alias("blocks")), "large")
    if large.isEmpty():
        return compare(plain)
    small = plain.join(large, "shard", "left_anti")
    held = members.join(large, "shard").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    held = materialize(held, "blocks")
    leaders = held.groupBy("shard", "blocks", F.pmod(F.xxhash64("node", F.lit(11)), F.lit(LEADERS)).alias("of")).agg(F.min_by(F.struct("node", "block"), F.xxhash64("node", F.lit(13))).alias("led"))
    leaders = leaders.select("shard", F.col("led.node").alias("node"), F.col("led.block").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).where("block != own")
    cell = F.xxhash64("shard", "block").alias("shard")
    dealt = held.select(cell, "node").unionByName(leaders.select(cell, "node"))
    found = materialize(compare(small.unionByName(dealt.select("shard", F.lit(0).alias("side"), "node", F.col("node").alias("group")))), "links")
    labels = connected_components(found).withColumnRenamed("node", "known")
    grouped = materialize(held.join(labels, held.node == labels.known, "left").select("shard", "blocks", "node", "block", F.coalesce("label", "node").alias("group")), "groups")
    groups = grouped.groupBy("shard", "group").count()
    most = groups.groupBy("shard").agg(F.max_by("group", F.struct("count", "group")).alias("most"), F.sum("count").alias("n"), F.max("count").alias("top"))
    most = materialize(most.where("n > top").select("shard", "most", F.ceil((F.col("n") - F.col("top")) / (SHARD // 2)).cast("int").alias("parts")), "most")
    if most.isEmpty():
        return found
    # what lies outside the largest group (side 2, in parts) meets every block (side 1)
    rest = grouped.join(most, "shard").withColumn("part", F.when(F.col("group") != F.col("most"), F.pmod(F.xxhash64("node", F.lit(17)), F.col("parts")).cast("int")))
    two = rest.where("part IS NOT NULL").select("shard", "node", "group", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(2).alias("side"))
    one = rest.select("shard", "node", "group", F.col("part").alias("own"), "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side")).where("own IS NULL OR own != part")
    cell = F.xxhash64("shard", "block", "part").alias("shard")
    met = one.select(cell, "side", "node", "group").unionByName(two.select(cell, "side", "node", "group"))
    # and those of one part, whatever their blocks, meet each other
    among = rest.where("part IS NOT NULL").select(F.xxhash64("shard", F.lit(-1), "part").alias("shard"), F.lit(0).alias("side"), "node", "group")
    return found.unionByName(compare(met.unionByName(among)))


def radius_links(nodes: DataFrame, radius: int, counted: int | None = None) -> DataFrame:
    """Links (a, b) between values of ``node``, a long and a fingerprint, that connect
    exactly what all pairs within ``radius`` connect."""
    m = matched_blocks(nodes.count() if counted is None else counted, radius)
    keyed = nodes.select(F.explode(block_keys(F.col("node"), radius, m)).alias("shard"), "node")

    def compare(rows: DataFrame) -> DataFrame:
        dealt = rows.select("shard", F.col("side").cast("int").alias("side"), "node").repartition("shard").sortWithinPartitions("shard")
        return dealt.withColumn("code", F.col("node")).mapInArrow(tidied(lambda it: shard_links(it, radius)), "a long, b long")

    return in_rounds(keyed, compare)


def fingerprints(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, code: the fingerprint of each row over shingles of ``size`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                codes = shingle_fingerprints(binary(part.column(1)).to_pylist(), size)
                yield pa.record_batch([part.column(0), pa.array(codes.view(np.int64), pa.int64())], names=["doc_id", "code"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), "doc_id long, code long")


def with_components(rows: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """``rows`` (doc_id, node, ...) with component_id, the smallest doc_id of the
    component of their node."""
    labels = connected_components(links)
    least = rows.groupBy(F.col(node).alias("n")).agg(F.min("doc_id").alias("least"))
    named = materialize(least.join(labels, least.n == labels.node, "left").select("n", "least", F.coalesce("label", "n").alias("label")), "nodes")
    whole = named.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = materialize(named.join(whole, "label").select("n", "component_id"), "components")
    return rows.join(ids, F.col(node) == ids.n, "left").drop("n")


def simhash_components(docs: DataFrame, size: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs``."""
    coded = materialize(fingerprints(docs, size, id_col, text_col), "fingerprints")
    nodes = materialize(coded.select(F.col("code").alias("node")).distinct(), "nodes")
    links = radius_links(nodes, radius)
    out = with_components(coded, links, "code")
    return out.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints: words of a shingle, and bits in which linked ones differ at most.
SIZE, RADIUS = 4, 4
#: Near duplicates: pairs whose sets of SHINGLE_WORDS-word shingles have a Jaccard
#: similarity of at least SIMILAR (a fraction). Texts with linked fingerprints are
#: candidates. So are texts that agree in the least hashes of
#: BAND_ROWS orders, in one of BANDS bands: a pair of similarity 0.8 agrees in none with a
#: probability of (1 - 0.8**BAND_ROWS)**BANDS, 5 in a million.
SHINGLE_WORDS, SIMILAR, BANDS, BAND_ROWS = 5, (4, 5), 40, 6
#: Bands that are looked at before the others.
FIRST_BANDS = 6
#: Text bytes that a task compares at a time, in whole shards.
COMPARED_BYTES = 1 << 24


def text_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, node (a hash of the text), code (its fingerprint), keys (of its bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = binary(part.column(2))
                codes = shingle_fingerprints(texts.to_pylist(), SIZE)
                keys = band_keys(*shingle_sets(Words(texts, lower=True), SHINGLE_WORDS))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(codes.view(np.int64), pa.int64()), lists], names=["doc_id", "node", "code", "keys"])

    text = F.col(f"`{text_col}`")
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    return plain.mapInArrow(tidied(run), "doc_id long, node long, code long, keys array<long>")


def fingerprint_candidates(nodes: DataFrame) -> DataFrame:
    """(node, least) of texts whose fingerprints the BK-trees link: a fingerprint is stood
    for by the least node that has it, and those of linked fingerprints are linked."""
    codes = materialize(nodes.groupBy("code").agg(F.min("node").alias("least")), "codes")
    equal = nodes.join(codes, "code").where("node != least").select("node", "least")
    linked = radius_links(codes.select(F.col("code").alias("node")), RADIUS)
    for side in ("a", "b"):
        linked = linked.join(codes.select(F.col("code").alias(side), F.col("least").alias(f"node_{side}")), side)
    return equal.unionByName(linked.select(F.col("node_a").alias("node"), F.col("node_b").alias("least")))


def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's links (a, b) as many as connect what they connect."""
    held: list[np.ndarray] = []

    def thinned() -> np.ndarray:
        links = np.concatenate(held, axis=1)
        node, at = np.unique(links, return_inverse=True)
        label = joined(np.arange(len(node)), [tuple(at.reshape(links.shape))])
        own = np.flatnonzero(label != np.arange(len(node)))
        return np.stack([node[own], node[label[own]]])

    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy() for i in (0, 1)]))
        if sum(x.shape[1] for x in held) > 1 << 20:
            held[:] = [thinned()]
            if held[0].shape[1] > 1 << 19:
                yield pa.record_batch([pa.array(x) for x in held.pop()], names=["a", "b"])
    if held:
        yield pa.record_batch([pa.array(x) for x in thinned()], names=["a", "b"])


def similar_links(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, side, node, group, text) sorted by shard -> spanning links (a, b)."""
    held: list[pa.RecordBatch] = []

    def solve(t: pa.Table) -> pa.RecordBatch:
        shard, side, node, group = (t.column(c).to_numpy() for c in ("shard", "side", "node", "group"))
        sets = [shingle_sets(Words(binary(part.column(part.schema.get_field_index("text"))), lower=True, seed=seed), SHINGLE_WORDS) for part in slices(t, "text")]
        hashes, counts = (np.concatenate([x[i] for x in sets]) for i in (0, 1))
        ends = np.cumsum(counts)
        bounds = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
        out = []
        for lo, hi in zip(bounds, bounds[1:]):
            last = similar_groups(hashes[ends[lo] - counts[lo] : ends[hi - 1]], counts[lo:hi], side[lo:hi], group[lo:hi])
            own = np.flatnonzero(last != np.arange(hi - lo))
            out.append(np.stack([node[lo + own], node[lo + last[own]]]))
        return pa.record_batch([pa.array(x) for x in np.concatenate(out, axis=1)], names=["a", "b"])

    size = 0
    for batch in batches:
        for part in slices(batch, "text", COMPARED_BYTES):
            held.append(part)
            size += part.nbytes
            if size >= COMPARED_BYTES:
                t = pa.Table.from_batches(held)
                shard = t.column("shard").to_numpy()
                cut = int(np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))[-1])
                if cut:
                    yield solve(t.slice(0, cut))
                held, size = t.slice(cut).to_batches(), t.slice(cut).nbytes
    if held:
        yield solve(pa.Table.from_batches(held))


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node, component_id: texts that pairs of similarity SIMILAR or more connect,
    and texts that are equal, share a component. What candidates connect is a shard, and
    within each shard all pairs that are not yet connected are compared exactly."""
    coded = materialize(text_keys(docs, id_col, text_col), "keys")
    nodes = coded.groupBy("node").agg(F.first("keys").alias("keys"))

    def by_key(keyed: DataFrame) -> DataFrame:
        """(node, least): each node with the least node of each of its keys that others have."""
        first = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most").select("key", "least")
        return keyed.join(first, "key").where("node != least").select("node", "least")

    # of the first bands the least node that a node meets stands for it, so that copies don't meet once a band
    few = by_key(nodes.select("node", F.explode(F.slice("keys", 1, FIRST_BANDS)).alias("key")))
    stands = materialize(few.groupBy("node").agg(F.min("least").alias("least")), "stands")
    more = nodes.select("node", F.explode(F.slice("keys", FIRST_BANDS + 1, BANDS)).alias("key")).join(stands.withColumnRenamed("node", "known"), F.col("node") == F.col("known"), "left")
    rest = by_key(more.select(F.coalesce("least", "node").alias("node"), "key").distinct())
    alike = fingerprint_candidates(coded.select("node", "code").distinct())
    links = few.unionByName(rest).unionByName(alike).select(F.col("node").alias("a"), F.col("least").alias("b"))
    candidates = materialize(links.repartition("a").mapInArrow(tidied(spanning), "a long, b long"), "candidates")
    labels = connected_components(candidates)
    members = materialize(labels.select(F.col("label").alias("shard"), "node"), "shards")
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.xxhash64(text).alias("node"), text.alias("text")).join(members.select("node"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    texts = materialize(texts, "texts")

    seed = drawn_seed()

    def compare(rows: DataFrame) -> DataFrame:
        whole = texts.join(rows, "node").select("shard", F.col("side").cast("int").alias("side"), "node", "group", "text")
        return whole.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidied(lambda it: similar_links(it, seed)), "a long, b long")

    return with_components(coded.select("doc_id", "node"), in_rounds(members, compare), "node")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest id
    (null last), then the smallest text hash. Null texts are copies of each other."""
    found = near_duplicate_components(docs, id_col, text_col)
    group = F.coalesce("component_id", "node")  # all ids of a component may be null
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "node"))
    kept = materialize(found.groupBy(group.alias("g"), F.col("component_id").isNull().alias("none")).agg(first.alias("first")).select("first.doc_id", "first.node"), "kept")
    key, node = "_kept_id", "_kept_node"
    while {x.lower() for x in docs.columns} & {key, node, f"{node}2"}:
        key, node = key + "_", node + "_"
    marked = docs.withColumn(node, F.xxhash64(F.col(f"`{text_col}`")))
    kept = kept.select(F.col("doc_id").alias(key), F.col("node").alias(f"{node}2"))
    own = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(key)) & (F.col(node) == F.col(f"{node}2"))
    return marked.join(kept, own, "left_semi").dropDuplicates([id_col, node]).drop(node)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), SIZE, RADIUS)


ORACLE_SQL = None
