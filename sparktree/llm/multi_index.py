"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors are scaled to length 1; rotations learned by iterative quantisation on a
sample of at most ``SAMPLE`` rows turn each into a binary code, whose radius is set so
that the sample's true neighbours lie within it in a share ``WITHIN`` of cases. Every
row is indexed: rows are dealt into blocks and, in each, codes are split into m
substrings with a table each, from substring to rows. Codes within radius r agree with
the query to floor(r/m) bits in one of m substrings, so probing each table at that
distance retrieves every code within the radius. The width of the substrings is that
with which the fewest rows are expected (``piece_width``); a table is probed by the
substrings at that distance, or entry by entry where those are more than its entries.
What is within the radius is reranked by the cosine of the original vectors in double
precision. Queries that found too few are searched again with a radius that covers all
codes, so none comes back short.

Queries meet blocks in cells of bounded size (block x query part), by shuffle; what
each cell keeps is the best few, merged by query.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part; vectors of other lengths are searched apart, each length by itself; rows equal
in id and vector count once; of several vectors with one id the best is the id's score,
for a query as for what it finds; a query never finds its own id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, ranges, table

SAMPLE, WITHIN = 4096, 0.97
#: Rotations, each giving up to 64 bits of the code.
ROTATIONS, ROUNDS = 4, 20
BLOCK, PART = 8192, 4096
#: Substring widths to choose from.
WIDTHS = (16, 32, 64)
#: Substrings that a table is probed with at most; beyond, its entries are looked through.
PROBES = 1024


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten() if column.num_chunks != 1 else column.chunk(0).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass
class Coder:
    mean: np.ndarray
    rotations: list[np.ndarray]
    radius: int = 0

    @classmethod
    def fit(cls, vectors: np.ndarray, k: int, seed: int = 3) -> Coder:
        """Learn rotations and the radius from sampled vectors of length 1."""
        mean = vectors.mean(axis=0)
        centred = vectors - mean
        _, _, axes = np.linalg.svd(centred, full_matrices=False)
        axes = axes[:64].T
        rng = np.random.default_rng(seed)
        rotations = []
        for _ in range(ROTATIONS):
            turn = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
            flat = centred @ axes
            for _ in range(ROUNDS):
                u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
                turn = (u @ v).T
            rotations.append(axes @ turn)
        coder = cls(mean, rotations)
        codes = coder.codes(vectors)
        gaps = []
        for i in range(0, len(vectors), max(1, len(vectors) // 256)):
            cosine = vectors @ vectors[i]
            cosine[i] = -9
            best = np.argpartition(-cosine, min(k, len(cosine) - 1))[:k]
            gaps.append(hamming(codes[best], codes[i]))
        gaps = np.concatenate(gaps) if gaps else np.zeros(1)
        coder.radius = int(np.ceil(np.quantile(gaps, WITHIN)))
        return coder

    @property
    def bits(self) -> int:
        return 64 * len(self.rotations)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Rows of ROTATIONS 64-bit words."""
        out = []
        for rotation in self.rotations:
            bits = np.zeros((len(vectors), 64), np.uint8)
            bits[:, : rotation.shape[1]] = (vectors - self.mean) @ rotation > 0
            out.append(np.packbits(bits, axis=1).view(">u8").astype(np.uint64))
        return np.concatenate(out, axis=1)


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


def piece_width(bits: int, radius: int) -> int:
    """The substring width with the fewest rows expected of all tables, for even codes."""

    def share(width: int) -> float:
        near = sum(comb(width, i) for i in range(min(radius // (bits // width), width) + 1)) / 2**width
        return bits // width * near

    return min((w for w in WIDTHS if w <= bits), key=share)


@lru_cache(maxsize=8)
def flips(width: int, most: int) -> np.ndarray | None:
    """All substrings with at most ``most`` set bits, if they are at most PROBES."""
    if sum(comb(width, i) for i in range(most + 1)) > PROBES:
        return None
    return np.array([sum(1 << b for b in chosen) for i in range(most + 1) for chosen in combinations(range(width), i)], np.uint64)


class Index:
    """A table for each substring of the codes of one block: distinct substrings, and the
    rows of each."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, self.radius = np.ascontiguousarray(codes), radius
        self.width = piece_width(64 * codes.shape[1], radius)
        self.kind = {16: np.uint16, 32: np.uint32, 64: np.uint64}[self.width]
        self.tables = []
        for piece in self.codes.view(self.kind).reshape(len(codes), -1).T:
            order = np.argsort(piece, kind="stable")
            values, first = np.unique(piece[order], return_index=True)
            self.tables.append((values, first, np.diff(np.append(first, len(order))), order))

    def retrieved(self, code: np.ndarray) -> np.ndarray:
        """Rows that agree with the code in one substring to as many bits as the radius asks."""
        each = self.radius // len(self.tables)
        near_by = flips(self.width, min(each, self.width))
        found = np.zeros(len(self.codes), bool)
        for (values, first, count, order), piece in zip(self.tables, code.view(self.kind)):
            if near_by is not None and len(near_by) < len(values):
                asked = piece ^ near_by.astype(self.kind)
                hit = np.minimum(np.searchsorted(values, asked), len(values) - 1)
                hit = hit[values[hit] == asked]
            else:
                hit = np.flatnonzero(np.bitwise_count(values ^ piece) <= each)
            found[order[ranges(first[hit], count[hit])]] = True
        return np.flatnonzero(found)

    def within(self, code: np.ndarray) -> np.ndarray:
        """Rows whose codes differ in at most the radius."""
        rows = self.retrieved(code)
        return rows[hamming(self.codes[rows], code) <= self.radius]


def search_cell(base: pa.Table, queries: pa.Table, coder: Coder, radius: int, k: int) -> pa.Table:
    """The k nearest rows of one block for each of its queries."""
    out: list[list] = [[], [], []]
    if base.num_rows and queries.num_rows:
        ids, vectors = base.column("vec_id").to_numpy(), matrix(base.column("vector"))
        asked, wanted = queries.column("vec_id").to_numpy(), matrix(queries.column("vector"))
        norms, own = np.sqrt((vectors * vectors).sum(axis=1)), np.sqrt((wanted * wanted).sum(axis=1))
        index = Index(coder.codes(vectors / norms[:, None]), radius)
        for q, code in enumerate(coder.codes(wanted / own[:, None])):
            rows = index.within(code)
            rows = rows[ids[rows] != asked[q]]
            if not len(rows):
                continue
            score = (vectors[rows] * wanted[q]).sum(axis=1) / (norms[rows] * own[q])
            best = np.lexsort((ids[rows], -score))
            _, first = np.unique(ids[rows][best], return_index=True)  # an id's best
            best = best[np.sort(first)][:k]
            out[0] += [asked[q]] * len(best)
            out[1] += ids[rows][best].tolist()
            out[2] += score[best].tolist()
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (array of double) of the rows that take part."""
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND size(vector) > 0")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own = own.where(fine & F.exists("vector", lambda x: x != 0))
    return own.dropDuplicates(["vec_id", "vector"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` nearest to each row of
    ``queries`` that are found, nearest first."""
    base = materialize(valid(vectors, id_col, vector_col), "vectors")
    asked = materialize(valid(queries, id_col, vector_col), "queries")
    sizes = [r["n"] for r in asked.groupBy(F.size("vector").alias("n")).count().orderBy("n").collect()]
    found = None
    for size in sizes:
        own = F.size("vector") == size
        more = _nearest(base.where(own), asked.where(own), k, sample)
        found = more if found is None else found.unionByName(more)
    if found is None:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    return _ranked(found, k) if len(sizes) > 1 else found


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(base: DataFrame, asked: DataFrame, k: int, sample: int) -> DataFrame:
    """``nearest`` for vectors of one length."""
    n, n_ids, n_asked = base.count(), base.select("vec_id").distinct().count(), asked.count()
    learn = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    unit = matrix(learn.column("vector"))
    if n_ids < 2:
        return asked.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    coder = Coder.fit(unit / np.sqrt((unit * unit).sum(axis=1))[:, None], k)
    blocks, parts = n // BLOCK + 1, n_asked // PART + 1

    def cells(rows: DataFrame, own: int, others: int, mine: bool) -> DataFrame:
        at = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(own))
        other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        dealt = rows.select("vec_id", "vector", at.alias("at"), other.alias("other"))
        cell = F.col("at") * F.lit(others) + F.col("other") if mine else F.col("other") * F.lit(own) + F.col("at")
        return dealt.select("vec_id", "vector", cell.cast("long").alias("cell"))

    def search(asked: DataFrame, radius: int) -> DataFrame:
        left, right = cells(base, blocks, parts, True), cells(asked, parts, blocks, False)
        found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(lambda b, q: search_cell(b, q, coder, radius, k), "query_id long, vec_id long, score double")
        return _ranked(found, k)

    found = materialize(search(asked, coder.radius), "found")
    full = found.where(F.col("rank") == min(k, n_ids - 1)).select("query_id")
    short = materialize(asked.join(full, asked.vec_id == full.query_id, "left_anti"), "short")
    if short.isEmpty():
        return found
    again = search(short, coder.bits)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE_SQL = None
