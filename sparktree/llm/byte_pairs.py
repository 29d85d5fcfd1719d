"""Byte-level BPE encoding and decoding by segment trees of pair ranks.

A piece of text (a match of the vocabulary's pattern) begins as its bytes. A segment
tree over the byte positions holds at leaf i the rank of the token that starts at i
joined with its right neighbour, and at each inner node the least of its children as
(rank, position), so the root names the leftmost pair of least rank. A merge makes that
pair one token, unlinks its right half from the list of live neighbours, and updates
three leaves (the pair, what stood right of it, the pair to its left) up to the root:
logarithmic in the piece, however long it is.

Each task remembers the ids of the different pieces that it has met; new ones of a slice
are merged together, one merge of every piece a step, in one array of trees for each
power of two of length. Pieces beyond ``TOGETHER`` bytes have a tree each. The
vocabulary (tokens, and the pairs of tokens that join to one) is broadcast: its size is
the vocabulary's and doesn't grow with the corpus. Nothing is shuffled.

Defined results: a null or empty text has no ids and decodes to no bytes; rows of a
null or repeated id are encoded one by one; bytes that are no UTF-8 are read as U+FFFD,
as the pattern needs characters; ids outside the vocabulary, when decoding, are an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, ranges, slices, table, tidied

#: Longest piece, in bytes, that is merged together with others.
TOGETHER = 64
#: Pieces, and their ids, that a task remembers; then it begins anew.
REMEMBERED = 1 << 19
#: Matches that are turned into ids at a time, so that one long text costs no more.
MATCHES = 1 << 17
NONE = np.iinfo(np.int64).max
POSITION = np.int64((1 << 32) - 1)


@dataclass
class Vocabulary:
    """``data``/``ends``: the tokens' bytes, by id, one after another; ``pairs``: sorted
    (left id, right id) of 32 bits each that join to a token, and the ``joined`` token."""

    data: np.ndarray
    ends: np.ndarray
    pairs: np.ndarray
    joined: np.ndarray

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Vocabulary:
        """From ranks that are dense from 0 and hold every single byte."""
        tokens = sorted(ranks, key=ranks.__getitem__)
        if [ranks[t] for t in (tokens[0], tokens[-1])] != [0, len(tokens) - 1] or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must count from 0 without gaps and hold all 256 bytes")
        get = ranks.get
        found = [(left << 32 | right, n) for n, t in enumerate(tokens) for i in range(1, len(t)) if (left := get(t[:i])) is not None and (right := get(t[i:])) is not None]
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([len(t) for t in tokens]), np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a file of lines "base64 rank"."""
        with open(path, "rb") as f:
            return cls.of({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})

    def arrays(self) -> tuple[np.ndarray, ...]:
        """What to broadcast: executors need not have this class on their path."""
        return self.data, self.ends, self.pairs, self.joined

    def tokens(self) -> list[bytes]:
        data, ends = self.data.tobytes(), self.ends.tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair joins to; -1 if none."""
        if not len(self.pairs):
            return np.full(len(left), -1, np.int64)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joined[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.ends)):
            raise ValueError("an id is not in the vocabulary")
        start = np.append(0, self.ends[:-1])[ids]
        return self.data[ranges(start, self.ends[ids] - start)].tobytes()


def keyed(rank: np.ndarray, position: np.ndarray) -> np.ndarray:
    """(rank, position) as one number; NONE where there is no rank."""
    return np.where(rank < 0, NONE, rank << 32 | position)


def merge_together(vocabulary: Vocabulary, byte_ids: np.ndarray, pieces: list[bytes]) -> list[np.ndarray]:
    """The ids of pieces of 2 to ``TOGETHER`` bytes: a row of each array is a piece's tree."""
    out: list[np.ndarray] = [None] * len(pieces)
    size = np.array([len(p) for p in pieces])
    width = 1 << np.ceil(np.log2(size)).astype(int)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        n = size[own]
        token = np.zeros((len(own), w + 1), np.int64)
        place = np.arange(w)
        token[:, :w][place < n[:, None]] = byte_ids[np.frombuffer(b"".join(pieces[i] for i in own), np.uint8)]
        after = np.minimum(np.broadcast_to(np.arange(1, w + 2), token.shape), n[:, None]).copy()
        before = np.broadcast_to(np.arange(-1, w), token.shape).copy()
        tree = np.full((len(own), 2 * w), NONE, np.int64)
        pair = place < n[:, None] - 1
        tree[:, w:][pair] = keyed(vocabulary.rank(token[:, :w][pair], token[:, 1:][pair]), np.nonzero(pair)[1])
        half = w // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        alive = np.ones((len(own), w), bool) & (place < n[:, None])
        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            least = tree[row, 1]
            left = least & POSITION
            right = after[row, left]
            token[row, left] = least >> 32
            alive[row, right] = False
            beyond = after[row, right]
            after[row, left] = beyond
            before[row, beyond] = left
            first = before[row, left]
            on, off = beyond < n[row], first >= 0
            leaf_left, leaf_first = np.full(len(row), NONE), np.full(len(row), NONE)
            leaf_left[on] = keyed(vocabulary.rank(token[row, left][on], token[row, beyond][on]), left[on])
            leaf_first[off] = keyed(vocabulary.rank(token[row, first][off], token[row, left][off]), first[off])
            first = np.where(off, first, left)
            tree[row, w + right] = NONE
            tree[row, w + first] = leaf_first
            tree[row, w + left] = leaf_left
            nodes = [w + right, w + left, w + first]
            for _ in range(int(w).bit_length() - 1):
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[row, x] = np.minimum(tree[row, 2 * x], tree[row, 2 * x + 1])
            row = row[tree[row, 1] != NONE]
        for i, t, a in zip(own.tolist(), token, alive):
            out[i] = t[:w][a]
    return out


def merge_long(pairs: dict[int, int], byte_ids: list[int], piece: bytes) -> list[int]:
    """The ids of one piece of any length, by a tree of its own."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    none = int(NONE)
    token = [byte_ids[b] for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n))
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = pairs.get(token[i] << 32 | token[i + 1])
        if rank is not None:
            tree[width + i] = rank << 32 | i
    for x in range(width - 1, 0, -1):
        tree[x] = min(tree[2 * x], tree[2 * x + 1])

    def update(i: int, rank: int | None) -> None:
        x = width + i
        tree[x] = none if rank is None else rank << 32 | i
        while x > 1:
            x >>= 1
            least = min(tree[2 * x], tree[2 * x + 1])
            if tree[x] == least:
                return
            tree[x] = least

    while tree[1] != none:
        left = tree[1] & 0xFFFFFFFF
        right = after[left]
        token[left] = tree[1] >> 32
        beyond = after[left] = after[right]
        token[right] = -1
        before[beyond] = left
        update(right, None)
        update(left, pairs.get(token[left] << 32 | token[beyond]) if beyond < n else None)
        first = before[left]
        if first >= 0:
            update(first, pairs.get(token[first] << 32 | token[left]))
    return [t for t in token if t >= 0]


class Encoder:
    """Ids of texts; remembers those of the pieces it has met."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary = vocabulary
        self.pattern = regex.compile(pattern)
        self.whole = {t: i for i, t in enumerate(vocabulary.tokens())}
        self.byte_ids = np.array([self.whole[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] | None = None
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_piece(self, piece: bytes) -> np.ndarray:
        if self.pairs is None:
            self.pairs = dict(zip(self.vocabulary.pairs.tolist(), self.vocabulary.joined.tolist()))
        return np.array(merge_long(self.pairs, self.byte_ids.tolist(), piece), np.int32)

    def learn(self, new: set[str]) -> None:
        """Remember the ids of pieces that are met for the first time. A piece that is a token is that token."""
        if len(self.number) + len(new) > REMEMBERED or len(self.ids) > 8 * REMEMBERED:
            raise OverflowError
        pieces = [p.encode() for p in new]
        found: list = [None] * len(pieces)
        merged = []
        for i, p in enumerate(pieces):
            own = self.whole.get(p)
            if own is not None:
                found[i] = np.array([own], np.int32)
            elif len(p) > TOGETHER:
                found[i] = self.encode_piece(p)
            else:
                merged.append(i)
        if merged:
            for i, ids in zip(merged, merge_together(self.vocabulary, self.byte_ids, [pieces[i] for i in merged])):
                found[i] = ids
        count = np.array([len(x) for x in found], np.int64)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, *found]).astype(np.int32)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some pieces, one after another, and where those of each end, from 0 on."""
        new = set(pieces).difference(self.number)
        if new:
            try:
                self.learn(new)
            except OverflowError:
                self.forget()
                self.learn(set(pieces))
        code = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        return self.ids[ranges(self.start[code], self.count[code])], np.append(0, np.cumsum(self.count[code]))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text. Pieces are looked up some at a time, over all texts."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[str] = []
        cuts: list[tuple[int, int]] = []

        def flush() -> None:
            ids, ends = self.ids_of(held)
            at = 0
            for i, end in cuts:
                parts[i].append(ids[ends[at] : ends[end]])
                at = end
            held.clear()
            cuts.clear()

        for i, text in enumerate(texts):
            if len(text or "") <= MATCHES:
                held += self.pattern.findall(text or "")
            else:
                for match in self.pattern.finditer(text):
                    held.append(match[0])
                    if len(held) >= MATCHES:
                        cuts.append((i, len(held)))
                        flush()
            cuts.append((i, len(held)))
            if len(held) >= MATCHES:
                flush()
        flush()
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, np.int32) for p in parts]


def lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.append(0, np.cumsum([len(v) for v in values]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32()))


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (an array of int) of every row of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary.arrays())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*shipped.value), pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [None if t is None else t.decode("utf-8", "replace") for t in binary(part.column(1)).to_pylist()]
                yield pa.record_batch([part.column(0), lists(encoder.encode(texts))], names=["doc_id", "ids"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(tidied(run), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids (null for null ids)."""
    spark = encoded.sparkSession
    shipped = spark.sparkContext.broadcast(vocabulary.arrays())
    at = encoded.columns.index(ids_col)
    if "decoded" in encoded.columns:
        raise ValueError("there is a column decoded already")
    schema = encoded.select("*", F.lit(b"").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(*shipped.value)
        for batch in batches:
            ids = batch.column(at)
            out = [None if not ids[i].is_valid else own.decode(ids[i].values.to_numpy(zero_copy_only=False)) for i in range(batch.num_rows)]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(tidied(run), schema)


def op11_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes they decode to."""
    import public_tokenizers

    vocabulary = Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = decode_ids(encode_documents(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN), vocabulary)
    words = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(words.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


ORACLE_SQL = None
