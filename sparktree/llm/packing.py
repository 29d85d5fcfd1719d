"""Sum-of-squares online packing of documents into fixed windows.

Each task packs the documents of its partition as they come. Whole windows of a long
document are sequences of their own; the rest of it goes to the fill level that
minimises the sum of squares of N(h), the number of open windows filled to level h,
which a level array keeps. There are ``LEVELS`` levels, so that the array fills soon and
a sum of squares says something. Levels with no open window are out, a new window
counts as level 0, ties go to the fullest. A window whose room is less than a level is
topped up with the first ids of the next document (documents may be cut) and written.

What stays open at the end of a partition, or whenever ``OPEN`` windows are open, is
joined and cut into full windows, so memory is bounded and at most one window of a
task is not full. That last one is cut at powers of two, at which a sequence takes no
padding. Sequence numbers hold the partition number, so a task that is repeated after
a lost executor gives the same rows; nothing is shuffled and nothing goes to the driver.

Defined results: a null text is empty and packs as its end token alone; rows with
equal or null ids are packed one by one.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, slices, table, tidied

#: Open windows of a task beyond which they are joined.
OPEN = 2048
#: Fill levels of a window.
LEVELS = 8
#: Words that a worker remembers the ids of, some 150 bytes each.
REMEMBERED = 50_000
SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids as the ``tokenizers`` file gives them, as bytes of uint32.

    The vocabulary's pattern never joins a space to what stands before it, so text
    without two spaces in a row splits at spaces into parts whose ids don't depend on
    each other; the ids of a part are looked up, and computed once with the same
    vocabulary's rank file. Other texts go to ``tokenizers`` whole, which is loaded for
    the first of them, as it takes more memory than all the rest.
    """

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import base64

        import tiktoken

        self.tokenizer = tokenizer
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.part = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=table, special_tokens={})._core_bpe.encode_to_tiktoken_buffer
        self.known: dict[str, bytes] = {}

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.tokenizer)

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        none: set[str] = set()
        for text in texts:
            if not text:
                yield b""
            elif "  " in text or text[-1] == " " or SPECIAL in text:
                yield np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
            else:
                first, *parts = text.split(" ")
                known = self.known
                if len(known) > REMEMBERED:
                    known.clear()
                for x in set(parts).difference(known):
                    known[x] = bytes(self.part(" " + x, none))
                yield (bytes(self.part(first, none)) if first else b"") + b"".join(map(known.__getitem__, parts))


def size_of(pieces: list[tuple]) -> int:
    return sum(len(p[2]) for p in pieces)


class Packer:
    """Sum-of-squares packing. ``out`` gets (doc, start, ids, sequence, offset); ``joined``
    counts the windows that were made at the end, not by levels."""

    def __init__(self, window: int):
        self.window, self.step = window, -(-window // LEVELS)
        self.top = window // self.step
        self.levels = [0] * self.top
        self.open: dict[int, list[list]] = defaultdict(list)
        self.short: list[list] = []  # windows with less room than a level
        self.n_open = self.next = self.joined = 0
        self.out: list[tuple] = []

    def add(self, doc: int, ids: np.ndarray) -> None:
        start = 0
        while len(ids) - start >= self.window:
            self.write([(doc, start, ids[start : start + self.window])])
            start += self.window
        while self.short and start < len(ids):
            pieces = self.short.pop()
            room = self.window - size_of(pieces)
            pieces.append((doc, start, ids[start : start + room].copy()))
            start += room
            self.shelve(pieces)
        if start < len(ids):
            self.place((doc, start, ids[start:].copy()))

    def level(self, pieces: list[tuple]) -> int:
        return -(-size_of(pieces) // self.step)

    def choose(self, size: int) -> int:
        """The level to which a piece of so many levels goes; 0 for a new window. Each is
        measured by what it adds to the sum of squares; a window at the top is not open."""
        n, top = self.levels, self.top
        if size >= top:
            return 0
        best, least = 0, 2 * n[size] + 1
        for h in range(1, top - size + 1):
            if n[h]:
                cost = 1 - 2 * n[h] + (2 * n[h + size] + 1 if h + size < top else 0)
                if cost <= least:
                    best, least = h, cost
        return best

    def place(self, piece: tuple) -> None:
        level = self.choose(self.level([piece]))
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        pieces.append(piece)
        self.shelve(pieces)
        if self.n_open > OPEN:
            self.join(last=False)

    def shelve(self, pieces: list[tuple]) -> None:
        """Write a full window; keep another at its level."""
        size = size_of(pieces)
        level = self.level(pieces)
        if size == self.window:
            self.write(pieces)
        elif level >= self.top:
            self.short.append(pieces)
        else:
            self.open[level].append(pieces)
            self.levels[level] += 1
            self.n_open += 1

    def join(self, last: bool = True) -> None:
        """Cut what is open into full windows."""
        pieces = [p for level in sorted(self.open) for group in self.open[level] for p in group]
        pieces += [p for group in self.short for p in group]
        self.open.clear()
        self.short.clear()
        self.levels = [0] * self.top
        self.n_open, before = 0, self.next
        left = sum(len(p[2]) for p in pieces)
        room, held, filled = (self.window, [], 0) if left >= self.window or not last else (1 << (left.bit_length() - 1) if left else 0, [], 0)
        for doc, start, ids in pieces:
            while len(ids):
                take = min(room - filled, len(ids))
                held.append((doc, start, ids[:take]))
                start, ids, filled, left = start + take, ids[take:], filled + take, left - take
                if filled == room:
                    self.write(held)
                    held, filled = [], 0
                    room = self.window if left >= self.window or not last else 1 << (left.bit_length() - 1) if left else 0
        self.joined += self.next - before
        if held:
            self.shelve(held)

    def write(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids in pieces:
            self.out.append((doc, start, ids, self.next, offset))
            offset += len(ids)
        self.next += 1


def pack_documents(docs: DataFrame, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, with ``with_ids``, ids (array of int).

    ``tokenizer``, ``ranks``: paths of the same vocabulary for ``tokenizers`` and as a
    rank file; the installed public ones if not given.
    """
    import public_tokenizers

    bound_batches(docs.sparkSession)
    files = (tokenizer or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(kinds + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Encoder(*files), Packer(window)
        base = TaskContext.get().partitionId() << 40
        end = np.array([end_id], np.uint32).tobytes()

        def rows() -> pa.RecordBatch:
            cols: list[list] = [[] for _ in kinds]
            for (doc, total), start, ids, sequence, offset in packer.out:
                for c, v in zip(cols, (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + sequence, offset)):
                    c.append(v)
            arrays = [pa.array(c, t) for c, (_, t) in zip(cols, kinds)]
            if with_ids:
                flat = np.concatenate([p[2] for p in packer.out] or [np.zeros(0, np.uint32)])
                arrays.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(cols[2])), pa.int32()), pa.array(flat.view(np.int32))))
            packer.out = []
            return pa.record_batch(arrays, schema=schema)

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    ids = np.frombuffer(ids + end, np.uint32)
                    packer.add((doc, len(ids)), ids)
                yield rows()
        packer.join()
        yield rows()

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), ddl)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).drop("ids")


ORACLE_SQL = None
