"""Gadget snapshots: one block of one or more files, by record ranges, and a sink.

A file is a header of 256 bytes and blocks, each between two 4-byte lengths. The first
length tells the byte order; a block's length and the header's number of records tell
whether it has 1 or 3 values a record.
"""

from __future__ import annotations

import os
import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .tipsy import opened, recorded

# tasks need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the format: numbers by type, masses by type, time, redshift, two flags,
# totals by type, flag and number of files, box and three cosmological numbers; the rest is 0.
HEADER, HEADER_BYTES = "6i6ddd2i6i2i4d", 256
#: Gadget's place of gas, dark and star records among its six types.
PLACES = (0, 1, 4)
#: The blocks that are written, in their order, with the kind of their values.
BLOCKS = ((("x", "y", "z"), "f4"), (("vx", "vy", "vz"), "f4"), (("id",), "u4"), (("mass",), "f4"))
BATCH = 65536
SCHEMA = "file int, dim int, idx long, value double"


def names(path: str, files: int) -> list[str]:
    return [path] if files == 1 else [f"{path}.{i}" for i in range(files)]


@dataclass
class Found:
    """Where a file has its block: byte order, offset of the values, records, values a record."""

    path: str
    order: str
    offset: int
    records: int
    width: int


def locate(path: str, block: int) -> Found:
    """Steps over the blocks before by their lengths; reads headers and lengths alone."""
    with opened(path) as f:
        first = f.read(4)
        order = next((o for o in "<>" if first == struct.pack(f"{o}i", HEADER_BYTES)), None)
        if order is None:
            raise ValueError(f"{path} does not begin with a header of {HEADER_BYTES} bytes")
        records = sum(struct.unpack(f"{order}6i", f.read(24)))
        at = 0
        for number in range(-1, block + 1):  # the header is framed like the blocks
            f.seek(at)
            head = f.read(4)
            if len(head) < 4:
                raise ValueError(f"{path} has no block {block}")
            size = struct.unpack(f"{order}I", head)[0]
            f.seek(at + 4 + size)
            if f.read(4) != head:
                raise ValueError(f"block {number} of {path} does not end with its length")
            start, at = at + 4, at + size + 8
    if size not in (4 * records, 12 * records):
        raise ValueError(f"block {block} of {path} has {size} bytes for {records} records")
    return Found(path, order, start, records, size // (4 * records) if records else 1)


@dataclass
class Part(InputPartition):
    found: Found
    file: int
    before: int
    first: int
    last: int


class GadgetReader(DataSourceReader):
    def __init__(self, options: dict):
        self.block = int(options.get("block", "0"))
        self.kind = options.get("kind", "f4")
        self.split = int(options.get("splitbytes", options.get("splitBytes", str(64 << 20))))
        self.files = names(options["path"], int(options.get("files", "1")))

    def partitions(self) -> list[Part]:
        parts, before = [], 0
        for number, path in enumerate(self.files):
            found = locate(path, self.block)
            each = max(1, self.split // (4 * found.width))
            parts += [Part(found, number, before, a, min(a + each, found.records)) for a in range(0, found.records, each)]
            before += found.records
        return parts or [Part(Found(self.files[0], "<", 0, 0, 1), 0, 0, 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        found = part.found
        with opened(found.path) as f:
            for a in range(part.first, part.last, BATCH):
                n = min(a + BATCH, part.last) - a
                f.seek(found.offset + 4 * found.width * a)
                values = np.frombuffer(f.read(4 * found.width * n), f"{found.order}{self.kind}").reshape(n, found.width).astype(float)
                rows = part.before + np.arange(a, a + n)
                for dim in range(found.width):
                    columns = [np.full(n, part.file, np.int32), np.full(n, dim, np.int32), rows, np.ascontiguousarray(values[:, dim])]
                    yield pa.record_batch([pa.array(c) for c in columns], names=["file", "dim", "idx", "value"])


@dataclass
class Written(WriterCommitMessage):
    records: int


@dataclass
class Plan:
    """What tasks need to write: drafts, the record at which each file begins, and how many
    records there are."""

    drafts: list[str]
    starts: list[int]
    records: int
    order: str


class GadgetWriter(DataSourceArrowWriter):
    """Writes values to their places: a repeated task writes the same bytes again."""

    def __init__(self, options: dict):
        self.files = names(options["path"], int(options["files"]))
        self.plan = Plan(options["drafts"].split("\n"), [int(i) for i in options["starts"].split(",")], int(options["records"]), options["order"])

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        plan, done = self.plan, 0
        ends = [*plan.starts[1:], plan.records]
        for batch in batches:
            column = {c: batch.column(i).to_numpy() for i, c in enumerate(batch.schema.names)}
            order = np.argsort(column["at"], kind="stable")
            at = column["at"][order]
            for draft, start, end in zip(plan.drafts, plan.starts, ends):
                own = order[np.searchsorted(at, start) : np.searchsorted(at, end)]
                if not len(own):
                    continue
                place = column["at"][own] - start
                cuts = np.append(np.flatnonzero(np.append(True, np.diff(place) != 1)), len(place))
                file = os.open(draft, os.O_WRONLY)
                try:
                    offset = HEADER_BYTES + 8 + 4
                    for block, kind in BLOCKS:
                        values = np.stack([column[c][own] for c in block], axis=1).astype(f"{plan.order}{kind}")
                        for lo, hi in zip(cuts, cuts[1:]):
                            where, data = int(offset + 4 * len(block) * place[lo]), memoryview(values[lo:hi].tobytes())
                            while data:
                                n = os.pwrite(file, data, where)
                                where, data = where + n, data[n:]
                        offset += 4 * len(block) * (end - start) + 8
                    os.fsync(file)
                finally:
                    os.close(file)
                done += len(own)
        return Written(done)

    def commit(self, messages: list) -> None:
        n = sum(m.records for m in messages if m is not None)
        if n != self.plan.records:
            raise ValueError(f"{n} records were written of {self.plan.records}")
        for draft, path in zip(self.plan.drafts, self.files):
            os.replace(draft, path)

    def abort(self, messages: list) -> None:
        for draft in self.plan.drafts:
            if os.path.exists(draft):
                os.remove(draft)


class GadgetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gadget"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GadgetReader:
        return GadgetReader(self.options)

    def writer(self, schema, overwrite: bool) -> GadgetWriter:
        return GadgetWriter(self.options)


def read_gadget(spark: SparkSession, path: str, block: int, files: int = 1, kind: str = "f4", split_bytes: int = 64 << 20) -> DataFrame:
    """(file, dim, idx, value) of one block: idx counts the records of all files in their
    order (``path``, or ``path``.0, ``path``.1 and so on), dim the values of a record. Tasks
    read ranges of records, of at most ``split_bytes``; the driver reads headers and lengths.
    ``kind``: f4, or u4 for a block of ids. A file of no records gives no rows."""
    spark.dataSource.register(GadgetSource)
    return spark.read.format("gadget").option("block", str(block)).option("files", str(files)).option("kind", kind).option("splitBytes", str(split_bytes)).load(path)


def skeleton(draft: str, counts: list[int], totals: list[int], files: int, order: str, time: float) -> None:
    """A draft with its header and the lengths around its blocks."""
    by_type = lambda c: [c[PLACES.index(i)] if i in PLACES else 0 for i in range(6)]
    frame = lambda n: struct.pack(f"{order}I", n)
    head = struct.pack(f"{order}{HEADER}", *by_type(counts), *[0.0] * 6, time, 0.0, 0, 0, *by_type(totals), 0, files, *[0.0] * 4)
    with open(draft, "wb") as f:
        f.write(frame(HEADER_BYTES) + head.ljust(HEADER_BYTES, b"\0") + frame(HEADER_BYTES))
        for block, _ in BLOCKS:
            size = 4 * len(block) * sum(counts)
            if size >= 1 << 32:
                raise ValueError("a block holds less than 4 GB: write more files")
            f.write(frame(size))
            f.seek(size, os.SEEK_CUR)
            f.write(frame(size))


def write_gadget(rows: DataFrame, path: str, files: int = 1, order: str = "<", time: float = 0.0) -> None:
    """Positions, velocities, ids and masses of gas, dark and star rows, then by id, in
    ``files`` files of equal ranges of records. Tasks write their records at their places
    in drafts beside the files; the driver writes headers and lengths. ``path`` must lie in
    a folder that the driver and all executors mount. Ids are unsigned 4-byte numbers: the
    caller's do not fit if they are larger, which is an error."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError("a snapshot is written to a mounted folder")
    path = path.removeprefix("file://")
    beyond = rows.where(~F.col("id").between(0, (1 << 32) - 1)).limit(1).count()
    if beyond:
        raise ValueError("ids are unsigned 4-byte numbers")
    records, counts = recorded(rows)
    n, each = sum(counts), max(1, -(-sum(counts) // files))
    starts = [min(i * each, n) for i in range(files)]
    drafts = [f"{name}.{uuid.uuid4().hex}" for name in names(path, files)]
    for draft, start, end in zip(drafts, starts, [*starts[1:], n]):
        before, own = 0, []
        for count in counts:
            own.append(max(0, min(end, before + count) - max(start, before)))
            before += count
        skeleton(draft, own, counts, files, order, time)
    rows.sparkSession.dataSource.register(GadgetSource)
    out = records.select(F.col("at").cast("long").alias("at"), F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for block, kind in BLOCKS for c in block if c != "id"))
    options = {"files": str(files), "drafts": "\n".join(drafts), "starts": ",".join(map(str, starts)), "records": str(n), "order": order}
    out.write.format("gadget").mode("append").options(**options).save(path)
