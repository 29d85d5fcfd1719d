"""Tipsy snapshots: a data source by record ranges, and a sink by record numbers."""

from __future__ import annotations

import os
import struct
import sys
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.tables import written

# tasks need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the format: big-endian; header, then gas, dark and star records.
HEADER, HEADER_BYTES = ">diiiiii", 32
#: Fields of 4-byte floats in a record.
FIELDS = {2: 12, 3: 9, 1: 11}
TYPES = {"gas": 2, "dark": 3, "star": 1}
#: Place of softening in a record, and of temperature in a gas record.
SOFT = {2: 9, 3: 7}
#: Where softening is written; that of stars is not read back.
EPS = {2: 9, 3: 7, 1: 9}
TEMPERATURE = 8
GAMMA_M1, GAS_CONSTANT, MOLECULAR_WEIGHT = 2.0 / 3.0, 1.0, 1.0
SCHEMA = "id long, type int, mass double, soft double, u double, x double, y double, z double, vx double, vy double, vz double"


def opened(path: str):
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return where.open_input_file(name)


class Part(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class TipsyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.parts = int(options.get("partitions", "8"))

    def header(self) -> list[tuple[int, int]]:
        """(type, number of records) in file order."""
        with opened(self.path) as f:
            _, _, _, gas, dark, star, _ = struct.unpack(HEADER, f.read(HEADER_BYTES))
        return [(2, gas), (3, dark), (1, star)]

    def partitions(self) -> list[Part]:
        n = sum(c for _, c in self.header())
        small, more = divmod(n, self.parts)
        ends = [0]
        for i in range(self.parts):
            ends.append(ends[-1] + small + (i < more))
        return [Part(a, b) for a, b in zip(ends, ends[1:]) if b > a] or [Part(0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        before, offset = 0, HEADER_BYTES
        with opened(self.path) as f:
            for kind, count in self.header():
                size = 4 * FIELDS[kind]
                lo, hi = max(part.first, before), min(part.last, before + count)
                for a in range(lo, hi, 65536):
                    b = min(a + 65536, hi)
                    f.seek(offset + (a - before) * size)
                    values = np.frombuffer(f.read((b - a) * size), ">f4").reshape(b - a, -1).astype(float)
                    soft = values[:, SOFT[kind]] if kind in SOFT else np.zeros(b - a)
                    u = values[:, TEMPERATURE] * GAS_CONSTANT / GAMMA_M1 / MOLECULAR_WEIGHT if kind == 2 else np.zeros(b - a)
                    columns = [np.arange(a, b), np.full(b - a, kind, np.int32), values[:, 0], soft, u, *values[:, 1:7].T]
                    yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])
                before += count
                offset += count * size


class TipsySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tipsy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TipsyReader:
        return TipsyReader(self.options)

    def writer(self, schema, overwrite: bool) -> TipsyWriter:
        return TipsyWriter(self.options)


def read_tipsy(spark: SparkSession, path: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(TipsySource)
    return spark.read.format("tipsy").option("partitions", str(partitions)).load(path)


@dataclass
class Written(WriterCommitMessage):
    records: int


class TipsyWriter(DataSourceArrowWriter):
    """Writes records to their places in a file that all tasks share: the number of a record
    (column ``at``) is its place, so a task that is repeated writes the same bytes again."""

    def __init__(self, options: dict):
        self.path, self.draft = options["path"], options["draft"]
        self.counts = [int(options[k]) for k in TYPES]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        kinds, done = list(TYPES.values()), 0
        first = np.cumsum([0, *self.counts])
        sizes = np.array([4 * FIELDS[k] for k in kinds])
        offset = HEADER_BYTES + np.append(0, np.cumsum(np.array(self.counts) * sizes))
        file = os.open(self.draft, os.O_WRONLY)
        try:
            for batch in batches:
                column = {c: batch.column(i).to_numpy() for i, c in enumerate(batch.schema.names)}
                order = np.argsort(column["at"], kind="stable")
                at = column["at"][order]
                for i, kind in enumerate(kinds):
                    own = order[(at >= first[i]) & (at < first[i + 1])]
                    if not len(own):
                        continue
                    block = np.zeros((len(own), FIELDS[kind]), ">f4")
                    for k, c in enumerate(("mass", "x", "y", "z", "vx", "vy", "vz")):
                        block[:, k] = column[c][own]
                    block[:, EPS[kind]] = column["soft"][own]
                    if kind == 2:
                        block[:, TEMPERATURE] = column["u"][own] * (GAMMA_M1 * MOLECULAR_WEIGHT / GAS_CONSTANT)
                    place = column["at"][own] - first[i]
                    cuts = np.append(np.flatnonzero(np.append(True, np.diff(place) != 1)), len(place))
                    for lo, hi in zip(cuts, cuts[1:]):
                        where, data = int(offset[i] + place[lo] * sizes[i]), memoryview(block[lo:hi].tobytes())
                        while data:
                            n = os.pwrite(file, data, where)
                            where, data = where + n, data[n:]
                    done += len(own)
            os.fsync(file)
        finally:
            os.close(file)
        return Written(done)

    def commit(self, messages: list) -> None:
        n = sum(m.records for m in messages if m is not None)
        if n != sum(self.counts):
            raise ValueError(f"{n} records were written of {sum(self.counts)}")
        os.replace(self.draft, self.path)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.draft):
            os.remove(self.draft)


def recorded(rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """``rows`` with ``at``, their record numbers in the order of (gas, dark, star), then id;
    and how many of each there are. Rows are sorted by ranges, written, and numbered by
    the counts of the ranges before; a row for each range is all that the driver sees."""
    section = F.when(F.col("type") == 2, 0).when(F.col("type") == 3, 1).otherwise(2)
    order = ["_s", "id", "x", "y", "z", "mass"]
    sorted_ = rows.withColumn("_s", section).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(sorted_.withColumn("_row", F.monotonically_increasing_id()), "records")
    part = F.shiftright("_row", 33)
    found = ranged.groupBy(part.alias("part"), "_s").count().collect()
    sizes, counts = defaultdict(int), [0, 0, 0]
    for r in found:
        sizes[r["part"]] += r["count"]
        counts[r["_s"]] += r["count"]
    before, starts = 0, []
    for number in sorted(sizes):
        starts.append((number, before))
        before += sizes[number]
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    numbered = ranged.join(F.broadcast(starts), part == F.col("_part")).withColumn("at", F.col("_before") + F.col("_row").bitwiseAND((1 << 33) - 1))
    return numbered.drop("_part", "_before", "_row", "_s"), counts


def routed(rows: DataFrame, writers: int) -> DataFrame:
    """Records (``at``) with the ``writer`` of each: equal ranges of record numbers, in order."""
    each = F.ceil(F.lit(rows.count()) / writers)
    return rows.withColumn("writer", F.floor(F.col("at") / F.greatest(each, F.lit(1))).cast("int"))


def write_tipsy(rows: DataFrame, path: str, time: float = 0.0) -> None:
    """One file of mass, position, velocity, softening and gas temperature, in the order of
    (gas, dark, star), then id. Tasks write their records at their places in a draft beside
    the file, which takes its name when all are there; the driver writes the header alone.
    ``path`` must lie in a folder that the driver and all executors mount: other stores have
    no writes at an offset."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError("a snapshot is written to a mounted folder")
    path = path.removeprefix("file://")
    records, counts = recorded(rows)
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        f.write(struct.pack(HEADER, time, sum(counts), 3, *counts, 0))
        f.truncate(HEADER_BYTES + sum(4 * FIELDS[k] * n for k, n in zip(TYPES.values(), counts)))
    rows.sparkSession.dataSource.register(TipsySource)
    out = records.select(F.col("at").cast("long").alias("at"), *(F.col(c).cast("double").alias(c) for c in ("mass", "x", "y", "z", "vx", "vy", "vz", "soft", "u")))
    options = dict(zip(TYPES, map(str, counts)))
    out.write.format("tipsy").mode("append").option("draft", draft).options(**options).save(path)
