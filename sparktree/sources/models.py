"""Generated models and other snapshot formats."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import particles


def plummer(spark: SparkSession, n: int, seed: int = 128363) -> DataFrame:
    """A particle view of two Plummer spheres of n/2 rows, the second moved by 4 along
    each axis, each around its own centre. Every row's draws depend on seed and id alone."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i in batch["id"]:
                rng = np.random.default_rng((seed, int(i) % max(1, n // 2)))
                r = 10.0
                while r > 9:
                    r = 1 / math.sqrt(rng.uniform(1e-9, 1) ** (-2 / 3) - 1)
                q, y = 0.0, 1.0
                while y > q * q * (1 - q * q) ** 3.5:
                    q, y = rng.uniform(0, 1), rng.uniform(0, 0.1)
                speed = q * math.sqrt(2) / (1 + r * r) ** 0.25
                ends = rng.normal(size=(2, 3))
                pos, vel = (v / np.linalg.norm(v) * s for v, s in zip(ends, (r, speed)))
                rows.append((int(i), *(pos + (4.0 if i >= n // 2 else 0.0)), *vel))
            yield pd.DataFrame(rows, columns=["id", "x", "y", "z", "vx", "vy", "vz"])

    drawn = spark.range(n).mapInPandas(draw, "id long, x double, y double, z double, vx double, vy double, vz double")
    return particles(drawn, **{c: F.col(c) for c in ("id", "x", "y", "z", "vx", "vy", "vz")}, mass=1.0 / n, soft=0.05)


def recentred(rows: DataFrame) -> DataFrame:
    """Mass-weighted mean position and velocity moved to 0."""
    mean = rows.agg(*((F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(f"m_{c}") for c in ("x", "y", "z", "vx", "vy", "vz")))
    out = rows.crossJoin(F.broadcast(mean))
    return out.withColumns({c: F.col(c) - F.col(f"m_{c}") for c in ("x", "y", "z", "vx", "vy", "vz")}).drop(*mean.columns)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """A model file: int n, int dimensions, float time, then 8 floats a row: position,
    velocity, mass, softening. Little-endian; files are read whole by Spark's reader."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                n, _, _ = struct.unpack("<iif", content[:12])
                values = np.frombuffer(content, "<f4", 8 * n, 12).reshape(n, 8).astype(float)
                yield pd.DataFrame(values, columns=["x", "y", "z", "vx", "vy", "vz", "mass", "soft"]).assign(id=np.arange(n))

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "x double, y double, z double, vx double, vy double, vz double, mass double, soft double, id long")
    return particles(rows, **{c: F.col(c) for c in rows.columns})


def head(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.orderBy("id").limit(n)
