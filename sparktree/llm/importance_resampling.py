"""Quality by importance resampling of hashed n-gram models.

Words and pairs of words (A-Z lower-cased) are counted in ``2**BITS`` buckets, over
all documents for the raw model and over the labelled good ones for the target model.
A document's log weight is the sum over its n-grams of log p(target) - log p(raw).
Adding Gumbel noise, a fixed function of the seed and the id, and keeping the k
largest draws k documents without replacement in proportion to their weights.

The models are one row a bucket, a fixed bound. At most ``SAMPLE`` good documents,
taken by hash of their id, teach the target, so their ids are broadcast. The k-th
largest key is found by histograms of the keys: each round narrows the range to one
bin, and only a bin of at most ``SORTED`` rows is sorted, so no task gathers all rows.

Defined results: null and empty texts have weight 0 in logarithms; a null id has a
noise of its text's; without a good document all weights are equal; rows with equal key
and id are kept or dropped together, so k may be exceeded by such copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, binary, materialize, slices, table

BITS = 16
SAMPLE = 40_000
SORTED = 20_000
BINS = 1024


def buckets(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each word and each pair of words."""
    words = Words(raw, lower=True)
    row, pair = words.row(), words.whole(2)
    row = np.concatenate([row, row[: len(pair)][pair]])
    key = np.concatenate([words.hash, words.windows(2)[pair]]) if len(words.start) else np.zeros(0, np.uint64)
    return row, (key >> np.uint64(64 - BITS)).astype(np.int64)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, good) -> bucket, raw, target."""
    sums = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            row, at = buckets(binary(part.column(0)))
            good = part.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            sums[0] += np.bincount(at, minlength=1 << BITS)
            sums[1] += np.bincount(at[good[row]], minlength=1 << BITS)
    used = np.flatnonzero(sums[0])
    yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(sums[0][used]), pa.array(sums[1][used])], names=["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> np.ndarray:
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    good = good.orderBy(F.xxhash64("good_id"), "good_id").limit(sample).withColumn("good", F.lit(True))
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("good_id"), F.col(f"`{text_col}`").alias("text"))
    marked = own.join(F.broadcast(good), "good_id", "left").select("text", "good")
    sums = marked.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = sums.column("bucket").to_numpy()
    raw[at], target[at] = sums.column("raw").to_numpy(), sums.column("target").to_numpy()
    if not target.sum():
        return np.zeros(1 << BITS)
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def log_weights(docs: DataFrame, ratios: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tie (the id, without one a hash of the text), log_weight of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            batch = pa.record_batch([pa.array(series, pa.string(), from_pandas=True)], names=["text"])
            out = [np.zeros(0)]
            for part in slices(batch, "text"):
                row, at = buckets(binary(part.column(0)))
                out.append(np.bincount(row, shipped.value[at], minlength=part.num_rows))
            yield pd.Series(np.concatenate(out))

    own = F.col(f"`{id_col}`").cast("long")
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.xxhash64(F.col(f"`{text_col}`"))).alias("tie"), F.pandas_udf(run, "double")(F.col(f"`{text_col}`")).alias("log_weight"))


def kth_largest(rows: DataFrame, key: str, tie: str, k: int) -> tuple[float, int] | None:
    """(key, tie) of the k-th row in the order of descending key and ascending tie."""
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if k <= 0 or not n:
        return None
    k = min(k, n)
    while n > SORTED and low < high:
        width = (high - low) / BINS
        place = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)).alias("bin")
        bins = {r["bin"]: r for r in rows.where(F.col(key).between(low, high)).groupBy(place).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()}
        for b in sorted(bins, reverse=True):
            if k <= bins[b]["n"]:
                break
            k -= bins[b]["n"]
        low, high, n = bins[b]["low"], bins[b]["high"], bins[b]["n"]
    if low == high and n > SORTED:  # one key: its ties decide
        return low, kth_smallest(rows.where(F.col(key) == low).select(F.col(tie).cast("long").alias("tie")), k)
    last = rows.where(F.col(key).between(low, high)).orderBy(F.desc(key), F.asc(tie)).limit(k).orderBy(F.asc(key), F.desc(tie)).first()
    return last[key], last[tie]


def kth_smallest(rows: DataFrame, k: int) -> int:
    """The k-th smallest of the whole numbers in column ``tie``, exactly."""
    low, high, n = rows.agg(F.min("tie"), F.max("tie"), F.count("tie")).first()
    while n > SORTED and low < high:
        width = (high - low) // BINS + 1
        place = F.expr(f"CAST((CAST(tie AS DECIMAL(38, 0)) - CAST('{low}' AS DECIMAL(38, 0))) div CAST('{width}' AS DECIMAL(38, 0)) AS INT)").alias("bin")
        bins = {r["bin"]: r for r in rows.where(F.col("tie").between(low, high)).groupBy(place).agg(F.count("*").alias("n"), F.min("tie").alias("low"), F.max("tie").alias("high")).collect()}
        for b in sorted(bins):
            if k <= bins[b]["n"]:
                break
            k -= bins[b]["n"]
        low, high, n = bins[b]["low"], bins[b]["high"], bins[b]["n"]
    if low == high:
        return low
    return rows.where(F.col("tie").between(low, high)).orderBy("tie").limit(k).agg(F.max("tie")).first()[0]


def resample(docs: DataFrame, labels: DataFrame, fraction: float = 0.5, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight, gumbel_key, selected of every row; ``fraction`` of them are selected."""
    weights = log_weights(docs, log_ratios(docs, labels, id_col, text_col), id_col, text_col)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "tie"), 11).cast("double") + 0.5) / 2.0**53
    keyed = materialize(weights.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "keys")
    last = kth_largest(keyed, "gumbel_key", "tie", round(fraction * keyed.count()))
    if last is None:
        chosen = F.lit(False)
    else:
        chosen = (F.col("gumbel_key") > last[0]) | ((F.col("gumbel_key") == last[0]) & (F.col("tie") <= last[1]))
    return keyed.select("doc_id", "log_weight", "gumbel_key", chosen.alias("selected"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = None
