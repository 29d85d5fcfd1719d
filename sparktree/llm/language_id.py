"""Language identification by n-gram filters with language bitmasks.

A bit-sliced Bloom filter holds one bit a language in each slot, in as many words as
the learnt languages need. An n-gram (``ORDER``
bytes of lower-cased text) is entered for the languages of which it occurs in a share
of at least ``SHARE`` of the learnt texts; looking it up ands the masks of its ``HASHES`` slots
and so returns all languages that contain it at once. For each text the languages'
bits are counted over its n-grams, the hits that a filter of that fill gives by chance
are taken off, and the largest count decides, ties going to the more frequent
language. The score is the winner's share of all corrected counts.

The rows of at most ``SAMPLE`` labelled ids, taken by hash, are learnt from, so these
ids are broadcast, and the n-grams that the driver gathers are at most 1/SHARE times
those of a mean text for each language. Text is never shuffled.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if no
language was learnt; a text with letters but no known n-gram gets the most frequent
language with score 0; a null id is never learnt from and counts as held out; a
repeated id teaches each of its rows' texts in the row's own language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, flat, mix, slices, table

ORDER, SHARE, HASHES = 4, 0.05, 3
#: Slots for each entered n-gram.
SLOTS = 8
#: Labelled rows to learn from, at most.
SAMPLE = 20_000
#: Languages of one mask word.
WORD = 64
UNKNOWN = "und"


def ngrams(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of each n-gram that holds a letter or a byte beyond ASCII."""
    buf, ends = flat(raw)
    n = len(buf) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
    letter = (low >= 128) | ((low >= 97) & (low <= 122))
    key, some = np.zeros(n, np.uint32), np.zeros(n, bool)
    for k in range(ORDER):
        key = (key << np.uint32(8)) | low[k : k + n]
        some |= letter[k : k + n]
    row = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))[:n]
    some &= np.arange(n) + ORDER <= ends[row]
    return row[some], key[some].astype(np.uint64)


def slots(key: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The places of each key in a table of n (a power of two) slots."""
    h = mix(key + np.uint64(0x9E3779B97F4A7C15))
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        yield ((first + np.uint64(i) * step) & np.uint64(n - 1)).astype(np.int64)


def bit(masks: np.ndarray, language: int) -> np.ndarray:
    """The bit of a language in each mask."""
    word = masks[:, language // WORD] if masks.ndim > 1 else masks
    return (word >> np.uint64(language % WORD)) & np.uint64(1)


@dataclass
class Filter:
    """languages: the most frequent first; masks: one bit of each in each slot, of up to
    WORD languages in one number, else a row of numbers for each slot."""

    languages: list[str]
    masks: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint64))
    chance: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def build(cls, languages: list[str], key: np.ndarray, language: np.ndarray) -> Filter:
        n = 1 << max(4, int(SLOTS * len(np.unique(key))).bit_length())
        words = -(-len(languages) // WORD)
        masks = np.zeros((n, words), np.uint64)
        for at in slots(key, n):
            np.bitwise_or.at(masks, (at, language // WORD), np.uint64(1) << (language % WORD).astype(np.uint64))
        masks = masks if words > 1 else masks[:, 0]
        fill = np.array([bit(masks, i).mean() for i in range(len(languages))])
        return cls(languages, masks, fill**HASHES)

    def lookup(self, key: np.ndarray) -> np.ndarray:
        found = None
        for at in slots(key, len(self.masks)):
            found = self.masks[at] if found is None else found & self.masks[at]
        return found

    def decide(self, raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language of each text, and its share of the corrected counts."""
        row, key = ngrams(raw)
        mask = self.lookup(key)
        n = np.bincount(row, minlength=len(raw))
        votes = np.zeros((len(raw), len(self.languages)))
        for i, chance in enumerate(self.chance):
            hits = np.bincount(row, bit(mask, i).astype(float), minlength=len(raw))
            votes[:, i] = np.maximum((hits - n * chance) / (1 - min(chance, 0.999)), 0)
        best = votes.argmax(axis=1)
        total = votes.sum(axis=1)
        return best, votes.max(axis=1) / np.where(total > 0, total, 1)

    def predict(self, text: Column) -> Column:
        """struct<lang_pred string, score double> of each text."""
        known = F.coalesce(text.rlike("\\p{L}"), F.lit(False))
        none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
        if not self.languages:
            return none
        shipped = SparkSession.active().sparkContext.broadcast((self.languages, self.masks, self.chance))

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            own = Filter(*shipped.value)
            names = np.array(own.languages, object)
            for series in batches:
                batch = pa.record_batch([pa.array(series, pa.string(), from_pandas=True)], names=["text"])
                out = [own.decide(binary(p.column(0))) for p in slices(batch, "text")]
                best, score = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, int) for i in (0, 1))
                yield pd.DataFrame({"lang_pred": names[best], "score": score.astype(float)})

        return F.when(known, F.pandas_udf(run, "lang_pred string, score double")(text)).otherwise(none)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, code of its language) -> number of texts of each language that hold each n-gram."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            row, key = ngrams(binary(part.column(0)))
            code = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            both = np.unique((row.astype(np.uint64) << np.uint64(8 * ORDER)) | key)
            owner, key = code[(both >> np.uint64(8 * ORDER)).astype(np.int64)], both & np.uint64((1 << 8 * ORDER) - 1)
            for c in np.unique(owner):
                own, n = np.unique(key[owner == c], return_counts=True)
                if c in sums:
                    own, back = np.unique(np.concatenate([sums[c][0], own]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([sums[c][1], n])).astype(np.int64)
                sums[c] = own, n
    for c, (key, n) in sums.items():
        yield pa.record_batch([pa.array(np.full(len(key), c), pa.int32()), pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["code", "ngram", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, share: float = SHARE) -> Filter:
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("learn_id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    marked = own.where("learn_id IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("learn_id")))
    ids = marked.select("learn_id").distinct().orderBy(F.xxhash64("learn_id"), "learn_id").limit(sample)
    learn = marked.join(F.broadcast(ids), "learn_id")
    languages = learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not languages:
        return Filter([])
    code = F.create_map(*(x for i, r in enumerate(languages) for x in (F.lit(r["lang"]), F.lit(i))))[F.col("lang")]
    texts = learn.select("text", code.alias("code"))
    counted = texts.mapInArrow(count_ngrams, "code int, ngram long, n long").groupBy("code", "ngram").agg(F.sum("n").alias("n"))
    enough = F.greatest(F.ceil(F.array(*(F.lit(r["count"] * share) for r in languages))[F.col("code")]), F.lit(1))
    entered = counted.where(F.col("n") >= enough).select("code", "ngram").toArrow()
    return Filter.build([r["lang"] for r in languages], entered.column(1).to_numpy().view(np.uint64), entered.column(0).to_numpy())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    model = fit(docs, id_col, text_col, lang_col)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), model.predict(F.col(f"`{text_col}`")).alias("found"))
    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


ORACLE_SQL = None
