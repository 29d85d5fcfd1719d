"""Runs of repeating words by Karp-Miller-Rosenberg naming.

A run is a stretch of consecutive words with smallest period q (words q apart are
equal), at least ``least_words`` and ``exponent`` * q words long, that no neighbouring
word extends keeping period q.

The blocks of 2**k words of a text get names level by level, equal blocks equal names:
a block's name comes from those of its two halves, pairs of names being numbered by
sorting, so no hash takes part. A block that occurs once in its text has no name: nor
has any longer block that begins with it, so in ordinary prose the levels end soon.
How far two places agree, forwards or backwards, is found by descending the levels.

For each period q only the places at multiples of q can be needed: from one of them on,
a run of e * q words agrees with itself q words on over (e - 2) * q words. Where the names
of the longest blocks of no more words tell that, the candidate is extended both ways to
its run. The smallest period of equal stretches is kept. A text of n words has n * log(n)
places to look at, in numpy blocks of bounded size, for all texts of a slice together.

A text is judged by itself: nothing is shuffled, and equal texts cost their own work.
Memory is some 4 bytes a word and level: one text of n words that repeats as a whole
holds 4 * n * log2(n) bytes.

Defined results: a null or wordless text has no runs and nothing to collapse (null
stays null, other white space becomes empty); rows of a null or repeated id are judged
one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, ranges, slices, table, tidied

#: Places that are looked at together.
PLACES = 1 << 20
WORD_GAPS = r"[\x20\x09-\x0D]+"


class Names:
    """The names of the blocks of 2**k words from each place on, one array a level.

    ``row``: the text of each word (ascending); only blocks of one text can be equal.
    A block that occurs once in its text is told by a negative number of its own.
    """

    def __init__(self, word: np.ndarray, row: np.ndarray):
        n = len(word)
        self.levels: list[np.ndarray] = []
        place = np.arange(n)
        first, second = row.astype(np.int64), word.astype(np.int64)
        size = 1
        while len(place):
            names = -1 - np.arange(n, dtype=np.int64)
            _, back, count = np.unique(first * (second.max() + 1) + second, return_inverse=True, return_counts=True)
            many = count > 1
            if not many.any():
                break
            kept = many[back]
            names[place[kept]] = (np.cumsum(many) - 1)[back[kept]]
            self.levels.append(names.astype(np.int32) if n < 1 << 31 else names)
            place = place[kept]
            place = place[place + size < n]
            place = place[(names[place + size] >= 0)]
            first, second = names[place], names[place + size]
            size *= 2

    def forwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and from ``b`` on are equal, a < b."""
        a, b, far = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names = self.levels[k]
            inside = np.minimum(b, len(names) - 1)
            on = (b < len(names)) & (names[a] == names[inside])
            step = np.where(on, 1 << k, 0)
            a, b, far = a + step, b + step, far + step
        return far

    def backwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` and before ``b`` are equal, a < b."""
        a, b, far = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[k], 1 << k
            inside = np.maximum(a - size, 0)
            on = (a >= size) & (names[inside] == names[np.maximum(b - size, 0)])
            step = np.where(on, size, 0)
            a, b, far = a - step, b - step, far + step
        return far


def runs_of(word: np.ndarray, first: np.ndarray, least_words: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of some texts, sorted by start, then period.

    ``word``: a number for each word, texts one after another; ``first``: where each text
    begins, with the number of words at its end. Starts count from the first text on.
    """
    none = (np.zeros(0, np.int64),) * 3
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    names = Names(word, row)
    # of each text the highest level that has names bounds the periods
    top = np.full(len(size), -1, np.int64)
    for k, level in enumerate(names.levels):
        top[row[level >= 0]] = k
    periods = np.where(top >= 0, np.minimum(size // exponent, ((2 << np.maximum(top, 0)) - 1) // (exponent - 2)), 0)
    texts = np.repeat(np.arange(len(size)), periods)
    period = ranges(np.ones(len(size), np.int64), periods)
    places = (size[texts] - 1) // period  # those with a place one period on
    found: list[tuple] = []
    ends = np.cumsum(places)
    at = 0
    while at < len(period):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, "right")))
        q = np.repeat(period[at:stop], places[at:stop])
        i = np.repeat(first[texts[at:stop]], places[at:stop]) + q * ranges(np.zeros(stop - at, np.int64), places[at:stop])
        # the longest blocks of at most (exponent - 2) * q words
        near = np.zeros(len(q), bool)
        level = np.floor(np.log2((exponent - 2) * q)).astype(np.int64)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            block = names.levels[k]
            here = block[i[own]]
            near[own] = (here >= 0) & (here == block[i[own] + q[own]])
        # a place whose blocks reach from the place one period back lies in the same stretch
        near[1:] &= ~(near[:-1] & (i[1:] - i[:-1] == q[1:]) & (q[1:] == q[:-1]) & ((1 << level[1:]) >= q[1:]))
        i, q = i[near], q[near]
        ahead, behind = names.forwards(i, i + q), names.backwards(i, i + q)
        length = q + ahead + behind
        long = length >= np.maximum(least_words, exponent * q)
        if long.any():
            found.append(np.unique(np.stack([(i - behind)[long], length[long], q[long]]), axis=1))
        at = stop
    if not found:
        return none
    start, length, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    smallest = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))
    start, length, q = start[smallest], length[smallest], q[smallest]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def judged(texts: list[bytes | None], least_words: int, exponent: int) -> tuple[list[int], np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], list[bytes | None]]:
    """Words of each text, runs of each text, the runs (starts counted in their text),
    and each text's kept words joined by a space."""
    words = [(t or b"").split() for t in texts]
    counts = [len(w) for w in words]
    first = np.append(0, np.cumsum(counts)).astype(np.int64)
    known: dict[bytes, int] = {}
    word = np.fromiter((known.setdefault(x, len(known)) for w in words for x in w), np.int64, int(first[-1]))
    start, length, period = runs_of(word, first, least_words, exponent)
    step = np.zeros(len(word) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    kept = np.cumsum(step)[:-1] == 0
    row = np.searchsorted(first, start, "right") - 1
    out: list[bytes | None] = []
    for i, (text, own) in enumerate(zip(texts, words)):
        if text is not None and not (mine := kept[first[i] : first[i + 1]]).all():
            own = [own[j] for j in np.flatnonzero(mine).tolist()]
        out.append(None if text is None else b" ".join(own))
    return counts, np.bincount(row, minlength=len(texts)), (start - first[row], length, period), out


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, least_words: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed (the text's words, joined
    by a space, without those that a run holds after its first period) of every row.

    ``exponent`` must be at least 3 (see above) and ``least_words`` at least 2.
    """
    if exponent < 3 or least_words < 2:
        raise ValueError("exponent must be at least 3 and least_words at least 2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, n_runs, runs, collapsed = judged(binary(part.column(1)).to_pylist(), least_words, exponent)
                cells = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in runs], ["start", "length", "period"])
                ends = pa.array(np.append(0, np.cumsum(n_runs)), pa.int32())
                text = pa.array([None if t is None else t.decode("utf-8", "replace") for t in collapsed], pa.string())
                yield pa.record_batch([part.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(ends, cells), text], names=["doc_id", "n_words", "runs", "collapsed"])

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return plain.mapInArrow(tidied(run), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length/period (the first of equals; null if there is none)."""
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, 0), lambda best, x: F.when(x.length * best.period > best.length * x.period, x).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents, of which some get a tail of repeating words: with
    h = crc32(doc_id as text), g = h div 10 and n words, if h % 10 = 0, words from
    a = g % n on repeat the first 1 + (n - a) div (3 + g % 8) of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", WORD_GAPS), lambda w: w != "")
    chosen = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    chosen = chosen.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    chosen = chosen.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", place(i).cast("int"))), " ")
    return chosen.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, with planted repetitions."""
    found = periodic_runs(planted(table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    digest = lambda text: F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli.alias("exponent_milli"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


ORACLE_SQL = None
