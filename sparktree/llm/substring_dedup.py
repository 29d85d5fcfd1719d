"""Exact removal of repeated passages by level-wise doubling of windows.

A passage counts as repeated if ``window`` consecutive words start in more than one
document. Windows are judged level by level, at lengths that double up to ``window``
(4, 7 and 13 words for 13). At a level each window still in the race is known by one
key, the smallest hash of that many words in it, so a run of unlike windows shares a
key. Keys that one document alone holds end there, and so do their windows; the others
are extended to twice the length, until none survive or the full length is reached.
There windows are told apart by 96 bits of two hashes of their words: two unlike ones
are taken for one with a chance of one in a thousand at 1e13 windows. Word hashes depend
on a seed that is drawn for each run, so texts can't be made to meet in them.

Documents are dealt once into chunks of bounded size (a bucketed table in the shared
folder; several chunks share a bucket where there are many). A chunk sends a hash once,
however many of its documents hold it, as packed arrays by hash range, and gets answers
for its own hashes only. So a passage that a third of all documents share costs one
entry for each chunk, of which there are ``CHUNKS`` at most (beyond 8 TB of text they
grow instead), no task gathers a document group, and nothing but row counts reaches
the driver.

Defined results: null text has no words; a document whose id is null neither removes
nor loses words; rows with equal ids never remove each other's words; documents
shorter than the window stay whole.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, binary, bucketed, drawn_seed, materialize, ranges, release_shuffles, shuffle_partitions, slices, table, text_bytes, tidy

CHUNK_BYTES = 8 << 20
#: Chunks and buckets of their table, at most.
CHUNKS, BUCKETS = 1 << 20, 1 << 14
#: Words of text for each hash range, of which there are 2**RANGE_BITS at most.
RANGE_WORDS, RANGE_BITS = 1 << 16, 30
#: Shortest level, as a part of the window.
FIRST = 4

_SENT = "bucket int, chunk int, hashes binary, who binary, ids binary"
_ANSWER = "chunk int, bucket int, hashes binary, ids binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("who", pa.binary()), ("ids", pa.binary())])
_ANSWER_ARROW = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary())])


def levels(window: int) -> list[int]:
    """Window lengths, each at most twice the one before."""
    out = [window]
    while out[0] > -(-window // FIRST):
        out.insert(0, (out[0] + 1) // 2)
    return out


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of the k values from each position on."""
    have, out = 1, x
    while have < k:
        step = min(have, k - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def level_keys(words: Words, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the whole windows, and for each the smallest hash of ``length`` words in it."""
    inside = words.whole(window)
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding_min(words.windows(length), window - length + 1)[: len(inside)]
    at = np.flatnonzero(inside)
    return at, least[at]


def by_range(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash range numbers of sorted hashes, with the first and last place of each."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    lo = np.concatenate([[0], cut]).astype(np.int64)
    return bucket[lo], lo, np.append(cut, len(hashes))


def tidied(run, *given):
    """run(*given), leaving no free memory behind."""
    try:
        return run(*given)
    finally:
        tidy()


def known_keys(answers: pa.Table) -> np.ndarray:
    """The keys of a level's answers, sorted: their range above 32 bits."""
    keys = [np.frombuffer(h, np.uint32).astype(np.uint64) | (np.uint64(b) << np.uint64(32)) for b, h in zip(answers.column("bucket").to_pylist(), answers.column("hashes").to_pylist())]
    return np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def survivors(words: Words, window: int, length: int, known: np.ndarray, bits: int) -> np.ndarray:
    """Starts of the windows whose key of that length is among the known ones."""
    starts, least = level_keys(words, window, length)
    least = least >> np.uint64(32 - bits)
    return starts[known[np.minimum(np.searchsorted(known, least), len(known) - 1)] == least]


def middle_level(chunk: pa.Table, answers: pa.Table | None, window: int, before: int | None, length: int, bits: int, seed: int = 0) -> pa.Table:
    """The chunk's keys of one level, of windows that survived the level before: 32 bits
    beyond the range bits, then one byte that tells whether two documents of this chunk
    hold it."""
    if not chunk.num_rows or answers is not None and not answers.num_rows:
        return _SENT_ARROW.empty_table()
    keys, owner = [], []
    ids = chunk.column("id").to_numpy()
    known = None if answers is None else known_keys(answers)
    for at, part in parts(chunk):
        words = Words(binary(part.column("text")), seed=seed)
        starts, least = level_keys(words, window, length)
        if known is not None:
            own = np.isin(starts, survivors(words, window, before, known, bits), assume_unique=True)
            starts, least = starts[own], least[own]
        doc = ids[at + words.row()[starts]]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        keys.append(least[new])
        owner.append(doc[new])
    key, doc = (np.concatenate(x) for x in (keys, owner))
    key = (key >> np.uint64(32 - bits)) << np.uint64(32 - bits)
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    lo = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    low, high = (f.reduceat(doc, lo) if len(lo) else doc for f in (np.minimum, np.maximum))
    key, many = key[lo], (low != high).astype(np.uint8)
    short = (key >> np.uint64(32 - bits)).astype(np.uint32)
    number = chunk.column("chunk")[0].as_py()
    bucket, a, b = by_range(key, bits)
    return pa.table([pa.array(bucket, pa.int32()), pa.array([number] * len(bucket), pa.int32()), [short[i:j].tobytes() for i, j in zip(a, b)], [many[i:j].tobytes() for i, j in zip(a, b)], pa.array([b""] * len(bucket), pa.binary())], schema=_SENT_ARROW)


def parts(chunk: pa.Table):
    """Slices of a chunk, each with the number of rows before it."""
    at = 0
    for part in slices(chunk.select(["text"]), "text"):
        yield at, part
        at += part.num_rows


def repeated_keys(rows: pa.Table) -> pa.Table:
    """Of one hash range: the keys that more than one document holds, for each chunk."""
    sent = [np.frombuffer(x, np.uint32) for x in rows.column("hashes").to_pylist()]
    many = np.concatenate([np.frombuffer(x, np.uint8) for x in rows.column("who").to_pylist()])
    key = np.concatenate(sent)
    owner = np.repeat(np.arange(len(sent)), [len(x) for x in sent])
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    twice = (n + np.bincount(back, many, len(n)) > 1)[back]
    key, owner = key[twice], owner[twice]
    cut = np.searchsorted(owner, np.arange(len(sent) + 1))
    keep = pa.array(np.flatnonzero(np.diff(cut)))
    return pa.table([rows.column("chunk").take(keep), rows.column("bucket").take(keep), [key[cut[i] : cut[i + 1]].tobytes() for i in keep.to_pylist()], pa.array([b""] * len(keep), pa.binary())], schema=_ANSWER_ARROW)


def distinct(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Where a new one of sorted (key, check) begins."""
    return np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])) if len(key) else np.zeros(0, bool)


def last_level(chunk: pa.Table, answers: pa.Table, window: int, before: int, bits: int, seed: int = 0) -> pa.Table:
    """The windows that survived: both their hashes, with the smallest id here and
    whether another document of this chunk holds it."""
    if not chunk.num_rows or not answers.num_rows:
        return _SENT_ARROW.empty_table()
    known = known_keys(answers)
    found: list[list[np.ndarray]] = [[], [], []]
    ids = chunk.column("id").to_numpy()
    for at, part in parts(chunk):
        words = Words(binary(part.column("text")), seed=seed)
        starts = survivors(words, window, before, known, bits)
        if len(starts):
            new = (words.windows(window)[starts], words.windows(window, "check")[starts].astype(np.uint32), ids[at + words.row()[starts]])
            for c, v in zip(found, new):
                c.append(v)
    if not found[0]:
        return _SENT_ARROW.empty_table()
    key, check, doc = (np.concatenate(c) for c in found)
    order = np.lexsort((doc, check, key))
    key, check, doc = key[order], check[order], doc[order]
    lo = np.flatnonzero(distinct(key, check))
    high = np.maximum.reduceat(doc, lo)
    key, check, doc = key[lo], check[lo], doc[lo]
    dictionary, code = np.unique(doc, return_inverse=True)
    who = ((code.astype(np.uint32) << np.uint32(1)) | (high != doc)).astype(np.uint32)
    number = chunk.column("chunk")[0].as_py()
    bucket, a, b = by_range(key, bits)
    packed = []
    for i, j in zip(a, b):
        used, short = np.unique(who[i:j] >> 1, return_inverse=True)
        flags = (short.astype(np.uint32) << np.uint32(1)) | (who[i:j] & np.uint32(1))
        packed.append((key[i:j].tobytes() + check[i:j].tobytes(), flags.astype(np.uint16 if len(used) < 1 << 15 else np.uint32).tobytes(), dictionary[used].tobytes()))
    return pa.table([pa.array(bucket, pa.int32()), pa.array([number] * len(bucket), pa.int32()), *([x[k] for x in packed] for k in range(3))], schema=_SENT_ARROW)


def both_hashes(packed: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The 64-bit and the 32-bit hashes of packed windows."""
    sizes = [len(x) // 12 for x in packed]
    return [np.frombuffer(x, np.uint64, n) for x, n in zip(packed, sizes)], [np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(packed, sizes)]


def smallest_ids(rows: pa.Table) -> pa.Table:
    """Of one hash range: for each chunk the windows that start in a document with a
    smaller id than one of the chunk's, with the smallest id of all."""
    keys, checks = both_hashes(rows.column("hashes").to_pylist())
    docs, more = [], []
    for key, w, d in zip(keys, rows.column("who").to_pylist(), rows.column("ids").to_pylist()):
        who = np.frombuffer(w, np.uint16 if len(w) == 2 * len(key) else np.uint32)
        docs.append(np.frombuffer(d, np.int64)[who >> 1])
        more.append((who & 1).astype(bool))
    key, check, doc, other = (np.concatenate(x) for x in (keys, checks, docs, more))
    owner = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
    order = np.lexsort((check, key))
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(distinct(key[order], check[order])) - 1
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc)
    least = least[group]
    need = other | (least < doc)
    key, check, least, owner = key[need], check[need], least[need], owner[need]
    cut = np.searchsorted(owner, np.arange(len(keys) + 1))
    keep = pa.array(np.flatnonzero(np.diff(cut)))
    own = [slice(cut[i], cut[i + 1]) for i in keep.to_pylist()]
    return pa.table([rows.column("chunk").take(keep), rows.column("bucket").take(keep), [key[i].tobytes() + check[i].tobytes() for i in own], [least[i].tobytes() for i in own]], schema=_ANSWER_ARROW)


def removed_words(chunk: pa.Table, answers: pa.Table, window: int, seed: int = 0):
    """For each slice of the chunk: rows before it, its words, and which of them go."""
    ids = chunk.column("id").to_numpy()
    keys, checks = both_hashes(answers.column("hashes").to_pylist()) if answers.num_rows else ([np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)])
    key, check = np.concatenate(keys), np.concatenate(checks)
    least = np.concatenate([np.frombuffer(x, np.int64) for x in answers.column("ids").to_pylist()] or [np.zeros(0, np.int64)])
    order = np.lexsort((check, key))
    key, check, least = key[order], check[order], least[order]
    for at, part in parts(chunk):
        words = Words(binary(part.column("text")), seed=seed)
        gone = np.zeros(len(words.start), bool)
        whole = np.flatnonzero(words.whole(window)) if len(key) else np.zeros(0, np.int64)
        if len(whole):
            hashes = words.windows(window)[whole]
            place = np.minimum(np.searchsorted(key, hashes), len(key) - 1)
            near = np.flatnonzero(key[place] == hashes)
            whole, hashes, place = whole[near], hashes[near], place[near]
        if len(whole):
            second = words.windows(window, "check")[whole].astype(np.uint32)
            while True:  # windows with one first hash lie in the order of their second one
                next_ = np.minimum(place + 1, len(key) - 1)
                on = (check[place] != second) & (key[next_] == hashes) & (next_ > place)
                if not on.any():
                    break
                place = np.where(on, next_, place)
            hit = (check[place] == second) & (least[place] < ids[at + words.row()[whole]])
            step = np.zeros(len(gone) + 1, np.int32)
            np.add.at(step, whole[hit], 1)
            np.add.at(step, whole[hit] + window, -1)
            gone = np.cumsum(step)[:-1] > 0
        yield at, part, words, gone


_DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def digest(chunk: pa.Table, answers: pa.Table, window: int, seed: int) -> pa.Table:
    out: list[list] = [[], [], []]
    for _, part, words, gone in removed_words(chunk, answers, window, seed):
        removed = np.add.reduceat(np.append(gone, False), words.first[:-1]) if part.num_rows else []
        removed = np.where(np.diff(words.first) > 0, removed, 0)
        for i, text in enumerate(binary(part.column("text")).to_pylist()):
            own = (text or b"").split()
            if removed[i]:
                own = compress(own, ~gone[words.first[i] : words.first[i + 1]])
            out[2].append(hashlib.sha256(b" ".join(own)).hexdigest())
        out[0] += np.diff(words.first).tolist()
        out[1] += removed.tolist()
    return pa.table([chunk.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def cut_text(chunk: pa.Table, answers: pa.Table, window: int, seed: int) -> pa.Table:
    """The chunk with the removed words, and the space after each, cut from its texts."""
    texts = []
    for _, part, words, gone in removed_words(chunk, answers, window, seed):
        raw = binary(part.column("text")).to_pylist()
        for i, text in enumerate(raw):
            a, b = words.first[i], words.first[i + 1]
            if text is not None and gone[a:b].any():
                base = words.row_start[i]
                stops = np.append(words.start[a + 1 : b], words.row_end[i]) - base
                starts = words.start[a:b] - base
                kept = np.flatnonzero(~gone[a:b])
                lead = text[: starts[0]]
                text = lead + b"".join(text[starts[j] : stops[j]] for j in kept)
            texts.append(None if text is None else text.decode("utf-8", "replace"))
    return chunk.set_column(chunk.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def _level(own: DataFrame, keys: DataFrame | None, window: int, before: int | None, length: int, bits: int, seed: int) -> DataFrame:
    """What the chunks send at one level short of the last."""
    if keys is None:
        return own.groupBy("chunk").applyInArrow(lambda t: tidied(middle_level, t, None, window, None, length, bits, seed), _SENT)
    return own.groupBy("chunk").cogroup(keys.groupBy("chunk")).applyInArrow(lambda t, a: tidied(middle_level, t, a, window, before, length, bits, seed), _SENT)


def _passes(spark: SparkSession, docs: DataFrame, window: int, n_bytes: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The chunk table (columns id, text, chunk and what docs has besides) and the
    answers of the last level."""
    if window < 2:
        raise ValueError("window must be at least 2")
    chunks = min(max(n_bytes // CHUNK_BYTES + 1, shuffle_partitions(spark)), CHUNKS)
    bits = min(RANGE_BITS, max(0, (n_bytes // 6 // RANGE_WORDS).bit_length()))
    # rows are dealt by their place too, so that equal rows don't share a chunk
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("id", F.length("text"), F.monotonically_increasing_id()), F.lit(chunks)).cast("int"))
    chunked = bucketed(dealt, "chunks", min(chunks, BUCKETS), "chunk")
    release_shuffles(spark)
    own = chunked.where("id IS NOT NULL").select("id", "text", "chunk")
    *lengths, _ = levels(window)
    keys, before = None, None
    for length in lengths:
        sent = _level(own, keys, window, before, length, bits, seed)
        keys, before = materialize(sent.groupBy("bucket").applyInArrow(repeated_keys, _ANSWER), "keys"), length
        release_shuffles(spark)
        if keys.isEmpty():
            return chunked, keys
    sent = own.groupBy("chunk").cogroup(keys.groupBy("chunk")).applyInArrow(lambda t, a: tidied(last_level, t, a, window, before, bits, seed), _SENT)
    answers = materialize(sent.groupBy("bucket").applyInArrow(smallest_ids, _ANSWER), "windows")
    release_shuffles(spark)
    return chunked, answers


def substring_digests(spark: SparkSession, docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seed = drawn_seed()
    chunked, answers = _passes(spark, plain, window, text_bytes(plain, "text"), seed)
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda t, a: tidied(digest, t, a, window, seed) if t.num_rows else pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]).empty_table(), _DIGEST)


def dedup_substrings(spark: SparkSession, docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from all documents but the one with the
    smallest id. Other columns stay as they are, whatever their names."""
    names, own = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    place: list[Column] = [F.col(f"`{n}`").alias("text" if n == text_col else o) for n, o in zip(names, own)]
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), *place)
    seed = drawn_seed()
    chunked, answers = _passes(spark, plain, window, text_bytes(plain, "text"), seed)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in chunked.schema])
    cut = chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda t, a: tidied(cut_text, t, a, window, seed), schema)
    return cut.select(*(F.col("text" if n == text_col else o).alias(n) for n, o in zip(names, own)))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(spark, table(spark, sf_dir, "documents"), window=13)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13
), k AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM g
), m AS (
  SELECT s, min(doc_id) AS first_id FROM k GROUP BY s
), r AS (
  SELECT DISTINCT k.doc_id, p.p AS pos FROM k JOIN m USING (s), LATERAL (SELECT unnest(range(k.i, k.i + 13)) AS p) p WHERE m.first_id < k.doc_id
), l AS (
  SELECT doc_id, list(pos) AS gone FROM r GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(l.gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN l.gone IS NULL THEN d.w ELSE list_transform(list_filter(list_zip(d.w, range(1, len(d.w) + 1)), lambda z: NOT list_contains(l.gone, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN l ON d.doc_id = l.doc_id
"""
