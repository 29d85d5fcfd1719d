"""Toxicity by class-conditional Kneser-Ney models of words, byte by byte.

A word is the chain of its bytes and an end sign, each given all bytes of the word
before it, so that expressions share what they begin with. Toxic and ordinary labelled
texts each give counts of these chains, one for each text that holds the word, since
what one text repeats says no more about its class. A class's probability of a byte is
its discounted count plus what the discounts leave times a shared one: the same of both
classes' counts together, which backs off to interpolated Kneser-Ney counts of byte
sequences of ``ORDER`` down to 1 (the longest counted, the shorter by the number of
their continuations), taken over all documents, labelled or not. Half of the shared
probability is mixed in. So a chain that a class has seen too rarely says what others say.

A word's evidence is the difference of its two log-likelihoods less ``LEAST`` nats, which
rare words have by chance. A text's raw score is the sum over all its words, by their
number; a logistic curve fitted on the labelled rows turns it into 0 to 1. Where no cut
tells their classes apart, every score is the share of toxic labels, below a half.

Labelled rows are at most ``SAMPLE``, taken by hash of their id, so their ids are
broadcast, and the driver gathers the chains that occur more than ``DISCOUNT`` times in
them: a bound that doesn't grow with the corpus. Rarer ones have no discounted count in
either class, so leaving them out changes no probability. Sequences of all documents
are added up before the shuffle; only those that the chains need reach the driver. Of
texts only the words of labelled ones are shuffled, with their counts.

Defined results: texts without letters or digits, empty and null ones have raw score
0; a null id is never learnt from and counts as held out; without a labelled row of
each class every score is 0; a repeated id takes its largest label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, binary, materialize, placed, ranges, sized_hash, slices, table, tidied, tidy

ORDER, DISCOUNT, SHARED_DISCOUNT, LEAST = 5, 3, 0.75, 1.0
#: Labelled rows to learn from, at most.
SAMPLE = 40_000
#: The score of every text is at most this where the labels teach nothing.
HIGHEST_PRIOR = 0.499
#: Distinct words or sequences that a task holds before it sends their counts.
HELD = 1 << 18
#: First bytes of a word by which words are dealt to tasks.
HEAD = 4
#: Letters, digits and bytes beyond ASCII make words.
INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
END = 32


@dataclass
class Chains:
    """All steps (bytes and the end) of some words, one word after another.

    ``word``: the word of each step; ``depth``: steps before it; ``node`` and ``above``:
    keys of the chain with and without the step; ``gram``: the last ORDER bytes, the
    step's last, after a space for the word's start.
    """

    word: np.ndarray
    depth: np.ndarray
    node: np.ndarray
    above: np.ndarray
    gram: np.ndarray

    @classmethod
    def of(cls, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> Chains:
        steps = end - start + 1
        word, depth = np.repeat(np.arange(len(steps)), steps), ranges(np.zeros(len(steps), np.int64), steps)
        last = depth == (steps - 1)[word]
        byte = np.where(last, np.uint8(END), buf[np.minimum(start[word] + depth, max(len(buf) - 1, 0))] if len(buf) else np.uint8(END))
        sums = np.append(np.uint64(0), np.cumsum(placed(depth.astype(np.uint64), byte), dtype=np.uint64))
        base = sums[np.cumsum(steps) - steps][word]
        gram = np.zeros(len(byte), np.uint64)
        for back in range(ORDER):
            before = np.zeros(len(byte), np.uint64)
            before[back:] = byte[: len(byte) - back]
            before = np.where(depth >= back, before, np.where(depth == back - 1, np.uint64(END), np.uint64(0)))
            gram |= before << np.uint64(8 * back)
        return cls(word, depth, sized_hash(sums[1:] - base, depth + 1), sized_hash(sums[:-1] - base, depth), gram)


ROOT = sized_hash(np.zeros(1, np.uint64), np.zeros(1, np.int64))[0]


def words_of(raw: pa.Array) -> Words:
    return Words(raw, lower=True, inside=INSIDE)


def shared_probability(gram: np.ndarray, counts: dict[int, tuple[np.ndarray, np.ndarray]], contexts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Interpolated Kneser-Ney of the last byte of each gram: by order, ``counts`` has
    sorted grams and their counts, ``contexts`` sorted contexts, their totals and what
    their discounts leave."""
    p = np.full(len(gram), 1 / 256)
    for k in range(1, ORDER + 1):
        own = gram & np.uint64((1 << 8 * k) - 1)
        keys, n = counts[k]
        above, total, left = contexts[k]
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        n = np.where(keys[at] == own, n[at], 0)
        at = np.minimum(np.searchsorted(above, own >> np.uint64(8)), len(above) - 1)
        known = above[at] == own >> np.uint64(8)
        p = np.where(known, (np.maximum(n - SHARED_DISCOUNT, 0) + left[at] * p) / np.where(known, total[at], 1), p)
    return p


@dataclass
class Model:
    """Sorted chains of labelled texts; the two log-likelihoods of each; what a chain's
    unseen continuation adds to their difference; and the curve."""

    keys: np.ndarray | None
    toxic: np.ndarray | None = None
    ordinary: np.ndarray | None = None
    leaving: np.ndarray | None = None
    middle: float = 0.0
    slope: float = 1.0
    #: The score of every text, if the labels teach nothing.
    prior: float | None = None

    @classmethod
    def build(cls, node: np.ndarray, above: np.ndarray, depth: np.ndarray, shared: np.ndarray, counts: tuple[np.ndarray, np.ndarray]) -> Model:
        """From chains with more than DISCOUNT occurrences (with every chain all that it begins with)."""
        node, above = np.append(node, ROOT), np.append(above, np.uint64(0))
        depth, shared = np.append(depth, -1), np.append(shared, 1.0)
        order = np.argsort(node)
        node, above, depth, shared = node[order], above[order], depth[order], shared[order]
        parent = np.searchsorted(node, above)
        inner = np.flatnonzero(depth >= 0)
        parent[depth < 0] = 0

        def smoothed(count: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The probability of each chain's last step, and what the discounts of its steps leave of each chain."""
            count = np.append(count, 0)[order].astype(float)
            count[depth < 0] = count[depth == 0].sum()
            kept = np.maximum(count - DISCOUNT, 0)
            total = np.where(count > 0, count, 1)
            rest = np.where(count > 0, 1 - np.bincount(parent[inner], kept[inner], minlength=len(node)) / total, 1.0)
            return kept / total[parent] + rest[parent] * shorter, rest

        shared, _ = smoothed(sum(counts), shared)
        both = [smoothed(count, shared) for count in counts]
        likelihoods = [np.where(depth >= 0, np.log((p + shared) / 2), 0) for p, _ in both]
        left = [np.log((rest + 1) / 2) for _, rest in both]
        for d in np.unique(depth[depth > 0]):  # from a chain's beginning on
            own = np.flatnonzero(depth == d)
            for log_p in likelihoods:
                log_p[own] += log_p[parent[own]]
        return cls(node, likelihoods[0], likelihoods[1], left[0] - left[1])

    def evidence(self, chains: Chains, words: int) -> np.ndarray:
        """The difference of the two log-likelihoods of each word, LEAST nearer to 0."""
        at = np.minimum(np.searchsorted(self.keys, chains.node), len(self.keys) - 1)
        known = np.bincount(chains.word, self.keys[at] == chains.node, minlength=words).astype(np.int64)
        steps = np.bincount(chains.word, minlength=words)
        first = np.cumsum(steps) - steps
        root = int(np.searchsorted(self.keys, ROOT))
        last = np.where(known > 0, at[first + np.maximum(known - 1, 0)], root)
        gap = self.toxic[last] - self.ordinary[last] + np.where(known < steps, self.leaving[last], 0)
        return np.sign(gap) * np.maximum(np.abs(gap) - LEAST, 0)

    def raw_scores(self, raw: pa.Array) -> np.ndarray:
        words = words_of(raw)
        if not len(words.start):
            return np.zeros(len(raw))
        _, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        found = self.evidence(Chains.of(words.buf, words.start[first], words.end[first]), len(first))
        row = words.row()
        return np.bincount(row, found[back], minlength=len(raw)) / np.maximum(np.bincount(row, minlength=len(raw)), 1)

    def raw(self, text: Column) -> Column:
        """The mean difference of log-likelihoods of each text."""
        if self.keys is None:
            return F.lit(0.0)
        shipped = SparkSession.active().sparkContext.broadcast((self.keys, self.toxic, self.ordinary, self.leaving))

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = Model(*shipped.value)
            try:
                for series in batches:
                    batch = pa.record_batch([pa.array(series, pa.string(), from_pandas=True)], names=["text"])
                    yield pd.Series(np.concatenate([own.raw_scores(binary(p.column(0))) for p in slices(batch, "text")] or [np.zeros(0)]))
            finally:
                tidy()

        return F.pandas_udf(run, "double")(text)

    def score(self, text: Column) -> Column:
        if self.keys is None:
            return F.lit(0.0)
        if self.prior is not None:
            return F.lit(self.prior)
        return 1 / (1 + F.exp(-self.slope * (self.raw(text) - self.middle)))


def added(key: np.ndarray, *counts: np.ndarray) -> tuple:
    """Distinct keys, sorted, with their summed counts."""
    key, back = np.unique(key, return_inverse=True)
    return key, *(np.bincount(back, c, len(key)).astype(np.int64) for c in counts)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> gram, n: sequences of ORDER bytes in words, and how often they stand in texts."""
    held: list[tuple] = []

    def rows() -> Iterator[pa.RecordBatch]:
        if held:
            gram, n = held[0] if len(held) == 1 else added(*(np.concatenate(x) for x in zip(*held)))
            for lo in range(0, len(gram), 1 << 16):
                yield pa.record_batch([pa.array(x[lo : lo + (1 << 16)].view(np.int64)) for x in (gram, n)], names=["gram", "n"])
        held.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            words = words_of(binary(part.column(0)))
            if not len(words.start):
                continue
            _, first, n = np.unique(words.hash, return_index=True, return_counts=True)
            chains = Chains.of(words.buf, words.start[first], words.end[first])
            held.append(added(chains.gram, n[chains.word]))
            if sum(len(h[0]) for h in held) > HELD:
                held[:] = [added(*(np.concatenate(x) for x in zip(*held)))]
                if len(held[0][0]) > HELD // 2:
                    yield from rows()
    yield from rows()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) -> head, word, ordinary, toxic: how often each word stands in texts.
    Small slices of text are added up to HELD words before they are sent."""
    held: list[pa.Table] = []

    def combined() -> pa.Table:
        t = pa.concat_tables(held)
        if len(held) > 1:
            t = t.group_by("word").aggregate([("ordinary", "sum"), ("toxic", "sum")]).rename_columns({"ordinary_sum": "ordinary", "toxic_sum": "toxic"})
        return t.select(["word", "ordinary", "toxic"])

    def rows() -> Iterator[pa.RecordBatch]:
        for t in held:
            heads = pa.compute.binary_slice(t.column("word"), 0, HEAD)
            yield from t.add_column(0, "head", heads).to_batches(max_chunksize=1 << 16)
        held.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            words = words_of(binary(part.column(0)))
            if not len(words.start):
                continue
            label = part.column(1).to_numpy(zero_copy_only=False)
            _, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
            both = np.unique(words.row() * len(first) + back)  # once for each text
            label, back = label[both // len(first)], both % len(first)
            counts = [np.bincount(back[label == c], minlength=len(first)).astype(np.int64) for c in (0, 1)]
            own = [words.buf[a:b].tobytes() for a, b in zip(words.start[first].tolist(), words.end[first].tolist())]
            held.append(pa.table([pa.array(own, pa.binary()), *map(pa.array, counts)], names=["word", "ordinary", "toxic"]))
            if sum(t.num_rows for t in held) > HELD:
                held[:] = [combined()]
                if held[0].num_rows > HELD // 2:
                    yield from rows()
    if held:
        held[:] = [combined()]
    yield from rows()


def count_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, those of one head together -> node, above, gram, depth,
    ordinary, toxic: chains longer than a head only if they occur more than DISCOUNT times."""
    held: list[pa.Table] = []

    def chains() -> pa.RecordBatch:
        t = pa.concat_tables(held)
        raw = binary(t.column("word"))
        ends = np.cumsum(np.fromiter((len(w) for w in raw.to_pylist()), np.int64, len(raw)))
        buf = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
        c = Chains.of(buf, np.append(0, ends[:-1]), ends)
        node, first, back = np.unique(c.node, return_index=True, return_inverse=True)
        ordinary, toxic = (np.bincount(back, t.column(x).to_numpy()[c.word], len(node)).astype(np.int64) for x in ("ordinary", "toxic"))
        own = (c.depth[first] < HEAD) | (ordinary + toxic > DISCOUNT)
        first = first[own]
        cols = (node[own].view(np.int64), c.above[first].view(np.int64), c.gram[first].view(np.int64), c.depth[first], ordinary[own], toxic[own])
        return pa.record_batch([pa.array(x) for x in cols], names=["node", "above", "gram", "depth", "ordinary", "toxic"])

    rows = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows > HELD // 4:
            t = pa.concat_tables(held)
            head = t.column("head")
            last = head[-1].as_py()
            cut = t.num_rows
            while cut and head[cut - 1].as_py() == last:
                cut -= 1
            if cut:
                held[:] = [t.slice(0, cut)]
                yield chains()
                held[:] = [t.slice(cut)]
                rows = t.num_rows - cut
    if held and rows:
        yield chains()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def labelled(labels: DataFrame, id_col: str, label: str, sample: int) -> DataFrame:
    """(learn_id, label) of at most ``sample`` rows that may be learnt from."""
    own = labels.select(F.col(id_col).cast("long").alias("learn_id"), F.col(label).cast("int").alias("label")).where("learn_id IS NOT NULL AND label IN (0, 1)")
    own = own.where(~held_out(F.col("learn_id"))).groupBy("learn_id").agg(F.max("label").alias("label"))
    return own.orderBy(F.xxhash64("learn_id"), "learn_id").limit(sample)


def class_chains(texts: DataFrame) -> DataFrame:
    """node, above, gram, depth, ordinary, toxic of the chains with more than DISCOUNT
    occurrences in the labelled texts (text, label)."""
    words = texts.mapInArrow(tidied(count_words), "head binary, word binary, ordinary long, toxic long")
    dealt = words.repartition("head").sortWithinPartitions("head")
    found = dealt.mapInArrow(tidied(count_chains), "node long, above long, gram long, depth long, ordinary long, toxic long")
    sums = found.groupBy("node").agg(*(F.first(c).alias(c) for c in ("above", "gram", "depth")), *(F.sum(c).alias(c) for c in ("ordinary", "toxic")))
    return sums.where(F.col("ordinary") + F.col("toxic") > DISCOUNT)


def shared_counts(texts: DataFrame) -> DataFrame:
    """k, gram, n: of all texts, sequences of ORDER bytes with their counts, and of each
    shorter length with the number of bytes that continue them to the left."""
    counted = texts.mapInArrow(tidied(count_grams), "gram long, n long")
    longest = materialize(counted.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    # (k, gram): a sequence of k + 1 bytes that continues one of k to the left
    longer = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")) for k in range(1, ORDER))))
    pairs = longest.select(longer.alias("s")).select("s.k", "s.gram").distinct()
    masks = F.array(*(F.lit((1 << 8 * k) - 1).cast("long") for k in range(1, ORDER)))
    shorter = pairs.groupBy("k", F.col("gram").bitwiseAND(masks[F.col("k") - 1]).alias("gram")).agg(F.count("*").alias("n"))
    return longest.select(F.lit(ORDER).alias("k"), "gram", "n").unionByName(shorter)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    learn = labelled(labels, id_col, label, sample)
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("learn_id"), F.col(f"`{text_col}`").alias("text"))
    taught = plain.join(F.broadcast(learn), "learn_id").select("text", "label")
    chains = materialize(class_chains(taught), "chains")
    counts = materialize(shared_counts(plain.select("text")), "orders")
    suffixes = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")) for k in range(1, ORDER + 1))))
    need = chains.select("gram").distinct().select(suffixes.alias("s")).select("s.k", "s.gram").distinct()
    above = F.shiftrightunsigned("gram", 8)
    context = counts.groupBy("k", above.alias("gram")).agg(F.sum("n").alias("total"), F.sum(F.least("n", F.lit(SHARED_DISCOUNT))).alias("rest"))
    n = counts.join(need, ["k", "gram"], "left_semi").orderBy("k", "gram").toArrow()
    c = context.join(need.select("k", above.alias("gram")).distinct(), ["k", "gram"], "left_semi").orderBy("k", "gram").toArrow()
    of = lambda t, k, *cols: tuple(t.filter(pa.compute.equal(t.column("k"), k)).column(x).to_numpy() for x in cols)
    seen = chains.toArrow()
    node, above, gram, depth, ordinary, toxic = (seen.column(x).to_numpy() for x in ("node", "above", "gram", "depth", "ordinary", "toxic"))
    if not toxic.sum() or not ordinary.sum():
        return Model(None)
    by_order = {k: of(n, k, "gram", "n") for k in range(1, ORDER + 1)}
    contexts = {k: of(c, k, "gram", "total", "rest") for k in range(1, ORDER + 1)}
    unsigned = lambda x: (x[0].view(np.uint64), *x[1:])
    shared = shared_probability(gram.view(np.uint64), {k: unsigned(x) for k, x in by_order.items()}, {k: unsigned(x) for k, x in contexts.items()})
    model = Model.build(node.view(np.uint64), above.view(np.uint64), depth, shared, (toxic, ordinary))
    checked = taught.select("label", model.raw(F.col("text")).alias("raw")).toPandas()
    raw, label = checked["raw"].to_numpy(), checked["label"].to_numpy()
    found = curve(raw, label)
    if found is None:
        model.prior = min(float(label.mean()) if len(label) else 0.0, HIGHEST_PRIOR)
    else:
        model.middle, model.slope = found
    return model


def curve(raw: np.ndarray, label: np.ndarray) -> tuple[float, float] | None:
    """Where the logistic curve is a half and its slope; None if no cut tells toxic texts
    from ordinary ones.

    The cut has the best F1 of those above 0, as a text of which nothing is known (raw 0)
    must stay below a half. It counts only if the curve says more about the labels than
    their share does: its log-loss, with two parameters' cost, must be the smaller one.
    """
    order = np.argsort(-raw, kind="stable")
    raw, label = raw[order], label[order]
    hits = np.cumsum(label)
    f1 = 2 * hits / (np.arange(len(raw)) + 1 + label.sum()) if len(raw) else raw
    cuts = np.append(raw[1:] != raw[:-1], True) & (raw > 0) if len(raw) else np.zeros(0, bool)
    if not cuts.any() or not label.any():
        return None
    best = int(np.argmax(np.where(cuts, f1, -1)))
    middle = (raw[best] + max(raw[best + 1] if best + 1 < len(raw) else 0.0, 0.0)) / 2
    slopes = np.geomspace(10, 10_000, 40)
    loss = [np.logaddexp(0, np.where(label == 1, -s, s) * (raw - middle)).mean() for s in slopes]
    share = label.mean()
    known = 0.0 if share == 1 else -(share * np.log(share) + (1 - share) * np.log(1 - share))
    if min(loss) + np.log(len(label)) / len(label) >= known:
        return None
    return float(middle), float(slopes[int(np.argmin(loss))])


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    model = fit(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), model.score(F.col(text_col)).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score 0.5 or more."""
    model = fit(docs, labels, id_col, text_col)
    return docs.where(model.score(F.col(f"`{text_col}`")) < 0.5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = None
