"""Text operators against brute force, and their defined results on odd rows."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sparktree.llm import decontamination, importance_resampling, language_id, packing, simhash, substring_dedup, toxicity
from sparktree.llm.bk_tree import Forest
from sparktree.llm.common import Words, binary, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (5, "two words"), (None, "no id at all"),
    (7, "é ß ÀB c D"), (8, "  lead and  double "), (9, "long " * 30_000), (10, "same text " * 20), (11, "same text " * 20),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash long, node string, chunk int"


def documents(spark, rows):
    full = [(i, t, None, "s", None if t is None else len(t), 1, "x", 2) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def some(spark, data):
    return spark.read.parquet(f"{data}/sf0.001/documents.parquet")


def test_words_and_slices():
    import pyarrow as pa

    texts = ["a  bc\td", None, "", " x", "é\x0b1"]
    w = Words(binary(pa.array(texts)))
    assert [bytes(w.buf[a:b]).decode() for a, b in zip(w.start, w.end)] == [x for t in texts for x in WORD.findall(t or "")]
    assert np.diff(w.first).tolist() == [3, 0, 0, 1, 2]
    assert len(set(w.hash.tolist())) == 6
    whole = Words(binary(pa.array(["p q r", "s t"])))
    assert whole.whole(2).tolist() == [True, True, False, True]
    assert [b.num_rows for b in slices(pa.record_batch([pa.array(["aa", "b" * 9, "c"])], names=["text"]), "text", 4)] == [1, 1, 1]


def brute_substring(rows, window):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for j in range(len(w) - window + 1):
                k = tuple(w[j : j + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[j : j + window])] < i:
                gone |= set(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [2, 5, 13])
def test_substring_odd_rows(spark, odd, window):
    rng = np.random.default_rng(window)
    rows = ODD + [(100 + i, " ".join(rng.choice(list("abc"), 40))) for i in range(20)]
    found = substring_dedup.substring_digests(spark, documents(spark, rows), window).collect()
    assert sorted(map(tuple, found), key=str) == brute_substring(rows, window)


def test_substring_query(spark, oracle, same, data):
    found = substring_dedup.op7_substring_dedup(spark, f"{data}/sf0.001").toPandas()
    same(found, oracle(substring_dedup.ORACLE_SQL))


#: A word of as many letters as this number has bits, a for 0 and b for 1: a sum over (place, letter) hashes can't tell it from one of a alone.
MADE_UP = 0xD3005D083514573D347443E6411095B709BF64687C2711CE358DDD85F432D2C081CA9E90744EFEA4013D4FBB60E14176004778D9781C11BD8AD28F2A06E314D9037C7C31DDA05A9BFC365688D76DA6C57364FCC6C3F5D44B1537D7809DFEA926DBDD37D92D4A5BD05A4337BCD681675923587E1901F30981B8307B97715CE33311E0884DBC0DAB6161206470BFD88DFD23B5E6DD6B6E6CC79D6248608350B389CAEE01E1A742A3BD9D7FF2B038B1EF2D8F729181C6680DBF81C09D991078F54E01D6088586C7B63EECB80B9F0290622CE6E3D0363B07A3599A2BD480542630481BAB44C7075D18666C6C6BF112CCF5F06B5BA45A5C6894B223AA494E49E106FF9C35479DCFDA1E3F052119B1157C0DA1


def test_made_up_words_remove_nothing(spark):
    one = "".join("ab"[(MADE_UP >> i) & 1] for i in range(2175, -1, -1))
    tail = " ".join(f"x{i}" for i in range(12))
    found = substring_dedup.substring_digests(spark, documents(spark, [(1, f"{one} {tail}"), (2, f"{'a' * 2176} {tail}"), (3, f"{one} {tail}")]))
    assert {r.doc_id: r.n_removed for r in found.collect()} == {1: 0, 2: 0, 3: 13}


def test_word_hashes():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("ab"), rng.integers(1, 90))) for _ in range(5000)} | {"a" * n for n in range(1, 130)} | {"\x00" * n for n in range(1, 20)})
    a, b, other = (Words(binary(pa.array([" ".join(words + words)])), seed=s) for s in (1, 1, 2))
    for x in (a.hash, a.check):
        assert (x[: len(words)] == x[len(words) :]).all() and len(np.unique(x)) == len(words)
    assert (a.hash == b.hash).all() and (a.check == b.check).all() and not np.isin(a.hash, other.hash).any() and not np.isin(a.hash, a.check).any()


def test_substring_texts_keep_other_columns(spark, empty):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"start {passage} end"), (2, f"other\n{passage}\ntail"), (3, "clean\n text"), (4, None)]
    out = {r.doc_id: r for r in substring_dedup.dedup_substrings(spark, documents(spark, rows), 50).collect()}
    assert out[1].text == rows[0][1] and out[3].text == "clean\n text" and out[4].text is None
    assert out[2].text == "other\ntail" and out[2].hash == 1 and out[2].chunk == 2
    assert substring_dedup.dedup_substrings(spark, empty, 50).count() == 0
    assert substring_dedup.substring_digests(spark, empty).count() == 0


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if h and sum(v >> b & 1 for v in h) * 2 > len(h))


def brute_components(ids, prints, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(len(prints))]
    least = {r: min((ids[i] for i in range(len(ids)) if roots[i] == r and ids[i] is not None), default=None) for r in roots}
    return [least[r] for r in roots]


def test_simhash_against_brute_force(spark, some):
    rows = [(r.doc_id, r.text) for r in some.select("doc_id", "text").collect()] + [(None if i is None else 10_000 + i, t) for i, t in ODD]
    found = simhash.simhash_components(documents(spark, rows)).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], prints, 4)
    assert sorted(map(tuple, found), key=str) == sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, want)), key=str)


def test_simhash_empty(empty):
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("cap", [8, 512])
def test_links_of_dense_shards(spark, cap, monkeypatch):
    """Codes that differ in a few bits, in shards beyond the cap: no link is lost."""
    monkeypatch.setattr(simhash, "SHARD", cap)
    rng = np.random.default_rng(cap)
    base = rng.integers(0, 2**62, 6)
    codes = sorted({int(b) ^ sum(1 << int(x) for x in rng.choice(62, rng.integers(0, 4), replace=False)) for b in base for _ in range(40)})
    nodes = spark.createDataFrame([(c,) for c in codes], "node long")
    links = simhash.radius_links(nodes, 4).collect()
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 64 for r in links)
    from sparktree.llm.components import connected_components

    label = {r.node: r.label for r in connected_components(simhash.radius_links(nodes, 4)).collect()}
    want = brute_components(codes, codes, 4)
    assert [label.get(c, c) for c in codes] == want


@pytest.mark.parametrize("cap", [8, 512])
def test_every_pair_of_a_shard_meets(spark, cap, monkeypatch):
    """Unlike nodes of one large shard: whatever blocks and parts they lie in, each two meet."""
    monkeypatch.setattr(simhash, "SHARD", cap)
    n = 60 if cap == 8 else 1500
    members = spark.range(n).selectExpr("1L AS shard", "id AS node")
    met = []

    def compare(rows):
        met.append(rows.toPandas())
        return spark.createDataFrame([], "a long, b long")

    simhash.in_rounds(members, compare)
    pairs = set()
    for frame in met:
        for _, cell in frame.groupby("shard"):
            assert len(cell) <= 2 * cap + simhash.LEADERS
            node, side = cell.node.to_numpy(), cell.side.to_numpy()
            a, b = np.nonzero((side[:, None] != side[None, :]) | (side[:, None] == 0))
            pairs |= set(zip(node[a].tolist(), node[b].tolist()))
    assert len({(a, b) for a, b in pairs if a < b}) == n * (n - 1) // 2


def test_planted_pairs_of_one_shard(spark):
    """2,000 codes that share 12 bits; 1,000 pairs differ in one bit of each other block."""
    rng = np.random.default_rng(2)
    codes = []
    for _ in range(1000):
        code = int(rng.integers(0, 2**51)) << 12
        codes += [code, code ^ sum(1 << int(rng.integers(lo, lo + 12)) for lo in (13, 26, 39, 51 - 1))]
    nodes = spark.createDataFrame([(c,) for c in codes], "node long")
    from sparktree.llm.components import connected_components

    label = {r.node: r.label for r in connected_components(simhash.radius_links(nodes, 4)).collect()}
    assert all(label.get(a) is not None and label.get(a) == label.get(b) for a, b in zip(codes[::2], codes[1::2]))


def test_bk_trees():
    rng = np.random.default_rng(0)
    code = np.unique(rng.integers(0, 2**10, 300)).astype(np.uint64)
    shard = np.sort(rng.integers(0, 3, len(code)))
    found = {(int(p), int(n)) for a, b in Forest(code, shard).search(code, shard, 2) for p, n in zip(a, b)}
    want = {(i, j) for i in range(len(code)) for j in range(len(code)) if shard[i] == shard[j] and bin(int(code[i]) ^ int(code[j])).count("1") <= 2}
    assert found == want


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(3000)]
    text = lambda n: list(rng.choice(vocabulary, n))
    rows, groups = [], 30
    for g in range(groups):
        words = text(int(rng.integers(120, 600)))
        for c in range(3):
            copy = list(words)
            for at in rng.choice(len(copy), len(copy) // 100, replace=False) if c else ():
                copy[at] = rng.choice(vocabulary)
            rows.append((g * 10 + c, " ".join(copy)))
    rows += [(1000 + i, " ".join(text(200))) for i in range(30)]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()}
    assert {i for i in kept if i >= 1000} == set(range(1000, 1030))
    assert {g * 10 for g in range(groups)} <= kept
    assert len([i for i in kept if i < 1000]) <= groups + 1


def jaccard(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("kind", ["cut", "longer", "block", "scattered"])
def test_near_copies_by_exact_similarity(spark, kind):
    """Every pair of 0.8 or more is found whatever the edit, and none below."""
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for g in range(120):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        new = [f"v{x}" for x in rng.integers(0, 10**6, 60)]
        k = int(rng.integers(5, 60))
        if kind == "cut":
            copy = words[:-k]
        elif kind == "longer":
            copy = words + new[:k]
        elif kind == "block":
            copy = words[:70] + new[:k] + words[70 + k :]
        else:
            copy = list(words)
            for at in rng.choice(200, max(1, k // 5), replace=False):
                copy[at] = new[0]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
        want[2 * g + 1] = jaccard(words, copy) >= 0.8
    assert 10 < sum(want.values()) < 110
    kept = {r.doc_id for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()}
    assert {i for i in range(0, 240, 2)} <= kept
    assert {i for i in want if i not in kept} == {i for i in want if want[i]}


@pytest.mark.parametrize("cap", [4, 512])
def test_similar_texts_of_large_shards(spark, cap, monkeypatch):
    """Chains of texts connect what pairs of 0.8 connect, also where parts of a shard meet."""
    monkeypatch.setattr(simhash, "SHARD", cap)
    words = [f"w{i}" for i in range(400)]
    texts = [words[i : i + 100] for i in (*range(0, 200, 4), *range(240, 290, 3))]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, " "), (902, "")]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicate_components(documents(spark, rows)).collect()}
    assert jaccard(texts[0], texts[1]) > 0.8 > jaccard(texts[49], texts[50])
    assert [found[i] for i in range(len(texts))] == [0] * 50 + [50] * 17
    assert found[900] == found[901] == found[902] == 900


def test_trees_of_fingerprints_give_candidates(spark, monkeypatch):
    """The pipeline's step takes what op4's trees link, and compares it."""
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(words[::-1])), (4, None), (5, " "), (6, " ".join(words))]
    docs = documents(spark, rows)
    code = {r.doc_id: int(r.fingerprint, 16) for r in simhash.simhash_components(docs).collect()}
    assert (code[1] ^ code[2]).bit_count() <= 4 < (code[1] ^ code[3]).bit_count()
    links, whole = [], simhash.fingerprint_candidates
    monkeypatch.setattr(simhash, "fingerprint_candidates", lambda nodes: links.append(whole(nodes)) or links[0])
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    nodes = {r.doc_id: r.node for r in simhash.text_keys(docs, "doc_id", "text").collect()}
    assert {frozenset(r) for r in links[0].collect()} == {frozenset((nodes[1], nodes[2])), frozenset((nodes[4], nodes[5]))}
    assert kept == {1, 3, 4}


def test_packing_round_trip(spark, odd, some):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text) for r in some.select("doc_id", "text").collect()] + [(10_000 + i, t) for i, (_, t) in enumerate(ODD)] + [(20_000, "a <|endoftext|> b"), (20_001, "x   y \n z  ")]
    pieces = packing.pack_documents(documents(spark, rows)).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    got, sequences = {}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == len(got.setdefault(p.doc_id, [])) and p.length == len(p.ids) and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, np.uint32).tobytes())
        got[p.doc_id] += p.ids
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == ids
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048


@pytest.mark.parametrize("window", [10, 64, 1000])
def test_packer_chooses_by_sum_of_squares(window):
    """Each placement has the least sum of squares over all levels, the fullest of equals."""
    packer, rng = packing.Packer(window), np.random.default_rng(window)
    for doc in range(600):
        size = int(rng.integers(1, packer.top))
        n = np.append(packer.levels, 0)

        def squares(level):
            m = n.copy()
            m[level] -= level > 0
            m[level + size] += level + size < packer.top
            return (m[1 : packer.top] ** 2).sum()

        allowed = [0] + [h for h in range(1, packer.top - size + 1) if n[h] > 0]
        assert packer.choose(size) == min(allowed, key=lambda h: (squares(h), -h)), (n, size)
        packer.add(doc, np.zeros(size * packer.step, np.uint32))


def test_packer_seldom_joins():
    packer, rng = packing.Packer(2048), np.random.default_rng(0)
    for doc in range(1500):
        packer.add(doc, np.zeros(int(rng.exponential(700)) + 1, np.uint32))
    packer.join()
    assert packer.joined < 0.1 * packer.next


def test_ids_equal_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(1)
    letters = list("abcXYZ019 .,;:'\n\t-_é漢字🙂ß") + [" "] * 4
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text, ids in zip(texts, encode(texts)):
        assert np.frombuffer(ids, np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_encoder_loads_the_tokenizer_when_needed():
    """Texts that split at spaces don't take the memory of the whole tokenizer."""
    import public_tokenizers

    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert all(encode(["some words", "other words"])) and "whole" not in vars(encode)
    assert all(encode(["two  spaces"])) and "whole" in vars(encode)


def test_packing_takes_batches_of_bounded_bytes(spark):
    key, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", "n long, size long"
    before = spark.conf.get(key)
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text"))

    def seen(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    try:
        packing.pack_documents(docs)
        got = docs.mapInArrow(seen, sizes).collect()
    finally:
        spark.conf.set(key, before)
    assert sum(r.n for r in got) == 400
    assert max(r.size for r in got) <= (4 << 20) + 200_000


def test_packer_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "OPEN", 16)
    packer = packing.Packer(64)
    for doc in range(500):
        packer.add(doc, np.zeros(33, np.uint32))
        assert packer.n_open <= 17
    packer.join()
    assert sum(len(o[2]) for o in packer.out) == 500 * 33


def test_decontamination_query(spark, oracle, same, data):
    found = decontamination.op8_decontamination(spark, f"{data}/sf0.001").toPandas()
    same(found, oracle(decontamination.ORACLE_SQL))


def test_decontamination_odd_rows(spark, odd, empty):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny one"), (5, item)], "item_id long, text string")
    docs = documents(spark, ODD + [(50, f"x {item.upper()} y"), (51, "pad " * 5000 + item), (52, "tiny ONE"), (53, item.replace("beta", "b")), (50, f"x {item.upper()} y")])
    found = {(r.doc_id, r.item_id) for r in decontamination.contained_items(docs, items).collect()}
    assert found == {(50, 1), (50, 5), (51, 1), (51, 5), (52, 4)}
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert decontamination.contained_items(empty, items).count() == 0
    assert decontamination.contained_items(docs, items.limit(0)).count() == 0


def test_decontamination_items_with_null_and_equal_ids(spark):
    texts = [" ".join(f"{c}{i}" for i in range(20)) for c in "abcd"]
    items = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (0, texts[2]), (0, texts[3]), (0, texts[3])], "item_id long, text string")
    docs = documents(spark, [(i, f"x {t} y") for i, t in enumerate(texts)] + [(9, "clean " * 20)])
    found = [(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontamination.contained_items(docs, items).collect()]
    assert sorted(found, key=str) == [(0, None, 16, 16), (1, None, 16, 16), (2, 0, 16, 16), (3, 0, 16, 16)]
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, items).collect()] == [9]


def test_decontamination_of_items_of_all_sizes(spark):
    """Items of 2 to 900 shingles, in long documents and alone, with words changed until they
    just hold enough, or just too little: equal to brute force, nothing is missed."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 40_000, n)]
    texts = [words(int(n)) for n in (6, 7, 12, 20, 40, 90, 180, 300, 600, 904)]
    cut = lambda t: {" ".join(t[i : i + 5]) for i in range(max(len(t) - 4, 1))}
    docs = []
    for t in texts:
        for changes in range(0, len(t) // 10 + 3, max(len(t) // 60, 1)):
            own = list(t)
            for at in rng.integers(0, len(t), changes):
                own[at] = "changed"
            docs.append(own if changes % 2 else words(400) + own + words(30))
    items = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "item_id long, text string")
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contained_items(rows, items).collect()}
    want = {(d, i) for d, doc in enumerate(docs) for i, t in enumerate(texts) if len(cut(doc) & cut(t)) >= 0.8 * len(cut(t))}
    assert found == want and len({i for _, i in want}) == len(texts)


def test_decontamination_looks_up_by_class(spark):
    """Each class takes the hashes up to its own bound, and no document too short for it."""
    rng = np.random.default_rng(9)
    words = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 40_000, n))
    items = spark.createDataFrame([(i, words(7)) for i in range(3)] + [(i, words(204)) for i in range(3, 6)], "item_id long, text string")
    docs = spark.createDataFrame([(1, words(2004)), (2, words(104))], "doc_key long, text string")
    sketch = decontamination.sketches(decontamination.item_shingles(items, "item_id", "text", 5), 0.8)
    share = {(r.doc_key, r.size): r.n for r in decontamination.looked_up(docs, F.col("text"), sketch, 5, 0.8).groupBy("doc_key", "size").agg(F.count("*").alias("n")).collect()}
    assert set(share) == {(1, 1), (1, 7), (2, 1)}
    assert share[1, 7] < 0.4 * 2000 and share[1, 7] < share[1, 1]


def test_decontamination_without_broadcast(spark, same, some, data, monkeypatch):
    items = spark.read.parquet(f"{data}/sf0.001/benchmark.parquet")
    want = decontamination.contained_items(some, items).toPandas()
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    same(decontamination.contained_items(some, items).toPandas(), want)


def learnt(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        own = list(rng.choice(words, 60))
        toxic = i % 4 == 0
        if toxic:
            own[int(rng.integers(60))] = "zzgrr" + rng.choice(["", "ul", "ok"])
            own[int(rng.integers(60))] = "qqvile"
        rows.append((i, " ".join(own)))
        labels.append((i, i % 2, int(toxic)))
    return rows, spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_finds_held_out(spark, empty):
    rows, labels = learnt(spark)
    found = toxicity.score_documents(documents(spark, rows + [(None if i is None else 5000 + i, t) for i, t in ODD]), labels).collect()
    assert len(found) == len(rows) + len(ODD)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert not any(r.predicted for r in found if r.doc_id is None or r.doc_id >= 5000)
    kept = toxicity.drop_toxic(documents(spark, rows), labels)
    assert kept.columns == documents(spark, []).columns and 440 <= kept.count() <= 455
    assert toxicity.score_documents(empty, labels).count() == 0
    assert all(r.score == 0 for r in toxicity.score_documents(documents(spark, rows[:5]), labels.limit(0)).collect())


def brute_toxicity(texts, labels):
    """Plain Python: (raw score of each text, P(byte | chain before it, class))."""
    import math
    from collections import Counter

    words = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    counts = [Counter(), Counter()]
    for own, label in zip(words, labels):
        if label is not None:
            counts[label].update(w[:i] for x in set(own) for w in [x + " "] for i in range(1, len(w) + 1))
    pooled = counts[0] + counts[1]
    known = {c for c, n in pooled.items() if n > 3}
    grams = {5: Counter((" " + w + " ")[: i + 1][-5:].rjust(5, "0") for own in words for w in own for i in range(1, len(w) + 2))}
    for k in (4, 3, 2, 1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])

    def lower(text, k=5):
        if not k:
            return 1 / 256
        own = (" " + text)[-k:].rjust(k, "0")
        rivals = [n for g, n in grams[k].items() if g[:-1] == own[:-1]]
        if not rivals:
            return lower(text, k - 1)
        return (max(grams[k][own] - 0.75, 0) + sum(min(n, 0.75) for n in rivals) * lower(text, k - 1)) / sum(rivals)

    def total(c, before):
        return sum(n for x, n in c.items() if len(x) == len(before) + 1 and x.startswith(before) and (len(before) > 0 or len(x) == 1))

    def discounted(c, text, shorter):
        n = total(c, text[:-1])
        if not n:
            return shorter
        kept = {x: max(c[x] - 3, 0) for x in known if len(x) == len(text) and x[:-1] == text[:-1]}
        return kept.get(text, 0) / n + (1 - sum(kept.values()) / n) * shorter

    def step(text, label):
        shared = discounted(pooled, text, lower(text))
        return (discounted(counts[label], text, shared) + shared) / 2

    def evidence(word):
        gap, text = 0.0, word + " "
        for i in range(1, len(text) + 1):
            gap += math.log(step(text[:i], 1)) - math.log(step(text[:i], 0))
            if text[:i] not in known:
                break
        return math.copysign(max(abs(gap) - 1, 0), gap)

    seen = {w: evidence(w) for own in words for w in own}
    return [sum(seen[w] for w in own) / max(len(own), 1) for own in words], step


def test_toxicity_equals_plain_python(spark):
    import pyarrow as pa

    rng = np.random.default_rng(9)
    texts = [" ".join("".join(rng.choice(list("abAc"), rng.integers(1, 5))) for _ in range(25)) + (" badx bady" if i % 3 == 0 else "") for i in range(40)]
    labels = [None if zlib.crc32(str(i).encode()) % 5 == 0 else int(i % 3 == 0) for i in range(40)]
    table = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(documents(spark, list(enumerate(texts))), table)
    want, step = brute_toxicity(texts, labels)
    np.testing.assert_allclose(model.raw_scores(binary(pa.array(texts))), want, atol=1e-9)
    assert max(want) > 0.01
    for before in ("", "a", "ba", "bad", "zz"):
        for label in (0, 1):
            assert abs(sum(step(before + chr(b), label) for b in range(256)) - 1) < 1e-6


def test_toxicity_reads_whole_words():
    import pyarrow as pa

    texts = ["Ab cdefghijklmnop", "", None, "é1"]
    words = toxicity.words_of(binary(pa.array(texts)))
    chains = toxicity.Chains.of(words.buf, words.start, words.end)
    assert np.bincount(chains.word).tolist() == [3, 15, 4]
    assert bytes(chains.gram[2].tobytes()[:4]) == b" ba "
    assert len(set(chains.node.tolist())) == 22 and chains.above[0] == toxicity.ROOT
    inner = chains.depth > 0
    assert (chains.above[inner] == chains.node[np.flatnonzero(inner) - 1]).all()


def test_language(spark, some, empty, odd):
    found = {r.doc_id: r for r in language_id.identify(some).collect()}
    truth = {r.doc_id: r.lang for r in some.select("doc_id", "lang").collect()}
    held = [i for i, r in found.items() if r.held_out]
    assert np.mean([found[i].lang_pred == truth[i] for i in held]) > 0.95
    assert language_id.identify(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd).collect()} == {"und"}
    mixed = some.select("doc_id", "text", "lang").union(odd.selectExpr("doc_id + 10000", "text", "lang"))
    by_id = {r.doc_id: r for r in language_id.identify(mixed).collect()}
    assert by_id[10001].lang_pred == by_id[10002].lang_pred == by_id[10003].lang_pred == "und"
    assert by_id[10004].lang_pred in set(truth.values()) and 0 <= by_id[10004].score <= 1


def test_language_of_repeated_ids_and_plain_python(spark):
    """A row is learnt in its own language; the counts that decide equal plain sets of n-grams."""
    import pyarrow as pa

    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, t, x) for i in ids for t, x in ((f"aaab{chr(97 + i % 9)} abab", "one"), (f"zzzy{chr(97 + i % 9)} zyzy", "two"), ("qqqq rrrr", None))]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(model.languages) == ["one", "two"]
    sets = {}
    for lang in model.languages:
        texts = [t for _, t, x in rows if x == lang]
        held = [{t[i : i + 4] for i in range(len(t) - 3)} for t in texts]
        sets[lang] = {g for g in set().union(*held) if sum(g in h for h in held) >= max(1, np.ceil(0.05 * len(texts)))}
    asked = ["aaab abab", "zyzy zzzy", "abab zyzy zyzy", "qqqq rrrr"]
    best, _ = model.decide(binary(pa.array(asked)))
    for text, b in zip(asked[:3], best):
        grams = [text[i : i + 4] for i in range(len(text) - 3)]
        assert model.languages[b] == max(model.languages, key=lambda x: sum(g in sets[x] for g in grams))
    mask = model.lookup(language_id.ngrams(binary(pa.array(["qqqq rrrr"])))[1])
    assert not mask.any()


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**32, 500).astype(np.uint64)
    language = rng.integers(0, 3, 500)
    mask = language_id.Filter.build(["a", "b", "c"], keys, language).lookup(keys)
    assert ((mask >> language.astype(np.uint64)) & np.uint64(1)).all()


def test_more_languages_than_bits_of_a_number(spark):
    rng = np.random.default_rng(4)
    words = {f"l{k:03}": ["".join(rng.choice(list("abcdefghijklmnop"), 8)) for _ in range(12)] for k in range(150)}
    rows = [(i, " ".join(rng.choice(words[lang], 10)), lang) for i, lang in enumerate(sorted(words) * 8)]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {i: x for i, _, x in rows}
    assert {r.lang_pred for r in found} == set(words)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in found]) > 0.95


def test_resampling(spark, some, empty, odd, data):
    labels = spark.read.parquet(f"{data}/sf0.001/labels.parquet")
    found = importance_resampling.resample(some, labels, 0.4).toPandas()
    k = round(0.4 * len(found))
    assert found.selected.sum() == k
    assert set(found[found.selected].doc_id) == set(found.nlargest(k, "gumbel_key").doc_id)
    assert importance_resampling.resample(empty, labels).count() == 0
    assert importance_resampling.resample(odd, labels.limit(0)).toPandas().log_weight.eq(0).all()


def test_resampling_weights_equal_plain_python(spark, some, data):
    import pyarrow as pa
    from collections import Counter

    labels = spark.read.parquet(f"{data}/sf0.001/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    rows = [(r.doc_id, r.text) for r in some.select("doc_id", "text").collect()]
    cells = 1 << importance_resampling.BITS
    place = {}

    def grams(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    raw, target = Counter(), Counter()
    for i, text in rows:
        for g in grams(text):
            if g not in place:
                place[g] = int(importance_resampling.buckets(binary(pa.array([g])))[1][-1])
            raw[place[g]] += 1
            target[place[g]] += i in good
    n, m = sum(raw.values()), sum(target.values())
    weight = lambda c: np.log((target[c] + 1) / (m + cells)) - np.log((raw[c] + 1) / (n + cells))
    want = {i: sum(weight(place[g]) for g in grams(t)) for i, t in rows}
    for r in importance_resampling.resample(some, labels).collect():
        assert abs(r.log_weight - want[r.doc_id]) < 1e-6 * max(1, abs(want[r.doc_id]))


def test_resampling_of_equal_keys_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(importance_resampling, "SORTED", 50)
    rows = spark.range(3000).selectExpr("1.5D AS key", "id + 1152921504606846976 AS tie")
    assert importance_resampling.kth_largest(rows, "key", "tie", 1000) == (1.5, 2**60 + 999)
    far = spark.createDataFrame([(-(2**63),), (2**63 - 1,)] + [(i,) for i in range(200)], "tie long")
    assert [importance_resampling.kth_smallest(far, k) for k in (1, 2, 100, 202)] == [-(2**63), 0, 98, 2**63 - 1]
    none = documents(spark, [(None, f"text {i}") for i in range(40)])
    found = importance_resampling.resample(none, spark.createDataFrame([], "doc_id long, quality int"), 0.5).collect()
    assert sum(r.selected for r in found) == 20 and len({r.gumbel_key for r in found}) == 40


@pytest.mark.parametrize("k", [1, 37, 500, 999])
def test_kth_largest(spark, k, monkeypatch):
    monkeypatch.setattr(importance_resampling, "SORTED", 20)
    rng = np.random.default_rng(k)
    rows = [(float(rng.integers(0, 40)), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "key double, tie long")
    assert importance_resampling.kth_largest(df, "key", "tie", k) == sorted(rows, key=lambda r: (-r[0], r[1]))[k - 1]


def test_substring_of_made_up_words(spark):
    """Words on which polynomial hashes modulo 2**64 meet don't make windows equal."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{one} {rest}"), (2, f"{other} {rest}")]
    assert [r.n_removed for r in substring_dedup.substring_digests(spark, documents(spark, rows), 13).collect()] == [0, 0]


def test_substring_levels():
    assert substring_dedup.levels(13) == [4, 7, 13] and substring_dedup.levels(50) == [13, 25, 50] and substring_dedup.levels(2) == [1, 2]


def test_substring_with_more_chunks_than_buckets(spark, some, oracle, same, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "BUCKETS", 5)
    before = spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "5")
    try:
        found = substring_dedup.substring_digests(spark, some).toPandas()
    finally:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", before)
    same(found, oracle(substring_dedup.ORACLE_SQL))


def test_substring_windows_with_one_first_hash(monkeypatch):
    """Windows that share the first hash are told apart by the second."""
    import pyarrow as pa

    plain = Words.windows
    monkeypatch.setattr(Words, "windows", lambda self, k, of="hash": plain(self, k, of) if of == "check" else plain(self, k) & np.uint64(0))
    texts = ["a b c", "d e f", "x a b c y", "g h i"]
    chunk = pa.table({"id": pa.array([1, 2, 3, 4]), "text": pa.array(texts), "chunk": pa.array([0] * 4, pa.int32())})
    sent = substring_dedup.middle_level(chunk, None, 3, None, 2, 0)
    sent = substring_dedup.last_level(chunk, substring_dedup.repeated_keys(sent), 3, 2, 0)
    answers = substring_dedup.smallest_ids(sent)
    gone = np.concatenate([g for _, _, _, g in substring_dedup.removed_words(chunk, answers, 3)])
    assert np.flatnonzero(gone).tolist() == [7, 8, 9]


def test_toxicity_where_labels_teach_nothing(spark, some, data):
    same_text = documents(spark, [(i, "the very same text of some words") for i in range(200)])
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(200)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score_documents(same_text, labels).collect()} == {0}
    assert toxicity.drop_toxic(same_text, labels).count() == 200
    few = some.where("doc_id < 61")
    assert toxicity.drop_toxic(few, spark.read.parquet(f"{data}/sf0.001/labels.parquet")).count() >= few.count() - 2
    rng = np.random.default_rng(8)
    chance = documents(spark, [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 40))) for i in range(300)] + [(900, None), (901, "12 ?!"), (902, "...")])
    drawn = spark.createDataFrame([(i, int(rng.random() < 0.3)) for i in range(300)], "doc_id long, toxic int")
    kept = {r.doc_id for r in toxicity.drop_toxic(chance, drawn).collect()}
    assert {900, 901, 902} <= kept and len(kept) > 150


def test_toxicity_curve():
    raw, label = np.array([3.0, 2.0, 0.0, 0.0, -1.0] * 20), np.array([1, 1, 0, 0, 0] * 20)
    middle, _ = toxicity.curve(raw, label)
    assert middle == 1.0
    assert toxicity.curve(np.zeros(50), np.arange(50) % 5 == 0) is None
    assert toxicity.curve(np.zeros(0), np.zeros(0)) is None
    assert toxicity.curve(-raw - 1, label) is None


@pytest.mark.parametrize("stage", ["near", "toxic", "items"])
def test_stages_with_clashing_columns(spark, data, stage):
    """Columns named like the operators' own, and an all-null row."""
    names = ["_kept_id", "_kept_node2", "node", "keys", "shard", "label", "learn_id", "score", "gram", "shingle", "item_id", "n", "hash", "text2"]
    rows = [(i, f"text number {i} has a few words of its own {i * 7}", *range(len(names))) for i in range(6)]
    rows += [(6, rows[0][1], *range(len(names))), (None, None, *[None] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
    if stage == "near":
        kept = simhash.drop_near_duplicates(docs)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 4, 5, None}
    elif stage == "toxic":
        kept = toxicity.drop_toxic(docs, spark.read.parquet(f"{data}/sf0.001/labels.parquet"))
        assert kept.columns == docs.columns and kept.count() == 8
    else:
        kept = decontamination.drop_contaminated(docs, spark.read.parquet(f"{data}/sf0.001/benchmark.parquet"))
        assert kept.columns == docs.columns and kept.count() == 8


def test_toxicity_counts_words_of_a_large_batch_in_little_memory():
    rng = np.random.default_rng(5)
    names = np.array([f"w{i:x}" for i in range(60_000)])
    texts = [" ".join(names[rng.integers(0, len(names), 5_000)]) for _ in range(300)]  # 7 MB
    labels = [i % 3 == 0 for i in range(len(texts))]
    batch = pa.record_batch([pa.array(texts), pa.array(np.array(labels, np.int32))], names=["text", "label"])
    tracemalloc.start()
    found = list(toxicity.count_words(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20
    want, seen = [Counter(), Counter()], [Counter(), Counter()]
    for text, label in zip(texts, labels):
        want[label].update({w.encode() for w in text.split()})
    for b in found:
        assert b.column("head").to_pylist() == [w[: toxicity.HEAD] for w in b.column("word").to_pylist()]
        for name, own in zip(("ordinary", "toxic"), seen):
            for word, n in zip(b.column("word").to_pylist(), b.column(name).to_pylist()):
                own[word] += n
    assert [+c for c in seen] == [+c for c in want]
