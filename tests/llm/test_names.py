"""Byte-level BPE, periodic runs and the conversation trie against brute force, and on odd rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken

from sparktree.llm import byte_pairs, periodic_runs, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "no id at all"), (7, "é ß ÀB 日本語 \U0001f600"), (8, "  lead and  double "),
    (9, "long " * 30_000), (10, "ab" * 40_000), (11, "<|endoftext|> it's 12345"), (12, "x" * 65 + " " + "y" * 64), (13, "a\x0bb\x0cc"), (-5, "a b c " * 9 + "d"),
]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, [1], "x", 2) for i, t in rows], "doc_id long, text string, ids array<int>, runs string, chunk int")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(library, data):
    ranks, theirs = library
    vocabulary = byte_pairs.Vocabulary.of(ranks)
    own = byte_pairs.Encoder(vocabulary, public_tokenizers.PATTERN)
    draw = random.Random(5)
    texts = [t for _, t in ODD if t] + ["".join(draw.choice("abcdeé 1\n日'") for _ in range(draw.randint(1, 300))) for _ in range(300)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == theirs.encode_ordinary(text)
        assert vocabulary.decode(ids) == text.encode()
    with pytest.raises(ValueError):
        vocabulary.decode(own.encode(["a"])[0] + 60_000)


def test_bpe_forgets_without_harm(library, monkeypatch):
    ranks, theirs = library
    monkeypatch.setattr(byte_pairs, "REMEMBERED", 64)
    monkeypatch.setattr(byte_pairs, "MATCHES", 8)
    own = byte_pairs.Encoder(byte_pairs.Vocabulary.of(ranks), public_tokenizers.PATTERN)
    draw = random.Random(6)
    texts = [" ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(40)) for _ in range(20)] + [None, ""]
    # a text as long as MATCHES is matched at once, so the bound on pieces is REMEMBERED
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == theirs.encode_ordinary(text or "")


def test_bpe_merges_small_vocabularies():
    """Ties of rank go to the leftmost pair; a token may be reached by other pairs than its own."""
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aaa": 258, b"aab": 259}
    vocabulary = byte_pairs.Vocabulary.of(ranks)
    theirs = tiktoken.Encoding("small", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    own = byte_pairs.Encoder(vocabulary, r"\S+")
    draw = random.Random(7)
    texts = ["".join(draw.choice("aaab") for _ in range(draw.randint(1, 150))) for _ in range(400)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == theirs.encode_ordinary(text)
    with pytest.raises(ValueError):
        byte_pairs.Vocabulary.of({b"a": 0, b"b": 1})


def test_bpe_query_rows(spark, library):
    ranks, theirs = library
    vocabulary = byte_pairs.Vocabulary.of(ranks)
    found = byte_pairs.decode_ids(byte_pairs.encode_documents(documents(spark, ODD), vocabulary, public_tokenizers.PATTERN), vocabulary).collect()
    got = sorted(((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in found), key=str)
    assert got == sorted(((i, tuple(theirs.encode_ordinary(t or "")), (t or "").encode()) for i, t in ODD), key=str)
    assert byte_pairs.encode_documents(documents(spark, []), vocabulary, public_tokenizers.PATTERN).count() == 0


def test_bpe_query(spark, library, data):
    _, theirs = library
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/sf0.001/documents.parquet").collect()}
    found = byte_pairs.op11_byte_level_bpe(spark, f"{data}/sf0.001").collect()
    assert len(found) == len(docs)
    for r in found:
        ids = theirs.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def brute_runs(words, least=6, exponent=4):
    out = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            own = words[start : i + q]
            smaller = any(all(own[t] == own[t + p] for t in range(len(own) - p)) for p in range(1, q))
            if len(own) >= max(least, exponent * q) and not smaller:
                out.append((start, len(own), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 3), (10, 5)])
def test_runs_equal_brute_force(least, exponent):
    draw = random.Random(least)
    texts = []
    for _ in range(300):
        words = []
        while len(words) < 60 and draw.random() < 0.9:
            unit = [draw.choice("abc") for _ in range(draw.randint(1, 7))]
            words += (unit * draw.randint(1, 8))[: draw.randint(1, 40)]
        texts.append(" ".join(words))
    for lo in range(0, len(texts), 7):
        own = texts[lo : lo + 7]
        counts, n_runs, runs, _ = periodic_runs.judged([t.encode() for t in own], least, exponent)
        flat, at = list(zip(*(x.tolist() for x in runs))), 0
        for text, n, k in zip(own, counts, n_runs.tolist()):
            assert n == len(text.split()) and flat[at : at + k] == brute_runs(text.split(), least, exponent)
            at += k


def brute_periodic(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_runs_query(spark, tmp_path):
    draw = random.Random(11)
    rows = [r for r in ODD if r[0] != 9] + [(i, " ".join(draw.choice("ab") for _ in range(draw.randint(0, 80)))) for i in range(20, 120)]
    rows += [(500, "same " * 700), (501, " ".join(f"w{i % 37}" for i in range(400)))]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=str) == sorted((brute_periodic(*r) for r in rows), key=str)
    assert any(r.n_runs > 1 for r in found)
    assert periodic_runs.periodic_runs(documents(spark, [])).count() == 0


def test_runs_of_given_tables(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet").collect()
    found = {r.doc_id: tuple(r) for r in periodic_runs.op12_periodic_runs(spark, f"{data}/sf0.001").collect()}
    short = [r for r in docs if len(r.text or "") < 3000]
    assert len(found) == len(docs) and len(short) > 50
    for r in short:
        assert found[r.doc_id] == brute_periodic(r.doc_id, r.text)


TURNS = "conv_id long, turn long, role string, text string, pos int, name string, node long"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)


def ordered(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}


def brute_trie(convs):
    members, children, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children.update(k[:-1] for k in members if k)
    for k, m in members.items():
        words = len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * words
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some_turns():
    draw = random.Random(13)
    rows = []
    for c in range(-40, 120):
        if draw.random() < 0.9:
            shared = c // 20
            for turn in range(draw.choice([1, 1, 2, 3, 5, 9])):
                rows.append((c, turn, draw.choice(["user", None]), draw.choice([f"hello {shared}", "a  b\tc", None, "", "long word " * 9])))
    rows += [(7, None, "user", "first"), (7, None, None, None), (8, 3, "user", "tie"), (8, 3, "system", "tie"), (9, 1, "user", "same"), (9, 1, "user", "same")]
    rows += [(300, t, "user", f"t{t % 5}") for t in range(70)] + [(301, t, "user", f"t{t % 5}") for t in range(65)]
    rows += [(400 + i, t, "user", "common") for i in range(60) for t in range(3)]
    return rows + [(None, 1, "user", "nobody"), (20_000, 0, "user", "alone")]


KEPT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_equals_brute_force(spark):
    rows = some_turns()
    found = prefix_trie.conversation_trie(turns_of(spark, rows)).select(*KEPT).collect()
    assert sorted(map(tuple, found), key=str) == brute_trie(ordered(rows))
    assert prefix_trie.conversation_trie(turns_of(spark, [])).count() == 0


def test_trie_query_on_odd_rows(spark, oracle, same, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 64)  # many pieces for each digest
    rows = some_turns()
    turns_of(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    own = ordered(rows)
    convs = {c: own.get(c - abs(c) % 20 * (1 if c >= 0 else -1), [])[:h] + turns[h:] for c, turns in own.items() for h in [zlib.crc32(str(c).encode()) % 4]}
    assert any(not turns for turns in convs.values())
    found = prefix_trie.op13_conversation_trie(spark, str(tmp_path))
    assert sorted(map(tuple, found.select(*KEPT).collect()), key=str) == brute_trie(convs)
    frame = turns_of(spark, rows).select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    same(found.toPandas(), oracle(prefix_trie.ORACLE_SQL, conversations=frame))


def test_trie_query(spark, oracle, same, data):
    same(prefix_trie.op13_conversation_trie(spark, f"{data}/sf0.001").toPandas(), oracle(prefix_trie.ORACLE_SQL))


def test_dense_names_leave_no_gaps(spark):
    names, end = prefix_trie.dense_names(spark.range(0, 1000, 1, 7).selectExpr("id % 321 AS key", "id % 3 AS other"), 5)
    rows = names.collect()
    assert end == 5 + len(rows) and sorted(r.name for r in rows) == list(range(5, end))
    assert len({(r.key, r.other) for r in rows}) == len(rows) == 321
