"""URL filters, archives, nearest neighbours and the pipeline."""

import gzip

import numpy as np
import pandas as pd
import pytest

from sparktree.llm import multi_index, url_filters, warc

PAGES = "page_id long, url string, html string, host string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "extra", "extra") for i, u, h in rows], PAGES)


def rules(spark, rows=None):
    return spark.createDataFrame(rows or url_filters.RULES, "host string, path string, verdict string")


URLS = [
    (1, "https://WWW.Example.com/en/x", None), (2, "http://example.com/en/", None), (3, "http://a.b.example.com/en/q?x=/fr/", None),
    (4, "http://notexample.com/en/", None), (5, "ftp://x.net/es/1#t", None), (6, "http://net/fr/", None), (7, "http://x.net/esp/", None),
    (8, None, None), (9, "no scheme", None), (10, "", None), (11, "http://", None), (12, "http://com", None), (13, "http://com?/", None),
    (14, "http://a.com/" + "x" * 20_000, None), (15, "http://" + "a." * 5_000 + "com/", None), (2, "http://example.com/en/", None), (None, "http://x.net/fr/", None), (16, "x://é.com/É/", None),
]


@pytest.mark.parametrize("limit", [0, 1000])
def test_urls_equal_sql(spark, oracle, same, monkeypatch, limit):
    monkeypatch.setattr(url_filters, "BROADCAST_ROWS", limit)
    df = pages(spark, URLS)
    found = url_filters.judge_urls(df, rules(spark)).toPandas()
    same(found, oracle(url_filters.ORACLE_SQL, pages=df.select("page_id", "url").toPandas()))


def test_url_query(spark, oracle, same, data):
    same(url_filters.op2_url_filters(spark, f"{data}/sf0.001").toPandas(), oracle(url_filters.ORACLE_SQL))


def test_urls_precedence_and_empty(spark):
    own = [("a.com", "/x", "allow"), ("a.com", "/x", "block"), ("com", "", "block"), (None, "/", "block"), ("a.com", None, "block")]
    df = pages(spark, [(1, "http://a.com/xy", None), (2, "http://b.com", None)])
    found = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge_urls(df, rules(spark, own)).collect()}
    assert found == {1: ("a.com/x", "block"), 2: ("com", "block")}
    assert url_filters.judge_urls(df, rules(spark).limit(0)).toPandas().rule.isna().all()
    assert url_filters.judge_urls(pages(spark, []), rules(spark)).count() == 0


BIG = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 60


def archived(spark, tmp_path, rows, name):
    df = pages(spark, rows)
    warc.write_archives(df, f"file://{tmp_path}/{name}")
    return df, warc.read_archives(spark, f"file://{tmp_path}/{name}").toPandas(), warc.resolved(spark, f"file://{tmp_path}/{name}").toPandas()


@pytest.mark.parametrize("limit", [0, 1000])
def test_archives(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", limit)
    rows = [(i, f"http://h/{i}", BIG) for i in range(30)] + [(40, "u\r\nX: y", "small"), (41, None, "small"), (42, "u", None), (43, "u", ""), (None, "u", BIG), (29, "again", BIG), (50, "u", "x" * 300_000)]
    df, records, full = archived(spark, tmp_path, rows, "a")
    assert len(records) == len(rows)
    held = records[records.type == "response"]
    assert sorted(held.payload) == sorted([BIG.encode()] * 2 + [b"small"] * 2 + [b""] * 2 + [b"x" * 300_000])
    assert (held.payload_digest == held.stated_digest).all()
    revisits = full[full.type == "revisit"]
    assert len(revisits) == 30 and set(revisits.payload_bytes) == {len(BIG.encode())} and revisits.payload_digest.nunique() == 1
    assert set(records[records.type == "revisit"].refers_to) == set(held[held.payload == BIG.encode()].record_id)
    assert not any("\n" in u for u in records.uri)


def test_archive_query_with_copies(spark, oracle, same, data, tmp_path):
    one = spark.read.parquet(f"{data}/sf0.001/pages.parquet").toPandas()
    twice = pd.concat([one, one.head(10).assign(page_id=lambda f: f.page_id + 10_000), one.head(3).assign(page_id=lambda f: f.page_id + 20_000)])
    spark.createDataFrame(twice).write.parquet(f"{tmp_path}/pages.parquet")
    found = warc.op10_warc(spark, str(tmp_path)).toPandas()
    assert (found.record_type == "revisit").sum() == 13 or (found.payload_bytes < 1000).any()
    same(found, oracle(warc.ORACLE_SQL, pages=twice))


def test_empty_archive(spark, tmp_path):
    _, records, full = archived(spark, tmp_path, [], "e")
    assert not len(records) and not len(full)


def test_damaged_archive():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse(gzip.decompress(gzip.compress(good * 2)))] == [b"abc"] * 2
    with pytest.raises(ValueError):
        list(warc.parse(good.replace(b": 3", b": 2")))


def test_foreign_archives(spark, tmp_path):
    """Records without digests, with other spellings, folded lines and blocks that are not HTTP."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\ncontent-length:5\r\n\r\na: b\n\r\n\r\n"
    page = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <x>\r\nX-Long: a\r\n b\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhi\r\n\r\n"
    (tmp_path / "f.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(page))
    found = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert [(r.type, r.record_id, bytes(r.payload), r.stated_digest) for r in found] == [("warcinfo", None, b"a: b\n", None), ("response", "<x>", b"hi", None)]
    for damaged in (page[:60], page[:-8], b"WARC/1.0\r\nA: b\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(damaged))


VECTORS = "vec_id long, embedding array<float>, label int, vector string, cell int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 1) for i, v in rows], VECTORS)


def brute(rows, asked, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in asked:
        at = int(np.flatnonzero(ids == q)[0])
        score = (x * x[at]).sum(axis=1) / (norm * norm[at])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_neighbours_recall(spark, data):
    df = spark.read.parquet(f"{data}/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    found = multi_index.nearest(df, df.where("vec_id % 5 = 0")).toPandas()
    want = brute(rows, [i for i, _ in rows if i % 5 == 0], 5)
    got = found.groupby("query_id").vec_id.apply(set)
    assert np.mean([len(got[q] & {i for i, _ in best}) / 5 for q, best in want.items()]) >= 0.9
    assert (found.groupby("query_id")["rank"].apply(sorted).apply(list) == pd.Series({q: [1, 2, 3, 4, 5] for q in want})).all()
    exact = {(q, i): s for q, best in want.items() for i, s in best}
    for r in found.itertuples():
        if (r.query_id, r.vec_id) in exact:
            assert abs(r.score - exact[r.query_id, r.vec_id]) < 1e-12


def test_neighbours_odd_rows(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    same_way = [(i, [1.0, 2.0, 0.5, 0.0]) for i in range(20)]
    bad = [(100, None), (101, [0.0] * 4), (102, [1.0, None, 1.0, 1.0]), (103, [nan, 1.0, 1.0, 1.0]), (104, [inf, 1.0, 1.0, 1.0]), (105, []), (106, [1.0]), (None, [1.0] * 4)]
    monkeypatch.setattr(multi_index, "BLOCK", 7)
    df = vectors(spark, same_way + bad + [(3, [1.0, 2.0, 0.5, 0.0]), (50, [-1.0, -2.0, 0.0, 0.0])])
    found = multi_index.nearest(df, df.where("vec_id IN (0, 10, 50, 101)")).toPandas()
    assert found.groupby("query_id").vec_id.apply(list).to_dict() == {0: [1, 2, 3, 4, 5], 10: [0, 1, 2, 3, 4], 50: [0, 1, 2, 3, 4]}
    few = vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])
    assert multi_index.nearest(few, few.where("vec_id = 0")).orderBy("rank").toPandas().vec_id.tolist() == [2, 1]
    assert multi_index.nearest(few.limit(0), few).count() == 0 and multi_index.nearest(few, few.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 5, 9, 40, 60, 128])
def test_index_returns_all_codes_within_the_radius(radius):
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 2**63, (2000, 2)).astype(np.uint64)
    near = codes[0] ^ np.array([0b1011, 1 << 40], np.uint64)
    index = multi_index.Index(np.vstack([codes, near]), radius)
    assert index.within(codes[0]).tolist() == np.flatnonzero(multi_index.hamming(index.codes, codes[0]) <= radius).tolist()
    if radius <= 40:
        assert len(index.retrieved(codes[0])) < 0.05 * len(index.codes)


def test_neighbours_of_equal_ids_and_other_lengths(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.1, 1.0]), (3, [1.0, 0.2]), (3, [-1.0, 0.0]), (4, [1.0, 1.0, 1.0]), (5, [1.0, 1.0, 0.9]), (3, [1.0, 0.2])]
    df = vectors(spark, rows)
    found = multi_index.nearest(df, df.where("vec_id IN (1, 4)")).toPandas().sort_values(["query_id", "rank"])
    assert [(int(r.query_id), int(r.vec_id)) for r in found.itertuples()] == [(1, 2), (1, 3), (4, 5)]
    assert abs(found.score.iloc[0] - 1 / np.sqrt(1.01)) < 1e-6


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, f"{data}/sf0.001").toPandas()
    assert set(out.doc_id) <= {r.doc_id for r in docs.select("doc_id").collect()}
    sizes = out.groupby("sequence_id").length.sum()
    assert (sizes <= 2048).all() and len(set(out.doc_id)) > 0.5 * docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, f"{data}/sf0.001")
        assert left.columns == docs.columns and left.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), f"{data}/sf0.001").count() == 0, name
