import random

import numpy as np
from pyspark.sql import functions as F

from citeloom.operators import matching, retrieval, vector_search

CHUNKS = (
    "chunk_id string, workspace_id string, document_id string, chunk_index int, text string, page_start int, page_end int, "
    "section_title string, snippet string, embedding array<float>"
)


def test_substring_pairs_both_ways(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    # one owner holds most rows, and one text repeats
    texts = [("hot" if i % 3 else "w", f"t{i}", word(12) if i % 4 else "aaaaaaaa") for i in range(120)]
    terms = [("hot" if i % 2 else "w", word(1 + i % 5)) for i in range(40)]
    a = spark.createDataFrame(texts, "w string, id string, body string")
    b = spark.createDataFrame(terms, "w string, term string")
    expected = sorted({(w, i, t) for w, i, body in texts for v, t in terms if v == w and t in body})
    for limit in (1000, 0):
        got = matching.substring_pairs(a, b, "id", "body", "term", ["w"], broadcast_rows=limit)
        assert sorted(map(tuple, got.collect())) == expected


def test_terms_that_no_text_can_hold_find_no_candidates(spark, monkeypatch):
    """Names that share most short substrings: only those whose substrings all occur are looked up."""
    names = [f"Customer#{i:09d}" for i in range(1000, 3000)]
    texts = [(f"t{i}", f"about Customer#{i:09d} and more") for i in (1000, 1234, 2999)]
    a, b = spark.createDataFrame(texts, "id string, body string"), spark.createDataFrame([(n,) for n in names], "term string")
    kept, staged = [], matching.staged
    monkeypatch.setattr(matching, "staged", lambda rows: kept.append(staged(rows)) or kept[-1])
    for limit in (100_000, 1):
        got = matching.substring_pairs(a, b, "id", "body", "term", [], broadcast_rows=limit)
        assert sorted(map(tuple, got.collect())) == sorted((i, body[6:24]) for i, body in texts)
        assert kept[-1].count() == 3  # the keys that are looked up


def _vectors(spark, n, ties=True):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        v = rng.normal(size=8) if not ties or i % 5 else np.ones(8)
        rows.append(("hot" if i % 3 else "w", f"c{i}", [float(x) for x in v] if i % 11 else [0.0] * 8))
    return rows


def test_vector_topk_paths(spark, monkeypatch):
    rows = _vectors(spark, 150)
    items = spark.createDataFrame(rows, "workspace_id string, chunk_id string, embedding array<float>")
    queries = items.select("workspace_id", F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    def cos(a, b):
        a, b = np.float32(a).astype(float), np.float32(b).astype(float)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(a @ b / n), 9) if n else 0.0

    expected = []
    for w, q, v in rows:
        ranked = sorted(((-cos(v, u), c) for x, c, u in rows if x == w))[:7]
        expected += [(q, c, n + 1) for n, (_, c) in enumerate(ranked)]
    direct = vector_search.vector_topk(queries, items, 7)
    assert sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in direct.collect()) == sorted(expected)
    monkeypatch.setattr(vector_search, "ITEM_BLOCK", 16)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 10)
    blocked = vector_search.vector_topk(queries, items, 7, broadcast_bytes=0)
    assert sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in blocked.collect()) == sorted(expected)


def test_tiles_of_one_block(monkeypatch):
    rng = np.random.default_rng(5)
    items, queries = rng.integers(-2, 3, (300, 4)).astype(float), rng.integers(-2, 3, (20, 4)).astype(float)
    items[::3] = 0
    ids = np.array([f"c{i * 7919 % 1000}" for i in range(300)], dtype=object)
    monkeypatch.setattr(vector_search, "ITEM_BLOCK", 16)
    found = vector_search._best(queries, np.arange(20), items, ids, 5)
    expected = [(q, c, -s) for q in range(20) for s, c in sorted((-float(queries[q] @ v), c) for v, c in zip(items, ids))[:5]]
    assert [tuple(r) for r in found.itertuples(index=False)] == expected


def test_blocks_take_no_more_zero_vectors_than_can_rank(spark, monkeypatch):
    rows = [("w", f"c{i:04d}", None if i % 4 == 1 else [0.0] * 4 if i % 4 else [1.0, float(i), -3.0, 2.0]) for i in range(400)]
    items = spark.createDataFrame(rows, ITEM)
    sizes, blocks_of = [], vector_search._blocks_of
    monkeypatch.setattr(vector_search, "_blocks_of", lambda rows, *a: sizes.append(rows.count()) or blocks_of(rows, *a))
    asked = _asked(items).limit(40)
    whole, blocked = (_rows(vector_search.vector_topk(asked, items, 5, broadcast_bytes=n)) for n in (1 << 20, 0))
    assert whole == blocked and len(whole) == 200
    assert sizes == [105, 40]


ITEM = "workspace_id string, chunk_id string, embedding array<float>"


def _asked(items):
    return items.select("workspace_id", F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def _rows(hits):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 7)) for r in hits.collect())


def test_ivf_recall(spark):
    items = spark.createDataFrame(_vectors(spark, 200, ties=False), ITEM)
    queries = _asked(items)
    centres = vector_search.ivf_fit(items, lists=8)
    assigned = vector_search.ivf_assign(items, centres)
    exact = {(r["query_id"], r["chunk_id"]) for r in vector_search.vector_topk(queries, items, 5).collect()}
    full = {(r["query_id"], r["chunk_id"]) for r in vector_search.ivf_topk(queries, assigned, centres, 5, nprobe=8).collect()}
    assert full == exact
    some = {(r["query_id"], r["chunk_id"]) for r in vector_search.ivf_topk(queries, assigned, centres, 5, nprobe=4).collect()}
    assert len(some & exact) / len(exact) > 0.6
    assert _rows(vector_search.ivf_search(queries, assigned, centres, 5, first=20)) == _rows(vector_search.vector_topk(queries, items, 5))


def test_ivf_search_stops_early_and_is_exact(spark, monkeypatch):
    """Tight clusters: the bounds settle every query long before all vectors are read."""
    import numpy as np

    draw = np.random.default_rng(5)
    middles = draw.normal(size=(12, 16))
    rows = [("a" if n % 3 else "b", f"i{n:04d}", (middles[n % 12] + 0.05 * draw.normal(size=16)).tolist()) for n in range(600)]
    items = spark.createDataFrame(rows, ITEM)
    queries = _asked(items.where("chunk_id < 'i0060'"))
    centres = vector_search.ivf_fit(items, lists=12)
    assigned = vector_search.ivf_assign(items, centres)
    compared, measured = [], vector_search.vector_topk

    def counted(probes, cells, k, key):
        compared.append(probes.join(cells, key).count())
        return measured(probes, cells, k, key)

    monkeypatch.setattr(vector_search, "vector_topk", counted)
    got = _rows(vector_search.ivf_search(queries, assigned, centres, 3, first=1))
    assert got == _rows(measured(queries, items, 3))
    assert sum(compared) < 60 * 600 / 3


def test_ivf_search_takes_null_zero_and_short_vectors(spark):
    rows = [("a", f"i{n}", v) for n, v in enumerate([[1.0, 0.0], [0.0, 2.0], [1.0, 1.0], None, [0.0, 0.0], [], [3.0], [1.0, 0.0], [-1.0, 0.2]])]
    items = spark.createDataFrame(rows, ITEM)
    centres = vector_search.ivf_fit(items, lists=2)
    assigned = vector_search.ivf_assign(items, centres)
    for k in (1, 3, 20):
        assert _rows(vector_search.ivf_search(_asked(items), assigned, centres, k, first=1)) == _rows(vector_search.vector_topk(_asked(items), items, k))
    none = items.limit(0)
    empty = vector_search.ivf_fit(none, lists=2)
    assert vector_search.ivf_search(_asked(items), vector_search.ivf_assign(none, empty), empty, 2).count() == 0
    blank = items.where("embedding is null")
    assert _rows(vector_search.ivf_search(_asked(items), vector_search.ivf_assign(blank, empty), empty, 2)) == _rows(vector_search.vector_topk(_asked(items), blank, 2))


def naive_density(words, terms):
    """Minimal intervals by trying every start and end."""
    spots = [i for i, w in enumerate(words) if w in terms]
    found = []
    for s in spots:
        for e in spots:
            if e >= s and set(terms) <= set(words[s : e + 1]):
                found.append((s, e))
    minimal = [(s, e) for s, e in found if not any((a, b) != (s, e) and a >= s and b <= e for a, b in found)]
    return sum(0.1 / (1 + sum(w not in terms for w in words[s : e + 1])) for s, e in minimal)


def test_keyword_search_paths(spark):
    rng = random.Random(8)
    vocabulary = ["the", "the", "the", "of", "alpha", "beta", "日本"]
    chunks = [("c%d" % i, "hot" if i % 3 else "w", [rng.choice(vocabulary) for _ in range(rng.randint(1, 14))]) for i in range(80)]
    queries = [("q%d" % i, rng.choice(["hot", "w"]), " ".join(rng.sample(["The", "of", "alpha", "beta", "日本", "absent"], 1 + i % 3))) for i in range(30)]
    a = spark.createDataFrame([(c, w, " ".join(t)) for c, w, t in chunks], "chunk_id string, workspace_id string, text string")
    b = spark.createDataFrame(queries, "query_id string, workspace_id string, query_text string")
    expected = {}
    for q, w, body in queries:
        terms = set(body.lower().split())
        for c, v, words in chunks:
            if v == w and terms <= set(words):
                expected[q, c] = round(naive_density(words, terms), 6)
    index = retrieval.term_index(a)
    for options in ({}, {"index": index}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "index": index}):
        got = {(r["query_id"], r["chunk_id"]): round(r["score"], 6) for r in retrieval.keyword_match(b, a, **options).collect()}
        assert got == expected
    top = retrieval.keyword_topk(b, a, 2).collect()
    assert max(r["rank"] for r in top) <= 2


def test_one_term_is_scored_by_its_places(spark):
    rows = [(["a"], "a b a c a"), (["a"], "b a"), (["b"], "b"), (["a", "b"], "a b a"), (["日"], "日 " * 12)]
    frame = spark.createDataFrame([(t, body.split()) for t, body in rows], "terms array<string>, words array<string>")
    plan = frame.select(retrieval._cover_density(F.col("words"), F.col("terms")).alias("d"))
    assert [round(r["d"], 9) for r in plan.collect()] == [round(naive_density(body.split(), set(t)), 9) for t, body in rows]


def test_alignment_bonus(spark):
    rows = [
        ("会計手順について", "会計手順.pdf", None, "x", 0.18),
        ("会計手順について", "勤務表.pdf", None, "x", 0.0),
        ("会計", "会計.pdf", "会計の部", "会計", 0.3),
        ("手順", "手順.pdf", None, "手順", 0.0),
        ("", "a.pdf", None, "", 0.0),
    ]
    frame = spark.createDataFrame([r[:4] for r in rows], "q string, f string, s string, n string")
    bonus = retrieval.alignment_bonus(F.col("q"), F.col("f"), F.col("s"), F.col("n"))
    assert [round(r["b"], 6) for r in frame.select(bonus.alias("b")).collect()] == [r[4] for r in rows]


def test_fusion_rules(spark):
    rows = [
        ("q", "a", -0.5, 2, "vector"),
        ("q", "b", 0.5, 1, "vector"),
        ("q", "b", 4.0, 1, "keyword"),
        ("q", "c", 1.0, 1, "title"),
        ("q", "a", 1.0, 2, "title"),
    ]
    fused = retrieval.fuse(spark.createDataFrame(rows, "query_id string, chunk_id string, score double, rank int, source string"))
    got = {r["chunk_id"]: (r["score"], r["raw_score"], r["source_order"], r["source_rank"]) for r in fused.collect()}
    assert got == {"a": (1.0, 1.0, 0, 2), "b": (1.0, 1.0, 0, 1), "c": (1.0, 1.0, 2, 1)}


def test_hybrid_retrieve_small(spark):
    docs = spark.createDataFrame(
        [
            ("d1", "w", "会計手順.pdf", "application/pdf", "k1", "ready"),
            ("d2", "w", "勤務表.pdf", "application/pdf", "k2", "ready"),
            ("d3", "w", "会計.pdf", "application/pdf", "k3", "failed"),
            ("d4", "v", "会計.pdf", "application/pdf", "k4", "ready"),
        ],
        "document_id string, workspace_id string, file_name string, mime_type string, storage_key string, status string",
    )
    chunks = spark.createDataFrame(
        [
            (f"{d}:0", w, d, 0, body, 1, 1, None, body, [1.0, float(n)])
            for n, (d, w, body) in enumerate([("d1", "w", "締め処理 を 行う"), ("d2", "w", "会計 担当 の 表"), ("d3", "w", "会計"), ("d4", "v", "会計")])
        ],
        CHUNKS,
    )
    queries = spark.createDataFrame([("q", "w", "会計", [1.0, 0.0])], "query_id string, workspace_id string, query_text string, query_vec array<float>")
    got = retrieval.hybrid_retrieve(queries, chunks, docs).orderBy("rank").collect()
    # d1: vector and title 1.0, query inside the title: hit .06 and title .18; d2: keyword 1.0, hit in the snippet
    assert [(r["chunk_id"], r["score"], r["ref"]) for r in got] == [("d1:0", 1.24, "p.1"), ("d2:0", 1.06, "p.1")]


def test_postings_are_written_where_they_are_made(spark, tmp_path):
    from citeloom.sources import tables

    rows = spark.range(0, 300, 1, 3).selectExpr("'w' as workspace_id", "concat('c', 299 - id) as chunk_id", "'a' as term", "1 as pos")
    tables.write_postings(rows, str(tmp_path / "p"))
    files = list((tmp_path / "p").glob("bucket=*/*.parquet"))
    assert len(files) == 3 and len({f.parent for f in files}) == 1
    found = tables.read_postings(spark, str(tmp_path / "p"), rows.select("term").distinct())
    assert sorted(map(tuple, found.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
