import random
from itertools import combinations

import corpus_pipeline
from citeloom.llm import near_copies, simhash
from tests.llm.cases import docs, odd_rows


def five(text):
    words = (text or "").lower().encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def plain(rows):
    sets = {i: five(t) for i, t, _ in rows}
    root = {i: i for i in sets}
    for a, b in combinations(sets, 2):
        if alike(sets[a], sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return {(i, r) for i, r in root.items()}


def edited_rows(seed, n):
    pick, rows = random.Random(seed), []
    word = lambda: f"w{pick.randrange(10**6)}"
    for i in range(n):
        text = [word() for _ in range(pick.choice((20, 100, 300)))]
        rows.append((10 * i, " ".join(text), "a"))
        for k in range(1, 4):
            for _ in range(pick.randint(1, 1 + len(text) // 60)):
                text[pick.randrange(len(text))] = word()
            rows.append((10 * i + k, " ".join(text), "b"))
    return rows


def test_matches_brute_force(spark, monkeypatch):
    rows = edited_rows(3, 40)
    expected = plain(rows)
    assert {tuple(r) for r in near_copies.near_copies(docs(spark, rows)).collect()} == expected
    assert len({r for _, r in expected}) < len(rows)
    monkeypatch.setattr(near_copies, "BLOCK", 2)  # groups of several blocks
    assert {tuple(r) for r in near_copies.near_copies(docs(spark, rows)).collect()} == expected


def test_stage_drops_edited_copies(spark):
    """One changed word of a hundred: five-word similarity 0.9, but seldom within three bits of SimHash."""
    pick, rows = random.Random(4), []
    for i in range(30):
        text = [f"w{pick.randrange(10**6)}" for _ in range(100)]
        rows.append((i, " ".join(text), "a"))
        rows.append((100 + i, " ".join(text[:50] + ["new"] + text[51:]), "a"))
        rows.append((200 + i, " ".join(text[:40] + ["new"] * 20 + text[60:]), "a"))
    out = corpus_pipeline.one_of_near_copies(spark, docs(spark, rows), "")
    assert {r.doc_id for r in out.collect()} == {i + k for i in range(30) for k in (0, 200)}


def test_simhash_finds_candidates(spark):
    """Pairs within three bits of SimHash are compared and linked even where no band is shared."""
    pick, texts, expected = random.Random(5), [], set()
    for _ in range(30):
        words = [f"w{pick.randrange(10**6)}" for _ in range(600)]
        pair = [" ".join(words), " ".join(words[:300] + ["new"] + words[301:])]
        sets = [near_copies.shingles(x.encode()) for x in pair]
        if ((simhash.of_set(sets[0]) ^ simhash.of_set(sets[1])) % 2**64).bit_count() <= simhash.THRESHOLD:
            expected.add(frozenset(near_copies.node(s) for s in sets))
        texts += pair
    assert 10 < len(expected) <= 30
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").selectExpr("doc_id", "cast(text as binary) text", "0L h")
    marked = frame.mapInArrow(near_copies._marked, "doc_id long, h long, node long, fp long, bands array<long>")
    alone = near_copies.staged(marked.selectExpr("doc_id", "h", "node", "fp", "array(node) bands"))
    assert {frozenset(r) for r in near_copies.links(frame, alone).collect()} == expected


def test_odd_rows(spark):
    frame = docs(spark, odd_rows())
    found = near_copies.near_copies(frame).collect()
    assert len(found) == frame.count()
    roots = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    assert roots == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 9, 10: 9, 11: 11, 12: 12, 13: 1, 14: 14}
    assert {r.component_id for r in found if r.doc_id is None} == {1, 4}
    kept = near_copies.keep_first(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 7, 8, 9, 11, 11, 12, 14]
    assert near_copies.near_copies(docs(spark, [])).collect() == []
