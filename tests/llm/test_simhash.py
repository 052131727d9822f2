import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import xxhash

import __spark_entry__ as entry
from citeloom.llm import common, simhash
from tests.llm.cases import docs, odd_rows

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, threshold=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= threshold:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def plain(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    roots = plain_components({f for _, f in fps})
    least = defaultdict(list)
    for i, f in fps:
        least[roots[f]] += [i] if i is not None else []
    return sorted(((i, f"{f:016x}", min(least[roots[f]], default=None)) for i, f in fps), key=str)


def test_matches_brute_force_on_given_documents(spark):
    got = entry.queries()["op1_simhash"](spark, SF)
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(table)


def test_odd_rows(spark):
    rows = odd_rows()
    got = simhash.near_duplicates(docs(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain([(i, t) for i, t, _ in rows])
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(common, "PIECE", 50)
    assert simhash.fingerprint(text.encode()) == whole
    assert whole & (1 << 64) - 1 == plain_fingerprint(text)


def test_covering_radius_bounds_the_reach():
    fps = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 2000)
    _, _, home = simhash.anchors(fps, 0)
    assert home.sum() == len(fps)


def test_all_links_of_clusters_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOMES", 16)
    monkeypatch.setattr(simhash, "COPIES", 64)
    pick = random.Random(3)
    fps = {pick.getrandbits(64) for _ in range(200)}
    for _ in range(6):  # chains and a crowded group
        at = pick.getrandbits(64)
        for _ in range(40):
            for bit in pick.sample(range(64), pick.randint(1, 4)):
                at ^= 1 << bit
            fps.add(at)
    centre = pick.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in pick.sample(range(64), pick.randint(0, 3))) for _ in range(150)}
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in common.components(simhash.links(frame)).collect()}
    want = plain_components(signed)
    members = defaultdict(set)
    for f, r in want.items():
        members[r].add(f)
    assert {f: got.get(f, f) for f in signed} == {f: min(m) for m in members.values() for f in m}


def test_keep_first(spark):
    rows = odd_rows()
    kept = simhash.keep_first(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    gone = {i for i, _, c in plain([(i, t) for i, t, _ in rows]) if i is not None and i != c}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted(i for i, _, _ in rows if i and i not in gone)
