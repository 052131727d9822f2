import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from citeloom.llm import lexical_search as ls
from tests.llm.cases import docs, odd_rows, prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, items, k=50):
    """The contract in plain Python: every document scored for every item, term by term."""
    found = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    total, words = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    w = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        asked, scored = set(TERM.findall((text or "").translate(LOWER))), []
        for doc, c, n in found:
            m = 100 - 50 + (50 * n * total) // words
            score = sum(w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda r: r[:2])


def got(spark, rows, items, k=50):
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, rank string, score int")
    return sorted((tuple(r) for r in ls.ranked(docs(spark, [(i, t, "s") for i, t in rows]), asked, k).collect()), key=lambda r: r[:2])


ITEMS = [(0, "The ther ring"), (1, "ONES oner at; reat the"), (2, "the of and"), (3, "and of the"), (4, "Ünï cödé 😀 nowhere"), (5, ""), (6, None), (8, "zz nowhere"), (9, "rating the of and one two")]


@pytest.mark.parametrize("items_a_block", [2000, 3])
def test_against_plain_python(spark, monkeypatch, items_a_block):
    monkeypatch.setattr(ls, "ITEMS", items_a_block)
    rows = [(i, t) for i, t, _ in odd_rows()] + [(100 + i, prose(i, 5 + i % 40)) for i in range(150)]
    rows += [(400 + i, prose(7, 30)) for i in range(80)]  # a group of copies: ties beyond the 50 that fit
    assert got(spark, rows, ITEMS) == plain(rows, ITEMS)


def test_odd_items_and_empty_tables(spark):
    rows = [(1, "one two"), (2, None), (2, "two\x00three_four"), (3, "")]
    assert got(spark, rows, [(1, "TWO four"), (1, "One"), (None, "two")]) == plain(rows, [(1, "One")])
    assert got(spark, [], ITEMS) == [] and got(spark, rows, []) == [] and got(spark, [(1, None), (2, " ")], ITEMS) == []


def test_few_best_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(ls, "HELD", 1 << 14)
    rows = [(i, prose(i, 200)) for i in range(60)]
    assert got(spark, rows, ITEMS, 3) == plain(rows, ITEMS, 3)


def test_split_in_pieces(monkeypatch):
    text = "Aé b-C " * 500 + "x" * 3000 + " end"
    whole = [t for t in TERM.findall(text.translate(LOWER))]
    monkeypatch.setattr(ls, "PIECE", 100)
    parts = list(ls.split(text.encode()))
    assert [t.decode() for p in parts for t in p] == whole and len(parts) > 20
    for c in range(0x80):
        assert ls.terms("a" + chr(c) + "a") == [t.encode() for t in TERM.findall(("a" + chr(c) + "a").translate(LOWER))]


def test_plan_shares_sums():
    pick = random.Random(3)
    common = [set(range(10)), set(range(5, 15)), {20, 21, 22, 23}]
    items = [set().union(*(c for c in common if pick.random() < 0.6), {pick.randrange(30, 60) for _ in range(4)}) for _ in range(40)] + [set(), {1}, {1}]
    plan = ls.Plan(items, 60)
    leaf = np.random.default_rng(1).integers(0, 1000, (60, 7))
    assert (plan.scores(leaf) == np.array([leaf[sorted(i)].sum(0) for i in items])).all()
    sets = [{n} for n in range(60)]
    for parts in plan.made:  # sums of disjoint sets, made of earlier nodes alone
        assert all(p < len(sets) for p in parts) and sum(len(sets[p]) for p in parts) == len(set().union(*(sets[p] for p in parts)))
        sets.append(set().union(*(sets[p] for p in parts)))
    assert plan.additions() < sum(len(i) - 1 for i in items if i) / 2


def test_best_takes_lower_ids_among_ties():
    best = ls._Best(1, 3)
    for at in range(0, 100, 10):
        best.add(np.array([[5] * 10]), [99 - at - n for n in range(10)])
    assert [d for _, _, d in sorted(best.rows[0])[:3]] == [0, 1, 2]
