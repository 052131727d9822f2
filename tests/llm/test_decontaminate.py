import random
from collections import Counter

import numpy as np

import __spark_entry__ as entry
from citeloom.llm import decontaminate as d
from tests.llm.cases import docs, odd_rows, prose

SF = "/root/testdata/sf0.001"


def test_wand_finds_all_above_the_threshold():
    pick = random.Random(1)
    rows, items = [], {}
    for item in range(300):
        terms = pick.sample(range(60), pick.randint(2, 15))
        total = sum(1 + t % 7 for t in terms)
        rows += [(item, f"t{t:02d}", (1 + t % 7) / total) for t in terms]
        items[item] = ([], [])
    index = d.Index(rows, items)
    by_item = {}
    for item, term, impact in rows:
        by_item.setdefault(item, {})[index.terms[term]] = impact
    for _ in range(200):
        query = sorted(pick.sample(range(len(index.terms)), pick.randint(1, 25)))
        least = pick.choice([0.2, 0.5, 0.8])
        want = {i: round(sum(w.get(t, 0) for t in query), 9) for i, w in by_item.items()}
        assert {i: round(s, 9) for i, s in d.search(index, query, least)} == {i: s for i, s in want.items() if s >= least - 1e-9}


def test_no_passage_above_the_threshold_is_passed_over():
    pick = random.Random(3)
    vocabulary = [f"t{n}" for n in range(80)]
    shares, items = [], {}
    for item in range(40):
        terms = pick.sample(vocabulary, pick.randint(3, 12))
        total = sum(1 + int(t[1:]) % 7 for t in terms)
        shares += [(item, t, (1 + int(t[1:]) % 7) / total) for t in terms]
        items[item] = (terms, [])
    index = d.Index(shares, items)
    by_item = {}
    for item, term, impact in shares:
        by_item.setdefault(item, {})[term] = impact
    texts = [[pick.choice([*vocabulary, "none"]) for _ in range(pick.choice([0, 1, 5, 64, 65, 200]))] for _ in range(60)]
    ids = np.array([index.terms.get(w, len(index.postings)) for t in texts for w in t], np.int64)
    got = set(zip(*(x.tolist() for x in d.promising(index, ids, np.array([len(t) for t in texts]), d.SCORE))))
    step = index.passage // 2
    for n, t in enumerate(texts):
        for k, s in enumerate(range(0, max(1, len(t) - index.passage + step), step) if t else ()):
            have = set(t[s : s + index.passage])
            if any(sum(v for w, v in share.items() if w in have) >= d.SCORE for share in by_item.values()):
                assert (n, k) in got


def test_in_order_is_the_longest_common_subsequence():
    pick = random.Random(2)
    for _ in range(300):
        a, b = ([pick.choice("abcd") for _ in range(pick.randint(1, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert d.in_order(a, b) == best[-1][-1] / len(a)


def enough(q, a, n):
    """Question to 0.8; answer to 0.8, or all but one of its words."""
    return q >= d.OVERLAP and (a >= d.OVERLAP or n > 1 and round(a * n) == n - 1)


def plain(rows, items):
    """Every passage against every item, without an index."""
    parts = {i: (d.words(q), d.words(a)) for i, q, a in items}
    whole = {i: q + a for i, (q, a) in parts.items() if q + a}
    df, mean = Counter(t for w in whole.values() for t in set(w)), sum(map(len, whole.values())) / len(whole)
    import math

    share = {}
    for i, w in whole.items():
        tf = Counter(w)
        raw = {t: math.log(1 + (len(whole) - df[t] + 0.5) / (df[t] + 0.5)) * n * (d.K1 + 1) / (n + d.K1 * (1 - d.B + d.B * len(w) / mean)) for t, n in tf.items()}
        share[i] = {t: v / sum(raw.values()) for t, v in raw.items()}
    size = max(d.PASSAGE, 2 * max(map(len, whole.values())))
    step, found = size // 2, set()
    for doc, text in rows:
        w = d.words(text)
        for s in range(0, max(1, len(w) - size + step), step) if w else ():
            have = set(w[s : s + size])
            for i, weights in share.items():
                if sum(v for t, v in weights.items() if t in have) >= d.SCORE - 1e-9 and enough(*d.verify(*parts[i], w[max(0, s - step) : s + size + step]), len(parts[i][1])):
                    found.add((doc, i))
    return found


def test_matches_brute_force_on_given_tables(spark):
    got = {(r.doc_id, r.item_id) for r in entry.queries()["op4_decontaminate"](spark, SF).collect()}
    items = d.split_items(spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == plain(rows, items) and got


def test_edits_are_caught_and_clean_texts_are_not(spark, monkeypatch):
    monkeypatch.setattr(d, "ITEMS", 3)  # several passes
    pick = random.Random(4)
    vocabulary = ["the", "of", "and", "to", "in"] + [f"w{n}" for n in range(400)]
    items = [(i, prose(100 + i, 25, vocabulary) + "?", prose(200 + i, 4, vocabulary) if i % 2 else None) for i in range(8)]
    rows = [(1, prose(5, 500, vocabulary)), (2, None), (3, "")]
    for i, q, a in items:
        w = f"{q} {a or ''}".split()
        w[pick.randrange(len(w))] = "changed"
        rows.append((10 + i, " ".join(prose(20 + i, 300, vocabulary).split()[: i * 40] + [x.upper() + "," for x in w] + prose(40 + i, 100, vocabulary).split())))
    rows.append((None, items[0][1]))
    frame = docs(spark, [(i, t, "a") for i, t in rows])
    table = spark.createDataFrame([*items, (None, "a b", "c"), (99, None, None), items[1]], "item_id long, question string, answer string")
    got = {(r.doc_id, r.item_id) for r in d.contaminated(frame, table).collect()}
    assert {(10 + i, i) for i, *_ in items} | {(None, 0)} == got
    kept = d.clean(frame, table)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


def test_odd_rows_and_empty_tables(spark):
    frame = docs(spark, odd_rows())
    none = spark.createDataFrame([], "item_id long, question string, answer string")
    assert d.contaminated(frame, none).collect() == []
    one = spark.createDataFrame([(1, odd_rows()[0][1], None)], none.schema)
    assert {r.doc_id for r in d.contaminated(frame, one).collect()} >= {1, 2, 3, 13, None}
    assert d.contaminated(docs(spark, []), one).collect() == []


def test_split_items(spark):
    rows = [(1, "One two. Three four? Five\nsix."), (2, "no end"), (3, None)]
    got = d.split_items(spark.createDataFrame(rows, "item_id long, text string")).orderBy("item_id").collect()
    assert [tuple(r) for r in got] == [(1, "One two. Three four? Five\nsix.", None), (2, "no end", None), (3, None, None)]


def test_copies_that_differ_or_stop_at_the_last_sentence(spark):
    vocabulary = [f"w{n}" for n in range(400)]
    item = prose(1, 21, vocabulary) + ". The Alder."
    lead = prose(2, 80, vocabulary)
    rows = [(1, f"{lead} {item}"), (2, f"{lead} {item}".replace("Alder", "Elder")), (3, f"{lead} {item}".replace(" The Alder.", "")), (4, lead), (5, "The Alder.")]
    one = d.split_items(spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {r.doc_id for r in d.contaminated(docs(spark, [(i, t, "a") for i, t in rows]), one).collect()} == {1, 2, 3}


def test_a_short_answer_may_miss_one_word(spark):
    vocabulary = [f"w{n}" for n in range(400)]
    question = prose(3, 20, vocabulary)
    items = spark.createDataFrame([(1, question, "red oak tree"), (2, prose(4, 20, vocabulary), "oak")], "item_id long, question string, answer string")
    second = prose(4, 20, vocabulary)
    rows = [(1, f"{question} red elm tree"), (2, f"{question} blue elm tree"), (3, f"{second} oak"), (4, f"{second} elm")]
    got = {(r.doc_id, r.item_id) for r in d.contaminated(docs(spark, [(i, t, "a") for i, t in rows]), items).collect()}
    assert got == {(1, 1), (3, 2)}
