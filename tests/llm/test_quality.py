import zlib

import numpy as np

import __spark_entry__ as entry
from citeloom.llm import quality as q
from tests.llm.cases import docs, odd_rows

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    n = label.sum()
    return (order[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_held_out_accuracy_on_given_documents(spark):
    got = entry.queries()["op6_quality"](spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == 1000
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[r.doc_id].held_out]
    score, label = np.array([rows[r.doc_id].score for r in labels]), np.array([r.quality for r in labels])
    assert auc(score, label) > 0.95
    assert ((score >= 0.7) == label).mean() > 0.9


def test_held_out_labels_are_not_learnt(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    score = lambda x: {r.doc_id: r.score for r in q.scored(table, x).collect()}
    assert score(labels) == score(turned)


def test_trees_in_arrays_match_a_walk_by_hand():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = q.grow(x, y)
    assert auc(trees.score(x), y) > 0.98
    for row, score in zip(x[:50], trees.score(x[:50])):
        margin = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            margin += leaf[node - len(feature)]
        assert abs(score - 1 / (1 + np.exp(-margin))) < 1e-12


def test_statistics_by_hand():
    named = dict(zip(q.FEATURES, q.statistics("AB ab ab!\n\nab ab | x1".encode())))
    assert np.isclose(named["log_words"], np.log1p(7)) and np.isclose(named["distinct_words"], 5 / 7)
    assert named["top_word"] == 3 / 7 and named["bars"] == 1 / 7 and named["ended_lines"] == 0.5
    assert named["upper"] == 2 / len("AB ab ab!\n\nab ab | x1")
    for empty in (None, b"", b" \n"):
        assert q.statistics(empty) == [0.0] * len(q.FEATURES)


def test_odd_rows_and_labels(spark):
    frame = docs(spark, odd_rows())
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = q.scored(frame, empty).collect()
    assert len(got) == len(odd_rows()) and {r.score for r in got} == {0.5}
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 1), (77, 0, 0), (3, 1, 0), (3, 1, 0)], empty.schema)
    got = q.scored(frame, odd).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert q.scored(docs(spark, []), odd).collect() == []
    kept = q.accepted(frame, spark.createDataFrame([(1, 1, 0), (3, 1, 0), (5, 1, 0)], empty.schema))
    assert kept.columns == frame.columns and kept.count() == len(odd_rows())
