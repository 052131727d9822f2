import random

import pytest
from pyspark.sql import functions as F

from citeloom.llm import common, decontaminate, line_dedup, mixing, near_copies, quality, simhash
from tests.llm.cases import prose

CLASH = "doc_id long, text string, source string, _id long, _gone string, _good int, _bad int, _words long, _size int, row string, id int, h int, gone int, of int, u int, words int, times int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, s, *range(1, 15)) for i, t, s in rows], CLASH.replace("_gone string", "_gone long").replace("row string", "row long"))


def test_columns_of_any_name_stay(spark):
    rows = [(n, prose(n, 40), "a") for n in range(8)] + [(8, prose(0, 40), "b"), (9, prose(50, 30), None)]
    frame = clashing(spark, rows)
    items = spark.createDataFrame([(1, prose(1, 40), None)], "item_id long, question string, answer string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(8)], "doc_id long, quality int")
    lines = line_dedup.deduplicated(frame)
    for out in (near_copies.keep_first(frame), simhash.keep_first(frame), decontaminate.clean(frame, items), quality.accepted(frame, labels), mixing.materialise(frame), line_dedup.rewritten(frame, lines)):
        got = out.collect()
        assert out.columns == frame.columns
        assert all(tuple(r)[3:] == tuple(range(1, 15)) for r in got)
    assert sorted(r.doc_id for r in near_copies.keep_first(frame).collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 9]
    assert 1 not in {r.doc_id for r in decontaminate.clean(frame, items).collect()}


def test_texts_of_a_repeated_id_are_judged_apart(spark):
    rows = [(1, prose(1, 60), "a"), (2, prose(1, 60), "a"), (2, prose(2, 60), "a"), (3, prose(3, 60), "a"), (3, prose(3, 60), "a")]
    kept = sorted((r.doc_id, r.text) for r in near_copies.keep_first(clashing(spark, rows)).collect())
    assert kept == sorted((i, t) for i, t, _ in rows if (i, t) != (2, prose(1, 60)))


@pytest.mark.parametrize("hub", [1000, 3])
def test_components_of_stars_and_chains(spark, monkeypatch, hub):
    monkeypatch.setattr(common, "HUB", hub)
    pick = random.Random(1)
    edges = [(5, n) for n in range(100, 900)] + [(n, n + 1) for n in range(2000, 2060)] + [(899, 2030)]
    edges += [(pick.randrange(5000, 5400), pick.randrange(5000, 5400)) for _ in range(300)] + [(7, 7)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(len(root)):
        before = dict(root)
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == root and len(got) == len(root)


def test_a_large_star_is_not_gathered(spark):
    """A centre with 10^6 leaves: its links are joined where they are."""
    leaves = spark.range(1, 1_000_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    out = common.components(leaves)
    assert out.agg(F.count("*"), F.max("root")).first() == (1_000_001, 0)
    least = leaves.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count("*").alias("n"))
    rows = common._beside(leaves.select(F.col("a").alias("u"), F.col("b").alias("v")).repartition(8), least, 1_000_000)
    spread = rows.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in spread) < 200_000


def test_sieve_loses_no_wanted_row(spark, monkeypatch):
    monkeypatch.setattr(common, "SIEVE", 256)
    rows = spark.createDataFrame([(n, f"t{n}") for n in range(400)] + [(None, "none")], "doc_id long, text string")
    wanted = spark.createDataFrame([(n,) for n in range(0, 400, 40)] + [(None,), (7,), (7,)], "doc_id long")
    got = {r.doc_id for r in common.sieved(rows, wanted, "doc_id").collect()}
    assert {*range(0, 400, 40), 7, None} <= got and len(got) < 100
    assert common.sieved(rows, wanted.limit(0), "doc_id").collect() == []
    assert common.sieved(rows, rows, "doc_id").count() == 401
    for gone in (wanted, rows.select("doc_id"), wanted.limit(0)):
        ids = {r.doc_id for r in gone.collect()}
        assert sorted(r.text for r in common.without(rows, gone, ["doc_id"]).collect()) == sorted(r.text for r in rows.collect() if r.doc_id not in ids)
