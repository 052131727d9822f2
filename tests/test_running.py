import random

from pyspark.sql import functions as F

from citeloom.operators import catalogue, running


def test_groups_larger_than_a_segment(spark):
    rng = random.Random(2)
    # one group holds most rows
    rows = [("hot" if n % 5 else f"g{n % 7}", n, rng.choice([None, None, f"h{n}"]), n % 3) for n in range(400)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, n int, h string, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = running._segments(frame, ["g"], [F.col("n")])
        assert parts.filter("g = 'hot'").select("_segment").distinct().count() > 1
        last = {r["n"]: r["x"] for r in running.running_last(frame, ["g"], [F.col("n")], F.col("h"), "x").collect()}
        total = {r["n"]: r["x"] for r in running.running_sum(frame, ["g"], [F.col("n")], F.col("v"), "x").collect()}
        number = {r["n"]: r["x"] for r in running.running_number(frame, ["g"], [F.desc("n")], "x").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = {}
    for g, n, h, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(g, []).append((n, h, v))
    for members in groups.values():
        title, added = None, 0
        for at, (n, h, v) in enumerate(members):
            title, added = h or title, added + v
            assert last[n] == title and total[n] == added and number[n] == len(members) - at


def test_a_null_group_is_a_group(spark):
    frame = spark.createDataFrame([(None, 1, "a"), (None, 2, None), ("g", 1, None)], "g string, n int, h string")
    for made in (running.running_number(frame, ["g"], [F.col("n")], "x"), running.running_last(frame, ["g"], [F.col("n")], F.col("h"), "x")):
        assert made.count() == 3
    got = running.running_last(frame, ["g"], [F.col("n")], F.col("h"), "x").collect()
    assert sorted((r.g or "", r.n, r.x) for r in got) == [("", 1, "a"), ("", 2, "a"), ("g", 1, None)]


def test_listing_order(spark):
    docs = spark.createDataFrame(
        [("b", "w", 1, 9), ("a", "w", 2, 1), ("c", "v", 3, 5), ("d", "w", 2, 7)], "document_id string, workspace_id string, created_at int, updated_at int"
    )
    spaces = spark.createDataFrame([("w", 2), ("v", 1)], "workspace_id string, created_at int")
    assert [r["document_id"] for r in catalogue.list_documents(docs, spaces.filter("workspace_id = 'w'")).collect()] == ["a", "d", "b"]
    assert [r["document_id"] for r in catalogue.docs_by_update(docs).collect()] == ["c", "b", "d", "a"]
    assert [r["workspace_id"] for r in catalogue.list_workspaces(spaces).collect()] == ["w", "v"]
    assert catalogue.default_workspace(spaces).first()["workspace_id"] == "v"
