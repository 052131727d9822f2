import re

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from citeloom.llm import mixing
from tests.llm.cases import docs, odd_rows, prose


def plain_targets(sizes):
    """source -> target, sources in order; the excess over three times a source's size goes round until none is left."""
    total, weight = sum(sizes.values()), {s: (5, 2, 1)[n % 3] for n, s in enumerate(sizes)}
    capped, level = {}, 0
    while True:
        free = [s for s in sizes if s not in capped]
        if not free or not total:
            break
        level = (total - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            break
        capped |= {s: 3.0 * sizes[s] for s in over}
    return {s: capped.get(s, weight[s] * level) for s in sizes}


def sizes_of(rows):
    found = {}
    for _, t, s in rows:
        found[s] = found.get(s, 0) + len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
    return {s: found[s] for s in sorted(found, key=lambda s: (s is None, s or ""))}


def check(rows, got, slack):
    sizes = sizes_of(rows)
    targets, taken = plain_targets(sizes), {s: 0 for s in sizes}
    source = {(i, len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])): s for i, t, s in rows}
    assert len(got) == len(rows)
    for r in got:
        s = source[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s, n in taken.items():
        assert abs(n - targets[s]) <= slack, (s, n, targets[s])


@pytest.mark.parametrize("slots", [1 << 20, 500, 7])
def test_targets_and_takes(spark, slots):
    rows = [(n, prose(n, 5 + n % 40), f"s{n % 7}" if n % 11 else None) for n in range(200)] + [(500, prose(5, 900), "s0")]
    got = mixing.mixed(docs(spark, rows), slots).collect()
    check(rows, got, 0.51)
    assert sorted(got) == sorted(mixing.mixed(docs(spark, rows).repartition(5), slots).collect())


def test_sources_smaller_than_a_block(spark):
    """Sources of a few words beside one of very many: blocks are far larger than they are."""
    small = [(1, prose(1, 30), "b"), (2, prose(2, 20), "c"), (3, prose(3, 27), "c"), (4, prose(4, 50), None)]
    rows = small + [(10 + n, prose(n, 4000), "a") for n in range(60)]
    got = mixing.mixed(docs(spark, rows), 100).collect()
    check(rows, got, 0.51)
    assert {r.doc_id: r.taken for r in got if r.doc_id < 10} == {1: 90, 2: 60, 3: 81, 4: 150}
    blocks = mixing.settled(mixing.targets(mixing.sizes(docs(spark, rows))), 100).collect()
    assert sum(b.words for b in blocks) == pytest.approx(sum(sizes_of(rows).values()), abs=2) and min(b.words for b in blocks) > 0
    assert sum(b.slot is None for b in blocks) <= 4  # the schedule gives all but the odd block
    copies = mixing.materialise(docs(spark, rows), 100).where("doc_id < 10").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies} == {1: 3, 2: 3, 3: 3, 4: 3}


def test_given_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").collect()
    check(table, entry.queries()["op10_mixing"](spark, "/root/testdata/sf0.001").collect(), 0.51)


def test_odd_rows_match_sql(spark):
    ids = [(i, t, s) for n, (i, t, s) in enumerate(odd_rows())]
    got = mixing.mixed(docs(spark, ids)).collect()
    connection = duckdb.connect()
    documents = pa.table({"doc_id": pa.array([i for i, *_ in ids], pa.int64()), "text": pa.array([t for _, t, _ in ids], pa.string()), "source": pa.array([s for *_, s in ids], pa.string())})
    connection.register("documents", documents)
    want = connection.execute(mixing.ORACLE).fetchall()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == sorted(((*r[:3], round(r[3], 6), r[4]) for r in want), key=str)


def test_no_rows_and_no_words(spark):
    assert mixing.mixed(docs(spark, [])).collect() == []
    got = mixing.mixed(docs(spark, [(1, None, "a"), (2, "", None), (2, "", None)])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_a_source_is_spread_over_the_schedule(spark):
    rows = [(n, prose(n, 50), f"s{n % 3}") for n in range(60)]
    sources = mixing.targets(mixing.sizes(docs(spark, rows)))
    places = {}
    for r in mixing.schedule(sources).orderBy("slot").collect():
        places.setdefault(r.place, []).append((r.slot, r.rank))
    for found in places.values():
        assert [k for _, k in found] == list(range(len(found)))
        gaps = [b - a for (a, _), (b, _) in zip(found, found[1:])]
        assert max(gaps) <= 4 * sum(gaps) / len(gaps)


def test_materialise(spark):
    rows = [(n, prose(n, 30), f"s{n % 3}") for n in range(60)] + [(99, None, "s0")]
    frame = docs(spark, rows)
    out = mixing.materialise(frame)
    assert out.columns == frame.columns
    taken = {r.doc_id: r.taken / r.size for r in mixing.mixed(frame).collect() if r.size}
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {i: int(x + 0.5) for i, x in taken.items() if int(x + 0.5)}
