import random
from collections import defaultdict

import pyarrow as pa
import xxhash

from citeloom.llm import line_dedup, queries
from tests.llm.cases import docs, odd_rows, prose


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def changed(text, pick, n):
    for _ in range(n):
        at, kind = pick.randrange(len(text) + 1), pick.randrange(3)
        text = text[:at] + ("" if kind == 0 else pick.choice("abcé")) + text[at + (kind != 1) :]
    return text


def plain(rows, threshold):
    lines = [(i, n, x) for i, t in rows if t is not None for n, x in enumerate(t.split("\n"))]
    texts = sorted({x for *_, x in lines if x.strip()})
    links, root = defaultdict(int), {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(texts):
        for b in texts[n + 1 :]:
            if abs(len(a) - len(b)) <= threshold and edits(a, b) <= threshold:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    head = {}
    for i, n, x in lines:
        if x.strip():
            place = (i is not None, i or 0, n)
            head[find(x)] = min(head.get(find(x), place), place)
    h = lambda x: xxhash.xxh64_intdigest(x, 42) if x.strip() else None
    name = {}
    for x in texts:
        signed = [v - (1 << 64) if v >> 63 else v for v in (h(y) for y in texts if find(y) == find(x))]
        name[x] = f"{min(signed) % (1 << 64):016x}"
    return sorted(((i, n, f"{h(x):016x}" if x.strip() else None, links[x], name.get(x), not x.strip() or head[find(x)] == (i is not None, i or 0, n)) for i, n, x in lines), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_distance_matches_the_full_table():
    pick = random.Random(5)
    for _ in range(3000):
        a = "".join(pick.choice("ab") for _ in range(pick.randint(0, 12)))
        b = changed(a, pick, pick.randint(0, 4)) if pick.random() < 0.7 else "".join(pick.choice("ab") for _ in range(pick.randint(0, 12)))
        for most in (0, 1, 2, 3):
            assert line_dedup.distance_within(a, b, most) == (edits(a, b) <= most), (a, b, most)


def test_no_pair_lacks_a_key():
    pick = random.Random(6)
    for _ in range(2000):
        a = "".join(pick.choice("abc") for _ in range(pick.randint(1, 15)))
        b = changed(a, pick, 2)
        short, other = sorted((a, b), key=len)
        if b and a != b:
            own, _ = line_dedup.line_keys(short, 2)
            mine, probes = line_dedup.line_keys(other, 2)
            assert set(own) & {*mine, *probes}
            assert line_dedup._first_key(short, other, 2) in own


def test_shared_keys_over_any_batches():
    pick = random.Random(7)
    for _ in range(200):
        rows = sorted({(pick.randrange(12), pick.randrange(2) == 0, pick.randrange(6)) for _ in range(40)}, key=lambda r: (r[0], not r[1], r[2]))
        cuts = sorted(pick.sample(range(len(rows)), min(5, len(rows))))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in p], pa.int64()), pa.array([r[2] for r in p], pa.int64()), pa.array([r[1] for r in p], pa.bool_())], ["key", "line", "own"]) for p in parts]
        out = {tuple(r.values()) for b in line_dedup._shared(iter(batches)) for r in b.to_pylist()}
        for key in {r[0] for r in rows}:
            mine = {(k, x, o) for k, o, x in rows if k == key}
            alive = len({x for _, x, _ in mine}) > 1 and any(o for *_, o in mine)
            if key in (rows[0][0], rows[-1][0]):
                assert not alive or {(k, x) for k, x, _ in mine} <= {(k, x) for k, x, _ in out}
            else:
                found = {(k, x) for k, x, o in out if k == key}
                assert found == ({(k, x) for k, x, _ in mine} if alive else set())


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    pick = random.Random(8)
    seeds = [prose(n, pick.randint(1, 7)) for n in range(12)]
    rows = []
    for i in range(40):
        rows.append((i, "\n".join(changed(pick.choice(seeds), pick, pick.randint(0, 3)) for _ in range(4)), "a"))
    frame = docs(spark, rows)
    for threshold in (1, 2):
        assert got(line_dedup.deduplicated(frame, threshold)) == plain([(i, t) for i, t, _ in rows], threshold)


def test_odd_rows(spark):
    rows = [r for r in odd_rows() if len(r[1] or "") < 1000] + [(20, "ab", "a"), (21, "abcd", "a"), (22, "a", "a")]
    assert got(line_dedup.deduplicated(docs(spark, rows))) == plain([(i, t) for i, t, _ in rows], 2)
    assert line_dedup.deduplicated(docs(spark, odd_rows())).where("not kept").count() > 0
    assert line_dedup.deduplicated(docs(spark, [])).collect() == []


def test_rewritten(spark):
    frame = docs(spark, [(1, "same line here\nother", "a"), (2, "some line here\n\nnew words", "a"), (3, None, "a")])
    out = line_dedup.rewritten(frame, line_dedup.deduplicated(frame))
    assert out.columns == frame.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "same line here\nother", 2: "\nnew words", 3: None}


def test_probes_before_their_index_line_survive_range_borders(spark):
    """One index line with a great hash and many probes with lesser ones: ranges cut inside the key."""
    hot = [(7, n, False) for n in range(20_000)] + [(7, 1 << 40, True)]
    frame = spark.createDataFrame([(-k, k, True) for k in range(1, 3000)] + hot, "key long, line long, own boolean").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        found = {(r.line, r.own) for r in line_dedup.alive(frame).where("key = 7").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == {(x, o) for _, x, o in hot}


def test_lines_are_keyed_once(spark):
    """Ranges of keys would be found by a run over all lines before the one that deals them."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(k, line, line == k) for k in range(3000) for line in (k, k + 1)]
    frame = spark.createDataFrame(rows, "key long, line long, own boolean").mapInArrow(counted, "key long, line long, own boolean")
    assert sorted(tuple(r) for r in line_dedup.alive(frame).collect()) == sorted(rows)
    assert made.value == len(rows)


def test_many_probes_wait_for_an_index_line_or_pass(monkeypatch):
    monkeypatch.setattr(line_dedup, "HELD", 5)
    rows = [(1, 0, True), (2, 1, False), (2, 1, False), *((3, n, False) for n in range(9)), (3, 20, True), *((4, n, False) for n in range(4))]
    batch = lambda r: pa.RecordBatch.from_pylist([dict(zip(("key", "line", "own"), r))], pa.schema([("key", pa.int64()), ("line", pa.int64()), ("own", pa.bool_())]))
    out = [tuple(r.values()) for b in line_dedup._shared(map(batch, rows)) for r in b.to_pylist()]
    assert out == [(3, n, False) for n in range(9)] + [(3, 20, True)]


def test_different_short_lines_stay_in_the_query(spark, tmp_path):
    short = [str(n) for n in range(30)] + ["A.", "Of", "St.", "Ti.", "2021-03-04", "2021-03-05"]
    long = "a line of forty characters, about so far"
    text = "\n".join(short + [long, long + "!?", long + "!?.", long[:20], long[:20] + "!", long[:20] + "?!."])
    docs(spark, [(1, text, "a"), (2, "\n".join(short), "a")]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op2_line_dedup(spark, str(tmp_path)).collect()
    kept = {(r.doc_id, r.line_no) for r in rows if r.kept}
    n = len(short)
    assert kept == {(1, i) for i in range(n)} | {(1, n), (1, n + 3), (1, n + 5)}
    assert {r.links for r in rows if r.line_no < n} == {0}
