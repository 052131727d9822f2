import hashlib
import math
import random

import numpy as np
import pytest

from citeloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, codes string, error string, y int, of int, hot int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, n, "c", "e", 1, 2, 3) for i, v, n in rows], SCHEMA)


def plain(rows, parts=8, entries=16, rounds=6):
    """The contract in plain Python: every entry measured, no cells."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], n) for i, v, n in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v, [*v, *[0] * (parts * width - len(v))], n) for i, v, n in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * width : (p + 1) * width] for _, _, v, _ in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            cells = [[] for _ in books[p]]
            for _, _, v, _ in kept:
                x = v[p * width : (p + 1) * width]
                cells[nearest(p, x)[1]].append(x)
            books[p] = [[sum(c) // len(xs) for c in zip(*xs)] if xs else e for xs, e in zip(cells, books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, _, v, n in kept:
        found = [nearest(p, v[p * width : (p + 1) * width]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), n))
    by = {}
    for _, _, e, n in out:
        by[n] = by.get(n, 0) + e
    return sorted(((i, c, e, by[n], sha) for i, c, e, n in out), key=repr)


def got(spark, rows):
    return sorted((tuple(r) for r in vc.compressed(table(spark, rows)).collect()), key=repr)


def random_rows(n, width, seed=1, coarse=False):
    pick = random.Random(seed)
    value = (lambda: pick.choice([-0.5, 0.0, 0.25])) if coarse else (lambda: pick.gauss(0, 0.2))
    return [(i, [value() for _ in range(width)], pick.choice([0, 0, 0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("coarse", [False, True])
def test_against_plain_python(spark, coarse):
    rows = random_rows(150, 24, coarse=coarse)
    assert got(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = random_rows(12, 16, seed=2)
    rows += [(3, rows[3][1], 5), (3, rows[4][1], None), (None, rows[5][1], None), (None, None, 1), (50, [], 1), (51, [0.1, None] * 8, 1), (52, [float("nan")] + [0.0] * 15, 1)]
    rows += [(53, [float("inf")] + [0.0] * 15, 1), (54, [-float("inf")] * 16, 1), (55, [0.3] * 5, 2), (56, [4000.0, -4000.0] * 8, 2)]
    assert got(spark, rows) == plain(rows)


def test_no_rows_and_out_of_range(spark):
    assert got(spark, []) == [] and got(spark, [(1, None, 1), (2, [float("nan")], 1)]) == []
    with pytest.raises(ValueError, match="64 bits"):
        got(spark, [(1, [1e9] * 8, 1)])


def test_many_labels_join_by_label(spark):
    rows = [(i, v, i % 1500 if i % 3 else 7) for i, v, _ in random_rows(2500, 8, seed=3)]
    assert got(spark, rows) == plain(rows)


def test_cells_drop_only_dominated_entries():
    pick = np.random.default_rng(4)
    book = pick.integers(-900, 900, (16, 4))
    cells = vc.Cells(book)
    parts = pick.integers(-1000, 1000, (5000, 4))
    parts[1000:2000] = parts[0] + pick.integers(0, 9, (1000, 4))
    apart = ((parts[:, None] - book[None]) ** 2).sum(2)
    for _ in range(2):  # the second time from memory
        codes, least = cells.nearest(parts)
        assert (codes == apart.argmin(1)).all() and (least == apart.min(1)).all()
    assert cells.bounded <= cells.looked / 2 and cells.measured < 2 * apart.size


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(vc, "CELLS", 50)
    pick = np.random.default_rng(5)
    book, parts = pick.integers(-900, 900, (16, 4)), pick.integers(-1000, 1000, (3000, 4))
    cells = vc.Cells(book)
    for at in range(0, 3000, 100):
        codes, _ = cells.nearest(parts[at : at + 100])
        assert len(cells.known) <= 50
        assert (codes == ((parts[at : at + 100, None] - book[None]) ** 2).sum(2).argmin(1)).all()


def test_decoded_is_near(spark):
    rows = random_rows(200, 16, seed=6)
    vectors = table(spark, rows)
    books = vc.codebooks(vectors)
    for r in vc.encoded(vectors, books).collect():
        x = np.array(rows[r.vec_id][1], np.float32)
        assert abs(((vc.decoded(books, r.codes) - x) ** 2).sum() - r.error / vc.SCALE**2) < 0.05
