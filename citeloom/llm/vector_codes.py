"""Vector codes: product quantisation in whole numbers, with nearest entries found by memoised grid cells.

A component x counts as floor(4096 x). A vector is cut into equal parts, each part position has a
codebook, and a vector's code names the nearest entry of each. For a part, the coarse grid cell it
lies in is looked up: the first part to fall into a cell bounds the distance of every entry to the
cell's box from below and above, and only entries that no other one beats all over the box are
remembered. Distances are then taken to those alone, exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import staged

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: Greatest whole-number component: squared distances of 4,096 components then fit 64 bits.
GREATEST = 1 << 24
#: Cells remembered per part position; a full memory starts anew.
CELLS = 100_000
#: Numbers handled at a time.
TOGETHER = 1 << 21
#: Labels with more than one row in so many are joined from memory; there can't be more of them than this.
HOT = 1000


def whole(vectors: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` and the whole-number vector ``y`` of each row of ``vectors`` whose embedding has only finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(*keep, F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("y"))


def _distinct(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and for each row the place of its like; rows are numbered in mixed radix where that fits 62 bits."""
    low = cells.min(0)
    spans = [int(n) for n in cells.max(0) - low + 1]
    if math.prod(spans) >= 1 << 62:
        found, of = np.unique(cells, axis=0, return_inverse=True)
        return found, of.reshape(-1)
    number = np.zeros(len(cells), np.int64)
    for n, span in enumerate(spans):
        number = number * span + (cells[:, n] - low[n])
    _, first, of = np.unique(number, return_index=True, return_inverse=True)
    return cells[first], of


class Cells:
    """Nearest entries of one codebook, remembering for each grid cell which entries can be nearest in it."""

    def __init__(self, book: np.ndarray):
        self.book, self.known = book, {}
        apart = ((book[:, None] - book[None]) ** 2).sum(2)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        near = apart.min(1)
        near = near[(near > 0) & (near < np.iinfo(np.int64).max)]
        # a cell as wide as entries are apart: its diagonal is about the median distance of an entry to the next one
        width = (float(np.median(near)) / max(1, book.shape[1])) ** 0.5 if len(near) else 1.0
        self.shift = max(0, int(width).bit_length() - 1)
        self.looked, self.bounded, self.measured = 0, 0, 0

    def bound(self, cells: np.ndarray) -> np.ndarray:
        """Which entries are not dominated in each cell: no other one's greatest distance to the box is below their least."""
        low = (cells << self.shift)[:, None, :]
        high = low + ((1 << self.shift) - 1)
        below, above = low - self.book, self.book - high
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
        most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(2)
        return least <= most.min(1, keepdims=True)

    def _allowed(self, parts: np.ndarray) -> np.ndarray:
        cells, of = _distinct(parts >> self.shift)
        keys = [c.tobytes() for c in cells]
        new = [n for n, key in enumerate(keys) if key not in self.known]
        self.looked, self.bounded = self.looked + len(keys), self.bounded + len(new)
        masks = np.zeros((len(keys), len(self.book)), bool)
        if new:
            masks[new] = self.bound(cells[new])
        for n in set(range(len(keys))).difference(new):
            masks[n] = self.known[keys[n]]
        if len(self.known) + len(new) > CELLS:
            self.known.clear()
        for n in new[:CELLS]:
            self.known[keys[n]] = masks[n].copy()
        return masks[of]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry to each of ``parts``; ties go to the lower index."""
        codes, best = np.zeros(len(parts), np.int64), np.full(len(parts), np.iinfo(np.int64).max)
        step = max(1, TOGETHER // max(1, self.book.size))
        for at in range(0, len(parts), step):
            some, code, least = parts[at : at + step], codes[at : at + step], best[at : at + step]
            allowed = self._allowed(some)
            self.measured += int(allowed.sum())
            for j, entry in enumerate(self.book):
                rows = np.flatnonzero(allowed[:, j])
                apart = ((some[rows] - entry) ** 2).sum(1)
                closer = apart < least[rows]
                least[rows[closer]], code[rows[closer]] = apart[closer], j
        return codes, best


def _stacked(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _sums(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        cells = [Cells(book) for book in books]
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            rows = _stacked(batch.column("y"), parts * width)
            for p in range(parts):
                mine = rows[:, p * width : (p + 1) * width]
                codes, _ = cells[p].nearest(mine)
                counts[p] += np.bincount(codes, minlength=entries)
                for n in range(width):  # exact: whole numbers far below 2^53
                    sums[p, :, n] += np.bincount(codes, mine[:, n], entries).astype(np.int64)
        part, entry = np.nonzero(counts)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total"])

    return run


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks, an array (part, entry, component), fitted on all of ``vectors`` (vec_id, embedding).

    They start as the parts of the rows with the least vec_ids (nulls last, ties by vector; fewer
    rows, fewer entries). Each round sends one sum per part, entry and task, so nothing grows with
    the rows; the vectors are read once a round. The dimension is that of the longest vector,
    rounded up to a multiple of ``parts``; shorter ones are filled with zeros. No rows: no entries.
    """
    known = whole(vectors, F.col("vec_id").alias("id"))
    most = F.max(F.aggregate("y", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x))))
    longest, greatest = known.agg(F.max(F.size("y")), most).first()
    if longest is None:
        return np.zeros((parts, 0, 0), np.int64)
    if greatest and greatest > GREATEST:
        raise ValueError(f"components beyond {GREATEST // SCALE} in size: squared distances would not fit 64 bits")
    width = -(-longest // parts)
    first = known.orderBy(F.col("id").asc_nulls_last(), "y").limit(entries).collect()  # as many rows as a codebook has entries
    start = np.zeros((len(first), parts * width), np.int64)
    for n, row in enumerate(first):
        start[n, : len(row.y)] = row.y
    books = np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        sums = known.select("y").mapInArrow(_sums(books), "part int, entry int, n long, total array<long>")
        at = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        moved = books.copy()
        for part, entry, place, n, x in at.collect():  # one row per component of the codebooks
            moved[part, entry, place] = x // n
        if (moved == books).all():
            break
        books = moved
    return books


def _coded(books: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        cells = [Cells(book) for book in books]
        for batch in batches:
            rows = _stacked(batch.column("y"), parts * width)
            found = [cells[p].nearest(rows[:, p * width : (p + 1) * width]) for p in range(parts)]
            codes = np.stack([c for c, _ in found], 1).astype(np.int16)
            errors = np.sum([e for _, e in found], axis=0, dtype=np.int64)
            keep = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(list(codes), pa.list_(pa.int16())), pa.array(errors)], [*names, "codes", "error"])

    return run


def encoded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, codes, error`` of each row of ``vectors`` with finite components: nearest entries and summed squared distances.

    Rows whose embedding is null or holds nulls or numbers that aren't finite are left out; repeated
    rows are repeated, null ids and labels stay; an empty vector has zeros for components. Columns
    besides vec_id, label and embedding are not looked at.
    """
    rows = whole(vectors, F.col("vec_id"), F.col("label"))
    if not books.shape[1]:
        return rows.select("vec_id", "label", F.array().cast("array<smallint>").alias("codes"), F.lit(0).cast("long").alias("error")).limit(0)
    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = f"vec_id {types['vec_id']}, label {types['label']}, codes array<smallint>, error long"
    return rows.mapInArrow(_coded(books, ["vec_id", "label"]), schema)


def decoded(books: np.ndarray, codes: list[int]) -> np.ndarray:
    """The vector that ``codes`` stand for, in the units of the embeddings (middle of each whole number)."""
    return (np.concatenate([books[p, c] for p, c in enumerate(codes)]) + 0.5) / SCALE


def with_label_error(rows: DataFrame) -> DataFrame:
    """Add ``label_error``: errors summed over equal labels, nulls being equal.

    Sums are partial before the shuffle. Labels of more than one row in ``HOT`` are fewer than
    ``HOT``, so their sums fit into memory and their rows aren't moved; the others are joined by label.
    """
    rows = staged(rows)
    sums = staged(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    least = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / HOT
    hot = sums.where(F.col("n") > least).select("of", "label_error", F.lit(True).alias("hot"))
    found = rows.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("of")), "left")
    rest = sums.where(F.col("n") <= least).select(F.col("of"), F.col("label_error"))
    cold = found.where("hot is null").select(*rows.columns).join(rest, F.col("label").eqNullSafe(F.col("of")))
    return found.where("hot").select(*rows.columns, "label_error").unionByName(cold.select(*rows.columns, "label_error"))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.reshape(-1)).encode()).hexdigest()


def compressed(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``: codebooks fitted on ``vectors``, and each vector's code of two hex digits a part."""
    books = codebooks(vectors)
    rows = with_label_error(encoded(vectors, books))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "")
    return rows.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same in SQL: one set of common table expressions per round."""
    nearest = """assigned{n} as materialized (
  select id, p, arg_min(e, d * 100 + e) as e, min(d) as d from (
    select v.id, v.p, b.e, sum((v.x - b.x) * (v.x - b.x)) as d from parts v join book{n} b on v.p = b.p and v.i = b.i group by v.id, v.p, b.e) group by id, p)"""
    moved = """book{m} as materialized (
  select b.p, b.e, b.i, coalesce(s.x, b.x) as x from book{n} b left join (
    select a.p, a.e, v.i, floor(sum(v.x) / count(*))::bigint as x from assigned{n} a join parts v on a.id = v.id and a.p = v.p group by a.p, a.e, v.i) s
  on b.p = s.p and b.e = s.e and b.i = s.i)"""
    steps = [nearest.format(n=0)]
    for n in range(ROUNDS):
        steps += [moved.format(n=n, m=n + 1), nearest.format(n=n + 1)]
    return f"""with kept as materialized (
  select row_number() over (order by vec_id) as id, vec_id, label, embedding from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (
  select id, ((k - 1) // (len(embedding) // {PARTS}))::int as p, ((k - 1) % (len(embedding) // {PARTS}))::int as i, floor({SCALE} * x::double)::bigint as x
  from (select id, embedding, unnest(embedding) as x, unnest(range(1, len(embedding) + 1)) as k from kept)),
book0 as materialized (select p, (id - 1)::int as e, i, x from parts where id <= {ENTRIES}),
{", ".join(steps)},
codes as (
  select id, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from assigned{ROUNDS} group by id),
books as (select sha256(string_agg(x::varchar, ',' order by p, e, i)) as sha from book{ROUNDS})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, sha as codebooks_sha256
from codes join kept using (id), books"""


ORACLE = _oracle()
