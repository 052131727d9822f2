"""Near-equal lines by a segment-partition edit join.

A line is cut into threshold + 1 segments; a line within ``THRESHOLD`` edits leaves one of them
whole, at a place that the two lengths bound. Index keys are a line's own segments, with its
length and the segment's number; probe keys are substrings at the possible places, for its own
and each shorter length. Only keys that two different lines share go on; then texts meet, and
pairs are verified by banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import components, packed, staged

#: Most edits (insert, delete or replace one code point) between linked lines.
THRESHOLD = 2
#: Characters of the shorter line for each edit allowed: shorter lines link to none, 2 edits need twice as many.
PER_EDIT = 12
#: Lines that a task remembers, so as not to send their keys again.
SEEN = 300_000
#: Most lines on each side of one comparison.
BLOCK = 512
#: Lines of one key, none an index line so far, that a task holds.
HELD = 100_000
#: Bits of the sieve that lets through the lines whose texts are needed: 2 MB, whatever the corpus.
SIEVE = 1 << 24


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """Start and length of the segments of a line; the later ones are one longer where it doesn't divide."""
    n = threshold + 1
    small, extra = divmod(length, n)
    sizes = [small] * (n - extra) + [small + 1] * extra
    return [(sum(sizes[:i]), size) for i, size in enumerate(sizes)]


def places(i: int, start: int, size: int, length: int, other: int, threshold: int) -> range:
    """Where segment ``i`` of a line of ``length`` can be found whole in one of ``other`` >= length characters."""
    delta, left, right = other - length, i, threshold - i
    return range(max(0, start - left, start + delta - right), min(other - size, start + left, start + delta + right) + 1)


def _key(text: str, length: int, i: int, threshold: int) -> int:
    return xxhash.xxh64_intdigest(text, length * (threshold + 1) + i) - (1 << 63)


@lru_cache(maxsize=50_000)
def _cuts(n: int, threshold: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Start, end and key number of a line's own segments, and of its further probes."""
    number = lambda length, i: length * (threshold + 1) + i
    own = [(s, s + size, number(n, i)) for i, (s, size) in enumerate(segments(n, threshold))]
    probes = [
        (p, p + size, number(length, i))
        for length in range(max(1, n - threshold), n + 1)
        for i, (s, size) in enumerate(segments(length, threshold))
        for p in places(i, s, size, length, n, threshold)
        if length < n or p != s
    ]
    return own, probes


def edits(length: int, threshold: int, per_edit: int) -> int:
    """Most edits between a line of ``length`` and a longer one; ``threshold`` for all where ``per_edit`` is 0."""
    return min(threshold, length // per_edit) if per_edit else threshold


def line_keys(line: str, threshold: int) -> tuple[list[int], list[int]]:
    """A line's index keys and its further probe keys."""
    own, probes = _cuts(len(line), threshold)
    digest, half = xxhash.xxh64_intdigest, 1 << 63
    return [digest(line[a:b], k) - half for a, b, k in own], [digest(line[a:b], k) - half for a, b, k in probes]


def _keys(threshold: int, per_edit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, lines, own = [], [], []

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lines, pa.int64()), pa.array(own, pa.bool_())], ["key", "line", "own"])

            for text in batch.column("text"):
                for line in (text.as_py() or "").split("\n"):
                    h = xxhash.xxh64_intdigest(line, 42)
                    if h in seen or not line.strip():
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(h)
                    if not edits(len(line), threshold, per_edit):  # nor has any shorter line
                        continue
                    mine, probes = line_keys(line, threshold)
                    keys += mine
                    keys += probes
                    lines += [h if h < 1 << 63 else h - (1 << 64)] * (len(mine) + len(probes))
                    own += [True] * len(mine) + [False] * len(probes)
                if len(keys) > 100_000:
                    yield out()
                    keys, lines, own = [], [], []
            yield out()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those of keys that an index line and some other line have.

    Rows of the last key of a batch wait for the next one while they are of one line or none is
    an index line; more than ``HELD`` different ones pass unseen, as verification decides anyway.
    """
    waiting, passed = None, None  # rows of the unfinished key, or that key, once its rows pass
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column("key").to_numpy(), batch.column("line").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False)]
        key, line, own = rows if waiting is None else [np.concatenate(x) for x in zip(waiting, rows)]
        starts = np.append(0, np.flatnonzero(np.diff(key)) + 1)
        ends = np.append(starts[1:], len(key))
        indexed = np.logical_or.reduceat(own, starts)
        good = (np.minimum.reduceat(line, starts) != np.maximum.reduceat(line, starts)) & indexed
        good[0] |= key[0] == passed
        waiting = None
        if not good[-1]:
            lines = np.unique(line[starts[-1] :])
            good[-1] = len(lines) > HELD
            if not good[-1]:
                waiting = [np.full(len(lines), key[-1]), lines, np.full(len(lines), indexed[-1])]
        passed = key[-1] if good[-1] else None
        keep = np.repeat(good, ends - starts)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, line, own)], ["key", "line", "own"])


def distance_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: a band of 2 x most + 1 diagonals, held in the bits of one number."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return False
    low, high = 0, len(a)  # common prefix, by halving
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, len(a)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if len(b) <= most:
        return True
    # reach[e]: diagonals d = i - j + most, as bits, on which row j is reached with e edits or fewer;
    # row by row of b, only cells inside the band exist
    width = 2 * most + 1
    full = (1 << width) - 1
    reach = [sum(1 << (most + d) for d in range(0, e + 1)) & full for e in range(most + 1)]
    for j, c in enumerate(b):
        same = 0
        for d in range(width):  # cell (i, j) with i = j + d - most
            i = j + d - most
            if 0 <= i < len(a) and a[i] == c:
                same |= 1 << d
        step = []
        for e in range(most + 1):
            now = reach[e] & same
            if e:
                now |= reach[e - 1]  # replace: same diagonal
                now |= reach[e - 1] >> 1  # a character of b alone: i stays, j goes on
                now |= (step[e - 1] << 1) & full  # a character of a alone: i goes on, j stays
            step.append(now)
        reach = step
        if not reach[most]:
            return False
    return bool(reach[most] >> (len(a) - len(b) + most) & 1)


def _counts(texts: list[str]) -> np.ndarray:
    """How many characters of each of 64 kinds a text has: one edit changes at most two counts, by one each."""
    return np.array([np.bincount(np.frombuffer(t.encode("utf-32-le"), "<u4") & 63, minlength=64) for t in texts], dtype=np.int32)


def _first_key(short: str, other: str, threshold: int) -> int | None:
    """The key of the first segment of ``short`` that the join finds in ``other``: a pair counts under this key alone."""
    for i, (s, size) in enumerate(segments(len(short), threshold)):
        part = short[s : s + size]
        if any(other[p : p + size] == part for p in places(i, s, size, len(short), len(other), threshold)):
            return _key(part, len(short), i, threshold)
    return None


def _verified(key: int, rows: list[tuple], threshold: int, per_edit: int = 0) -> tuple[dict[int, int], dict[int, int]]:
    """Links per line and a tree over linked lines, from one key's rows (line, text, is index line here, is probe here)."""
    index = [(h, t) for h, t, own, _ in rows if own]
    probes = [(h, t) for h, t, _, probe in rows if probe]
    links: dict[int, int] = {}
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if not index or not probes or (len(index) == len(probes) == 1 and index[0][0] == probes[0][0]):
        return links, parent
    theirs = _counts([t for _, t in probes])
    long, ids = np.array([len(t) for _, t in probes]), np.array([h for h, _ in probes])
    mine = _counts([t for _, t in index])
    for n, (h, text) in enumerate(index):
        gap, most = long - len(text), edits(len(text), threshold, per_edit)
        near = (np.abs(theirs - mine[n]).sum(axis=1) <= 2 * most) & (gap >= 0) & (gap <= most) & ((gap > 0) | (ids > h))
        for k in np.flatnonzero(near):
            other_h, other = probes[k]
            if _first_key(text, other, threshold) == key and distance_within(text, other, most):
                links[h] = links.get(h, 0) + 1
                links[other_h] = links.get(other_h, 0) + 1
                a, b = root(h), root(other_h)
                parent[max(a, b)] = min(a, b)
    return links, {x: root(x) for x in parent}


def _compared(threshold: int, per_edit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(mark: tuple, rows: list) -> Iterator[pa.RecordBatch]:
            links, roots = _verified(mark[0], rows, threshold, per_edit)
            if links:
                found = list(links)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([links[x] for x in found], pa.int64()), pa.array([roots[x] for x in found], pa.int64())], ["line", "links", "root"])

        mark, rows = None, []
        for batch in batches:
            for key, x, y, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, x, y) != mark:
                    if rows:
                        yield from out(mark, rows)
                    mark, rows = (key, x, y), []
                rows.append(row)
        if rows:
            yield from out(mark, rows)

    return run


def _lines(docs: DataFrame) -> DataFrame:
    split = F.posexplode(F.split(F.col("text"), "\n"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), split.alias("line_no", "text"))
    blank = F.regexp_like("text", F.lit(r"^\s*$"))
    return rows.select("doc_id", "line_no", "text", F.when(~blank, F.xxhash64("text")).alias("line"))


def _sieved(sieve):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sieve.value
        for batch in batches:
            found: dict[int, str] = {}
            for text in batch.column("text"):
                for line in (text.as_py() or "").split("\n"):
                    h = xxhash.xxh64_intdigest(line, 42)
                    cell = h & (SIEVE - 1)
                    if bits[cell >> 6] >> (cell & 63) & 1:
                        found[h if h < 1 << 63 else h - (1 << 64)] = line
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], ["line", "text"])

    return run


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """``line, text`` of the needed lines.

    A sieve of fixed size, sent to all tasks, stops most other lines before the exchange; the
    join after it is exact.
    """
    words = needed.groupBy(F.expr(f"cast((line & {SIEVE - 1}) div 64 as int)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(line & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(SIEVE // 64, np.int64)  # that many rows at most
    bits[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    sieve = docs.sparkSession.sparkContext.broadcast([int(x) for x in bits.view(np.uint64)])
    lines = docs.select("text").mapInArrow(_sieved(sieve), "line long, text string")
    return lines.join(needed, "line", "left_semi").dropDuplicates(["line"])


def alive(keys: DataFrame) -> DataFrame:
    """Rows of the keys that two different lines share, one of them as index line.

    Keys are hashes, dealt by hash: ranges would make all keys a second time, to find their borders.
    The task of a key that many lines share streams through its rows.
    """
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, line long, own boolean")


def links(docs: DataFrame, threshold: int = THRESHOLD, per_edit: int = 0) -> DataFrame:
    """``line, links, root`` of partial counts and trees over the distinct lines within the ``edits`` of the shorter one."""
    keys = docs.select(F.col("text")).mapInArrow(_keys(threshold, per_edit), "key long, line long, own boolean")
    shared = staged(alive(keys).groupBy("key", "line").agg(F.max("own").alias("own")))
    needed = staged(shared.select("line").distinct())
    texts = _texts(docs, needed)
    crowd = shared.groupBy("key").agg(F.count("*").alias("_n"), F.max("own").alias("_own")).where("_n > 1 and _own").select("key", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_g"))
    placed = shared.join(crowd, "key").withColumn("_b", F.pmod(F.xxhash64("line", F.lit("block")), F.col("_g")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda n: n)
    as_index = F.when(F.col("own"), F.transform(others, lambda n: F.struct(F.col("_b").alias("x"), n.alias("y"), F.lit(True).alias("own"), (n == F.col("_b")).alias("probe"))))
    as_probe = F.transform(F.filter(others, lambda n: ~F.col("own") | (n != F.col("_b"))), lambda n: F.struct(n.alias("x"), F.col("_b").alias("y"), F.lit(False).alias("own"), F.lit(True).alias("probe")))
    spread = placed.select("key", "line", F.explode(F.concat(F.coalesce(as_index, F.slice(as_probe, 1, 0)), as_probe)).alias("p"))
    rows = spread.join(texts, "line").select("key", "p.x", "p.y", "line", "text", "p.own", "p.probe")
    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_compared(threshold, per_edit), "line long, links long, root long")


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD, per_edit: int = 0) -> DataFrame:
    """``doc_id, line_no, class_id, links, component_id, kept`` for every line of ``docs`` (doc_id, text).

    Lines are the parts between line feeds, compared whole. class_id names a line's text, links
    counts the different texts within ``threshold`` edits, component_id names all texts reachable
    over links. With ``per_edit``, the shorter line has that many characters for each edit, else it
    doesn't link: equal short lines are one class, different ones all stay. Of a component only the first line stays, in order of doc_id (null first) and
    line_no. Lines of white space alone aren't compared: they stay, without class. A null text
    has no lines, an empty one has one blank line; repeated rows of one doc_id repeat their line
    numbers, of which all equal to the first stay. Other columns are not looked at; no rows give
    no rows. Texts are told apart by their 64-bit XXH64.
    """
    found = staged(links(docs, threshold, per_edit))
    roots = components(found.select(F.col("line").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("line").agg(F.sum("links").alias("links"))
    lines = _lines(docs).select("doc_id", "line_no", "line")
    near = staged(counts.join(roots, F.col("line") == F.col("node")).select("line", "links", "root"))
    classes = lines.where("line is not null").groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("first")).join(near, "line", "left")
    classes = staged(classes.withColumn("root", F.coalesce("root", "line")))
    heads = classes.where("links > 0").groupBy("root").agg(F.min("first").alias("head"))
    headed = classes.join(heads, "root", "left").select("line", "root", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("head", "first").alias("head"))
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    kept = F.coalesce(F.struct("doc_id", "line_no").eqNullSafe(F.col("head")) | F.col("line").isNull(), F.lit(True))
    return lines.join(headed, "line", "left").select(
        "doc_id", "line_no", text("line").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), text("root").alias("component_id"), kept.alias("kept")
    )


def rewritten(docs: DataFrame, marked: DataFrame, text: Column | None = None) -> DataFrame:
    """``docs`` with only the lines that ``deduplicated`` keeps, in place; all columns stay."""
    gone = marked.where(~F.col("kept")).groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("line_no").alias("gone"))  # lines of one document
    rows = packed(docs, id=F.col("doc_id"), parts=F.split(F.col("text") if text is None else text, "\n"))
    left = F.array_join(F.filter("parts", lambda _, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False))), "\n")
    return rows.join(gone, F.col("id").eqNullSafe(F.col("of")), "left").select(*[left.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
