"""Near-copied documents: five-word shingles with a Jaccard similarity of at least 0.8.

Candidates are found by SimHash: each text's 64-bit fingerprint over its five-word shingles meets
all others within three bits at the anchors of ``simhash``. Three bits hold the nearest copies
only (at 0.8 about 10 bits differ), so MinHash bands add the wider ones: a pair at 0.8 shares one of the
32 bands of five values but for 3 in a million, a likelier one sooner. Texts that are linked by
either form groups; inside each group every pair that isn't joined yet is compared by its whole
shingle sets, so that a link is exact. Large groups are compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import simhash
from citeloom.llm.common import components, packed, pieces, sieved, staged, without

SEED = 42
SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 32, 5
#: Most texts of one block of a group; two blocks meet in one comparison.
BLOCK = 256
#: Rows whose shingle sets are held and sent on at a time.
SLICE = 512

_draw = np.random.default_rng(SEED)
TIMES = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(data: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a whole text's shingles; a shorter text is one shingle, one without words has none."""
    found, tail = [], []
    for piece in pieces((data or b"").lower()):
        words = tail + piece.split()
        if len(words) >= SHINGLE:
            parts = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
            found.append(np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in parts], np.uint64)))
        tail = words[-(SHINGLE - 1) :]
    if not found and tail:
        found.append(np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def node(sketch: np.ndarray) -> int:
    """One number for a set of shingles, 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(sketch.tobytes(), SEED)).astype(np.int64)) if len(sketch) else 0


def bands(sketch: np.ndarray) -> list[int]:
    """The keys under which a set of shingles meets similar ones."""
    if not len(sketch):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(sketch), 2048):
        least = np.minimum(least, (sketch[at : at + 2048, None] * TIMES + PLUS).min(axis=0))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), n) for n, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = (shingles(x.as_py()) for x in batch.column("text"))
        nodes, fps, keys = zip(*((node(s), simhash.of_set(s), bands(s)) for s in sets)) if batch.num_rows else ((), (), ())
        columns = [batch.column("doc_id"), batch.column("h"), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "node", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            sets = [shingles(x.as_py()) for x in batch.column("text").slice(at, SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array([node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "sketch"])


def trees(sets: list[np.ndarray], side: np.ndarray | None = None) -> np.ndarray:
    """For every set the first one that it is linked to here; with ``side``, only sets of unlike sides are compared."""
    label, n = np.arange(len(sets)), np.array([len(s) for s in sets])
    _, terms = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(n) - n
    mark = np.zeros(terms.max() + 1, np.int64)
    for i in range(len(sets) - 1):
        open_ = label[i + 1 :] != label[i]
        if side is not None:
            open_ &= side[i + 1 :] != side[i]
        if not open_.any():
            continue
        mine = terms[starts[i] : starts[i] + n[i]]
        mark[mine] = 1
        common = np.add.reduceat(mark[terms[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        mark[mine] = 0
        a, b = LEAST  # common / (both - common) >= a / b
        near = np.flatnonzero(open_ & ((a + b) * common >= a * (n[i] + n[i + 1 :])))
        if len(near):
            met = np.unique(label[np.append(near + i + 1, i)])
            label[np.isin(label, met)] = met[0]
    return label


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple], mark: tuple) -> pa.RecordBatch:
        nodes, sets = [r[0] for r in rows], [np.frombuffer(r[1], np.uint64) for r in rows]
        label = trees(sets, None if mark[1] == mark[2] else np.array([r[2] for r in rows]))
        moved = np.flatnonzero(label != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in moved], pa.int64()), pa.array([nodes[label[i]] for i in moved], pa.int64())], ["a", "b"])

    mark, rows = None, []
    for batch in batches:
        for n in range(batch.num_rows):
            group, x, y, *row = (c[n].as_py() for c in batch.columns)
            if (group, x, y) != mark:
                if len(rows) > 1:
                    yield out(rows, mark)
                mark, rows = (group, x, y), []
            rows.append(row)
    if len(rows) > 1:
        yield out(rows, mark)


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """Links ``a, b`` between ``nodes`` (node, fp) whose fingerprints are within the threshold of ``simhash``."""
    heads = staged(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    equal = nodes.join(heads, "fp").where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = simhash.links(heads.select("fp"))
    for end in ("a", "b"):
        near = near.join(heads.select(F.col("fp").alias(end), F.col("head").alias(f"_{end}")), end)
    return equal.unionByName(near.select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def links(texts: DataFrame, marked: DataFrame) -> DataFrame:
    """Links ``a, b`` between distinct shingle sets (column ``node`` of ``marked``) that join all similar enough."""
    nodes = staged(marked.where(F.size("bands") > 0).groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    keys = nodes.select("node", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("_n")).where("_n > 1")
    banded = keys.join(heads, "key").select(F.col("node").alias("a"), F.col("head").alias("b"))
    groups = staged(components(banded.unionByName(_by_simhash(nodes.select("node", "fp")))).withColumnRenamed("root", "group"))
    counts = groups.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_g"))
    placed = staged(groups.join(counts, "group").withColumn("_b", F.pmod(F.xxhash64("node", F.lit("block")), F.col("_g")).cast("int")))
    # one row stands for all of equal sets; rows without an id are looked through, whichever it is
    wanted = staged(marked.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(placed.select("node"), "node").select("doc_id").distinct())
    some = sieved(texts, wanted, "doc_id").alias("t").join(wanted.alias("w"), F.expr("t.doc_id <=> w.doc_id"), "left_semi").select("text")
    sets = some.mapInArrow(_sets, "node long, sketch binary").join(placed, "node").dropDuplicates(["node"])
    spread = sets.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    rows = spread.select("group", F.least("_b", "_j").alias("x"), F.greatest("_b", "_j").alias("y"), "node", "sketch", "_b")
    return rows.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y").mapInArrow(_compared, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id`` for every row of ``docs`` (doc_id, text).

    Texts link if their sets of five-word shingles (ASCII letters in lower case) have a Jaccard
    similarity of at least 0.8; component_id is the least doc_id reachable over links. Texts
    without words, null or not, are copies of each other; a shorter text is one shingle. A null
    doc_id keeps its row and carries links, but names no component. No rows give no rows.
    """
    return _named(docs).select("doc_id", "component_id")


def _named(docs: DataFrame) -> DataFrame:
    """``doc_id, h, component_id`` with h a hash of the text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    marked = staged(texts.mapInArrow(_marked, "doc_id long, h long, node long, fp long, bands array<long>"))
    classes = staged(marked.groupBy("node").agg(F.min("doc_id").alias("first")))
    roots = components(links(texts, marked))
    rooted = staged(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    return marked.select("doc_id", "h", "node").join(named.select("node", "component_id"), "node").select("doc_id", "h", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without those that are near copies of one with a lower doc_id; all columns stay.

    A row stays if its component is named after its doc_id; each text of a repeated doc_id is
    judged by itself, and equal rows stay together. Rows without an id stay.
    """
    gone = staged(_named(docs).where("doc_id != component_id").select(F.col("doc_id").alias("id"), "h").distinct())
    rows = packed(docs, id=F.col("doc_id").cast("long"), h=F.xxhash64("text"))
    return without(rows, gone, ["id", "h"]).select("row.*")
