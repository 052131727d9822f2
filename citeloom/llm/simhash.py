"""Near-duplicate documents by SimHash: links between fingerprints are found at anchor points.

The anchors are the words of a covering code: pairs of words of the first-order Reed-Muller
code of length 32, 64 x 64 anchors, covering radius 12 + 12. A fingerprint's home is an anchor
nearest to it; it is copied to every anchor within its own distance from the code plus the
threshold, at most covering radius plus threshold. Of two fingerprints that link, the one
nearer to the code has its home among the anchors of the other: d(y, home(x)) <= d(y, x) +
d(x, home(x)) <= threshold + d(y, code). So comparing homes with copies at each anchor, and
nothing else, finds every link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import components, packed, pieces, staged

SEED = 42
SHINGLE = 3
THRESHOLD = 3
#: Covering radius of the code of one half.
HALF_RADIUS = 12
#: Most homes and copies of one anchor that one comparison holds.
HOMES, COPIES = 4096, 16384


def _codewords() -> np.ndarray:
    """The 64 words of the first-order Reed-Muller code of length 32: linear functions and their complements."""
    x = np.arange(32, dtype=np.uint32)
    linear = [int(sum(1 << int(i) for i in x if bin(int(a & i)).count("1") % 2)) for a in x]
    return np.array(linear + [w ^ 0xFFFFFFFF for w in linear], dtype=np.uint32)


CODE = _codewords()


def fingerprint(data: bytes | None) -> int:
    """The SimHash of a whole text over its three-word shingles, as a signed 64-bit number; 0 without words."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for piece in pieces((data or b"").lower()):
        words = tail + piece.split()
        if len(words) >= SHINGLE:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
            hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
        tail = words[-(SHINGLE - 1) :]
    if not total:
        if not tail:
            return 0
        total, whole = 1, np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], dtype="<u8")
        ones = np.unpackbits(whole.view(np.uint8), bitorder="little").astype(np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def of_set(hashes: np.ndarray) -> int:
    """The SimHash of distinct shingles given by their hashes, as a signed 64-bit number; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        ones += np.unpackbits(hashes[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(x.as_py()) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(_fingerprints, "doc_id long, fp long")


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number and anchor of every copy, and whether it is the row's home."""
    bits = fps.astype(np.int64).view(np.uint64)
    low = np.bitwise_count((bits & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None] ^ CODE)
    high = np.bitwise_count((bits >> np.uint64(32)).astype(np.uint32)[:, None] ^ CODE)
    own = low.min(axis=1) + high.min(axis=1)
    home = high.argmin(axis=1) * len(CODE) + low.argmin(axis=1)
    reach = np.minimum(own, 2 * HALF_RADIUS) + threshold
    near = (high[:, :, None] + low[:, None, :]).reshape(len(fps), -1) <= reach[:, None]
    row, anchor = np.nonzero(near)
    return row, anchor, home[row] == anchor


def _copies(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for at in range(0, len(fps), 1024):
                part = fps[at : at + 1024]
                row, anchor, home = anchors(part, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(home), pa.array(part[row])], ["anchor", "home", "fp"])

    return run


def _compared(threshold: int):
    def run(group: pa.Table) -> pa.Table:
        fps, home = group.column("fp").to_numpy(), group.column("home").to_numpy(zero_copy_only=False)
        nodes, place = np.unique(fps, return_inverse=True)
        homes, copies = np.unique(place[home]), np.unique(place[group.column("copy").to_numpy(zero_copy_only=False)])
        label, bits = np.arange(len(nodes)), nodes.view(np.uint64)
        for at in range(0, len(homes), 128):
            part = homes[at : at + 128]
            near = np.bitwise_count(bits[part][:, None] ^ bits[copies][None, :]) <= threshold
            for i in np.nonzero(near.any(axis=1))[0]:
                met = np.unique(label[np.append(copies[near[i]], part[i])])
                if len(met) > 1:  # one tree for all that meet here, under the least
                    label[np.isin(label, met)] = met[0]
        moved = np.nonzero(label != np.arange(len(nodes)))[0]
        return pa.table({"a": nodes[moved], "b": nodes[label[moved]]})

    return run


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that join all within ``threshold`` bits of each other.

    Each comparison gives trees over what it saw to be linked, not all its pairs. A crowded anchor
    is compared in blocks: homes by copies, each block of a bounded size.
    """
    copies = staged(fps.select("fp").mapInArrow(_copies(threshold), "anchor int, home boolean, fp long"))
    crowd = copies.groupBy("anchor").agg(
        F.ceil(F.count_if("home") / HOMES).cast("int").alias("_h"), F.ceil(F.count("*") / COPIES).cast("int").alias("_c")
    ).where("_h > 0")
    placed = copies.join(F.broadcast(crowd), "anchor")  # at most one row for each of the 4,096 anchors
    spot = lambda n: F.pmod(F.xxhash64("fp", F.lit("block")), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_home = placed.where("home").withColumn("_x", spot("_h")).withColumn("_y", others("_c")).withColumn("copy", F.lit(False))
    as_copy = placed.withColumn("home", F.lit(False)).withColumn("_y", spot("_c")).withColumn("_x", others("_h")).withColumn("copy", F.lit(True))
    keys = ["anchor", "_x", "_y"]
    blocks = as_home.select(*keys, "home", "copy", "fp").unionByName(as_copy.select(*keys, "home", "copy", "fp"))
    return blocks.groupBy(*keys).applyInArrow(_compared(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (doc_id, text).

    Fingerprints link at ``threshold`` or fewer differing bits; component_id is the least doc_id
    reachable over links. A null or empty text has fingerprint zero and links like any other. A
    null doc_id keeps its row and carries links, but names no component (null where no member
    has an id). Repeated rows give repeated rows; other columns of ``docs`` are not looked at;
    no rows give no rows.
    """
    marked = staged(fingerprints(docs))
    classes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes, threshold)).withColumnRenamed("node", "fp")
    rooted = staged(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return marked.join(named.select("fp", "component_id"), "fp").select("doc_id", text, "component_id")


def keep_first(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without those that are near copies of one with a lower doc_id; all columns stay.

    A document stays if its component is its own; of repeated rows of one doc_id all stay
    (they are one document), and so do documents without an id.
    """
    found = near_duplicates(docs, threshold).where("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct()
    return packed(docs, id=F.col("doc_id").cast("long")).join(found, F.col("id") == F.col("gone"), "left_anti").select("row.*")
