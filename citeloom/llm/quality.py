"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from every whole text in one pass. Trees are grown on a bounded sample of
the labelled rows, binned by quantiles, and flattened into arrays; scoring walks all rows of a
batch down all trees at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import packed, pieces, staged, without

#: Most labelled rows that trees are grown on: those with the least hash of doc_id.
SAMPLE = 40_000
TREES, DEPTH, BINS, RATE, LEAST_HESSIAN, RIDGE = 80, 4, 64, 0.15, 0.25, 1.0
#: A score from here on predicts 1.
ACCEPT = 0.7
#: Rows are held out whose crc32 has this remainder by 4.
HELD_OUT = 2

FEATURES = (
    "log_bytes", "log_words", "word_length", "space", "upper", "lower", "digit", "symbol", "stop_mark", "comma", "other_ascii", "beyond_ascii", "distinct_words", "top_word",
    "top_five", "pair_repeats", "short_words", "long_words", "symbol_words", "upper_words", "marked_ends", "log_lines", "line_length", "repeated_lines", "ended_lines", "bars",
)

_KINDS = {
    "space": b" \t\n\r\x0b\x0c", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "symbol": b"#$%&*+/<=>@\\^_`|~{}[]",
    "stop_mark": b".!?", "comma": b",;:", "beyond_ascii": bytes(range(128, 256)),
}
_TABLE = np.full(256, len(_KINDS), np.int64)
for _n, _chars in enumerate(_KINDS.values()):
    _TABLE[list(_chars)] = _n
_SYMBOLS = re.compile(rb"[#$%&*|@^~<>]")


def statistics(data: bytes | None) -> list[float]:
    """The ``FEATURES`` of a whole text; all 0 for an empty one."""
    data = data or b""
    if not data.strip():
        return [0.0] * len(FEATURES)
    kinds = np.zeros(len(_KINDS) + 1, np.int64)
    for at in range(0, len(data), 1 << 22):
        kinds += np.bincount(_TABLE[np.frombuffer(data[at : at + (1 << 22)], np.uint8)], minlength=len(kinds))
    share = dict(zip([*_KINDS, "other_ascii"], kinds / len(data)))
    counts: Counter = Counter()
    n = short = long = upper = symbols = marked = pairs = again = 0
    total = 0
    for piece in pieces(data):
        found = piece.split()
        n += len(found)
        counts.update(found)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        total += int(lengths.sum())
        short += int((lengths <= 2).sum())
        long += int((lengths > 14).sum())
        upper += sum(map(bytes.isupper, found))
        symbols += sum(1 for w in found if not w.isalnum() and _SYMBOLS.search(w))
        marked += sum(1 for w in found if w[-1:] in b"!?*#%&$")
        pairs += max(0, len(found) - 1)
        again += max(0, len(found) - 1) - len(set(zip(found, found[1:])))
    lines = [x for x in data.split(b"\n") if x.strip()]
    top = [c for _, c in counts.most_common(5)]
    return [
        np.log1p(len(data)), np.log1p(n), total / n, share["space"], share["upper"], share["lower"], share["digit"], share["symbol"], share["stop_mark"], share["comma"],
        share["other_ascii"], share["beyond_ascii"], len(counts) / n, top[0] / n, sum(top) / n, again / max(1, pairs), short / n, long / n, symbols / n, upper / n, marked / n,
        np.log1p(len(lines)), np.log1p(len(data) / len(lines)), 1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines), data.count(b" | ") / n,
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(x.as_py()) for x in batch.column("text")], np.float64).reshape(-1, len(FEATURES))
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, len(FEATURES)), pa.int32()), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], ["doc_id", "features"])


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, features`` of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(_statistics, "doc_id long, features array<double>")


@dataclass
class Trees:
    """Trees in arrays, all of one full shape: inner node i has the children 2i + 1 and 2i + 2."""

    base: float
    feature: np.ndarray  # tree, inner node
    threshold: np.ndarray  # tree, inner node: greater goes right
    leaf: np.ndarray  # tree, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-margin))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost trees for logistic loss on histograms of binned columns; y holds 0 to 1."""
    mean = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)  # above cut k: bin > k
    width = bins.shape[1]
    margin = np.full(len(y), base)
    all_f, all_t, all_l = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, count = (1 << depth) - 1, 1 << depth
            spot = ((node - first)[:, None] * width + np.arange(width)) * BINS + bins
            g = np.bincount(spot.ravel(), np.repeat(grad, width), count * width * BINS).reshape(count, width, BINS)
            h = np.bincount(spot.ravel(), np.repeat(hess, width), count * width * BINS).reshape(count, width, BINS)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hl < LEAST_HESSIAN) | (ht - hl < LEAST_HESSIAN)] = 0
            for k in range(count):
                f, b = np.unravel_index(np.argmax(gain[k]), gain[k].shape)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[first + k], threshold[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = -RATE * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + RIDGE)
        margin += leaf[at]
        all_f.append(feature), all_t.append(threshold), all_l.append(leaf)
    return Trees(base, np.array(all_f), np.array(all_t), np.array(all_l))


def held_out(doc_id):
    """Whether a row is never learnt from: by the crc32 of its doc_id as text; a null doc_id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(True))


def train(known: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from documents' features and the labels (doc_id, quality) of rows that aren't held out.

    Only ``sample`` rows are read by the driver, chosen by a hash of doc_id. A document labelled
    more than once counts with the mean; null labels count for nothing. Without labels of both
    kinds every score is the same: their mean, or 0.5.
    """
    marked = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    one = known.join(marked, "doc_id").dropDuplicates(["doc_id"])
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("features", "quality").toArrow()
    x = np.array(rows.column("features").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return grow(x, rows.column("quality").to_numpy())


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, quality).

    score is the probability of label 1 and depends on the text alone; predicted is 1 from
    ``ACCEPT`` on. Null and empty texts are scored as texts of length 0. A null doc_id counts as
    held out. Repeated rows give repeated rows; other columns are not looked at; no rows give no rows.
    """
    known = staged(features(docs))
    trees = train(known, labels, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.score(x))], ["doc_id", "score"])

    found = known.mapInArrow(score, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted 0; all columns stay. Rows of one doc_id stay if any of them is accepted."""
    judged = scored(docs, labels).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("predicted").alias("good"))
    bad = staged(judged.where("good = 0").select("id"))
    return without(packed(docs, id=F.col("doc_id").cast("long")), bad, ["id"]).select("row.*")
