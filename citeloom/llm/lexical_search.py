"""Ranked lexical search of many queries at once, with shared parts of the queries evaluated once.

Terms that stand in the same items, and sets of terms that several items share, become nodes of a
graph: a node's accumulator holds, for each document of a block, the summed scores of its terms. It
is filled once, from the accumulators below it, and every item or larger set that contains it takes
it from there; an item's score is the sum of the few nodes that it is made of.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import staged

#: Documents returned for an item.
BEST = 50
#: Items and characters of items that one pass over the documents searches for.
ITEMS, CHARS = 2_000, 4_000_000
#: Bytes of accumulators that a task holds; rows that it passes on at a time.
HELD = 32 << 20
#: Bytes of a text that are split at a time.
PIECE = 1 << 20
#: Groups of task results that meet before the last ranking.
GROUPS = 64

_UPPER = range(0x41, 0x5B)
#: Every byte of a term to itself, A-Z to lower case, all other bytes below 128 to a space.
_TERMS = bytes(b + 32 if b in _UPPER else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def split(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, those of about ``PIECE`` bytes at a time."""
    data = text.translate(_TERMS)
    at = 0
    while len(data) - at > PIECE:
        end = data.find(b" ", at + PIECE)
        if end < 0:
            break
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def terms(text: str | None) -> list[bytes]:
    return [t for part in split((text or "").encode("utf-8", "replace")) for t in part]


class Plan:
    """How the scores of ``items`` (sets of numbers below ``leaves``) are put together.

    Nodes below ``leaves`` are single terms. ``made[n]`` lists the nodes that node ``leaves + n`` is
    the sum of, all of lower number; ``of[i]`` lists the nodes that item i is the sum of. No term
    comes twice in a sum.
    """

    def __init__(self, items: list[set[int]], leaves: int):
        self.leaves, self.made = leaves, []
        holders: dict[int, list[int]] = defaultdict(list)
        for i, item in enumerate(items):
            for t in item:
                holders[t].append(i)
        alike: dict[tuple, list[int]] = defaultdict(list)
        for t in sorted(holders):
            alike[tuple(holders[t])].append(t)
        self.of: list[list[int]] = [[] for _ in items]
        count: dict[int, int] = {}
        for held, same in sorted(alike.items()):
            node = self._node(same) if len(same) > 1 and len(held) > 1 else None
            for n in same if node is None else [node]:
                count[n] = len(held)
                for i in held:
                    self.of[i].append(n)
        order = lambda n: (-count[n], n)
        while True:  # neighbours in a common order, so that equal sets meet as equal pairs
            pairs: Counter = Counter()
            for nodes in self.of:
                nodes.sort(key=order)
                pairs.update(zip(nodes, nodes[1:]))
            shared = {p for p, n in pairs.items() if n > 1}
            if not shared:
                break
            taken: dict[tuple, list] = defaultdict(list)
            for i, nodes in enumerate(self.of):
                for at in self._chosen(nodes, shared, pairs):
                    taken[nodes[at], nodes[at + 1]].append((i, at))
            for pair, places in sorted(taken.items()):
                node = self._node(list(pair)) if len(places) > 1 else None
                if node is not None:
                    count[node] = len(places)
                for i, at in places if node is not None else ():
                    self.of[i][at], self.of[i][at + 1] = node, -1
            if not any(-1 in nodes for nodes in self.of):
                break
            self.of = [[n for n in nodes if n >= 0] for nodes in self.of]

    def _node(self, parts: list[int]) -> int:
        self.made.append(parts)
        return self.leaves + len(self.made) - 1

    @staticmethod
    def _chosen(nodes: list[int], shared: set, pairs: Counter) -> list[int]:
        """Places of pairs of ``nodes`` that don't overlap, the most frequent pairs first."""
        places = [at for at in range(len(nodes) - 1) if (nodes[at], nodes[at + 1]) in shared]
        places.sort(key=lambda at: (-pairs[nodes[at], nodes[at + 1]], nodes[at], nodes[at + 1]))
        used, out = set(), []
        for at in places:
            if at not in used and at + 1 not in used:
                used |= {at, at + 1}
                out.append(at)
        return out

    def additions(self) -> int:
        """Sums of two numbers that one document takes."""
        return sum(len(p) - 1 for p in self.made) + sum(max(0, len(n) - 1) for n in self.of)

    def scores(self, leaf: np.ndarray) -> np.ndarray:
        """Scores (item, document) from those of the single terms (term, document)."""
        filled = np.zeros((self.leaves + len(self.made), leaf.shape[1]), np.int64)
        filled[: self.leaves] = leaf
        for n, parts in enumerate(self.made):
            np.add.reduce(filled[parts], axis=0, out=filled[self.leaves + n])
        out = np.zeros((len(self.of), leaf.shape[1]), np.int64)
        for i, nodes in enumerate(self.of):
            if nodes:
                np.add.reduce(filled[nodes], axis=0, out=out[i])
        return out


def _found(vocabulary):
    """Of each document that has terms: how many, and the known ones with how often they occur."""
    types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        none = len(known)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                n, times = 0, np.zeros(0, np.int64)
                for part in split(text.as_py() or b""):
                    n += len(part)
                    more = np.bincount(np.fromiter(map(known.get, part, repeat(none)), np.int64, len(part)), minlength=none + 1)
                    times = more if not len(times) else times + more
                if n:
                    held = np.flatnonzero(times[:none])
                    out.append((doc, n, held.astype(np.int32), times[held]))
            columns = list(zip(*out)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["doc_id", "n", "held", "tf"])

    return run


class _Best:
    """The best ``k`` documents of each item so far: higher scores first, then lower doc_ids, nulls last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows: list[list] = [[] for _ in range(items)]

    def add(self, scores: np.ndarray, docs: list) -> None:
        item, at = np.nonzero(scores >= self.least[:, None])
        for i, d, s in zip(item.tolist(), at.tolist(), scores[item, at].tolist()):
            doc = docs[d]
            self.rows[i].append((-s, doc is None, doc or 0))
            if len(self.rows[i]) >= 8 * self.k:
                self._cut(i)
        for i in set(item.tolist()):
            if len(self.rows[i]) >= self.k:
                self._cut(i)

    def _cut(self, i: int) -> None:
        self.rows[i] = sorted(self.rows[i])[: self.k]
        if len(self.rows[i]) == self.k:
            self.least[i] = -self.rows[i][-1][0]


def _ranked(searched, k: int):
    types = (pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights, ids, total, words = searched.value
        best = _Best(len(ids), k)
        step = max(1, HELD // (8 * (plan.leaves + len(plan.made) + len(ids) + 1)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                n = rows.column("n").to_numpy()
                held, tf = rows.column("held"), rows.column("tf").flatten().to_numpy()
                term = held.flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(rows.num_rows), np.diff(held.offsets.to_numpy()))
                m = 100 - 50 + (50 * n * total) // words
                leaf = np.zeros((plan.leaves, rows.num_rows), np.int64)
                leaf[term, row] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
                best.add(plan.scores(leaf), rows.column("doc_id").to_pylist())
        out = [(ids[i], None if none else doc, -s) for i, rows in enumerate(best.rows) for s, none, doc in sorted(rows)[:k]]
        columns = list(zip(*out)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["item_id", "doc_id", "score"])

    return run


def _first(rows: DataFrame, k: int, *also: Column) -> DataFrame:
    order = Window.partitionBy("item_id", *also).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Scores are whole numbers above 0, as many rows as there are such documents if fewer than ``k``;
    equal scores rank by doc_id, nulls last. Every row of ``docs`` counts as a document, repeated
    ids too; null and empty texts have no terms and count nowhere. Items of null id are left out; of
    repeated ids the least text counts; items without terms have no rows. Other columns are not
    looked at. Statistics cover all documents. Items go in blocks of a bounded size, each with
    one pass over the texts; a task passes on no more than ``k`` rows for an item.
    """
    spark = docs.sparkSession
    one = items.where("item_id is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    known = staged(one)
    n, chars = known.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-chars // CHARS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = None
    for block in range(blocks):
        mine = {r.item_id: set(terms(r.text)) for r in known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator()}  # bounded
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*mine.values())))}
        held = staged(texts.mapInArrow(_found(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, held array<int>, tf array<long>"))
        total, words = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        spread = held.select(F.explode("held").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weights = np.zeros(len(vocabulary), np.int64)
        for term, df in spread.toLocalIterator():  # one row per term of the block's items
            weights[term] = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
        ids = sorted(mine)
        plan = Plan([{vocabulary[t] for t in mine[i]} for i in ids], len(vocabulary))
        searched = spark.sparkContext.broadcast((plan, weights, ids, total, words))
        hits = held.mapInArrow(_ranked(searched, k), "item_id long, doc_id long, score long")
        found = hits if found is None else found.unionByName(hits)
    group = F.pmod(F.spark_partition_id(), F.lit(GROUPS))
    near = _first(found.withColumn("group", group), k, F.col("group"))
    return _first(near.drop("rank", "group"), k).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""with words as materialized (
  select doc_id, t from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents)),
sizes as materialized (select doc_id, count(*) as n from words group by doc_id),
whole as materialized (select count(*) as docs, sum(n)::bigint as terms from sizes),
asked as materialized (
  select distinct item_id, t from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark)),
held as materialized (select doc_id, t, count(*) as tf from words where t in (select t from asked) group by doc_id, t),
weights as materialized (
  select t, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from held, whole group by t),
parts as materialized (
  select doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))) as s
  from held join weights using (t) join sizes using (doc_id), whole),
scores as (select item_id, doc_id, sum(s)::bigint as score from asked join parts using (t) group by item_id, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scores where score > 0 qualify rank <= 50"""
