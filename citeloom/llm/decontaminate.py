"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND with every passage.

Impacts are shares of an item's own score, so that a passage that holds every term of an item
scores 1. Passages overlap by half and are twice as long as the longest item: each item copied
into a document lies whole in some passage. All items above the threshold come back; they stay
if question and answer both are found in order in one stretch of the document.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import packed, staged

K1, B = 1.2, 0.75
#: Least share of an item's own score.
SCORE = 0.6
#: Least share of the question's words, and of the answer's, found in order.
OVERLAP = 0.8
#: Entries of a postings block that share one maximum.
POSTINGS = 64
#: Items and characters that one pass over the documents searches for.
ITEMS, CHARS = 20_000, 16_000_000
#: Shortest passage.
PASSAGE = 64
#: Most that an item can score by terms that are not essential; below SCORE.
REST = 0.25
#: Words that are looked up together.
TOGETHER = 400_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORD.findall((text or "").lower())


def split_items(benchmark: DataFrame) -> DataFrame:
    """``item_id, question, answer`` of items that are one text: no part of it is an answer of its own, so all of it is verified as one."""
    return benchmark.select("item_id", F.col("text").alias("question"), F.lit(None).cast("string").alias("answer"))


def found_enough(share: float, length: int, overlap: float) -> bool:
    """Whether a part of ``length`` words is found: to ``overlap``, or but for one word if it is a short one of several words."""
    return share >= overlap or length > 1 and share * length > length - 1.5


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for item, question, answer in zip(*(batch.column(c).to_pylist() for c in ("item_id", "question", "answer"))):
            found = words(question) + words(answer)
            out += [(item, t, n, len(found)) for t, n in Counter(found).items()]
        columns = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["item_id", "term", "tf", "length"])


def impacts(items: DataFrame) -> DataFrame:
    """``item_id, term, impact``: BM25 weights of an item's terms as shares of their sum, from statistics of all items."""
    terms = staged(items.select("item_id", "question", "answer").mapInArrow(_terms, "item_id long, term string, tf long, length long"))
    spread = terms.groupBy("term").agg(F.count("*").alias("df"))
    whole = terms.select("item_id", "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    weighed = terms.join(spread, "term").crossJoin(F.broadcast(whole)).select("item_id", "term", (idf * tf).alias("w"))  # one row
    own = weighed.groupBy("item_id").agg(F.sum("w").alias("own"))
    return weighed.join(own, "item_id").select("item_id", "term", (F.col("w") / F.col("own")).alias("impact"))


class Index:
    """Postings by term, ordered by item, in blocks with their greatest impact; and the items to verify."""

    def __init__(self, rows: list[tuple], items: dict[int, tuple[list[str], list[str]]]):
        self.items, self.terms = items, {}
        by_term: dict[str, list] = defaultdict(list)
        for item, term, impact in rows:
            by_term[term].append((item, impact))
        self.postings = []
        for n, (term, entries) in enumerate(sorted(by_term.items())):
            entries.sort()
            ids, values = [i for i, _ in entries], [v for _, v in entries]
            cut = range(0, len(ids), POSTINGS)
            self.postings.append((ids, values, [ids[min(at + POSTINGS, len(ids)) - 1] for at in cut], [max(values[at : at + POSTINGS]) for at in cut]))
            self.terms[term] = n
        self.bounds = np.array([max(p[1]) for p in self.postings] + [0.0])  # the last is for words of no item
        longest = max((len(q) + len(a) for q, a in items.values()), default=0)
        self.passage = max(PASSAGE, 2 * longest)
        self._essential()

    def _essential(self) -> None:
        """Postings of the essential terms, and what an item needs of them.

        Frequent terms are left out as long as every item keeps more than it would need without
        them: an item's rest says how much its other terms can add at most.
        """
        place = {item: n for n, item in enumerate(sorted({i for ids, *_ in self.postings for i in ids}))}
        self.rest = np.zeros(len(place))
        self.sizes = np.zeros(len(self.postings) + 1, np.int64)
        rows, values = [], []
        for t in sorted(range(len(self.postings)), key=lambda t: (-len(self.postings[t][0]), t)):
            at, impact = np.array([place[i] for i in self.postings[t][0]]), np.array(self.postings[t][1])
            if (self.rest[at] + impact <= REST).all():
                self.rest[at] += impact
            else:
                self.sizes[t] = len(at)
                rows.append((t, at, impact))
        rows.sort(key=lambda r: r[0])
        self.item = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.int64)
        self.impact = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0)
        self.first = np.cumsum(self.sizes) - self.sizes


def promising(index: Index, ids: np.ndarray, lengths: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of texts given as term ids, laid end to end, the passages in which some item can score ``least``: text, passage.

    The sum of an item's essential terms in the passage and of its rest bounds its score.
    """
    step = index.passage // 2
    counts = np.where(lengths > 0, np.maximum(1, -(-(lengths - index.passage) // step) + 1), 0)
    base = np.cumsum(counts) - counts
    place = np.flatnonzero(index.sizes[ids])
    text = np.repeat(np.arange(len(lengths)), lengths)[place]
    spot = (place - (np.cumsum(lengths) - lengths)[text]) // step
    inside = np.concatenate([spot, spot - 1])
    text, term = np.tile(text, 2), np.tile(ids[place], 2)
    good = (inside >= 0) & (inside < counts[text])
    width = len(index.sizes)
    met = np.unique((base[text] + inside)[good] * width + term[good])  # a term counts once for a passage
    passage, term = met // width, met % width
    n = index.sizes[term]
    entry = np.repeat(index.first[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    key, where = np.unique(np.repeat(passage, n) * (len(index.rest) + 1) + index.item[entry], return_inverse=True)
    score = np.bincount(where, index.impact[entry], len(key)) + index.rest[key % (len(index.rest) + 1)]
    found = np.unique(key[score >= least - 1e-9] // (len(index.rest) + 1))
    of = np.searchsorted(base, found, side="right") - 1
    return of, found - base[of]


def search(index: Index, terms: list[int], least: float) -> list[tuple[int, float]]:
    """All items with a score of at least ``least`` for the distinct ``terms``: block-max WAND with a fixed threshold."""
    least -= 1e-9
    cursors = [[0, t] for t in terms]  # place in the postings, term
    found = []

    def at(c: list[int]) -> float:
        ids = index.postings[c[1]][0]
        return ids[c[0]] if c[0] < len(ids) else math.inf

    while True:
        cursors = sorted((c for c in cursors if at(c) < math.inf), key=at)
        bound, pivot = 0.0, None
        for n, c in enumerate(cursors):
            bound += index.bounds[c[1]]
            if bound >= least:
                pivot = n
                break
        if pivot is None:
            return found
        item = at(cursors[pivot])
        while pivot + 1 < len(cursors) and at(cursors[pivot + 1]) == item:
            pivot += 1
        block_bound, block_end = 0.0, math.inf
        for c in cursors[: pivot + 1]:
            _, _, ends, tops = index.postings[c[1]]
            block = bisect_left(ends, item)
            if block < len(ends):
                block_bound += tops[block]
                block_end = min(block_end, ends[block])
        if block_bound < least:  # no item up to the end of these blocks, or before the next list begins, can do
            onward = block_end + 1 if pivot + 1 == len(cursors) else min(block_end + 1, at(cursors[pivot + 1]))
        elif at(cursors[0]) == item:
            score = sum(index.postings[c[1]][1][c[0]] for c in cursors[: pivot + 1])
            if score >= least:
                found.append((item, score))
            onward = item + 1
        else:
            onward = item
        for c in cursors[: pivot + 1]:
            c[0] = bisect_left(index.postings[c[1]][0], onward, c[0])


def in_order(part: list[str], stretch: list[str]) -> float:
    """Length of the longest common subsequence as a share of ``part``, with ``part`` held in the bits of one number."""
    if not part:
        return 1.0
    where: dict[str, int] = defaultdict(int)
    for i, w in enumerate(part):
        where[w] |= 1 << i
    full = (1 << len(part)) - 1
    state = full
    for w in stretch:
        hit = state & where.get(w, 0)
        state = ((state + hit) | (state - hit)) & full
    return (len(part) - bin(state).count("1")) / len(part)


def verify(question: list[str], answer: list[str], passage: list[str]) -> tuple[float, float]:
    """Shares of question and answer found in order where the passage best lines up with the item."""
    item = question + answer
    places = defaultdict(list)
    for i, w in enumerate(item):
        places[w].append(i)
    votes = Counter(p - i for p, w in enumerate(passage) for i in places.get(w, ()))
    if not votes:
        return 0.0, 0.0
    at = max(votes.items(), key=lambda v: (v[1], -v[0]))[0]
    slack = 2 + len(item) // 8
    stretch = passage[max(0, at - slack) : max(0, at + len(item) + slack)]
    return in_order(question, stretch), in_order(answer, stretch)


def _hits(index: Index, texts: list[list[str]], least: float, overlap: float) -> Iterator[tuple]:
    """Text number, item, word, score and overlaps of every item found in some of ``texts``, where it is found best."""
    none, size, step = len(index.postings), index.passage, index.passage // 2
    lengths = np.array([len(t) for t in texts], np.int64)
    words_of = chain.from_iterable(texts)
    ids = np.fromiter(map(index.terms.get, words_of, repeat(none)), np.int64, int(lengths.sum()))
    starts = np.cumsum(lengths) - lengths
    best: dict[tuple, tuple] = {}
    for text, passage in zip(*(x.tolist() for x in promising(index, ids, lengths, least))):
        s, found = passage * step, texts[text]
        terms = np.unique(ids[starts[text] + s : starts[text] + min(s + size, len(found))])
        for item, score in search(index, terms[terms < none].tolist(), least):
            q, a = verify(*index.items[item], found[max(0, s - step) : s + size + step])
            question, answer = index.items[item]
            if q >= overlap and found_enough(a, len(answer), overlap) and (q + a, score) > best.get((text, item), (0.0, 0.0))[:2]:
                best[text, item] = (q + a, score, s, q, a)
    for (text, item), (_, score, s, q, a) in sorted(best.items()):
        yield text, item, s, score, q, a


def _searched(index_of, least: float, overlap: float):
    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = index_of.value
        for batch in batches:
            docs, texts, some, out = batch.column("doc_id").to_pylist(), [], 0, []
            first = 0
            for n, text in enumerate(batch.column("text")):
                texts.append(words(text.as_py()))
                some += len(texts[-1])
                if some >= TOGETHER or n + 1 == len(docs):
                    out += [(docs[first + t], *rest) for t, *rest in _hits(index, texts, least, overlap)]
                    first, texts, some = n + 1, [], 0
            columns = list(zip(*out)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "item_id", "word", "score", "question_overlap", "answer_overlap"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, least: float = SCORE, overlap: float = OVERLAP) -> DataFrame:
    """``doc_id, item_id, word, score, question_overlap, answer_overlap``: items (item_id, question, answer) found in ``docs`` (doc_id, text).

    One row for each row of ``docs`` and item, at the passage where it is found best; word is the
    place of the passage's first word. Null and empty texts have no words and hold nothing; items
    without words are not searched, an item without an answer is its question alone. Items of
    equal text are all found. Null item_ids are left out, repeated ones count once; a null doc_id
    comes back as such. Rows without hits give no row; other columns are not looked at. Items are
    searched in blocks of a bounded size, each with one pass over the documents.
    """
    spark = docs.sparkSession
    one = items.where("item_id is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min_by(F.struct("question", "answer"), F.struct("question", "answer")).alias("t"))
    known = staged(one.select("item_id", "t.question", "t.answer"))
    weights = staged(impacts(known))
    n, chars = known.agg(F.count("*"), F.coalesce(F.sum(F.coalesce(F.char_length("question"), F.lit(0)) + F.coalesce(F.char_length("answer"), F.lit(0))), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-chars // CHARS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block
        parts = {r.item_id: (words(r.question), words(r.answer)) for r in known.where(mine).toLocalIterator()}  # a block of bounded size
        rows = [tuple(r) for r in weights.where(mine).select("item_id", "term", "impact").toLocalIterator()]
        index = spark.sparkContext.broadcast(Index(rows, parts))
        hits = texts.mapInArrow(_searched(index, least, overlap), "doc_id long, item_id long, word long, score double, question_overlap double, answer_overlap double")
        found = hits if found is None else found.unionByName(hits)
    return found


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a test item; all columns stay. Documents without an id are judged together."""
    bad = staged(contaminated(docs, items).select(F.col("doc_id").alias("bad")).distinct())
    return packed(docs, id=F.col("doc_id").cast("long")).join(bad, F.col("id").eqNullSafe(F.col("bad")), "left_anti").select("row.*")
