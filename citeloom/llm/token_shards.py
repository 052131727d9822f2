"""Training-order materialisation of token ids.

All documents' tokens, each document closed by an end token, form one stream that is cut into
sequences of equal length. A keyed Feistel permutation of the sequence numbers, walked along
its cycles until it falls below their count, gives every sequence its global slot. Range
partitions of the slots are shards of fixed stride, so slot s lies at byte
(s mod sequences per shard) x stride of shard s div sequences per shard.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import shared_dir

#: Byte-pair ranks, one base64 token and rank per line, and the pattern that cuts text before merging.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The id after the last rank closes a document and fills the last sequence.
END = 50256
#: Tokens of a sequence, sequences of a shard, partitions at most.
LENGTH, PER_SHARD, MOST_PARTITIONS = 2048, 2048, 100_000
KEY = 20240229
ROUNDS = 6
#: Most bytes of a vocabulary file: it goes to every task.
VOCABULARY = 64 << 20
#: Rows whose tokens are held and sent on at a time.
SLICE = 512

PIECES = "seq long, slot long, pos int, doc_id long, piece binary"
SEQUENCES = "shard int, slot long, offset long, seq long, n_tokens int, doc_ids array<long>, tokens binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input bears on every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(numbers: np.ndarray, count: int, key: int = KEY) -> np.ndarray:
    """The slot of each sequence number: a permutation of 0 to ``count`` - 1."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mix(np.uint64(key) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = numbers.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> shift, x[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        x[todo] = (left << shift) | right
        todo = x >= count
    return x.astype(np.int64)


def encoder(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def _tokens(ranks, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value).encode_to_numpy
        segment, before = TaskContext.get().partitionId(), 0
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            found = [np.append(encode(x.as_py() or "", disallowed_special=()), end).astype("<u2").tobytes() for x in batch.column("text")]
            lengths = np.array([len(x) // 2 for x in found], np.int64)
            starts = before + np.cumsum(lengths) - lengths
            before += int(lengths.sum())
            columns = [pa.array(np.full(len(found), segment, np.int32)), pa.array(starts), batch.column("doc_id"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["segment", "start", "doc_id", "tokens"])

    return run


def _pieces(length: int, count: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            seqs, places, docs, parts = [], [], [], []
            for doc, start, tokens in zip(batch.column("doc_id").to_pylist(), batch.column("start").to_pylist(), batch.column("tokens")):
                data, at = tokens.as_py(), 0
                while at < len(data):
                    seq, pos = divmod(start + at // 2, length)
                    part = data[at : at + 2 * (length - pos)]
                    seqs.append(seq), places.append(pos), docs.append(doc), parts.append(part)
                    at += len(part)
            numbers = np.array(seqs, np.int64)
            columns = [pa.array(numbers), pa.array(slots(numbers, count, key)), pa.array(places, pa.int32()), pa.array(docs, pa.int64()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["seq", "slot", "pos", "doc_id", "piece"])

    return run


def _assembled(length: int, per_shard: int, end: int):
    pad = np.uint16(end).tobytes()
    names = ["shard", "slot", "offset", "seq", "n_tokens", "doc_ids", "tokens"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        slot, seq, docs, parts = None, None, [], []

        def close() -> None:
            if slot is not None:
                data = b"".join(parts)
                rows.append((slot // per_shard, slot, slot % per_shard * length * 2, seq, len(data) // 2, docs, data + pad * (length - len(data) // 2)))

        for batch in batches:
            for s, q, doc, part in zip(*(batch.column(c).to_pylist() for c in ("slot", "seq", "doc_id", "piece"))):
                if s != slot:
                    close()
                    slot, seq, docs, parts = s, q, [], []
                docs.append(doc)
                parts.append(part)
                if len(rows) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def sequences(docs: DataFrame, ranks: str = RANKS, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, end: int = END) -> DataFrame:
    """``shard, slot, offset, seq, n_tokens, doc_ids, tokens`` of every sequence of ``docs`` (doc_id, text), in slot order within a partition.

    tokens are ``length`` little-endian 16-bit ids, offset is their place in the shard's file;
    doc_ids are the documents in the sequence, in order, once per piece. The stream follows the
    input's partitions and rows. A null or empty text is an end token alone; the last sequence is
    filled up with end tokens, n_tokens counts those before. Null doc_ids stay null; repeated
    rows are repeated; other columns are not looked at; no rows give no rows.
    """
    spark = docs.sparkSession
    with open(ranks, "rb") as file:
        vocabulary = file.read(VOCABULARY + 1)
    if len(vocabulary) > VOCABULARY:
        raise ValueError(f"{ranks} is larger than {VOCABULARY} bytes")
    known = spark.sparkContext.broadcast(vocabulary)  # a bounded file
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}"  # tokens are dense: worth a better codec than usual
    schema = "segment int, start long, doc_id long, tokens binary"
    texts.mapInArrow(_tokens(known, end), schema).write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(schema).parquet(path)
    ends = tokens.groupBy("segment").agg(F.max(F.col("start") + F.expr("length(tokens) div 2")).alias("n"))
    earlier = F.sum("n").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    bases = ends.select("segment", "n", F.coalesce(earlier, F.lit(0)).alias("base"))  # one row per task of the first pass
    total = bases.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = -(-total // length)
    placed = tokens.join(F.broadcast(bases), "segment").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "tokens")
    pieces = placed.mapInArrow(_pieces(length, count, key), PIECES)
    shards = max(1, -(-count // per_shard))
    partitions = min(shards, MOST_PARTITIONS)
    by_shard = F.expr(f"cast((slot div {per_shard}) * {partitions} div {shards} as int)")
    ordered = pieces.repartitionById(partitions, by_shard).sortWithinPartitions("slot", "pos")
    return ordered.mapInArrow(_assembled(length, per_shard, end), SEQUENCES)


def _name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(rows: DataFrame, path: str) -> DataFrame:
    """Write ``sequences`` as one file of fixed-stride records per shard; returns ``shard, first_slot, records, bytes``.

    A shard is written by one task under a name of its own and then renamed, so a task that runs
    again after a lost executor leaves the same files. ``path`` is a folder or URI that all
    executors reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root)
        shard, file, part, done, first, n, size = None, None, "", [], 0, 0, 0

        def close() -> None:
            if file is not None:
                file.close()
                store.move(part, f"{root}/{_name(shard)}")
                done.append((shard, first, n, size))

        for batch in batches:
            for s, slot, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "tokens"))):
                if s != shard:
                    close()
                    part = f"{root}/.{_name(s)}-{uuid.uuid4().hex}"
                    shard, file, first, n, size = s, store.open_output_stream(part), slot, 0, 0
                file.write(data)
                n, size = n + 1, size + len(data)
        close()
        columns = list(zip(*done)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["shard", "first_slot", "records", "bytes"])

    out = rows.select("shard", "slot", "tokens").repartition("shard").sortWithinPartitions("shard", "slot").mapInArrow(run, "shard int, first_slot long, records long, bytes long")
    out.write.mode("overwrite").parquet(f"{path}/manifest")
    return rows.sparkSession.read.parquet(f"{path}/manifest")


def read_from(path: str, slot: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """The sequences from ``slot`` on, in training order: what a run that stopped there reads next."""
    store, root = fs.FileSystem.from_uri(path)
    while slot < count:
        with store.open_input_file(f"{root}/{_name(slot // per_shard)}") as file:
            file.seek(slot % per_shard * length * 2)
            while data := file.read(length * 2):
                yield np.frombuffer(data, "<u2")
                slot += 1
