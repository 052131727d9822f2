import numpy as np
import pytest

from citeloom.llm import token_shards
from tests.llm.cases import docs, odd_rows


@pytest.mark.parametrize("count", [1, 2, 3, 7, 64, 1000, 4097])
def test_slots_permute(count):
    found = token_shards.slots(np.arange(count), count)
    assert sorted(found.tolist()) == list(range(count))
    if count > 60:
        assert found.tolist() != list(range(count))
        assert found.tolist() != token_shards.slots(np.arange(count), count, key=1).tolist()


def streams(rows, end=token_shards.END):
    encode = token_shards.encoder(open(token_shards.RANKS, "rb").read()).encode_ordinary
    return {(i, tuple(encode(t or "") + [end])) for i, t, _ in rows}


def test_exact_round_trip(spark, tmp_path):
    rows = odd_rows()
    frame = docs(spark, rows)
    made = token_shards.sequences(frame, length=16, per_shard=50)
    made.write.parquet(str(tmp_path / "rows"))
    made = spark.read.parquet(str(tmp_path / "rows"))
    found = made.orderBy("seq").collect()
    count = len(found)
    assert [r.seq for r in found] == list(range(count))
    assert sorted(r.slot for r in found) == list(range(count))
    stream = [t for r in found for t in np.frombuffer(r.tokens, "<u2")[: r.n_tokens].tolist()]
    want = [t for _, s in streams(rows) for t in s]
    encode = token_shards.encoder(open(token_shards.RANKS, "rb").read())
    texts, part = [], []
    for t in stream:
        if t == token_shards.END:
            texts.append(encode.decode(part))
            part = []
        else:
            part.append(t)
    assert sorted(texts) == sorted(t or "" for _, t, _ in rows)
    assert len(stream) >= len(want)
    assert all(len(r.tokens) == 32 and r.shard == r.slot // 50 and r.offset == r.slot % 50 * 32 for r in found)
    assert {i for r in found for i in r.doc_ids} == {i for i, *_ in rows}
    files = token_shards.write_shards(made, str(tmp_path / "shards"))
    assert files.agg({"records": "sum"}).first()[0] == count
    by_slot = {r.slot: r.tokens for r in found}
    for first in (0, 17, 50, count - 1):
        read = list(token_shards.read_from(str(tmp_path / "shards"), first, count, 16, 50))
        assert [x.tobytes() for x in read] == [by_slot[s] for s in range(first, count)]


def test_no_rows(spark):
    assert token_shards.sequences(docs(spark, [])).collect() == []


def test_large_vocabulary_is_refused(spark, tmp_path):
    (tmp_path / "ranks").write_bytes(b"x" * (token_shards.VOCABULARY + 1))
    with pytest.raises(ValueError):
        token_shards.sequences(docs(spark, []), ranks=str(tmp_path / "ranks"))
