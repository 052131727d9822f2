import zlib

import numpy as np

import corpus_pipeline
from citeloom.llm import decontaminate, mixing, quality, token_shards
from tests.llm.test_near_copies import plain

SF = "/root/testdata/sf0.001"


def test_each_stage_against_its_operator(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / str(n)))
        kept.append(spark.read.parquet(str(tmp_path / str(n))))
    assert all(x.columns == columns for x in kept[:-1])
    ids = lambda x: sorted(r.doc_id for r in x.select("doc_id").collect())

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = quality.scored(docs, labels).collect()
    assert ids(kept[1]) == sorted(r.doc_id for r in scores if r.score >= 0.7)
    bad = {r.doc_id for r in labels.collect() if r.quality == 0 and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    assert len(set(ids(kept[1])) & bad) <= len(bad) // 2

    links = plain([(r.doc_id, r.text, None) for r in kept[1].collect()])  # five-word shingles alike to 0.8, pair by pair
    assert ids(kept[2]) == sorted(i for i, root in links if root == i)

    items = decontaminate.split_items(spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    held = [r.doc_id for r in kept[2].collect() if any(r.text.find(f"{i.question}") >= 0 for i in items)]
    assert set(ids(kept[3])) == set(ids(kept[2])) - set(held)

    taken = {r.doc_id: r.taken / r.size for r in mixing.mixed(kept[3]).collect() if r.size}
    assert ids(kept[4]) == sorted(i for i, x in taken.items() for _ in range(int(x + 0.5)))

    encode = token_shards.encoder(open(token_shards.RANKS, "rb").read())
    stream = np.concatenate([np.frombuffer(r.tokens, "<u2")[: r.n_tokens] for r in kept[5].orderBy("seq").collect()])
    got, part = [], []
    for t in stream.tolist():
        if t == token_shards.END:
            got.append(encode.decode(part))
            part = []
        else:
            part.append(t)
    assert sorted(got) == sorted(r.text for r in kept[4].collect())
    assert corpus_pipeline.run(spark, SF).count() == kept[5].count()
