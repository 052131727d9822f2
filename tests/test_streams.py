import pytest
from pyspark.sql import functions as F

from citeloom.streaming import conversation, imports, ingest, parts


def test_incremental_ingest(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def arrive(rows):
        spark.createDataFrame(rows, ingest.RAW_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ingest.RAW_SCHEMA).parquet(source)
        ingest.start_ingest(stream, out, mark, dim=4, size=40, overlap=5).awaitTermination()
        return {r["chunk_id"]: r["text"] for r in ingest.read_chunks(spark, out).collect()}

    first = arrive(
        [
            ("w", "a", "a.txt", "text/plain", "一行目\n二行目".encode()),
            ("w", "b", "b.md", "text/markdown", b"# T\nbody"),
            ("w", "v", "v.mp4", "video/mp4", b""),
            ("w", "x", "x.xlsx", "", b"zip"),
            ("w", "e", "e.txt", "text/plain", b"  \n"),
        ]
    )
    assert first == {"a:0": "一行目\n二行目", "b:0": "body", "v:0": "Video Title: v.mp4"}
    # a new version replaces the document, a failed one keeps the old chunks
    second = arrive([("w", "a", "a.txt", "text/plain", b"new " * 30), ("w", "b", "b.md", "text/markdown", b"")])
    assert second["b:0"] == "body" and second["a:0"].startswith("new") and len([c for c in second if c.startswith("a:")]) > 1
    runs = ingest.tables.read_log(spark, f"{out}/runs", ingest.RUNS)
    outcome = {r["document_id"]: r for r in runs.filter("version = 0").collect()}
    assert outcome["x"]["status"] == "failed" and outcome["x"]["tags"] == ["TABLE_EXTRACT_FAILED", "UNSUPPORTED_XLS"]
    assert outcome["e"]["reason"] == "Text document is empty"
    assert outcome["v"]["tags"] == ["EMBED_FALLBACK", "TITLE_ONLY", "VIDEO_CONTENT"] and outcome["a"]["chunk_count"] == 1


def test_uploads_of_one_batch(spark, tmp_path):
    """The newest upload counts, the others are on record; each chunk goes to the provider once; an error stays with its document."""
    source, out, calls = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "calls"
    calls.mkdir()
    rows = [
        ("w", "a", "a.txt", "text/plain", b"first version", 1), ("w", "a", "a.txt", "text/plain", b"second version", 2),
        ("w", "b", "b.txt", "text/plain", b"fails", 3), ("w", "c", "c.txt", "text/plain", b"fine", 4),
    ]
    schema = ingest.RAW_SCHEMA + ", arrived long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    folder = str(calls)

    def provider(texts):
        import uuid

        for t in texts:
            open(f"{folder}/{uuid.uuid4().hex}", "w").write(t)
        if "fails" in texts:
            raise RuntimeError("no vectors")
        return [[1.0, 0.0]] * len(texts)

    stream = spark.readStream.schema(schema).parquet(source)
    ingest.start_ingest(stream, out, str(tmp_path / "mark"), provider, dim=2, size=40, overlap=5).awaitTermination()
    chunks = {r["chunk_id"]: (r["text"], r["embedding"]) for r in ingest.read_chunks(spark, out).collect()}
    assert chunks == {"a:0": ("second version", [1.0, 0.0]), "b:0": ("fails", [0.0, 0.0]), "c:0": ("fine", [1.0, 0.0])}
    runs = ingest.tables.read_log(spark, f"{out}/runs", ingest.RUNS).collect()
    assert sorted((r["document_id"], r["status"], r["tags"]) for r in runs) == [
        ("a", "ready", []), ("a", "superseded", []), ("b", "ready", ["EMBED_FALLBACK"]), ("c", "ready", []),
    ]
    assert sorted(p.read_text() for p in calls.iterdir()) == ["fails", "fine", "second version"]


def test_only_a_missing_log_is_empty(spark, tmp_path):
    assert ingest.tables.read_log(spark, str(tmp_path / "none"), ingest.RUNS).collect() == []
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        ingest.tables.read_log(spark, str(tmp_path / "broken"), ingest.RUNS).collect()


def test_import_stream(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def arrive(rows):
        spark.createDataFrame(rows, imports.LISTING).coalesce(1).write.mode("append").parquet(source)
        imports.start_imports(spark.readStream.schema(imports.LISTING).parquet(source), out, mark).awaitTermination()
        return sorted((r["storage_key"], r["file_name"]) for r in imports.read_documents(spark, out).collect())

    assert arrive([("w", 1, "f1", "a.mp4", None, "1"), ("w", 2, "f2", "b.pdf", None, "1")]) == [("drive://f1", "a.mp4")]
    assert arrive([("w", 1, "f1", "renamed.mp4", None, "1"), ("w", 3, "f3", "c.webm", None, "1")]) == [("drive://f1", "a.mp4"), ("drive://f3", "c.webm")]


def _part(doc, kind, no, of, body, second, style=None, whole=None):
    import datetime

    return ("w", doc, kind, no, of, body, None, style, whole, datetime.datetime(2024, 1, 1, 0, 0, second % 60) + datetime.timedelta(seconds=second))


def test_documents_in_parts(spark, tmp_path):
    """Parts in any order, over several runs, repeated and missing; each document is ingested once, when it is whole."""
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    long = "a page of text that is long enough to count as native"

    def arrive(rows):
        spark.createDataFrame(rows, parts.PARTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(parts.PARTS).parquet(source)
        parts.start_parts(stream, out, mark, dim=4, size=400, overlap=0, patience=100).awaitTermination()
        return {r["document_id"]: (r["page_start"], r["page_end"], r["section_title"], r["text"]) for r in parts.read_chunks(spark, out).collect()}

    assert arrive([_part("a", "page", 2, 2, f"{long} two", 1), _part("b", "paragraph", 1, 2, "body", 1), _part("b", "paragraph", 0, 2, "Head", 1, "Heading 1"), _part(None, "page", 1, 1, "x", 1)]) == {
        "b": (None, None, "Head", "body")
    }
    # page 1 comes twice, the later one counts; c never gets its second page, d has nothing to read but its whole text
    got = arrive([_part("a", "page", 1, 2, "old", 2), _part("a", "page", 1, 2, f"{long} one", 3), _part("c", "page", 1, 2, long, 3), _part("d", "page", 1, 1, "", 3, whole="read from all of it")])
    assert got["a"] == (1, 2, None, f"{long} one\n{long} two") and got["d"][2:] == ("Document OCR", "read from all of it") and "c" not in got
    # e declares no number: it is taken as it is once time has moved on; f has no text at all
    got = arrive([_part("e", "page", 1, None, f"{long} e", 4), _part("f", "page", 1, 1, None, 5)])
    assert "e" not in got
    got = arrive([_part("b", "paragraph", 0, 1, "anew", 900)])
    assert got["b"][3] == "anew" and got["e"][3] == f"{long} e" and "c" not in got
    runs = {(r["document_id"], r["version"]): r for r in parts.read_runs(spark, out).collect()}
    assert set(runs) == {("b", 0), ("a", 1), ("d", 1), ("f", 2), ("b", 3), ("c", 3), ("e", 3)}
    assert runs["c", 3]["reason"] == "1 of 2 parts arrived" and runs["c", 3]["log"]["stage"] == "failed"
    assert (runs["f", 2]["reason"], runs["f", 2]["failed_pages_count"], runs["f", 2]["page_count"]) == (parts.NO_CHUNKS, 1, 1)
    assert runs["a", 1]["started_at"] < runs["a", 1]["finished_at"] and runs["a", 1]["log"]["chunk_count"] == "1"
    assert runs["d", 1]["ocr_used_pages"] == [1] and "DOC_OCR" in runs["d", 1]["tags"]
    docs = spark.createDataFrame([(i, "processing", None, ["t"], None) for i in "abcz"], "document_id string, status string, page_count int, tags array<string>, fail_reason string")
    after = {r["document_id"]: r for r in parts.read_documents(spark, out, docs).collect()}
    assert (after["a"]["status"], after["a"]["page_count"]) == ("ready", 2) and after["c"]["fail_reason"] == "1 of 2 parts arrived" and after["z"]["status"] == "processing"


def test_a_repeated_batch_of_parts_writes_the_same(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (1, 2):
        spark.createDataFrame([_part("a", "page", n, 2, "a page of text that is long enough to count as native", n)], parts.PARTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(parts.PARTS).parquet(source)
        parts.start_parts(stream, out, str(tmp_path / "mark"), dim=4, size=400, overlap=0).awaitTermination()
    before = (parts.read_chunks(spark, out).collect(), parts.read_runs(spark, out).collect())
    commit = max((tmp_path / "mark" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commit.write_text("not a commit")  # as if the driver had been lost before the last commit
    for log in (commit, commit.parent / f".{commit.name}.crc"):
        log.unlink(missing_ok=True)
    stream = spark.readStream.schema(parts.PARTS).parquet(source)
    parts.start_parts(stream, out, str(tmp_path / "mark"), dim=4, size=400, overlap=0).awaitTermination()
    assert (parts.read_chunks(spark, out).collect(), parts.read_runs(spark, out).collect()) == before and len(before[0]) == 1


def test_turns_are_folded_once_a_batch(spark, tmp_path, monkeypatch):
    """The search reads a batch several times; the stateful fold must not run for each."""
    folded, resolve = spark.sparkContext.accumulator(0), conversation.resolve_stream

    def counted(batches):
        for batch in batches:
            folded.add(len(batch))
            yield batch

    monkeypatch.setattr(conversation, "resolve_stream", lambda prepared, cover: (rows := resolve(prepared, cover)).mapInPandas(counted, rows.schema))
    columns = ["facility_id", "name", "prefecture", "city", "service_type", "address", "phone", "business_hours", "last_updated", "source_url"]
    facility = [("F1", "青空", "東京", "世田谷区", "通所介護", "a", "1", "9-17", "2024", "u"), ("F2", "若葉", "大阪", "北区", "訪問介護", "b", "2", "9-17", "2024", "u")]
    rows = spark.createDataFrame(facility, columns).withColumn("ordinal", F.substring("facility_id", 2, 9).cast("long")).withColumn("features", F.array(F.lit("送迎")))
    turns = [("c1", 0, "世田谷区で"), ("c1", 1, "送迎は"), ("c2", 0, "北区 訪問介護"), ("c2", 1, "/reset"), ("c2", 2, "hello")]
    spark.createDataFrame(turns, conversation.TURNS).write.parquet(f"{tmp_path}/turns")
    arriving = spark.readStream.schema(conversation.TURNS).parquet(f"{tmp_path}/turns")
    conversation.start_prepare(arriving, rows, f"{tmp_path}/prepared", f"{tmp_path}/c1").awaitTermination()
    conversation.start_resolve(spark, f"{tmp_path}/prepared", rows, f"{tmp_path}/answers", f"{tmp_path}/c2").awaitTermination()
    found = {(r.conv_id, r.turn): r.outcome for r in spark.read.parquet(f"{tmp_path}/answers").collect()}
    assert found == {("c1", 0): "answer", ("c1", 1): "answer", ("c2", 0): "answer", ("c2", 1): "reset", ("c2", 2): "clarify"}
    assert folded.value == len(turns)
