import json

from pyspark.sql import functions as F

from citeloom.operators import answers, catalogue, normalisers
from citeloom.sources import readers, tables


def _contexts(spark):
    rows = [
        (q, n, f"{q}c{n}", f"{q}d", "w", "f.pdf", "page", f"p.{n}", f"s{n}", "body " * 3, 1.0 / n, raw, "drive://x", "application/pdf")
        for q, raw in (("good", 0.9), ("weak", 0.1), ("bad", 0.15), ("odd", 0.9), ("gone", 0.9), ("empty", 0.9))
        for n in (1, 2)
    ]
    names = (
        "query_id string, rank int, chunk_id string, document_id string, workspace_id string, file_name string, ref_type string, ref string, "
        "snippet string, text string, score double, raw_score double, storage_key string, mime_type string"
    )
    return spark.createDataFrame(rows, names)


def test_answer_queries(spark):
    contexts = _contexts(spark)
    queries = contexts.select("query_id").distinct().unionAll(spark.createDataFrame([("none",)], "query_id string"))
    good = {"answer": {"conclusion": "結論", "details": 3, "notes": None, "next_actions": ["a", "", " ", 1]}, "citations": ["x", {"chunk_id": "goodc2"}, {"chunk_id": "goodc1"}, {"chunk_id": "goodc2"}, {"chunk_id": "weakc1"}, {}]}
    responses = [
        ("good", 1, "nonsense"),
        ("good", 2, "```json\n" + json.dumps(good, ensure_ascii=False) + "\n```"),
        ("bad", 1, "x"),
        ("bad", 2, "[1]"),
        ("bad", 3, ""),
        ("bad", 4, '{"answer":{"conclusion":"late"},"citations":[{"chunk_id":"badc1"}]}'),
        ("odd", 1, '{"answer":"text","citations":[{"chunk_id":"oddc1"}]}'),
        ("gone", 1, '{"answer":{"conclusion":"c"},"citations":[{"chunk_id":"gonec1"}]}'),
        ("empty", 1, "{}"),
        ("weak", 1, '{"answer":{"conclusion":"c"},"citations":[{"chunk_id":"weakc1"}]}'),
    ]
    frame = spark.createDataFrame(responses, "query_id string, attempt int, raw string")
    chunks = contexts.filter("chunk_id <> 'gonec1'").select("workspace_id", "chunk_id")
    replies, cites = answers.answer_queries(queries, contexts, frame, chunks, "https://files")
    got = {r["query_id"]: r for r in replies.collect()}
    assert {q: r["kind"] for q, r in got.items()} == {
        "good": "grounded", "weak": "not_found", "none": "not_found", "bad": "extractive", "odd": "error", "gone": "not_found", "empty": "extractive",
    }
    assert got["good"]["conclusion"] == "結論" and got["good"]["details"] == "3" and got["good"]["notes"] == "None"
    assert got["good"]["next_actions"] == ["a", "1"]
    assert got["bad"]["details"] == "- f.pdf p.1: s1\n- f.pdf p.2: s2"
    listed = {}
    for c in cites.orderBy("query_id", "cite_no").collect():
        listed.setdefault(c["query_id"], []).append(c["chunk_id"])
    assert listed == {"good": ["goodc2", "goodc1"], "bad": ["badc1", "badc2"], "empty": ["emptyc1", "emptyc2"]}
    flags = {r["query_id"]: r["no_evidence"] for r in answers.flag_no_evidence(replies, cites).collect()}
    assert flags["good"] is False and flags["none"] is True and flags["odd"] is True
    sent = {r["query_id"]: json.loads(r["response"]) for r in answers.to_response_json(replies, cites).collect()}
    assert [c["chunk_id"] for c in sent["good"]["citations"]] == ["goodc2", "goodc1"]
    assert sent["good"]["citations"][0]["url"] == "https://drive.google.com/file/d/x/view" and sent["none"]["citations"] == []


def test_prompt_context(spark):
    row = answers.prompt_context(_contexts(spark), 5).filter("query_id = 'good'").first()
    first = "[chunk_id=goodc1]\nfile_name=f.pdf\nref=p.1\nscore=1.000\nsnippet=s1\ntext=body "
    assert row["context"].startswith(first + "\n\n[chunk_id=goodc2]")


def test_normalisers(spark):
    lines = [
        '{"id":5,"name":null}',
        '{"id":"","name":"x"}',
        '{"doc_id":"d","status":"Processing","page_count":"3","tags":[1,"b",null],"fail_reason":"","created_at":"t"}',
        "null",
        "[]",
        "broken",
    ]
    raw = spark.createDataFrame([(line,) for line in lines], "value string")
    assert [tuple(r) for r in normalisers.normalize_workspaces(raw).collect()] == [("5", "")]
    docs = {r["document_id"]: r for r in normalisers.normalize_docs(raw).collect()}
    assert set(docs) == {"5", "d"}
    assert docs["d"]["status"] == "processing" and docs["d"]["page_count"] is None and docs["d"]["tags"] == ["1", "b", "null"]
    assert docs["d"]["updated_at"] == "t" and docs["d"]["fail_reason"] is None and docs["5"]["status"] == "failed"


def test_import_reconciliation(spark):
    listing = spark.createDataFrame(
        [("w", 1, "new", "a.mov", "video/quicktime"), ("w", 2, "new", "again.mov", "video/quicktime"), ("w", 3, " ", "b.mp4", None), ("w", 4, "failed", "", None),
         ("w", 5, "ready", "c.mp4", None), ("v", 6, "ready", "c.mp4", None)],
        "workspace_id string, item_no long, id string, name string, mimeType string",
    )
    docs = spark.createDataFrame(
        [("d1", "w", "old", "m", "drive://failed", "failed", 1, ["z"], "why"), ("d2", "w", "old", "m", "drive://ready", "ready", 1, ["z"], None)],
        "document_id string, workspace_id string, file_name string, mime_type string, storage_key string, status string, page_count int, tags array<string>, fail_reason string",
    )
    actions = catalogue.reconcile_import(listing, docs)
    got = {r["item_no"]: r for r in actions.collect()}
    assert [got[n]["action"] for n in range(1, 7)] == ["insert", "skip", "skip", "requeue", "skip", "insert"]
    assert got[4]["file_name"] == "drive-file-failed" and got[4]["tags"] == ["folder-import", "google-drive", "z"]
    after = {r["document_id"]: r for r in catalogue.apply_import(docs, actions).collect()}
    assert len(after) == 4 and after["d1"]["status"] == "processing" and after["d1"]["fail_reason"] is None and after["d2"]["status"] == "ready"


def test_success_and_failure(spark):
    schema = "document_id string, status string, page_count int, tags array<string>, fail_reason string"
    docs = spark.createDataFrame([("a", "processing", None, None, None), ("b", "processing", 4, ["t"], None), ("c", "ready", 1, [], None)], schema)
    reports = spark.createDataFrame(
        [("a", 2, 2, [(1, "r")], [2], ["OCR_USED"], 3)],
        "document_id string, page_count int, extracted_pages int, failed_pages array<struct<page:int,reason:string>>, ocr_used_pages array<int>, tags array<string>, chunk_count int",
    )
    updated, runs = catalogue.apply_success(docs, reports)
    a = updated.filter("document_id = 'a'").first()
    assert (a["status"], a["page_count"], a["tags"]) == ("ready", 2, ["OCR_USED"])
    run = runs.first()
    assert run["failed_pages_count"] == 1 and run["log"]["stage"] == "completed" and run["log"]["chunk_count"] == "3"
    errors = spark.createDataFrame(
        [("b", "unexpected", "boom", ["x"], 1, [], [])],
        "document_id string, kind string, message string, tags array<string>, extracted_pages int, failed_pages array<struct<page:int,reason:string>>, ocr_used_pages array<int>",
    )
    updated, runs = catalogue.apply_failure(docs, errors)
    b = updated.filter("document_id = 'b'").first()
    assert (b["status"], b["fail_reason"], b["tags"]) == ("failed", "unexpected_error: boom", ["t", "x"])
    assert runs.first()["log"]["reason"] == "unexpected_error: boom"


def test_repeated_reports_and_errors_without_a_message(spark):
    schema = "document_id string, status string, page_count int, tags array<string>, fail_reason string"
    docs = spark.createDataFrame([("a", "processing", None, None, None), ("b", "processing", 4, ["t"], None)], schema)
    columns = "document_id string, page_count int, extracted_pages int, failed_pages array<struct<page:int,reason:string>>, ocr_used_pages array<int>, tags array<string>, chunk_count int, finished_at int"
    reports = spark.createDataFrame([("a", 9, 2, [], [], ["OLD"], 3, 1), ("a", 2, 2, [], [], ["NEW"], 4, 2), ("a", 5, 2, [], [], ["NONE"], 4, None)], columns)
    updated, runs = catalogue.apply_success(docs, reports)
    assert sorted((r["document_id"], r["status"], r["page_count"], r["tags"]) for r in updated.collect()) == [("a", "ready", 2, ["NEW"]), ("b", "processing", 4, ["t"])]
    assert runs.count() == 3
    columns = "document_id string, kind string, message string, tags array<string>, extracted_pages int, failed_pages array<struct<page:int,reason:string>>, ocr_used_pages array<int>"
    errors = spark.createDataFrame([("a", "unexpected", None, ["x"], 1, [], []), ("b", "other", None, None, 0, None, None), ("b", "other", None, None, 0, None, None)], columns)
    updated, runs = catalogue.apply_failure(docs, errors)
    got = sorted((r["document_id"], r["status"], r["fail_reason"], r["tags"]) for r in updated.collect())
    assert got == [("a", "failed", "unexpected_error: ", ["x"]), ("b", "failed", "", ["t"])] and runs.count() == 3


def test_readers(spark, tmp_path):
    path = tmp_path / "facilities.csv"
    head = ",".join(readers.FACILITY_COLUMNS)
    path.write_text(head + "\n F1 , 施設 ,東京都,新宿区,デイサービス,住所,03,9-17, 送迎 ||入浴,2024,https://x\n", encoding="utf-8")
    row = readers.read_facilities(spark, str(path)).first()
    assert (row["facility_id"], row["name"], row["features"]) == ("F1", "施設", ["送迎", "入浴"])
    for body in (head + "\n", "id,name\n1,2\n"):
        path.write_text(body, encoding="utf-8")
        try:
            readers.read_facilities(spark, str(path))
            raise AssertionError("expected an error")
        except ValueError:
            pass
    store = tmp_path / "store"
    (store / "workspaces/w").mkdir(parents=True)
    (store / "workspaces/w/a b.txt").write_bytes(b"hello")
    docs = spark.createDataFrame(
        [("1", "workspaces/w/a b.txt", "a b.txt", "text/plain"), ("2", "drive://x", "v.MOV", None), ("3", "workspaces/w/none", "n.txt", None)],
        "document_id string, storage_key string, file_name string, mime_type string",
    )
    got = {r["document_id"]: r["content"] for r in readers.read_raw_documents(spark, str(store), docs).collect()}
    assert got == {"1": b"hello", "2": b"", "3": None}
    listing = tmp_path / "listing.json"
    listing.write_text('{"id":"1","name":"a","size":"5","trashed":true}\n{"id":"2","name":"b"}\n')
    assert [r["id"] for r in readers.read_listing(spark, str(listing)).collect()] == ["2"]


def test_tables(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "document_id string, n int"
    assert tables.read_log(spark, path, schema).count() == 0
    for version, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)], [("a", 3)]]):
        tables.write_version(spark.createDataFrame(rows, schema), path, version)
    newest = tables.newest_rows(tables.read_log(spark, path, schema), "document_id")
    assert sorted(map(tuple, newest.collect())) == [("a", 3), ("b", 1)]
    before = tables.newest_rows(tables.read_log(spark, path, schema, before=2), "document_id")
    assert sorted(map(tuple, before.collect())) == [("a", 2), ("b", 1)]
    postings = spark.createDataFrame([("w", f"c{i}", "the" if i % 2 else f"t{i}", 1) for i in range(40)], "workspace_id string, chunk_id string, term string, pos int")
    tables.write_postings(postings, str(tmp_path / "p"), 4)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.filter(F.col("term") == "the").select("bucket").distinct().count() == 1 and back.count() == 40
    runs = str(tmp_path / "runs")
    tables.append_runs(spark.createDataFrame([("a", 1)], schema), runs)
    tables.append_runs(spark.createDataFrame([("a", 2)], schema), runs)
    assert spark.read.parquet(runs).count() == 2
