import random

from pyspark.sql import functions as F

from citeloom.operators import blocks, chunking, triage


def test_markdown_blocks(spark):
    body = "intro\n# 見出し\r\n本文\n\n　## 次 ##\n行1\x0b行2\n#\n終わり"
    docs = spark.createDataFrame([("d", body), ("e", "# only heading")], "document_id string, text string")
    got = [(r["block_no"], r["text"], r["section_title"]) for r in blocks.markdown_blocks(docs).orderBy("block_no").collect()]
    assert got == [(0, "intro", None), (1, "本文", "見出し"), (2, "行1", "次 ##"), (3, "行2", "次 ##"), (4, "終わり", "")]
    empty = blocks.flag_empty(docs, blocks.markdown_blocks(docs)).collect()
    assert [r["document_id"] for r in empty] == ["e"]


def test_paragraph_blocks(spark):
    rows = [("d", 0, None, " a "), ("d", 1, "Heading 1", "H"), ("d", 2, "Normal", "b"), ("d", 3, "heading 2", " "), ("d", 4, "Normal", "c")]
    frame = spark.createDataFrame(rows, "document_id string, ordinal int, style string, text string")
    got = [(r["text"], r["section_title"]) for r in blocks.paragraph_blocks(frame).orderBy("ordinal").collect()]
    assert got == [("a", None), ("b", "H"), ("c", "H")]


def _triage(spark, pages, **options):
    frame = spark.createDataFrame([("d", *p) for p in pages], "document_id string, page int, raw_text string, ocr_text string")
    out = triage.triage_pages(triage.apply_ocr_budget(frame, **options))
    return out, triage.parse_report(out, image_ratio=0.9).first()


def test_page_triage(spark):
    long, short, garbled = "A" * 100, "短い本文", "Ã©" * 30
    cases = [
        ([(1, long, None), (2, short, None)], 2, [], [], ["SHORT_TEXT_INCLUDED"]),
        ([(1, long, None), (2, "", None)], 1, [2], [], []),
        ([(1, long, None), (2, "", "読取")], 2, [], [2], ["SHORT_TEXT_INCLUDED", "OCR_USED"]),
        ([(1, long, None), (2, garbled, None)], 1, [2], [], ["POSSIBLE_MOJIBAKE"]),
        ([(1, long, None), (2, garbled, "B" * 60)], 2, [], [2], ["POSSIBLE_MOJIBAKE", "OCR_USED"]),
        ([(1, "", None)], 0, [1], [], ["IMAGE_ONLY_PDF", "OCR_REQUIRED"]),
    ]
    for pages, extracted, failed, used, tags in cases:
        _, report = _triage(spark, pages)
        assert report["extracted_pages"] == extracted
        assert [p["page"] for p in report["failed_pages"]] == failed
        assert report["ocr_used_pages"] == used
        assert report["tags"] == tags


def test_ocr_budget(spark):
    out, report = _triage(spark, [(p, "", "x" * 50) for p in range(1, 6)], max_pages=3)
    assert report["ocr_used_pages"] == [1, 2, 3]
    assert [p["page"] for p in report["failed_pages"]] == [4, 5]


def test_document_ocr(spark):
    pages = spark.createDataFrame([("d", 1, "", None), ("d", 2, "", None)], "document_id string, page int, raw_text string, ocr_text string")
    whole = spark.createDataFrame([("d", " 全文 ")], "document_id string, doc_ocr_text string")
    out = triage.triage_pages(pages)
    report = triage.parse_report(out, whole)
    row = report.first()
    assert (row["extracted_pages"], row["ocr_used_pages"], row["failed_pages"]) == (2, [1, 2], [])
    assert row["tags"] == ["DOC_OCR", "IMAGE_ONLY_PDF", "OCR_USED"]
    block = triage.page_blocks(out, report).collect()
    assert [(b["text"], b["page"], b["section_title"]) for b in block] == [("全文", None, "Document OCR")]


def naive_chunks(units, size, overlap):
    """The packing rule written out for one document."""
    done, held, length = [], [], 0
    for unit in units:
        if held and length + len(unit[0]) + 1 > size:
            body = "\n".join(h[0] for h in held)
            pages = [h[1] for h in held if h[1] is not None]
            title = next((h[2] for h in held if h[2]), None)
            done.append((body, min(pages, default=None), max(pages, default=None), title))
            tail = body[-overlap:] if overlap else ""
            held, length = ([(tail.strip(), done[-1][2], title)], len(tail)) if tail.strip() else ([], 0)
        held.append(unit)
        length += len(unit[0]) + (1 if len(held) > 1 else 0)
    if held:
        pages = [h[1] for h in held if h[1] is not None]
        done.append(("\n".join(h[0] for h in held), min(pages, default=None), max(pages, default=None), next((h[2] for h in held if h[2]), None)))
    return done


def test_build_chunks_against_naive(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for size, overlap in ((30, 8), (30, 0), (12, 12)):
        for d in range(12):
            name = f"{size}-{overlap}-{d}"
            units = [
                ("".join(rng.choice("ab c") for _ in range(rng.randint(1, size))).strip() or "x", rng.choice([None, n // 3]), rng.choice([None, "", f"s{n}"]))
                for n in range(rng.randint(1, 40))
            ]
            rows += [("w", name, n, 0, *u) for n, u in enumerate(units)]
            expected[name] = naive_chunks(units, size, overlap)
    schema = "workspace_id string, document_id string, block_no int, unit_no int, text string, page int, section_title string"
    frame = spark.createDataFrame(rows, schema)
    for size, overlap in ((30, 8), (30, 0), (12, 12)):
        mine = frame.filter(F.col("document_id").startswith(f"{size}-{overlap}-"))
        got = {}
        for r in chunking.build_chunks(mine, size, overlap).orderBy("document_id", "chunk_index").collect():
            got.setdefault(r["document_id"], []).append((r["text"], r["page_start"], r["page_end"], r["section_title"]))
        assert got == {k: v for k, v in expected.items() if k.startswith(f"{size}-{overlap}-")}


def test_chunk_documents_equals_unit_table(spark):
    rng = random.Random(9)
    docs = [("w", f"d{i}", "\n".join("word " * rng.randint(0, 40) for _ in range(rng.randint(0, 30)))) for i in range(20)]
    frame = spark.createDataFrame(docs, "workspace_id string, document_id string, text string")
    direct = chunking.chunk_documents(frame, 120, 30)
    units = chunking.build_units(blocks.text_blocks(frame), 120).withColumns({"page": F.lit(None).cast("int"), "section_title": F.lit(None).cast("string")})
    table = chunking.build_chunks(units, 120, 30)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, table.collect()))


def test_markdown_chunks_carry_sections(spark):
    frame = spark.createDataFrame([("w", "d", "# A\none\n# B\ntwo"), ("w", "t", "# A\none")], "workspace_id string, document_id string, text string")
    got = {r["chunk_id"]: (r["text"], r["section_title"]) for r in chunking.chunk_documents(frame, 100, 10, F.col("document_id") == "d").collect()}
    assert got == {"d:0": ("one\ntwo", "A"), "t:0": ("# A\none", None)}


def test_unit_split(spark):
    frame = spark.createDataFrame([("a\r\n\r\nbbbbb\n\n \n\nc",), ("\n\n",)], "t string")
    assert [r["u"] for r in frame.select(chunking.unit_array(F.col("t"), 2).alias("u")).collect()] == [["a", "bb", "bb", "b", "c"], []]
