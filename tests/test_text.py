from pyspark.sql import functions as F

from citeloom.functions import files, links, text
from citeloom.operators import decoding, embedding


def one(spark, column, **values):
    names = ", ".join(f"{k} {v[0]}" for k, v in values.items())
    row = tuple(v[1] for v in values.values())
    return spark.createDataFrame([row], names).select(column.alias("out")).first()["out"]


def texts(spark, column, rows):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r["out"] for r in frame.select("i", column.alias("out")).orderBy("i").collect()]


def test_charset_from_mime(spark):
    got = texts(
        spark,
        files.charset_from_mime(F.col("t")),
        ["text/plain; charset=Shift_JIS", None, "text/plain; charset=nope", 'text/plain; CHARSET = "EUC-JP"', "text/plain; charset=latin-1"],
    )
    assert got == ["shift_jis", None, None, "euc_jp", "iso8859-1"]


def test_garbled(spark):
    noise = "ɐɑɒɓ αβγδ אבגד"
    clean = "介護サービスの利用手順について説明します。"
    pairs = "Ã©Ã¨Ãª"
    got = texts(spark, text.is_garbled(F.col("t")), [noise, clean, "", None, pairs, "plain text", "\x01ł ł ł ł", "łłłł"])
    assert got == [True, False, False, False, True, False, True, True]


def test_quality_counts(spark):
    got = texts(spark, text.decode_quality(F.col("t")), ["ok\n\t", "\x01\x02", "a\x00b", "Ã©", "Ã\n", "�"])
    assert got == [0, 40, 50, 8, 0, 0 + 8]


def test_strip_covers_unicode_space(spark):
    assert texts(spark, text.strip(F.col("t")), ["　 a b \x1c\n", "\x85x\xa0"]) == ["a b", "x"]


def test_query_fragments(spark):
    got = texts(spark, text.query_fragments(F.col("t")), ["会計の手順について教えてください", "A b-C", "x", "確認"])
    assert got == [["会計", "会計の手順について教えてください"], ["abc"], [], ["確認"]]


def test_significant_tokens_and_soft_fragments(spark):
    assert texts(spark, text.significant_tokens(F.col("t")), ["abc x こと abc 12"]) == [["abc", "12"]]
    got = texts(spark, text.soft_fragments(F.col("t")), ["新宿、デイ？a bb　bb!"])
    assert got == [["新宿", "デイ", "bb"]]


def test_suffix_rules(spark):
    got = texts(spark, files.suffix(F.col("t")), ["a/b.tar.GZ", ".hidden", "name.", "plain", "d.x/e"])
    assert got == [".GZ", "", "", "", ""]
    assert texts(spark, files.stem(F.col("t")), ["a/b.tar.gz", ".hidden"]) == ["b.tar", ".hidden"]


def test_routes(spark):
    rows = [
        ("a.PDF", "", "pdf"),
        ("a.bin", "application/pdf", "pdf"),
        ("a.doc", "application/msword", "docx"),
        ("a.pptx", "text/plain", "text"),
        ("a.pptx", None, "ppt"),
        ("a.xls", "", "xls"),
        ("a.webp", "", "image"),
        ("a.m4v", "", "other"),
        ("a.m4v", "video/x-m4v", "video"),
        ("a.mkv", "", "video"),
    ]
    frame = spark.createDataFrame([(r[0], r[1]) for r in rows], "n string, m string")
    got = [r["out"] for r in frame.select(files.route_type(F.col("n"), F.col("m")).alias("out")).collect()]
    assert got == [r[2] for r in rows]


def test_decode_corpus(spark):
    japanese = "介護サービスの利用手順"
    rows = [
        ("bom", b"\xef\xbb\xbf" + japanese.encode(), "text/plain"),
        ("cp932", japanese.encode("cp932"), "text/plain"),
        ("declared", japanese.encode("euc_jp"), "text/plain; charset=EUC-JP"),
        ("byte", b"\x81", "text/plain; charset=ascii"),
        ("empty", b"", "text/plain"),
        ("utf8", japanese.encode(), "text/plain"),
        ("utf16", japanese.encode("utf-16"), None),
        ("null", None, None),
    ]
    out = decoding.decode_corpus(spark.createDataFrame(rows, "id string, content binary, mime_type string"))
    got = {r["id"]: r for r in out.collect()}
    assert got["bom"]["text"] == japanese and got["bom"]["encoding"] == "utf-8-sig"
    assert got["cp932"]["text"] == japanese and got["cp932"]["encoding"] in ("cp932", "shift_jis")
    assert got["declared"]["text"] == japanese and got["declared"]["encoding"] == "euc_jp"
    assert got["empty"]["text"] == "" and got["empty"]["encoding"] == "utf-8" and not got["empty"]["decode_tags"]
    assert got["utf8"]["text"] == japanese and got["utf8"]["encoding"] == "utf-8-sig"
    assert got["utf16"]["text"] == japanese and got["utf16"]["encoding"] == "utf-16"
    assert got["null"]["text"] == ""


def test_decode_replacement():
    # no candidate accepts these bytes: the odd length fails every two-byte codec
    text_, encoding, replaced = decoding._best_decoding(b"\x81", [])
    assert (encoding, replaced) == ("utf-8(replace)", True) and text_ == "�"


def test_image_mime(spark):
    rows = [("a.JPG", b""), ("x", b"\xff\xd8\xff1"), ("x", b"RIFF1234WEBP"), ("x", b"GIF89a"), ("x", b"MM\x00*"), ("x", b"??")]
    frame = spark.createDataFrame(rows, "n string, c binary")
    got = [r["out"] for r in frame.select(files.image_mime(F.col("n"), F.col("c")).alias("out")).collect()]
    assert got == ["image/jpeg", "image/jpeg", "image/webp", "image/gif", "image/tiff", "application/octet-stream"]


def test_folder_requests(spark):
    values = [
        "https://drive.google.com/drive/folders/1AbCdEfGhIj?usp=sharing",
        "https://drive.google.com/open?id=1AbCdEfGhIj",
        "1AbCdEfGhIj",
        "https://drive.google.com/file/d/1AbCdEfGhIj/view",
        "https://example.com/folders/1AbCdEfGhIj",
        "  ",
        "short",
    ]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string")
    got = [tuple(r["out"]) for r in frame.select("i", links.folder_request(F.col("value")).alias("out")).orderBy("i").collect()]
    assert got[:3] == [("1AbCdEfGhIj", None)] * 3
    assert [g[1] for g in got[3:]] == ["file_url", "foreign_host", "blank", "foreign_host"]


def test_citation_ref(spark):
    rows = [
        ("video/mp4", 75, None, None, ("video", "01:15")),
        ("video/mp4", None, None, None, ("video", "冒頭")),
        ("application/pdf", 3, 5, None, ("page", "p.3-5")),
        ("application/pdf", 3, 3, "s", ("page", "p.3")),
        ("text/plain", None, None, "概要", ("page", "section:概要")),
        ("text/plain", None, None, "", ("page", "section:unknown")),
    ]
    frame = spark.createDataFrame([r[:4] for r in rows], "m string, a int, b int, s string")
    out = frame.select(links.citation_ref(F.col("m"), F.col("a"), F.col("b"), F.col("s")).alias("out")).collect()
    assert [tuple(r["out"]) for r in out] == [r[4] for r in rows]


def test_embedding_fallbacks(spark):
    rows = spark.createDataFrame([("a", "one two"), ("b", "")], "document_id string, text string")
    good = {r["document_id"]: r["embedding"] for r in embedding.embed_chunks(rows, embedding.hashing_provider(4), 6).collect()}
    assert len(good["a"]) == 6 and any(good["a"]) and not any(good["b"])

    def broken(values):
        raise RuntimeError("no provider")

    for provider in (None, broken):
        out = embedding.embed_chunks(rows, provider, 3)
        assert all(list(r["embedding"]) == [0.0] * 3 for r in out.collect())
        tags = embedding.embed_fallback_tag(out).collect()
        assert all(t["tags"] == ["EMBED_FALLBACK"] for t in tags)
