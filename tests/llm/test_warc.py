import random

import pytest

from citeloom.llm import warc


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://User:pw@WWW.Example.com:80/A/b/?b=2&a=1#x", "example.com/A/b?a=1&b=2"), ("https://m.example.com:8443", "example.com:8443"), ("https://example.com/?&", "example.com"),
        ("no scheme", None), ("http://", None), (None, None), ("", None), ("http://example.com?q=1/2", "example.com?q=1/2"),
    ],
)
def test_canonical(spark, url, want):
    frame = spark.createDataFrame([(url,)], "url string")
    assert frame.select(warc.canonical(frame.url).alias("u")).first().u == want


def plain(rows):
    full = [r for r in rows if r[1] == "response" and r[4] == 200 and r[2] and r[3] is not None]
    out = []
    for i, kind, url, ts, _, headers, digest in rows:
        if kind != "revisit":
            continue
        own = {k.lower(): v for k, v in (headers or {}).items()}
        before = [r for r in full if url and ts is not None and r[2] == url and r[3] < ts]
        best = max(before, key=lambda r: (r[3], r[0])) if before else None
        weak = lambda x: None if x is None else x.removeprefix("W/")
        theirs = {k.lower(): v for k, v in (best[5] or {}).items()} if best else {}
        tag, date = own.get("etag"), own.get("last-modified")
        if not url:
            outcome = "no_url"
        elif ts is None:
            outcome = "no_time"
        elif not best:
            outcome = "no_response"
        elif tag is not None and weak(tag) != weak(theirs.get("etag")):
            outcome = "etag_differs"
        elif tag is None and date is not None and date != theirs.get("last-modified"):
            outcome = "date_differs"
        elif tag is None and date is None and digest and best[6] and digest != best[6]:
            outcome = "digest_differs"
        else:
            outcome = "resolved"
        merged = theirs | {k: v for k, v in own.items() if k not in warc.KEPT and v is not None}
        text = "; ".join(f"{k}={v}" for k, v in sorted(merged.items()))
        out.append((i, outcome, *((best[0], best[3], best[6], text) if outcome == "resolved" else (None,) * 4)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    pick = random.Random(1)
    tags = [None, '"a"', 'W/"a"', '"b"']
    rows = []
    for n in range(400):
        kind = pick.choice(["response", "revisit", "revisit", "request"])
        url = pick.choice([None, "", *["http://hot.com/"] * 6, "http://b.com/x"])
        headers = {k: v for k, v in (("ETag", pick.choice(tags)), ("Last-Modified", pick.choice([None, None, "d1", "d2"])), ("Content-Type", pick.choice(["x", "y"])), ("Age", str(n))) if v}
        rows.append((n, kind, url, pick.choice([None, *range(30)]), pick.choice([200, 200, 404]), pick.choice([headers, headers, None]), pick.choice([None, "s1", "s2"])))
    rows.append(rows[0])
    frame = spark.createDataFrame([(*r, "u", 1) for r in rows], warc.RECORD + ", url_key string, outcome int")
    got = [tuple(r) for r in warc.listed(warc.resolve(frame)).select("record_id", "outcome", "response_id", "response_ts", "digest", "headers").collect()]
    assert sorted(got, key=str) == plain(rows)
    assert {r[1] for r in got} == {"no_url", "no_time", "no_response", "etag_differs", "date_differs", "digest_differs", "resolved"}


def test_no_rows(spark):
    assert warc.resolve(spark.createDataFrame([], warc.RECORD)).collect() == []
    assert warc.captures(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_headers_of_any_spelling(spark):
    frame = spark.createDataFrame([({"ETag": " x ", "etag": "y", "Age": "1"},), (None,), ({},)], "h map<string,string>")
    assert [r.h for r in frame.select(warc.lowered(frame.h).alias("h")).collect()] == [{"etag": "y", "age": "1"}, {}, {}]


def test_pages_with_nulls(spark):
    frame = spark.createDataFrame([(1, None, None), (2, "http://a.com/x", None), (2, "http://a.com/x", "long " * 50_000)], "page_id long, url string, html string")
    got = warc.resolve(warc.captures(frame)).collect()
    assert len(got) == 9 and {r.outcome for r in got if r.record_id < 16} == {"no_url"}
