import __spark_entry__ as entry
from citeloom.llm import url_filter as u

SF = "/root/testdata/sf0.001"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    stop = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:stop]


def plain_rule(host, path):
    fits = [(h, p, v) for h, p, v in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


def check(rows, got):
    assert len(rows) == len(got)
    for r in got:
        host, path = plain_parts(rows[r.page_id])
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= u.BLOCK_FROM else "allow"))
        assert 0 <= r.score <= 1


URLS = [
    None, "", "no scheme/at all", "http://", "://x", "HTTP://WWW.Example.COM/en/7#a?b", "http://example.com/en/71?x=/y", "http://myexample.com/en/7", "http://example.com/en/",
    "http://a.example.net/de/8.html", "http://example.net/de/7", "http://other.net/de/8", "http://x.org/es", "http://x.org/es/", "http://x.org?/es/", "http://com/en/", "a://b://c/d",
    "http://ÄÖ.example.com/Straße?q", "http://x.example.com\n/en/7\nx", "http://" + "a" * 50_000 + ".net/de/" + "9" * 50_000,
]


def test_odd_urls(spark):
    frame = spark.createDataFrame([(n, x, "h", "p", 0.0) for n, x in enumerate(URLS)], "page_id long, url string, host string, path string, score double")
    check(dict(enumerate(URLS)), u.judged(frame).collect())
    assert u.judged(frame.limit(0)).collect() == []
    assert len(u.judged(frame.union(frame)).collect()) == 2 * len(URLS)
    assert u.judged(spark.createDataFrame([(None, "http://a.com/")], "page_id long, url string")).first().page_id is None


def test_given_pages(spark):
    rows = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = entry.queries()["op5_url_filter"](spark, SF)
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    check(rows, got.collect())


def test_model_tells_unwanted_names_from_plain_ones(spark):
    """Names that the labelled table doesn't hold: made of its words, then of others too."""
    names = ["casino-pills", "www.casino-farm", "free-bonus-bets"], ["best-casino", "poker-win", "spam-links", "free-pills"], ["citytimes", "river-notes", "museum", "thandering"]
    rows = [(n, f"https://{x}.example.com/fr/5") for n, x in enumerate(sum(names, []))]
    got = {r.page_id: r.score for r in u.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    first, plain = [got[n] for n in range(3)], [got[n] for n in range(7, 11)]
    assert min(first) >= 0.5 and max(plain) < 0.05 and min(got[n] for n in range(7)) > 2 * max(plain), got
