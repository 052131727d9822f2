import hashlib
import re
import struct

import xxhash

import __spark_entry__ as entry
from citeloom.llm import imatch as m
from tests.llm.cases import docs, odd_rows, prose

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_terms(text):
    words = {w for w in re.split(r"[^\w]+|_+", text) if w}
    return {signed(xxhash.xxh64_intdigest(w.lower(), 42)) for w in words}


def plain_signature(text, band):
    kept = sorted(plain_terms(text) & band)
    out, at = [], m.FIRST_BIT
    if not kept:
        h = 42
        for t in sorted(plain_terms(text)):
            h = xxhash.xxh64_intdigest(struct.pack("<q", t), h)
        return [h >> 32] * sum(parts for _, parts in m.LEVELS)
    for bits, parts in m.LEVELS:
        for p in range(parts):
            h, some = 42, [t for t in kept if (t >> at) & ((1 << bits) - 1) == p]
            for t in some:
                h = xxhash.xxh64_intdigest(struct.pack("<q", t), h)
            out.append(h >> 32 if some else None)
        at += bits
    return out


def near(a, b):
    either = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
    return sum(x == y for x, y in either) / len(either) if either else 1.0


def plain(rows):
    rows = [(i, t or "") for i, t in rows]
    counts = {}
    for t in {t for _, t in rows}:
        for x in plain_terms(t):
            counts[x] = counts.get(x, 0) + 1
    most = max(m.MOST_LEAST, -(-len({t for _, t in rows}) * m.MOST_SHARE // 1))
    band = {x for x, n in counts.items() if 2 <= n <= most}
    order = sorted(set(rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest(r[1], 42))))
    text = lambda s: "".join("-" * 8 if x is None else f"{x:08x}" for x in s)
    out = []
    onward = dict(zip(order, order[1:] + order[:1]))
    for i, t in rows:
        _, u = onward[i, t]
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        a, b, c = (plain_signature(x, band) for x in (t, edited, u))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), round(near(a, b), 9), round(near(a, c), 9)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in frame.collect()), key=str)


def test_matches_brute_force_on_given_documents(spark):
    frame = entry.queries()["op8_imatch"](spark, SF)
    assert frame.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = got(frame)
    assert rows == plain(table)
    assert sum(r[5] for r in rows) > 2 * sum(r[6] for r in rows)


def test_odd_rows(spark):
    rows = [*odd_rows(), (15, prose(9, 30), "a"), (15, prose(10, 31), "a")]
    assert got(m.edited(docs(spark, rows))) == plain([(i, t) for i, t, _ in rows])
    assert m.edited(docs(spark, [])).collect() == []
    assert got(m.edited(docs(spark, [(5, "alone here", "a")]))) == plain([(5, "alone here")])


def test_equal_texts_have_equal_fingerprints(spark):
    found = {}
    for r, (_, t, _) in zip(m.fingerprints(docs(spark, odd_rows())).collect(), odd_rows()):
        assert found.setdefault(t or "", r.fingerprint) == r.fingerprint


def test_texts_without_terms_of_the_band(spark):
    """Texts of words that no other one has are like themselves alone, and like texts of the same words."""
    words = [f"only{n}x" for n in range(60)]
    rows = [(n, " ".join(words[n * 10 : n * 10 + 10]), "a") for n in range(5)] + [(5, "", "a"), (6, None, "a"), (7, "?!", "a")]
    found = m.edited(docs(spark, rows)).collect()
    assert got(m.edited(docs(spark, rows))) == plain([(i, t) for i, t, _ in rows])
    near = {r.doc_id: r.near_next for r in found}
    assert [near[n] for n in range(1, 5)] == [0.0] * 4 and near[7] == near[6] == 1.0
    assert len({r.fingerprint for r in found if r.doc_id < 5}) == 5


def test_copies_count_once_and_single_terms_stay_out(spark):
    """A group of copies keeps its terms in the band; a word of one text only changes no fingerprint."""
    texts = [" ".join(f"w{m % 30}x{k}" for m in (n, n + 1) for k in range(30)) for n in range(30)]  # each word in two of thirty
    rows = [(n, t, "a") for n, t in enumerate(texts)] + [(100 + n, texts[3], "a") for n in range(40)]
    rows += [(200, texts[5] + " onlyhere7", "a"), (201, texts[5].replace(" ", "  ", 3), "a")]
    assert got(m.edited(docs(spark, rows))) == plain([(i, t) for i, t, _ in rows])
    found = {r.doc_id: r.fingerprint for r in m.fingerprints(docs(spark, rows)).collect()}
    assert found == {r.doc_id: r.fingerprint for r in m.edited(docs(spark, rows)).collect()}
    assert found[3] == found[100] and "-" * 8 * 28 != found[3] and found[200] == found[201] == found[5]


def test_words_made_by_the_edit(spark):
    """A word over the seam or at the end that other texts hold is a term; one that no two texts hold is none."""
    rows = [(3, "alpha beta abxx", "a"), (2, "cd gamma deltoid", "a"), (1, "xabcd abcd gam", "a"), (0, "abcd gam xyab zz", "a"), (9, "ΑΣ ΣΑΣ ΟΔΟΣ x", "a"), (8, "Σ ος", "a"), (7, "w" * 70_000, "a"), (6, "w" * 70_001, "a")]
    assert got(m.edited(docs(spark, rows))) == plain([(i, t) for i, t, _ in rows])
